"""Permutations, distinct draws and window starts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from episodelake.operators import sampling as P


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 1023, 1024, 1025, 20_011])
def test_permutation_and_its_inverse(spark, n):
    df = spark.range(n).select("id", P.permuted(F.col("id"), n, 3, 1).alias("p"))
    got = df.select("id", "p", P.permuted(F.col("p"), n, 3, 1, back=True).alias("b")).toPandas()
    assert sorted(got.p) == list(range(n)) and (got.b == got.id).all()


def test_permutation_of_very_many(spark):
    n = 10**15 + 7
    df = spark.createDataFrame([(0,), (1,), (n // 2,), (n - 1,), (n,), (-1,), (None,)], "x long")
    got = df.select("x", P.permuted(F.col("x"), n, 9, 0).alias("p")).select("x", "p", P.permuted(F.col("p"), n, 9, 0, back=True).alias("b")).collect()
    inside = [r for r in got if r.x is not None and 0 <= r.x < n]
    assert len(inside) == 4 and all(0 <= r.p < n and r.b == r.x for r in inside)
    assert all(r.p is None for r in got if r not in inside)


def test_permutations_are_uniform(spark):
    """Over many seeds a tenth of the numbers falls into each tenth of the places, and neighbours part."""
    n, seeds = 500, 60
    df = spark.range(n).select("id", *[P.permuted(F.col("id"), n, s, 0).alias(f"p{s}") for s in range(seeds)]).toPandas().sort_values("id")
    places = np.stack([df[f"p{s}"] for s in range(seeds)])
    seen = np.stack([np.bincount((places[:, 50 * i : 50 * i + 50] // 50).ravel(), minlength=10) for i in range(10)])
    want = 50 * seeds / 10
    assert ((seen - want) ** 2 / want).sum() < 1.5 * 81
    first = np.bincount(places[:, 0] // 50, minlength=10)
    assert ((first - seeds / 10) ** 2 / (seeds / 10)).sum() < 30
    steps = np.abs(np.diff(places, axis=1))
    assert abs(steps.mean() - n / 3) < 6 and (steps == 1).mean() < 0.01
    assert len({tuple(p) for p in places}) == seeds


def test_positions_are_made_without_an_exchange(spark):
    plan = P.resume(P.epoch_positions(spark.range(1000), "id", 1, 0, n=1000), 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    plan = P.epoch_samples(spark, 10**12, 1, 0, rank=5, world=8, done=10**12 - 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize(("rank", "done"), [(0, 0), (3, 0), (3, 40), (3, 43), (3, 44), (7, 999), (3, 5000)])
def test_ranks_resume(spark, rank, done):
    n, world = 1003, 8
    all_ = {r.position: r.id for r in P.epoch_positions(spark.range(n), "id", 4, 2, n=n).collect()}
    got = {r.position: r["index"] for r in P.epoch_samples(spark, n, 4, 2, rank, world, done).collect()}
    assert got == {p: i for p, i in all_.items() if p % world == rank and p >= done}


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_window_starts(spark):
    """By the fractions of the valid starts, one candidate at least, no start twice."""
    lengths = [(i, n) for i, n in enumerate([3, 32, 33, 34, 40, 100, 37, 5000, 10**12])]
    df = spark.createDataFrame(lengths, "episode_index long, length long")
    got = {}
    for r in P.episode_windows(df, 33, 0.25, 0.75, 4, 1000, 1).collect():
        got.setdefault(r.episode_index, []).append(r.start)
    for i, n in lengths:
        last = n - 33
        if last < 0:
            assert i not in got
            continue
        lo = math.floor(0.25 * last)
        hi = max(lo, min(math.floor(0.75 * last), last))
        assert len(got[i]) == len({*got[i]}) == min(4, hi - lo + 1) and all(lo <= s <= hi for s in got[i]), (i, n)
    assert got[4] and min(got[4]) >= 1 and max(got[4]) <= 5 and min(got[5]) >= 16
    few = P.episode_windows(df, 33, 0.25, 0.75, 4, 7, 1).collect()
    assert len(few) == 7 and all(r.start in got[r.episode_index] for r in few)
    whole = [r for r in lengths if r[0] in {x.episode_index for x in few}]
    order = sorted(got, key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))
    assert {x.episode_index for x in few} == {*order[: len(whole)]}


def test_distinct_draws_are_uniform(spark):
    df = spark.range(6000).select("id", P.distinct_draws(F.lit(6), 3, lambda j: P.hash_number(F.lit(5), F.col("id"), j)).alias("d")).toPandas()
    sets = {}
    for d in df.d:
        sets[tuple(sorted(d))] = sets.get(tuple(sorted(d)), 0) + 1
    assert len(sets) == 20 and all(len({*s}) == 3 for s in sets)
    assert sum((c - 300) ** 2 / 300 for c in sets.values()) < 45
    edge = spark.range(1).select(*[P.distinct_draws(F.lit(n), 3, lambda j: j).alias(f"n{n}") for n in (0, 1, 3)]).first()
    assert edge.n0 == [] and edge.n1 == [0] and sorted(edge.n3) == [0, 1, 2]


def test_a_walk_that_does_not_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(P, "WALKS", 0)
    monkeypatch.setattr(P, "_side", lambda n: 100)
    with pytest.raises(PySparkException, match="did not come back"):
        spark.range(5).select(P.permuted(F.col("id"), 5, 1, 0)).collect()
