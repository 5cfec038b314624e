"""Sketches, quantiles of all values and step statistics against plain forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodelake.functions import scalars
from episodelake.operators import stats as S


@pytest.mark.parametrize("kind", ["normal", "ties", "sorted", "heavy"])
def test_merged_sketches_keep_their_rank_error(spark, kind):
    """Sketches of 40 episodes of very different lengths, merged, against the ranks of all values."""
    rng = np.random.default_rng(3)
    n = 60_000
    x = {"normal": rng.normal(size=n), "ties": rng.integers(0, 30, n).astype(float), "sorted": np.arange(n) * 1.0, "heavy": rng.pareto(0.5, n)}[kind]
    episode = np.minimum(39, (rng.pareto(0.7, n) * 2).astype(int))
    df = spark.createDataFrame(list(zip(episode.tolist(), x.tolist(), strict=True)), "episode int, x double").repartition(6)
    parts = S.sketched_stats(df, ["episode"])
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = S.merged_quantiles(parts, [], qs).first().q
    for q, v in zip(qs, got, strict=True):
        low, high = (x < v).mean(), (x <= v).mean()
        assert low - 2 * S.sketch_error() <= q <= high + 2 * S.sketch_error(), (q, v)
    merged = parts.agg(F.sum("count").alias("n"), F.min("min").alias("lo")).first()
    assert merged.n == n and merged.lo == x.min()
    assert max(len(r.sketch) for r in parts.collect()) < 80_000


def test_quantiles_of_all_values_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    qs = [0.0, 0.01, 0.5, 0.99, 1.0]
    for x in (rng.normal(size=50_000), rng.integers(0, 5, 20_000).astype(float), np.array([3.0]), np.arange(7.0)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
        got, row = S.global_quantiles(df, "x", qs, [F.max("x").alias("most")])
        assert got == pytest.approx(np.quantile(x, qs).tolist()) and row["most"] == x.max()
    monkeypatch.setattr(S, "GATHERED", 3)  # ranks come from blocks then
    got, _ = S.global_quantiles(df, "x", qs, [])
    assert got == pytest.approx(np.quantile(x, qs).tolist())
    assert S.global_quantiles(df.limit(0), "x", [0.5], [])[0] == [None]


def test_step_statistics_from_arrays(spark):
    rng = np.random.default_rng(6)
    rows = [(e, i, [float(v) for v in rng.normal(size=3)]) for e, n in enumerate([1, 2, 5, 8, 30]) for i in range(n)]
    df = spark.createDataFrame(rows, "e long, i long, v array<double>").repartition(3)
    key = lambda r: (r.e, r.step, r.dim)
    direct = {key(r): r for r in S.stepwise_stats(df, "v", 8, "e", "i").collect()}
    arrays = {key(r): r for r in S.stepwise_arrays(df, "v", 8, "e", "i").collect()}
    assert direct.keys() == arrays.keys() and len(direct) == 5 * 8 * 3
    for k, a in direct.items():
        for c in ("min", "max", "mean", "var", "q01", "q99"):
            assert arrays[k][c] == pytest.approx(a[c], nan_ok=True, abs=1e-12), (k, c)


def test_a_record_without_a_field_does_not_take_the_next_ones(spark):
    log = "epoch=1 step=2/9 loss=1.5 loss_action=0.5 loss_video=0.25\nepoch=1 step=3/9 loss=2.5 loss_action=1 x=7 loss_video=2\n lr=1e-4 my_step=4 val_step=5\nstep=3 val_loss=4 infer_psnr=20 infer_ssim=0.5 action_l2=1 action_l1=2 step=9 val_loss=nothing"
    r = spark.createDataFrame([(log,), (None,)], "t string").select(scalars.parse_records(F.col("t"), "train").alias("a"), scalars.parse_records(F.col("t"), "val").alias("b")).collect()
    assert [tuple(x) for x in r[0].a] == [(1, 3, 2.5, 1.0, 2.0, 1e-4)]
    assert [tuple(x) for x in r[0].b] == [(3, 4.0, 20.0, 0.5, 1.0, 2.0)]
    assert r[1].a is None and r[1].b is None
