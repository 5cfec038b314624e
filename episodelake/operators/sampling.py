"""Deterministic sampling and sharding: orders come from md5, so they are the same in every run and engine."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rounds of a permutation, the prime they calculate with, and how often a number may go round in a long one, where once is rare.
ROUNDS, PRIME, WALKS = 6, (1 << 31) - 1, 64


def hash_order(*cols: Column) -> Column:
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def linspace_indices(lengths: DataFrame, keys: list[str], length: str, low: int = 100, high: int = 10_000, power: float = 0.75) -> DataFrame:
    """(keys, index): clamp(length^power, low, high) evenly spaced rows of each series, at most its length, halves to even."""
    n = F.least(F.col(length), F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.pow(F.col(length), F.lit(power))))))
    rows = lengths.select(*keys, length, n.cast("int").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.when(F.col("n") == 1, 0.0).otherwise(F.col("i") * (F.col(length) - 1) / (F.col("n") - 1))
    return rows.select(*keys, F.bround(at).cast("long").alias("index"))


def distinct_draws(n: Column, k: int, draw: Callable[[Column], Column]) -> Column:
    """k distinct numbers of [0, n), all of them if n is smaller, as an array; the interval is not listed (Floyd's method).

    ``draw`` gives a random number, 0 or more, for each j. Every set of k numbers is as likely as another.
    """
    first = F.greatest(n - k, F.lit(0)).cast("long")

    def add(chosen: Column, j: Column) -> Column:
        t = draw(j) % (j + 1)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, t), j).otherwise(t)))

    return F.when(n > 0, F.aggregate(F.sequence(first, n.cast("long") - 1), F.array().cast("array<long>"), add)).otherwise(F.array().cast("array<long>"))


def hash_number(*cols: Column) -> Column:
    """A number of 32 bits from the md5 of the columns."""
    return F.conv(F.substring(hash_order(*cols), 1, 8), 16, 10).cast("long")


def episode_windows(episodes: DataFrame, width: int, low: float, high: float, k: int, most: int, seed: int) -> DataFrame:
    """(episode_index, start): k random window starts of each episode, and of all the first ``most`` in a random order of episodes.

    Of an episode's valid starts 0 .. v, v = length - width, those from
    floor(low * v) to floor(high * v) are candidates, one at least; episodes
    shorter than a window have none. Starts are drawn without listing them; the
    cut is a top-k by hash, which keeps ``most`` rows of each task.
    """
    last = F.col("length") - width
    first = F.floor(F.lit(low) * last)
    end = F.greatest(first, F.least(F.floor(F.lit(high) * last), last))
    drawn = distinct_draws(end - first + 1, k, lambda j: hash_number(F.lit(seed), F.col("episode_index"), j))
    starts = episodes.where(last >= 0).select("episode_index", first.alias("__first"), F.posexplode(drawn).alias("__r", "__d"))
    chosen = starts.select("episode_index", "__r", (F.col("__first") + F.col("__d")).alias("start"))
    return chosen.orderBy(hash_order(F.lit(seed), F.col("episode_index")), "episode_index", "__r").limit(most).select("episode_index", "start")


def sequential(df: DataFrame, index: str, start: int, stride: int, most: int) -> DataFrame:
    """Rows start, start + stride, … up to ``most`` of them, by their index alone."""
    at = F.col(index)
    return df.where((at >= start) & ((at - start) % stride == 0) & (at < start + stride * most))


def round_keys(seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for each round."""
    digests = [hashlib.md5(f"{seed}:{epoch}:{r}".encode()).digest() for r in range(ROUNDS)]
    return [tuple(int.from_bytes(d[4 * i : 4 * i + 4], "little") % PRIME for i in range(3)) for d in digests]


def _side(n: int) -> int:
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def _mixed(half: Column, key: Column) -> Column:
    """A number below PRIME from one half and a round's key."""
    x = (half + key["a"]) % PRIME
    return ((x * x % PRIME) * x % PRIME + key["b"]) % PRIME * key["c"] % PRIME


def _permuted(x: Column, n: int, keys: list[tuple[int, int, int]], back: bool) -> Column:
    """One pass of all rounds over the square of numbers next to n."""
    m = _side(n)
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(name) for v, name in zip(k, "abc", strict=True)]) for k in (keys[::-1] if back else keys)])
    if back:
        step = lambda s, k: F.struct(F.pmod(s["r"] - _mixed(s["l"], k), F.lit(m)).alias("l"), s["l"].alias("r"))
    else:
        step = lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + _mixed(s["r"], k)) % m).alias("r"))
    start = F.struct(F.floor(x / m).cast("long").alias("l"), F.pmod(x, F.lit(m)).cast("long").alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * m + s["r"])


def permuted(x: Column, n: int, seed: int, epoch: int, back: bool = False) -> Column:
    """The place of x in a pseudo-random permutation of [0, n), or with ``back`` the x of a place, from x alone.

    Feistel rounds permute the square of numbers next to n, which has at most
    2 sqrt(n) + 1 more; what falls outside goes round again until it is inside
    (cycle walking), so this is a permutation of [0, n) for every n up to 2**62
    and its inverse. No row is moved or sorted. Numbers outside [0, n) are null.
    """
    m, keys = _side(n), round_keys(seed, epoch)
    once = F.transform(F.array(x.cast("long")), lambda v: _permuted(v, n, keys, back))[0]
    walks = F.sequence(F.lit(1), F.lit(min(2 * m + 1, WALKS)))
    walked = F.aggregate(walks, once, lambda v, _: F.when(v >= n, _permuted(v, n, keys, back)).otherwise(v))
    inside = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the permutation did not come back")).cast("long"))
    first = F.transform(F.array(once), lambda v: F.when(v < n, v))[0]
    return F.when((x >= 0) & (x < n), F.coalesce(first, inside))


def epoch_positions(df: DataFrame, index: str, seed: int, epoch: int, n: int | None = None) -> DataFrame:
    """Adds position: the place of the row in the epoch's permutation, rows being counted 0 .. n - 1 by ``index``; nothing is shuffled.

    ``n`` is counted where it is not given.
    """
    n = df.count() if n is None else n
    return df.withColumn("position", permuted(F.col(index), n, seed, epoch))


def epoch_samples(spark: SparkSession, n: int, seed: int, epoch: int, rank: int = 0, world: int = 1, done: int = 0) -> DataFrame:
    """(position, index): what a rank reads in an epoch from a number of finished samples on, by the inverse permutation.

    The rank's positions are made where they are used, so a reader of a few
    samples does work for those alone.
    """
    first = rank + world * max(0, -(-(done - rank) // world))
    return spark.range(first, n, world).select(F.col("id").alias("position"), permuted(F.col("id"), n, seed, epoch, back=True).alias("index"))


def resume(df: DataFrame, done: int) -> DataFrame:
    """The positions of an epoch that are left after ``done`` samples."""
    return df.where(F.col("position") >= done)


def rank_shard(df: DataFrame, position: str, rank: int, world: int) -> DataFrame:
    return df.where(F.pmod(F.col(position), F.lit(world)) == rank)


def replace_padded(df: DataFrame, index: str, padded: str, n: Column, seed: int, tries: int = 3) -> DataFrame:
    """Adds chosen: the row itself, or for a padded one the first of ``tries`` random other rows that is not padded, else the last try.

    Rows are counted 0..n-1 by ``index``; the candidates are one equi-join.
    """
    draw = hash_number(F.lit(seed), F.col(index), F.col("attempt"))
    asked = df.where(F.col(padded)).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(tries)))).withColumn("cand", F.pmod(draw, n))
    flags = df.select(F.col(index).alias("cand"), F.col(padded).alias("cand_padded"))
    best = asked.join(flags, "cand").groupBy(index).agg(F.min_by("cand", F.when(~F.col("cand_padded"), F.col("attempt")).otherwise(F.lit(2 * tries) - F.col("attempt"))).alias("c"))
    return df.join(best, index, "left").withColumn("chosen", F.coalesce("c", index)).drop("c")


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group, with short marking groups that have fewer."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"r": F.row_number().over(w.orderBy(*order)), "short": F.count(F.lit(1)).over(w) < k}).where(F.col("r") <= k)


def first_frames(df: DataFrame, chosen: DataFrame) -> DataFrame:
    return df.where("frame_index = 0").join(chosen, "episode_index", "left_semi")


def natural_order(name: Column) -> tuple[Column, Column]:
    """(text before the trailing number, the number): task_2 comes before task_10."""
    return F.regexp_extract(name, r"^(.*?)(\d*)$", 1), F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("long"), F.lit(-1).cast("long"))
