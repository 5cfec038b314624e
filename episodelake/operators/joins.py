"""Joins: dictionaries, caches, ranges, nearest times, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodelake.operators.windows import overlapping
from episodelake.paths import kept

#: A side of up to so many rows is broadcast after it was counted.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def role_texts(df: DataFrame, roles: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Text columns of dictionary ids: {id column: (dictionary, its id column, new text column)}; a missing id gives null."""
    for column, (words, key, name) in roles.items():
        side = small(words.select(F.col(key).alias("__k"), F.col(words.columns[-1] if words.columns[-1] != key else words.columns[0]).alias(name)))
        df = df.join(side, F.col(column) == F.col("__k"), "left").drop("__k")
    return df


def cached(samples: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(samples with their cache entry, samples that miss)."""
    return samples.join(cache, keys), samples.join(cache.select(*keys), keys, "left_anti")


def with_context(samples: DataFrame, cache: DataFrame, key: str, length: int, strict: bool = True) -> DataFrame:
    """Samples with their prompt's context and mask from the cache (key, context, mask), both of ``length`` steps.

    A key that the cache lacks, a context or a mask of another length is an
    error that names the key; without ``strict`` it is told in ``problem``, and
    context and mask are null. A key counts once in the cache.
    """
    found = samples.join(cache.select(key, "context", "mask").withColumn("__there", F.lit(True)), key, "left")
    told = lambda what, c: F.concat(F.lit(f"{what} of "), F.coalesce(F.size(c).cast("string"), F.lit("no")), F.lit(f" steps, not {length}"))
    wrong = lambda c: F.coalesce(F.size(c), F.lit(-1)) != length
    problem = F.when(F.col("__there").isNull(), "not in the cache").when(wrong("context"), told("context", "context")).when(wrong("mask"), told("mask", "mask"))
    if strict:
        failed = F.raise_error(F.concat(F.col(key), F.lit(": "), problem)).cast("string")
        return found.withColumn("__problem", F.when(problem.isNotNull(), failed)).where("__problem is null").drop("__there", "__problem")
    marked = found.withColumn("problem", problem)
    return marked.withColumns({c: F.when(F.col("problem").isNull(), F.col(c)) for c in ("context", "mask")}).drop("__there")


def todo(prompts: DataFrame, caches: DataFrame, key: str, n_caches: int) -> DataFrame:
    """Prompts that are not in all of ``n_caches`` caches (key, cache)."""
    done = caches.groupBy(key).agg(F.countDistinct("cache").alias("n")).where(F.col("n") >= n_caches)
    return prompts.join(done.select(key), key, "left_anti")


def range_lookup(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, block: int | None = None, how: str = "inner") -> DataFrame:
    """Points with the range [start, end) that holds them, as an equi-join on blocks of the number line.

    A range is repeated for each block it touches, so both sides can be
    shuffled. By default a block is as long as the mean range, so the repeated
    ranges are at most three times the ranges, however long one of them is.
    Points in no range are lost, or with ``how="left"`` have nulls.
    """
    if block is None:
        mean = ranges.agg(F.avg((F.col(end) - F.col(start)).cast("double")).alias("m")).first()["m"]
        block = max(1, int(mean or 1))
    cut = lambda c: F.floor(c / block)
    wide = ranges.withColumn("__b", F.explode(F.sequence(cut(F.col(start)), cut(F.col(end) - 1))))
    p, r = points.withColumn("__p", cut(F.col(at))), small(wide)
    return p.join(r, (F.col("__p") == F.col("__b")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)), how).drop("__p", "__b")


def physical_rows(points: DataFrame, at: str, runs: DataFrame, strict: bool = True) -> DataFrame:
    """Adds row: the physical row that holds each point's logical index, by the sorted runs of ``index_runs``.

    Where runs overlap, an index may have two rows; then logical indices are not
    used at all, and a point is its own physical row. A point in no run fails,
    or without ``strict`` has no row. The runs are found once and kept.
    """
    runs = kept(runs.select("start", "end", "physical_start"), "runs")
    if runs.isEmpty() or not overlapping(runs).where("overlaps_next").isEmpty():
        return points.withColumn("row", F.col(at).cast("long"))
    ranges = runs.select(F.col("start").alias("__start"), F.col("end").alias("__end"), F.col("physical_start").alias("__physical"))
    found = range_lookup(points, at, ranges, "__start", "__end", how="left")
    row = F.col("__physical") + F.col(at) - F.col("__start")
    if strict:
        row = F.coalesce(row, F.raise_error(F.concat(F.lit("no stored row has index "), F.col(at).cast("string"))).cast("long"))
    return found.withColumn("row", row).drop("__start", "__end", "__physical")


def nearest_time(queries: DataFrame, frames: DataFrame, keys: list[str], at: str, ts: str, tolerance: float) -> DataFrame:
    """Each query with the frame time nearest to it, if strictly nearer than the tolerance; the earlier one of equals.

    Times are cut into blocks of one tolerance; a query asks its own block and
    the two beside it, so it is an equi-join and skew stays within a block. The
    queries' columns go along, so nothing is joined back. ``queries`` has a
    unique column qid.
    """
    block = lambda c: F.floor(F.col(c) / tolerance)
    asked = queries.withColumn("__b", F.explode(F.array(*[block(at) + d for d in (-1, 0, 1)])))
    held = frames.select(*keys, F.col(ts).alias("__ts"), block(ts).alias("__b"))
    found = asked.join(held, [*keys, "__b"], "left").withColumn("__d", F.abs(F.col("__ts") - F.col(at)))
    rest = [c for c in queries.columns if c != "qid"]
    near = F.min(F.when(F.col("__d") < tolerance, F.struct("__d", "__ts"))).alias("m")
    return found.groupBy("qid").agg(*[F.first(c).alias(c) for c in rest], near).select("qid", *rest, F.col("m.__ts").alias("nearest"), F.col("m.__d").alias("distance"))


def frame_of_time(ts: Column, fps: Column | float) -> Column:
    """Frame number of a time, halves to even."""
    return F.bround(ts * fps).cast("long")


def with_offsets(df: DataFrame, offsets: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Times in a video file: the episode's time plus the offset of its camera."""
    return df.join(offsets, keys).withColumn("video_time", F.col(ts) + F.col("from_timestamp"))


def matched(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    return pred.join(truth, keys)


def gain(model: DataFrame, baseline: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Adds baseline and gain = baseline - model."""
    side = baseline.select(*keys, F.col(metric).alias("baseline"))
    return model.join(side, keys).withColumn("gain", F.col("baseline") - F.col(metric))


def fresh_snapshot(df: DataFrame, group: list[str], camera: str, ts: str, now: DataFrame, max_age: float, n_cameras: int) -> DataFrame:
    """The latest row of each camera, for groups in which all cameras have one no older than ``max_age`` at ``now``."""
    latest = df.groupBy(*group, camera).agg(F.max(ts).alias("latest"), F.max_by("value", ts).alias("value"))
    fresh = latest.join(now, group).where(F.col("now") - F.col("latest") <= max_age)
    whole = fresh.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_cameras).select(*group)
    return fresh.join(whole, group, "left_semi")


def running_rate(df: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """Adds rate: successes so far in percent, one decimal, halves to even."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("rate", F.bround(100.0 * F.sum(F.col(flag).cast("int")).over(w) / F.count(F.lit(1)).over(w), 1))
