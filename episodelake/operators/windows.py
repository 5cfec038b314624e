"""Windows over the frames of an episode; every window is partitioned by the episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodelake.paths import scratch


def _episode(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def forward_replicate(df: DataFrame, value: str, width: int, keys: list[str], order: str) -> DataFrame:
    """Adds window (the next ``width`` values, the last one repeated past the end) and is_pad (which steps lie past the end)."""
    ahead = F.collect_list(F.struct(F.col(value).alias("v"))).over(_episode(keys, order).rowsBetween(0, width - 1))
    with_list = df.withColumn("__w", ahead)
    missing = F.lit(width) - F.size("__w")
    window = F.transform(F.concat("__w", F.array_repeat(F.element_at("__w", -1), missing)), lambda s: s["v"])
    pad = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i >= F.size("__w"))
    return with_list.withColumns({"window": window, "is_pad": pad}).drop("__w")


def delta_clamped(df: DataFrame, value: str, deltas: list[int], keys: list[str], order: str, length: str) -> DataFrame:
    """(…, step, x, is_pad) for each delta: the value at the place clamped to the episode, and whether it lay outside.

    ``order`` counts 0.. without gaps in each episode. One pass over a frame
    of rows from the least to the largest delta; no self join.
    """
    low, high = min(0, *deltas), max(0, *deltas)
    around = F.collect_list(value).over(_episode(keys, order).rowsBetween(low, high))
    at = F.col(order)
    first = F.greatest(F.lit(0), at + low)  # place of the first collected row
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(d).cast("long").alias("delta")) for i, d in enumerate(deltas)])
    rows = df.withColumn("__w", around).withColumn("__d", F.explode(steps))
    target = at + F.col("__d.delta")
    clamped = F.least(F.greatest(target, F.lit(0)), F.col(length) - 1)
    x = F.get("__w", (clamped - first).cast("int"))
    return rows.select(*df.columns, F.col("__d.step").alias("step"), x.alias("x"), ((target < 0) | (target >= F.col(length))).alias("is_pad"))


def delta_plan(seconds: Column, fps: Column, stride: int = 1) -> Column:
    """Seconds as frame offsets, halves to even."""
    return (F.bround(seconds * fps) * stride).cast("long")


def strided(window: Column, every: int) -> Column:
    """Every ``every``-th element of a window."""
    return F.filter(window, lambda x, i: i % every == 0)


def episode_offsets(episodes: DataFrame, length: str = "length", order: str = "episode_index", block: int = 4096) -> DataFrame:
    """Adds from_index and to_index, running sums of lengths over the table of episodes.

    Sums go by blocks of ids, so only the blocks' totals are summed in one task.
    """
    at = F.floor(F.col(order) / block)
    totals = episodes.groupBy(at.alias("__b")).agg(F.sum(length).alias("__n"))
    before = totals.select("__b", (F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    inside = F.sum(length).over(Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = episodes.withColumn("__b", at).withColumn("__in", inside).join(before, "__b")
    return out.withColumn("to_index", F.col("__before") + F.col("__in")).withColumn("from_index", F.col("to_index") - F.col(length)).drop("__b", "__in", "__before")


def index_runs(rows: DataFrame, file: str = "file", row: str = "row", index: str = "index", section: str | None = None) -> DataFrame:
    """Runs of stored rows whose index grows by one from row to row of a file: file, start, end (exclusive), physical_start.

    ``rows`` has the rows that count, in the order of ``row`` inside files that
    follow each other by name; physical rows are counted from 0 over all of
    them. A run begins where the index breaks, whatever order the file is in.
    Where a file holds several small ones in turn, ``section`` names the column
    that tells them apart: runs end with their section and are given with it.
    Windows are over one file each, and one over a row for each file.
    """
    inside = Window.partitionBy(file).orderBy(row)
    parts = [section] * (section is not None)
    breaks = F.coalesce(F.col(index) - F.lag(index).over(inside), F.lit(0)) != 1
    for c in parts:
        breaks |= ~F.col(c).eqNullSafe(F.lag(c).over(inside))
    placed = rows.select(file, *parts, index, (F.row_number().over(inside) - 1).alias("__row"), breaks.cast("int").alias("__breaks"))
    numbered = placed.withColumn("__run", F.sum("__breaks").over(Window.partitionBy(file).orderBy("__row")))
    found = numbered.groupBy(file, *parts, "__run").agg(F.min("__row").alias("__first"), F.min(index).alias("start"), (F.max(index) + 1).alias("end"))
    sizes = rows.groupBy(file).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(file, (F.sum("__n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    return found.join(before, file).select(file, *parts, "start", "end", (F.col("__before") + F.col("__first")).cast("long").alias("physical_start"))


def places(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds place: 0.. in the order of the columns, with no task that has all rows.

    Rows are range-partitioned, sorted and written with the number of their
    block; only the blocks' row counts are summed in one task.
    """
    path = scratch(df.sparkSession, "ordered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__block", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("__block", T.IntegerType())])).parquet(path)
    counts = rows.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")  # one row per block
    inside = F.row_number().over(Window.partitionBy("__block").orderBy(*order)) - 1
    return rows.withColumn("__in", inside).join(F.broadcast(counts.select("__block", before.alias("__before"))), "__block").withColumn("place", (F.col("__before") + F.col("__in")).cast("long")).drop("__block", "__in", "__before")


def overlapping(runs_: DataFrame) -> DataFrame:
    """Whether each run overlaps the next one by start."""
    placed = places(runs_, ["start", "end"])
    nxt = placed.select((F.col("place") - 1).alias("place"), F.col("start").alias("__next"))
    return placed.join(nxt, "place", "left").withColumn("overlaps_next", F.coalesce(F.col("__next") < F.col("end"), F.lit(False))).drop("place", "__next")


def number_frames(df: DataFrame, keys: list[str], order: list[str], fps: float, offsets: DataFrame) -> DataFrame:
    """frame_index, timestamp = frame_index / fps and the global index from the episodes' offsets (keys, from_index)."""
    n = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    return df.withColumn("frame_index", n).join(offsets.select(*keys, "from_index"), keys).withColumn("timestamp", F.col("frame_index") / fps).withColumn("index", F.col("from_index") + F.col("frame_index"))


def moving_average(df: DataFrame, value: str, width: int, keys: list[str], order: str) -> DataFrame:
    """Adds avg: the mean of the last ``width`` values; the first ones take the first full mean, short series stay raw."""
    if width <= 1:
        return df.withColumn("avg", F.col(value))
    series = Window.partitionBy(*keys)
    n, total = F.row_number().over(series.orderBy(order)), F.count(F.lit(1)).over(series)
    mean = F.avg(value).over(series.orderBy(order).rowsBetween(-(width - 1), 0))
    out = df.withColumns({"__n": n, "__t": total, "__m": mean})
    full = F.first(F.when(F.col("__n") == width, F.col("__m")), ignorenulls=True).over(series)
    out = out.withColumn("__f", full)
    return out.withColumn("avg", F.when(F.col("__t") < width, F.col(value)).when(F.col("__n") < width, F.col("__f")).otherwise(F.col("__m"))).drop("__n", "__t", "__m", "__f")


def integrate(df: DataFrame, velocity: str, dt: float, start: Column, keys: list[str], order: str) -> DataFrame:
    """Adds position: start plus the running sum of velocity times dt."""
    return df.withColumn("position", start + F.sum(velocity).over(_episode(keys, order).rowsBetween(Window.unboundedPreceding, 0)) * dt)


def blend_start(step: Column, state: Column, action: Column, steps: int) -> Column:
    """The first steps move from the state to the action along p^2 (3 - 2p), p = step / steps."""
    p = step / F.lit(float(steps))
    w = p * p * (3 - 2 * p)
    return F.when(step < steps, state * (1 - w) + action * w).otherwise(action)


def last_n(df: DataFrame, value: str, n: int, keys: list[str], order: str) -> DataFrame:
    """Adds history: the last ``n`` values, filled up on the left with the first one."""
    past = F.collect_list(value).over(_episode(keys, order).rowsBetween(-(n - 1), 0))
    out = df.withColumn("__w", past)
    return out.withColumn("history", F.concat(F.array_repeat(F.element_at("__w", 1), F.lit(n) - F.size("__w")), "__w")).drop("__w")
