"""Normalisation statistics of vector columns: per episode, per step, per dataset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodelake.operators.windows import forward_replicate
from episodelake.paths import scratch

#: Size of a quantile sketch, some 40 KB at most; values that one row may gather.
SKETCH_K, GATHERED = 2048, 1 << 20


def long_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One row per number of a vector column: keys, dim, x."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x"))


def feature_stats(long: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """min, max, mean, population std and count."""
    return long.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("count")
    )


def merge_stats(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of the union: means weighted by count, variance from the parts' variances and the shift of their means.

    Every part is weighed against the merged mean, so large means cost no precision.
    """
    means = parts.groupBy(*keys).agg(F.min("min").alias("lo"), F.max("max").alias("hi"), F.sum("count").alias("n"), (F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("m"))
    shift = F.col("mean") - F.col("m")
    square = parts.join(means, keys).groupBy(*keys, "lo", "hi", "n", "m").agg((F.sum((F.col("std") * F.col("std") + shift * shift) * F.col("count")) / F.col("n")).alias("var"))
    return square.select(*keys, F.col("lo").alias("min"), F.col("hi").alias("max"), F.col("m").alias("mean"), F.sqrt("var").alias("std"), F.col("n").alias("count"))


def _sample_var(value: str) -> Column:
    """Sample variance; one value alone gives NaN, which later means carry on."""
    return F.coalesce(F.var_samp(value), F.when(F.count(value) > 0, F.lit(float("nan"))))


def episode_stats(long: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """min, max, mean, sample variance, q01 and q99."""
    q = F.percentile(value, F.array(F.lit(0.01), F.lit(0.99)))
    out = long.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), _sample_var(value).alias("var"), q.alias("q"))
    return out.withColumns({"q01": F.col("q")[0], "q99": F.col("q")[1]}).drop("q")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """(keys, q array<double>): linearly interpolated quantiles of large groups, as ``percentile`` gives them.

    Equal values are counted first; ranks come from range-partitioned blocks
    and their totals, so no task holds all values of a group. Nulls are left out.
    """
    order = [*keys, "__v"]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    path = scratch(df.sparkSession, "ranks")
    counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__b", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.schema(T.StructType([*counts.schema.fields, T.StructField("__b", T.IntegerType())])).parquet(path)
    totals = rows.groupBy(*keys, "__b").agg(F.sum("__c").alias("__n"))
    group = Window.partitionBy(*keys)  # a row for each block of a group
    upto = F.sum("__n").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    totals = totals.select(*keys, "__b", (upto - F.col("__n")).alias("__before"), F.sum("__n").over(group).alias("__all"))
    inside = F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn("__in", inside).join(totals, [*keys, "__b"]).withColumn("__end", F.col("__before") + F.col("__in"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("__end")) & (rank >= F.col("__end") - F.col("__c")), F.col("__v")))

    place = [F.lit(q) * (F.col("__all") - 1) for q in qs]
    ends = [(at(F.floor(p)), at(F.ceil(p)), F.max(p - F.floor(p))) for p in place]
    return ranked.groupBy(*keys).agg(F.array(*[lo + (hi - lo) * share for lo, hi, share in ends]).alias("q"))


def sketched_stats(long: DataFrame, keys: list[str], value: str = "x", k: int = SKETCH_K) -> DataFrame:
    """min, max, mean, population std, count and a quantile sketch of each group, in one pass.

    Sketches of parts merge (``merged_quantiles``), so an episode's may be
    stored with its statistics and no value is read again for a dataset's.
    """
    return long.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("count"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"),
    )


def merged_quantiles(parts: DataFrame, keys: list[str], qs: list[float], k: int = SKETCH_K) -> DataFrame:
    """(keys, q array<double>): quantiles of the union of sketched parts, off by a rank of ``sketch_error(k)`` of the values (99 % of the time)."""
    merged = parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("__s"))
    return merged.select(*keys, F.array(*[F.kll_sketch_get_quantile_double("__s", F.lit(float(q))) for q in qs]).alias("q"))


def sketch_error(k: int = SKETCH_K) -> float:
    """The rank error of a sketch as a part of all values: published bound for a single quantile."""
    return 2.296 / k**0.9021


def global_quantiles(df: DataFrame, value: str, qs: list[float], others: list[Column]) -> tuple[list[float], Row]:
    """(exact quantiles of a column, linearly interpolated; a row of other aggregates of the same pass).

    A sketch brackets each quantile; a second pass counts what lies below a
    bracket and gathers what lies in it, a few thousandths of the values. Where
    that is more than GATHERED values, or a bracket misses, ranks come from
    range-partitioned blocks as in ``exact_quantiles``.
    """
    x = F.col(value).cast("double")
    first = df.agg(F.count(x).alias("__n"), F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias("__s"), F.min(x).alias("__min"), F.max(x).alias("__max"), *others)
    room = 3 * sketch_error()
    ends = [F.kll_sketch_get_quantile_double("__s", F.lit(float(min(1.0, max(0.0, q + d))))) for q in qs for d in (-room, room)]
    row = first.withColumn("__ends", F.when(F.col("__n") > 0, F.array(*ends))).drop("__s").first()
    n = row["__n"]
    if n == 0:
        return [None] * len(qs), row
    if 2 * room * n <= GATHERED:
        low = [row["__min"] if q - room <= 0 else e for q, e in zip(qs, row["__ends"][::2], strict=True)]
        high = [row["__max"] if q + room >= 1 else e for q, e in zip(qs, row["__ends"][1::2], strict=True)]
        gathered = [(F.count_if(x < F.lit(a)), F.array_sort(F.collect_list(F.when((x >= F.lit(a)) & (x <= F.lit(b)), x)))) for a, b in zip(low, high, strict=True)]
        got = df.agg(*[c.alias(f"{kind}{i}") for i, pair in enumerate(gathered) for kind, c in zip("bv", pair, strict=True)]).first()
        out = []
        for i, q in enumerate(qs):
            at, values = q * (n - 1) - got[f"b{i}"], got[f"v{i}"]
            if not 0 <= at <= len(values) - 1:
                break
            a, b = values[math.floor(at)], values[math.ceil(at)]
            out.append(a + (b - a) * (at - math.floor(at)))
        if len(out) == len(qs):
            return out, row
    return exact_quantiles(df, [], value, qs).first()["q"], row


def stepwise_stats(df: DataFrame, vector: str, width: int, episode: str, order: str) -> DataFrame:
    """Per episode, window step and dimension over clamp-padded windows, by building the windows."""
    w = forward_replicate(df, vector, width, [episode], order)
    steps = w.select(episode, F.posexplode("window").alias("step", "v"))
    return episode_stats(steps.select(episode, "step", F.posexplode("v").alias("dim", "x")), [episode, "step", "dim"])


def stepwise_closed_form(df: DataFrame, vector: str, width: int, episode: str, order: str) -> DataFrame:
    """min, max, mean and sample variance of ``stepwise_stats`` without building windows.

    Step j of the windows holds rows j.. of the episode and j copies of its
    last row, so suffix sums, minima and maxima of each row give every step.
    """
    long = df.select(episode, order, F.posexplode(vector).alias("dim", "x"))
    series = Window.partitionBy(episode, "dim")
    suffix = series.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    n, last = F.count(F.lit(1)).over(series), F.max_by("x", order).over(series)
    # sums are of distances from the episode's mean, which keeps their squares small
    mean = F.avg("x").over(series)
    rows = long.withColumns({"n": n, "last": last, "shift": mean}).withColumn("y", F.col("x") - F.col("shift"))
    rows = rows.withColumns({"s": F.sum("y").over(suffix), "ss": F.sum(F.col("y") * F.col("y")).over(suffix), "lo": F.min("x").over(suffix), "hi": F.max("x").over(suffix)})
    held = rows.where(F.col(order) < F.least(F.lit(width), F.col("n")))
    # steps past the end of the episode hold its last row only
    beyond = held.where(F.col(order) == 0).withColumn("step", F.explode(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i >= F.col("n"))).alias("step"))
    end = F.col("last") - F.col("shift")
    past = beyond.withColumns({"s": F.lit(0.0), "ss": F.lit(0.0), "lo": F.col("last"), "hi": F.col("last"), "step": F.col("step").cast("long")})
    steps = held.withColumn("step", F.col(order).cast("long")).unionByName(past)
    copies = F.least(F.col("step"), F.col("n"))
    total, squares = F.col("s") + copies * end, F.col("ss") + copies * end * end
    var = F.greatest(F.lit(0.0), F.try_divide(squares - total * total / F.col("n"), F.col("n") - 1))
    return steps.select(
        episode, "step", "dim", F.least("lo", "last").alias("min"), F.greatest("hi", "last").alias("max"), (F.col("shift") + total / F.col("n")).alias("mean"), F.when(F.col("n") > 1, var).otherwise(F.lit(float("nan"))).alias("var")
    )


def stepwise_arrays(df: DataFrame, vector: str, width: int, episode: str, order: str) -> DataFrame:
    """``stepwise_stats`` from one array of an episode's values for each dimension: no window is built as rows, and one shuffle moves each value once.

    An episode's values of a dimension are one row; episodes are bounded.
    """
    series = df.select(episode, order, F.posexplode(vector).alias("dim", "x")).where("x is not null")
    held = series.groupBy(episode, "dim").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "x"))), lambda s: s["x"].cast("double")).alias("v"))
    n = F.size("v")
    held = held.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    copies = F.least("step", n)
    window = F.concat(F.slice("v", copies + 1, n), F.array_repeat(F.element_at("v", -1), copies))
    rows = held.select(episode, "step", "dim", F.sort_array(window).alias("w"))
    m = F.size("w")
    mean = F.aggregate("w", F.lit(0.0), lambda s, x: s + x) / m
    rows = rows.withColumn("mean", mean)
    squares = F.aggregate("w", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))

    def quantile(q: float) -> Column:
        at = F.lit(q) * (m - 1)
        low, high = F.get("w", F.floor(at).cast("int")), F.get("w", F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    var = F.when(m > 1, squares / F.greatest(m - 1, F.lit(1))).otherwise(F.lit(float("nan")))
    return rows.select(episode, "step", "dim", F.get("w", F.lit(0)).alias("min"), F.element_at("w", -1).alias("max"), "mean", var.alias("var"), quantile(0.01).alias("q01"), quantile(0.99).alias("q99"))


def combined() -> list[Column]:
    """Aggregates of episodes' statistics; the mean of (var + shift^2) is the mean of the variances plus the variance of the means."""
    std = F.sqrt(F.avg("var") + F.var_pop("mean"))
    return [F.min("min").alias("min"), F.max("max").alias("max"), F.avg("mean").alias("mean"), std.alias("std"), F.min("q01").alias("q01"), F.max("q99").alias("q99")]


def combine_episodes(parts: DataFrame, keys: list[str], skip_short: bool = False) -> DataFrame:
    """Episodes as one dataset: least min, largest max, plain mean of the episodes' means, std from variances and shifts.

    q01 and q99 are envelopes (the least q01, the largest q99). Episodes of one
    row carry NaN into mean std unless ``skip_short``.
    """
    if skip_short:
        parts = parts.where(~F.isnan("var"))
    return parts.groupBy(*keys).agg(*combined())


def norm_stats(frames: DataFrame, vector: str, width: int, episode: str, order: str) -> DataFrame:
    """Dataset statistics, long: scope ('stepwise' with its step, or 'global' with null), dim, stat, value."""
    per_step = stepwise_arrays(frames, vector, width, episode, order)
    # both scopes in one pass over the episodes' rows
    wide = per_step.groupingSets([["step", "dim"], ["dim"]], "step", "dim").agg(*combined(), F.when(F.grouping("step") == 1, "global").otherwise("stepwise").alias("scope"))
    names = ["min", "max", "mean", "std", "q01", "q99"]
    return wide.select("scope", "step", "dim", F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in names])).alias("s")).select("scope", "step", "dim", "s.stat", "s.value")


def quantile_envelope(parts: DataFrame, keys: list[str], skip_quantile: bool = False) -> DataFrame:
    """q01 and q99 of a dataset: the least and largest of its episodes'; with ``skip_quantile`` their least min and largest max."""
    low, high = ("min", "max") if skip_quantile else ("q01", "q99")
    return parts.groupBy(*keys).agg(F.min(low).alias("q01"), F.max(high).alias("q99"))


def dataset_totals(frames: DataFrame, keys: list[str], chunk_size: int, cameras: int) -> DataFrame:
    """Per dataset (keys): episodes, frames, chunks, videos and the split string."""
    t = frames.groupBy(*keys).agg(F.countDistinct("episode_index").alias("episodes"), F.count(F.lit(1)).alias("frames"))
    return t.select(
        *keys, "episodes", "frames", F.ceil(F.col("episodes") / chunk_size).alias("chunks"), (F.col("episodes") * cameras).alias("videos"), F.concat(F.lit("0:"), F.col("episodes").cast("string")).alias("split")
    )
