"""Structured Streaming jobs: dictionaries, ring buffers, snapshots, ensembles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodelake.operators.windows import places
from episodelake.paths import scratch


def run_to_end(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str | None = None, conf: dict[str, str] | None = None) -> None:
    """Runs over all that is there now; ``each`` takes every micro-batch. With a checkpoint it goes on where it ended; ``conf`` holds while it starts."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(availableNow=True).foreachBatch(each).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()


def latest(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """The result of a stream when it has caught up: of each key the row of the last batch that has it.

    Batches are written under their number, so a batch that is done twice replaces itself.
    """
    spark, out, kind = stream.sparkSession, scratch(stream.sparkSession, "sink"), stream.schema
    run_to_end(stream, mode, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    rows = spark.read.schema(kind.add("batch", "long")).parquet(out)
    if mode == "append":
        return rows.drop("batch")
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"], "left_semi").drop("batch")


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a file stream, 16 files a batch; a glob, since a stream does not take a single file."""
    kind = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/{name}*.parquet")


def task_dictionary(stream: DataFrame, text: str, order: str) -> DataFrame:
    """(task, task_index): new texts take the next ids in order of arrival, old ids stay.

    The dictionary is small; each batch adds its new texts as a file of its own.
    """
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "tasks")
    kind = "task string, task_index long, batch long"
    spark.createDataFrame([], "task string, task_index long").write.parquet(f"{out}/batch=-1")

    def add(df: DataFrame, n: int) -> None:
        s = df.sparkSession
        known = s.read.schema(kind).parquet(out).where(F.col("batch") < n)
        fresh = df.groupBy(F.col(text).alias("task")).agg(F.min(order).alias("o")).join(known, "task", "left_anti")
        start = known.agg(F.coalesce(F.max("task_index") + 1, F.lit(0)).alias("start"))
        ids = places(fresh, ["o", "task"]).crossJoin(F.broadcast(start)).select("task", (F.col("start") + F.col("place")).cast("long").alias("task_index"))
        ids.write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_to_end(stream, "append", add)
    return spark.read.schema(kind).parquet(out).drop("batch")


def ring_buffer(stream: DataFrame, key: str, frame: str, value: str, order: list[str], n: int) -> DataFrame:
    """The last n values of each key after each row, filled up with the first: key, frame, pos, x.

    Each batch's rows join the last n that are stored of their keys, in one
    sorted pass that spills; the new last n are stored under the batch's number,
    so a batch that is done again finds what it found before.
    """
    spark, out, held = stream.sparkSession, scratch(stream.sparkSession, "ring"), scratch(stream.sparkSession, "held")
    columns = [key, frame, value, *[c for c in order if c not in (key, frame, value)]]
    kind = stream.select(columns).schema
    spark.createDataFrame([], kind).write.parquet(f"{held}/batch=-1")
    series = Window.partitionBy(key).orderBy(*order)

    def push(df: DataFrame, number: int) -> None:
        s = df.sparkSession
        past = s.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.LongType())])).parquet(held).where(F.col("batch") < number)
        newest = past.groupBy(key).agg(F.max("batch").alias("batch"))
        both = df.select(columns).withColumn("__new", F.lit(True)).unionByName(past.join(newest, [key, "batch"], "left_semi").drop("batch").withColumn("__new", F.lit(False)))
        ring = both.withColumn("__w", F.collect_list(value).over(series.rowsBetween(-(n - 1), 0)))
        full = F.concat(F.array_repeat(F.element_at("__w", 1), F.lit(n) - F.size("__w")), "__w")
        ring.where("__new").select(key, frame, F.posexplode(full).alias("pos", "x")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
        both.withColumn("__r", back).where(F.col("__r") <= n).select(columns).write.mode("overwrite").parquet(f"{held}/batch={number}")

    run_to_end(stream, "append", push)
    return spark.read.schema(T.StructType([kind[key], kind[frame], T.StructField("pos", T.IntegerType()), T.StructField("x", kind[value].dataType), T.StructField("batch", T.LongType())])).parquet(out).drop("batch")


def fresh_snapshot(stream: DataFrame, keys: list[str], camera: Column, ts: str, value: str, max_age: str, n_cameras: int) -> DataFrame:
    """Latest value of each camera for keys whose cameras are all within ``max_age`` of the key's newest frame.

    The watermark drops frames that come too late; state is one row per key and camera.
    """
    newest = stream.withWatermark(ts, max_age).groupBy(*keys, camera.alias("camera")).agg(F.max(ts).alias("latest"), F.max_by(value, ts).alias("value"))
    rows = latest(newest, "update", [*keys, "camera"])
    now = rows.groupBy(*keys).agg(F.max("latest").alias("now"))
    fresh = rows.join(now, keys).where(F.col("now") - F.col("latest") <= F.expr(f"interval {max_age}"))
    whole = fresh.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_cameras)
    return fresh.join(whole, keys, "left_semi").drop("now")


def action_ensemble(stream: DataFrame, late: str) -> DataFrame:
    """Mean of the chunk predictions that aim at one step; steps behind the watermark leave the state."""
    # a day later than the epoch, where the first watermark stands
    timed = stream.withColumn("at", F.timestamp_seconds(F.col("target") + 86_400)).withWatermark("at", late)
    return timed.groupBy("episode_index", "target", "at").agg(F.avg("pred").alias("action"), F.count(F.lit(1)).alias("n")).drop("at")
