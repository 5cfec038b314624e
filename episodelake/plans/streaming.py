"""Queries of the streaming jobs; their results are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.lenses import chunks, sql
from episodelake.paths import scratch
from episodelake.plans.projections import r6
from episodelake.registry import query
from episodelake.streaming import jobs as J
from episodelake.streaming import recorder as R


@query("""WITH a AS (SELECT *, event_id % 8 = 0 AS closed FROM events),
b AS (SELECT *, CAST(sum(closed::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) - closed::int AS bigint) AS episode FROM a),
c AS (SELECT *, row_number() OVER w - 1 AS frame_index, count(*) OVER e AS n, min(value) OVER e AS lo, max(value) OVER e AS hi, avg(value) OVER e AS m, stddev_pop(value) OVER e AS s FROM b WINDOW w AS (PARTITION BY user_id, episode ORDER BY ts, event_id), e AS (PARTITION BY user_id, episode)),
t AS (SELECT count(*) FILTER (WHERE closed) AS episodes, CAST(sum(CASE WHEN closed THEN n END) AS bigint) AS frames, count(*) AS rows FROM c)
SELECT user_id, event_id, episode, frame_index, round(frame_index / CAST(30 AS double), 6) AS timestamp, closed, CASE WHEN closed THEN n END AS length, CASE WHEN closed THEN lo END AS min, CASE WHEN closed THEN hi END AS max,
round(CASE WHEN closed THEN m END, 6) AS mean, round(CASE WHEN closed THEN s END, 6) AS std, t.episodes, t.frames, concat('0:', t.episodes) AS split, rows - t.frames AS open_frames FROM c, t""")
def str_episode_recorder(spark: SparkSession, sf: str) -> DataFrame:
    """An event whose number is a multiple of eight ends its user's episode; what is open at the end has no end yet."""
    rows, _ = recorded(spark, sf)
    rows = rows.withColumns({c: F.round(c, 6) for c in ("timestamp", "mean", "std")}).withColumnsRenamed({"id": "event_id"})
    totals = R.recorded_totals(rows.withColumnRenamed("event_id", "id"))
    return rows.where("user_id is not null").crossJoin(F.broadcast(totals))  # one row of totals


def recorded(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """(recorded frames of all events, the store of statistics by source into which closed episodes were merged batch by batch).

    A table's files come in no order of time, so a frame may be as late as the
    table is long. Times are counted from the day before the first event, since
    no watermark is older than the epoch, and events without a time are last.
    When the events have been read, a frame of no user moves the watermark past
    them. Every batch opens and saves all state partitions, so their number does
    not grow with the shuffle's.
    """
    out, store, checkpoint, clock = (scratch(spark, n) for n in ("recorded", "statistics", "stream", "clock"))
    us, day = F.unix_micros(F.col("ts").cast("timestamp")), 86_400_000_000
    first, newest = spark.read.parquet(f"{sf}/events.parquet").agg(F.min(us), F.max(us)).first()
    first, length = first or 0, (newest or 0) - (first or 0)
    at = F.timestamp_micros(F.coalesce(us - first, F.lit(length + 1)) + day)
    frames = J.events_stream(spark, sf).select("user_id", "event_id", at.alias("at"), "value", (F.col("event_id") % 8 == 0).alias("done"))
    kind = frames.schema
    spark.createDataFrame([], kind).write.parquet(clock)
    stream = frames.unionByName(spark.readStream.schema(kind).parquet(clock))
    late = length // 1_000_000 + 3600
    episodes = R.record_episodes(stream, "user_id", "event_id", "at", "done", "value", 30.0, late=f"{late} seconds", idle_seconds=3.0 * (late + 86_400), slice_seconds=30 * 86_400.0)

    def each(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        rows = df.sparkSession.read.schema(episodes.schema).parquet(f"{out}/batch={n}").where("closed")
        R.merge_batch(rows.select((F.col("user_id") % 3).alias("source"), *R.STATISTICS, F.col("length").alias("count")), n, store, ["source"])

    conf = R.ROCKS | {"spark.sql.shuffle.partitions": str(min(48, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    J.run_to_end(episodes, "append", each, checkpoint, conf)
    end = length + late * 1_000_000 + 2 * day
    spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), F.timestamp_micros(F.lit(end)).alias("at"), F.lit(0.0).alias("value"), F.lit(False).alias("done")).select(*[F.col(f.name).cast(f.dataType) for f in kind]).write.mode("append").parquet(clock)
    J.run_to_end(episodes, "append", each, checkpoint, conf)
    return spark.read.schema(episodes.schema.add("batch", "long")).parquet(out).drop("batch"), store


@query("SELECT task, row_number() OVER (ORDER BY f) - 1 AS task_index FROM (SELECT concat(event_type, '-', user_id % 9) AS task, min(event_id) AS f FROM events GROUP BY 1)")
def str_task_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    s = J.events_stream(spark, sf).select("event_id", F.concat("event_type", F.lit("-"), (F.col("user_id") % 9).cast("string")).alias("text"))
    return J.task_dictionary(s, "text", "event_id")


@query("""WITH b AS (SELECT *, CAST(sum((event_id % 8 = 0)::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) - (event_id % 8 = 0)::int AS bigint) AS episode FROM events),
c AS (SELECT user_id % 3 AS source, value, bool_or(event_id % 8 = 0) OVER (PARTITION BY user_id, episode) AS closed FROM b)
SELECT source, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS count FROM c WHERE closed GROUP BY 1""")
def str_running_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics by source of all closed episodes, merged from the episodes' own as they close."""
    _, store = recorded(spark, sf)
    return R.stored_stats(spark, store).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(sql("frames", """SELECT a.episode_index AS user_id, a.index AS event_id, CAST(i AS bigint) AS pos, b.value AS x FROM frames a, LATERAL unnest(range(0, 4)) t(i)
JOIN frames b ON b.episode_index = a.episode_index AND b.frame_index = greatest(a.frame_index - 3 + i, 0)"""))
def str_ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    s = J.events_stream(spark, sf).select("user_id", "event_id", "ts", "value")
    return J.ring_buffer(s, "user_id", "event_id", "value", ["ts", "event_id"], 4).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH c AS (SELECT user_id, event_id % 3 AS camera, max(ts) AS latest, arg_max(value, ts) AS value FROM events GROUP BY 1, 2),
f AS (SELECT *, latest >= max(latest) OVER (PARTITION BY user_id) - INTERVAL 2 DAY AS fresh FROM c)
SELECT user_id, camera, CAST(latest AS varchar) AS latest, value FROM f QUALIFY count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id) = 3""")
def str_fresh_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    s = J.events_stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    return J.fresh_snapshot(s, ["user_id"], F.col("event_id") % 3, "at", "value", "2 days", 3).withColumn("latest", F.col("latest").cast("string"))


@query(sql("chunks", "SELECT episode_index, target, round(avg(pred), 6) + 0.0 AS action, count(*) AS n FROM chunks GROUP BY ALL"))
def str_action_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "chunks")
    chunks(spark, sf).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return J.latest(J.action_ensemble(stream, "1 hour"), "update", ["episode_index", "target"]).withColumn("action", r6("action"))


@query("""SELECT o_orderpriority AS suite, o_custkey % 10 AS task_id, count(*) AS trials, CAST(sum((o_orderstatus = 'F')::int) AS bigint) AS successes,
CAST(round_even(100.0::double * sum((o_orderstatus = 'F')::int) / count(*), 1) AS double) AS rate FROM orders GROUP BY ALL""")
def str_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    s = J.events_stream(spark, sf, "orders").select(F.col("o_orderpriority").alias("suite"), (F.col("o_custkey") % 10).alias("task_id"), (F.col("o_orderstatus") == "F").alias("success"))
    agg = s.groupBy("suite", "task_id").agg(F.count(F.lit(1)).alias("trials"), F.count_if("success").alias("successes"))
    return J.latest(agg, "complete", ["suite", "task_id"]).withColumn("rate", F.bround(100.0 * F.col("successes") / F.col("trials"), 1))
