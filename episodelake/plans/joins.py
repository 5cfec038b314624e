"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.functions.scalars import prompt_key
from episodelake.functions.udfs import embed
from episodelake.lenses import catalog, chunks, frames, prompts, sql, table, vectors
from episodelake.operators import joins as J
from episodelake.operators.evals import latent_error
from episodelake.plans.projections import r6
from episodelake.plans.windows import RUNS_SQL, episodes, stored_runs
from episodelake.registry import query


@query("""WITH t AS (SELECT n_nationkey AS i, n_name AS text FROM nation WHERE n_nationkey <> 7)
SELECT event_id, a.text AS task, b.text AS coarse_task FROM events LEFT JOIN t a ON a.i = user_id % 25 LEFT JOIN t b ON b.i = event_id % 30""")
def jn_task_text(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "nation").where("n_nationkey <> 7").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("text"))
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 25).alias("task_index"), (F.col("event_id") % 30).alias("coarse_task_index"))
    return J.role_texts(e, {"task_index": (tasks, "i", "task"), "coarse_task_index": (tasks, "i", "coarse_task")}).select("event_id", "task", "coarse_task")


def prompt_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.concat(F.sha2("task", 256), F.lit(".t5_len128.t5.pt")))


@query(sql("prompts", """p AS (SELECT pos, concat(sha256(task), '.t5_len8.hash.pt') AS key, least(8, len(string_split(task, ' '))) AS words FROM prompts), c AS (SELECT key, min(pos) % 4 AS kind FROM p GROUP BY key)
SELECT pos, key, CASE kind WHEN 0 THEN 'not in the cache' WHEN 1 THEN 'context of 7 steps, not 8' WHEN 2 THEN 'mask of 9 steps, not 8' END AS problem, CASE WHEN kind = 3 THEN words END AS tokens FROM p JOIN c USING (key)"""))
def jn_prompt_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts with their contexts from a cache that lacks some and has others of a wrong length."""
    p = prompts(spark, sf).select("pos", prompt_key(F.col("task"), 8, "hash").alias("key"), F.col("task").alias("prompt"))
    firsts = p.groupBy("key").agg(F.min("pos").alias("first"), F.first("prompt").alias("prompt"))
    kind = (F.col("first") % 4).alias("kind")
    made = embed(firsts, 8, 4).join(firsts.select("key", kind), "key").where("kind <> 0")
    cache = made.select("key", F.when(F.col("kind") == 1, F.slice("context", 1, 7)).otherwise(F.col("context")).alias("context"), F.when(F.col("kind") == 2, F.concat("mask", F.array(F.lit(False)))).otherwise(F.col("mask")).alias("mask"))
    found = J.with_context(p, cache, "key", 8, strict=False)
    return found.select("pos", "key", "problem", F.when(F.col("problem").isNull(), F.size(F.filter("mask", lambda m: m))).cast("long").alias("tokens"))


@query(sql("prompts", """k AS (SELECT DISTINCT task, sha256(task) AS key FROM prompts), c AS (SELECT key, 'a' AS cache FROM k WHERE task LIKE 'en%' UNION ALL SELECT key, 'b' FROM k WHERE task NOT LIKE '%src1%')
SELECT key FROM k WHERE key NOT IN (SELECT key FROM c GROUP BY key HAVING count(DISTINCT cache) >= 2)"""))
def jn_cache_todo(spark: SparkSession, sf: str) -> DataFrame:
    k = prompts(spark, sf).select("task").distinct().withColumn("key", F.sha2("task", 256))
    caches = k.where("task like 'en%'").select("key", F.lit("a").alias("cache")).unionByName(k.where("task not like '%src1%'").select("key", F.lit("b").alias("cache")))
    return J.todo(k, caches, "key", 2).select("key")


@query(sql("catalog", "SELECT task, dataset FROM catalog WHERE dataset_id NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"))
def jn_invalid_datasets(spark: SparkSession, sf: str) -> DataFrame:
    valid = table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("dataset_id"))
    return catalog(spark, sf).join(valid, "dataset_id", "left_anti").select("task", "dataset")


@query(f"""WITH {RUNS_SQL.format(lower="false")} SELECT e.event_id, r.physical_start + e.event_id - r.start AS row, e.event_id AS overlapping_row FROM events e LEFT JOIN r ON e.event_id >= r.start AND e.event_id < r."end" """)
def jn_logical_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The physical row of each event in permuted files, none for those left out; where runs overlap an index is its own row."""
    points = table(spark, sf, "events").select("event_id")
    found = J.physical_rows(points, "event_id", stored_runs(spark, sf, False), strict=False)
    return J.physical_rows(found.withColumnRenamed("row", "__row"), "event_id", stored_runs(spark, sf, True)).select("event_id", F.col("__row").alias("row"), F.col("row").alias("overlapping_row"))


@query(sql("catalog", """o AS (SELECT dataset_id, sum(frames) OVER (ORDER BY dataset_id) - frames AS f, sum(frames) OVER (ORDER BY dataset_id) AS t FROM catalog)
SELECT o_orderkey AS idx, dataset_id, CAST(o_orderkey - f AS bigint) AS local FROM orders JOIN o ON o_orderkey >= f AND o_orderkey < t"""))
def jn_locate_sample(spark: SparkSession, sf: str) -> DataFrame:
    from episodelake.operators.windows import episode_offsets

    sizes = episode_offsets(catalog(spark, sf).select("dataset_id", "frames"), "frames", "dataset_id").where("frames > 0")
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"))
    return J.range_lookup(points, "idx", sizes, "from_index", "to_index").select("idx", "dataset_id", (F.col("idx") - F.col("from_index")).alias("local"))


@query(sql("frames", """q AS (SELECT event_id AS qid, user_id AS episode_index, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 + (event_id % 11 - 5) * 137.5 AS at FROM events),
c AS (SELECT qid, q.at, timestamp, abs(timestamp - q.at) AS d FROM q JOIN frames USING (episode_index)),
b AS (SELECT qid, min(d) AS d FROM c WHERE d < 500 GROUP BY qid)
SELECT q.qid, round(min(c.timestamp), 6) AS nearest, round(b.d, 6) AS distance FROM q LEFT JOIN b ON b.qid = q.qid LEFT JOIN c ON c.qid = b.qid AND c.d = b.d GROUP BY q.qid, b.d"""))
def jn_nearest_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    q = f.select(F.col("index").alias("qid"), "episode_index", (F.col("timestamp") + (F.col("index") % 11 - 5) * F.lit(137.5)).alias("at"))
    return J.nearest_time(q, f, ["episode_index"], "at", "timestamp", 500.0).select("qid", F.round("nearest", 6).alias("nearest"), F.round("distance", 6).alias("distance"))


@query(sql("frames", """SELECT q.index AS qid, f.index AS found FROM frames q JOIN frames f ON f.episode_index = q.episode_index AND f.frame_index = CAST(round_even(q.k * CAST(2.5 AS double), 0) AS bigint)"""))
def jn_frame_by_time(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    q = f.select(F.col("index").alias("qid"), "episode_index", J.frame_of_time(F.col("k"), 2.5).alias("frame_index"))
    return q.join(f.select("episode_index", "frame_index", F.col("index").alias("found")), ["episode_index", "frame_index"]).select("qid", "found")


@query(sql("frames", """c AS (SELECT * FROM (VALUES ('high', 0.5), ('wrist', 1.25)) t(camera, base)), o AS (SELECT DISTINCT episode_index, camera, episode_index * CAST(base AS double) AS from_timestamp FROM frames, c)
SELECT index, camera, concat('videos/', camera, '/file-', lpad(CAST(f.episode_index AS varchar), 6, '0'), '.mp4') AS file, round(timestamp + from_timestamp, 6) AS video_time FROM frames f JOIN o USING (episode_index)"""))
def jn_video_offset(spark: SparkSession, sf: str) -> DataFrame:
    wide = episodes(spark, sf).select("episode_index", (F.col("episode_index") * F.lit(0.5)).alias("a"), (F.col("episode_index") * F.lit(1.25)).alias("b"))
    long = wide.selectExpr("episode_index", "stack(2, 'high', a, 'wrist', b) as (camera, from_timestamp)")
    long = long.withColumn("file", F.format_string("videos/%s/file-%06d.mp4", "camera", "episode_index"))
    return J.with_offsets(frames(spark, sf), long, ["episode_index"], "timestamp").select("index", "camera", "file", F.round("video_time", 6).alias("video_time"))


@query(sql("chunks", "SELECT c.episode_index, chunk_start, target, round(pred, 6) AS pred, value AS truth FROM chunks c JOIN frames f ON f.episode_index = c.episode_index AND f.frame_index = target"))
def jn_pred_truth(spark: SparkSession, sf: str) -> DataFrame:
    truth = frames(spark, sf).select("episode_index", F.col("frame_index").alias("target"), F.col("value").alias("truth"))
    return J.matched(chunks(spark, sf), truth, ["episode_index", "target"]).select("episode_index", "chunk_start", "target", F.round("pred", 6).alias("pred"), "truth")


MSE = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))) / len({a})"


@query(sql("vectors", f"""p AS (SELECT a.vec_id, a.v AS x, b.v AS y, c.v AS z FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1 JOIN vectors c ON c.vec_id = a.vec_id + 2)
SELECT vec_id, round({MSE.format(a="x", b="y")}, 6) AS mse, round({MSE.format(a="x", b="z")}, 6) AS baseline, round({MSE.format(a="x", b="z")} - {MSE.format(a="x", b="y")}, 6) + 0.0 AS gain FROM p"""))
def jn_baseline_gain(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)

    def errors(step: int) -> DataFrame:
        other = v.select((F.col("vec_id") - step).alias("vec_id"), F.col("v").alias("w"))
        return v.join(other, "vec_id").select("vec_id", latent_error(F.col("v"), F.col("w"))["mse"].alias("mse"))

    g = J.gain(errors(1), errors(2), ["vec_id"], "mse")
    return g.select("vec_id", F.round("mse", 6).alias("mse"), F.round("baseline", 6).alias("baseline"), r6("gain").alias("gain"))


@query(sql("frames", """s AS (SELECT min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM frames) SELECT DISTINCT episode_index, lo, hi, mean FROM frames, s"""))
def jn_stats_per_episode(spark: SparkSession, sf: str) -> DataFrame:
    # the one cross join: the right side is a single row of aggregates
    stats = table(spark, sf, "events").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))
    return episodes(spark, sf).select("episode_index").crossJoin(F.broadcast(stats))


@query(sql("catalog", "SELECT task, dataset, CASE WHEN dataset_id % 6 <> 0 THEN fps END AS fps, dataset_id % 6 = 0 AS missing FROM catalog"))
def jn_catalog_info(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark, sf)
    info = c.where("dataset_id % 6 <> 0").select("dataset_id", "fps")
    return c.drop("fps").join(info, "dataset_id", "left").select("task", "dataset", "fps", F.col("fps").isNull().alias("missing"))


@query(sql("frames", """t AS (SELECT episode_index, max(timestamp) AS now FROM frames GROUP BY 1), l AS (SELECT episode_index, source_cam AS camera, max(timestamp) AS latest, arg_max(value, timestamp) AS value FROM (SELECT *, index % 3 AS source_cam FROM frames) GROUP BY ALL),
f AS (SELECT l.* FROM l JOIN t USING (episode_index) WHERE now - latest <= 200000)
SELECT episode_index, camera, round(latest, 6) AS latest, value FROM f WHERE episode_index IN (SELECT episode_index FROM f GROUP BY 1 HAVING count(*) = 3)"""))
def jn_fresh_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("camera", F.col("index") % 3)
    now = f.groupBy("episode_index").agg(F.max("timestamp").alias("now"))
    return J.fresh_snapshot(f, ["episode_index"], "camera", "timestamp", now, 200000.0, 3).select("episode_index", "camera", F.round("latest", 6).alias("latest"), "value")
