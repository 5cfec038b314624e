"""Views of the shared tables in the shapes the operators work on, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is an episode, an event a frame; state and action are [value, k]."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "episode_index")
    # the windows are by the name that callers filter on, so such filters reach the scan
    episode = Window.partitionBy("episode_index")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    source = F.when(F.col("episode_index") % 3 == 0, "alpha").when(F.col("episode_index") % 3 == 1, "beta").otherwise("gamma")
    return e.select(
        "episode_index",
        (F.row_number().over(episode.orderBy("ts", "event_id")) - 1).cast("long").alias("frame_index"),
        F.count(F.lit(1)).over(episode).alias("ep_len"),
        F.col("event_id").alias("index"),
        ((micros - F.min(micros).over(episode)) / 1e6).alias("timestamp"),
        F.col("event_type").alias("task"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        source.alias("source"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 numbers per row; pose7 is the first seven as x, y, z and a quaternion x, y, z, w."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"), F.slice(v, 1, 7).alias("pose7"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    task = F.concat("lang", F.lit(" task "), "source", F.lit("@do "), "source", F.lit(" in "), "lang")
    return d.select(F.col("doc_id").alias("pos"), F.col("source").alias("dataset"), task.alias("task"), "text")


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("suite"),
        (cust % 10).alias("task_id"),
        key.alias("trial"),
        (F.col("o_orderstatus") == "F").alias("success"),
        F.col("o_totalprice").alias("duration"),
        F.when(key % 7 != 0, 10 + (key % 1000) / F.lit(50.0)).alias("psnr"),
        F.concat(F.lit("gpu"), (key % 8).cast("string"), F.lit("_task"), (cust % 10).cast("string"), F.lit("_results.json")).alias("file_name"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rate = F.format_string("%.4f", ((key % 101) / F.lit(100.0)).cast("double"))
    line = F.concat(
        F.lit("done task=task_"), (F.col("o_custkey") % 50).cast("string"), F.lit(" phase="), F.when(key % 2 == 0, "clean").otherwise("random"),
        F.lit(" gpu="), (key % 8).cast("string"), F.lit(" success_rate="), rate,
    )
    return table(spark, sf_dir, "orders").select((key % 20).alias("run"), key.alias("line_no"), line.alias("line"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region is a task, a nation a dataset, a customer an episode, an order a frame."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("frames"))
    c = table(spark, sf_dir, "customer").join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    sums = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"))
    return (
        n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(sums, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select(
            F.col("r_name").alias("task"),
            F.col("n_name").alias("dataset"),
            F.col("n_nationkey").alias("dataset_id"),
            F.coalesce("episodes", F.lit(0)).cast("long").alias("episodes"),
            F.coalesce("frames", F.lit(0)).cast("long").alias("frames"),
            F.when(F.col("n_nationkey") % 5 == 0, 50).otherwise(30).alias("fps"),
        )
    )


def dataset_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, feature, width): the market segments that a nation's customers have."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("dataset_id"), F.col("c_mktsegment").alias("feature")).agg(F.count(F.lit(1)).alias("width"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth frame predicts the eight steps from it; past the end the last frame holds."""
    f = frames(spark, sf_dir)
    starts = f.where("frame_index % 4 = 0").select("episode_index", F.col("frame_index").alias("chunk_start"), "ep_len", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("offset_in_chunk"))
    at = starts.withColumn("target", F.col("chunk_start") + F.col("offset_in_chunk")).withColumn("frame_index", F.least("target", F.col("ep_len") - 1))
    return at.join(f.select("episode_index", "frame_index", "value"), ["episode_index", "frame_index"]).select(
        "episode_index", "chunk_start", "offset_in_chunk", "target", (F.col("value") + F.lit(0.1) * F.col("offset_in_chunk")).alias("pred")
    )


SQL = {
    "frames": """SELECT user_id AS episode_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
  count(*) OVER (PARTITION BY user_id) AS ep_len, event_id AS index, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS timestamp,
  event_type AS task, value, CAST(json_extract_string(props, '$.k') AS double) AS k,
  CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source FROM events""",
    "vectors": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding[1:7] AS DOUBLE[]) AS pose7 FROM embeddings",
    "prompts": "SELECT doc_id AS pos, source AS dataset, concat(lang, ' task ', source, '@do ', source, ' in ', lang) AS task, text FROM documents",
    "eval_results": """SELECT o_orderpriority AS suite, o_custkey % 10 AS task_id, o_orderkey AS trial, o_orderstatus = 'F' AS success, o_totalprice AS duration,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 10 + (o_orderkey % 1000) / CAST(50 AS double) END AS psnr,
  concat('gpu', CAST(o_orderkey % 8 AS varchar), '_task', CAST(o_custkey % 10 AS varchar), '_results.json') AS file_name FROM orders""",
    "log_lines": """SELECT o_orderkey % 20 AS run, o_orderkey AS line_no, concat('done task=task_', CAST(o_custkey % 50 AS varchar), ' phase=',
  CASE WHEN o_orderkey % 2 = 0 THEN 'clean' ELSE 'random' END, ' gpu=', CAST(o_orderkey % 8 AS varchar), ' success_rate=', printf('%.4f', (o_orderkey % 101) / 100.0)) AS line FROM orders""",
    "catalog": """SELECT r.r_name AS task, n.n_name AS dataset, n.n_nationkey AS dataset_id, count(DISTINCT c.c_custkey) AS episodes, count(o.o_orderkey) AS frames,
  CASE WHEN n.n_nationkey % 5 = 0 THEN 50 ELSE 30 END AS fps FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name, n.n_name, n.n_nationkey""",
    "dataset_features": "SELECT c_nationkey AS dataset_id, c_mktsegment AS feature, count(*) AS width FROM customer GROUP BY ALL",
    "chunks": """SELECT a.episode_index, a.frame_index AS chunk_start, b.o AS offset_in_chunk, a.frame_index + b.o AS target, f.value + CAST(0.1 AS double) * b.o AS pred
  FROM frames a CROSS JOIN (SELECT CAST(x AS bigint) AS o FROM range(8) t(x)) b
  JOIN frames f ON f.episode_index = a.episode_index AND f.frame_index = least(a.frame_index + b.o, a.ep_len - 1) WHERE a.frame_index % 4 = 0""",
}
_NEEDS = {"chunks": ["frames"]}


def sql(lenses: str, body: str) -> str:
    """A DuckDB query over lenses (names, space-separated); the body is a SELECT or further named queries and one."""
    names: list[str] = []
    for name in lenses.split():
        names += [x for x in [*_NEEDS.get(name, []), name] if x not in names]
    body = body.strip()
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {parts}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
