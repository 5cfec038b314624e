"""Queries of sampling, sorting and the set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.lenses import catalog, dataset_features, eval_results, frames, log_lines, prompts, sql, table
from episodelake.operators import sampling as P
from episodelake.operators import sets as U
from episodelake.plans.windows import episodes
from episodelake.operators.windows import places
from episodelake.registry import query
from episodelake.sources.discovery import first_paths


@query("""WITH e AS (SELECT o_custkey % 20 AS series, count(*) AS len FROM orders GROUP BY 1), n AS (SELECT series, len, CAST(least(len, greatest(100, least(10000, floor(pow(len, 0.75))))) AS bigint) AS n FROM e)
SELECT series, CAST(round_even(CASE WHEN n = 1 THEN 0.0::double ELSE CAST(i AS double) * (len - 1) / (n - 1) END, 0) AS bigint) AS index FROM n, LATERAL unnest(range(0, n)) t(i)""")
def smp_linspace(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("series")).agg(F.count(F.lit(1)).alias("len"))
    return P.linspace_indices(e, ["series"], "len")


@query("""WITH e AS (SELECT user_id AS episode_index, count(*) - 8 AS v FROM events GROUP BY user_id),
c AS (SELECT episode_index, CAST(floor(0.1::double * v) AS bigint) AS lo, CAST(greatest(floor(0.1::double * v), floor(0.8::double * v)) AS bigint) AS hi FROM e WHERE v >= 0),
d AS (SELECT episode_index, lo, list_reduce([CAST([] AS bigint[])] || list_transform(range(greatest(hi - lo + 1 - 3, 0), hi - lo + 1), lambda j: [j]),
  lambda done, j: done || [CASE WHEN list_contains(done, CAST(concat('0x', substr(md5(concat('7:', episode_index, ':', j[1])), 1, 8)) AS bigint) % (j[1] + 1)) THEN j[1]
    ELSE CAST(concat('0x', substr(md5(concat('7:', episode_index, ':', j[1])), 1, 8)) AS bigint) % (j[1] + 1) END]) AS draws FROM c),
s AS (SELECT episode_index, lo + unnest(draws) AS start, unnest(range(len(draws))) AS r FROM d)
SELECT episode_index, start FROM s ORDER BY md5(concat('7:', episode_index)), episode_index, r LIMIT 200""")
def smp_episode_windows(spark: SparkSession, sf: str) -> DataFrame:
    return P.episode_windows(episodes(spark, sf), 8, 0.1, 0.8, 3, 200, 7)


@query(sql("frames", "SELECT index, value FROM frames WHERE index >= 10 AND (index - 10) % 7 = 0 AND index < 10 + 7 * 500"))
def smp_sequential(spark: SparkSession, sf: str) -> DataFrame:
    return P.sequential(frames(spark, sf), "index", 10, 7, 500).select("index", "value")


def permutation_sql(keys: list[tuple[int, int, int]]) -> str:
    """Named queries n (n, side m) and p (idx, position): the permutation of the events' numbers, by another way round."""
    rounds = "SELECT idx, n, m, CAST(floor(x / m) AS bigint) AS l, x % m AS r FROM q CROSS JOIN n WHERE go"
    for a, b, c in keys:
        u = f"((r + {a}) % {P.PRIME})"
        mixed = f"((({u} * {u} % {P.PRIME}) * {u} % {P.PRIME} + {b}) % {P.PRIME} * {c} % {P.PRIME})"
        rounds = f"SELECT idx, n, m, r AS l, (l + {mixed}) % m AS r FROM ({rounds})"
    return f"""n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS bigint) AS m FROM events),
q(idx, x, go) AS (SELECT event_id, event_id, true FROM events UNION ALL SELECT idx, l * m + r, l * m + r >= n FROM ({rounds})),
p AS (SELECT idx, x AS position FROM q WHERE NOT go)"""


@query(f"WITH RECURSIVE {permutation_sql(P.round_keys(42, 0))} SELECT idx AS index, position FROM p WHERE position >= 256")
def smp_epoch_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("index"))
    return P.resume(P.epoch_positions(e, "index", 42, 0), 4 * 8 * 8)


@query(f"WITH RECURSIVE {permutation_sql(P.round_keys(42, 1))} SELECT idx AS index, position, user_id FROM p JOIN events ON event_id = idx WHERE position % 8 = 3 AND position >= 100")
def smp_rank_shard(spark: SparkSession, sf: str) -> DataFrame:
    """The rank's samples from the inverse permutation, joined to their rows."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("index"), "user_id")
    return P.epoch_samples(spark, e.count(), 42, 1, rank=3, world=8, done=100).join(e, "index")


@query("""WITH d AS (SELECT event_id AS index, row_number() OVER (ORDER BY event_id) - 1 AS pos, value > 100 AS padded, count(*) OVER () AS n FROM events),
c AS (SELECT d.pos, a, CAST(concat('0x', substr(md5(concat('5:', d.pos, ':', a)), 1, 8)) AS bigint) % d.n AS cand FROM d, LATERAL unnest(range(1, 4)) t(a) WHERE padded),
b AS (SELECT c.pos, arg_min(c.cand, CASE WHEN NOT x.padded THEN a ELSE 6 - a END) AS chosen FROM c JOIN d x ON x.pos = c.cand GROUP BY c.pos)
SELECT d.pos, d.padded, coalesce(b.chosen, d.pos) AS chosen FROM d LEFT JOIN b USING (pos)""")
def smp_replace_padded(spark: SparkSession, sf: str) -> DataFrame:
    e = places(table(spark, sf, "events").select("event_id", (F.col("value") > 100).alias("padded")), ["event_id"]).withColumnRenamed("place", "pos")
    d = e.select("pos", "padded").crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return P.replace_padded(d, "pos", "padded", F.col("n"), 5).select("pos", "padded", "chosen")


@query(sql("prompts", """d AS (SELECT dataset, task, min(pos) AS pos FROM prompts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY task) AS r, count(*) OVER (PARTITION BY dataset) < 4 AS short FROM d)
SELECT dataset, task, pos, short FROM r WHERE r <= 4"""))
def srt_first_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    d = prompts(spark, sf).groupBy("dataset", "task").agg(F.min("pos").alias("pos"))
    return P.first_k(d, ["dataset"], ["task"], 4).select("dataset", "task", "pos", "short")


@query(sql("frames", "SELECT episode_index, index, value FROM frames WHERE frame_index = 0 AND episode_index % 3 = 1"))
def srt_first_frame(spark: SparkSession, sf: str) -> DataFrame:
    chosen = episodes(spark, sf).where("episode_index % 3 = 1").select("episode_index")
    return P.first_frames(frames(spark, sf), chosen).select("episode_index", "index", "value")


@query(sql("eval_results", """t AS (SELECT DISTINCT suite, concat('task_', task_id * 7) AS task FROM eval_results)
SELECT suite, task, row_number() OVER (PARTITION BY suite ORDER BY CAST(regexp_extract(task, '(\\d+)$', 1) AS bigint)) AS place FROM t""".replace("\\\\", "\\")))
def srt_natural_task(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    t = eval_results(spark, sf).select("suite", F.concat(F.lit("task_"), (F.col("task_id") * 7).cast("string")).alias("task")).distinct()
    return t.withColumn("place", F.row_number().over(Window.partitionBy("suite").orderBy(*P.natural_order(F.col("task")))).cast("long"))


@query("""SELECT o_orderkey AS id, o_totalprice AS price, NULL AS "observation.images.top", 0 AS dataset_index FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, l_returnflag, 1 FROM lineitem""")
def set_union_common(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("observation.images.top"))
    return U.union_common([a, b])


HAVE = "h AS (SELECT dataset_id, feature FROM dataset_features WHERE NOT (dataset_id % 5 = 0 AND feature IN ('BUILDING', 'FURNITURE')))"


def have(spark: SparkSession, sf: str) -> DataFrame:
    return dataset_features(spark, sf).where("not (dataset_id % 5 = 0 and feature in ('BUILDING', 'FURNITURE'))")


@query(sql("dataset_features", f"{HAVE} SELECT DISTINCT dataset_id, feature FROM h WHERE feature IN (SELECT feature FROM h GROUP BY 1 HAVING count(DISTINCT dataset_id) < (SELECT count(DISTINCT dataset_id) FROM h))"))
def set_feature_diff(spark: SparkSession, sf: str) -> DataFrame:
    return U.feature_difference(have(spark, sf))


@query(sql("dataset_features", f"{HAVE} SELECT feature FROM h GROUP BY 1 HAVING count(DISTINCT dataset_id) = (SELECT count(DISTINCT dataset_id) FROM h)"))
def set_feature_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return U.feature_intersection(have(spark, sf))


@query(sql("prompts", "SELECT min(pos) AS pos FROM (SELECT pos, concat(dataset, '/', substr(task, 1, 2)) AS path FROM prompts) GROUP BY path"))
def set_dedup_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Each path is written in four ways; the first row of each place stays."""
    parts = ["dataset", F.substring("task", 1, 2)]
    forms = [F.concat_ws("/", *parts), F.concat_ws("/", F.lit("."), parts[0], F.lit(""), parts[1], F.lit("")), F.concat_ws("/", parts[0], F.lit("x/.."), parts[1]), F.concat_ws("/", F.lit("y/../z"), F.lit(".."), *parts, F.lit("."))]
    p = prompts(spark, sf).select("pos", F.array(*forms)[(F.col("pos") % 4).cast("int")].alias("path"))
    return first_paths(p, "path", "pos").select("pos")


@query(sql("prompts", "SELECT prompt, min(pos) AS pos FROM (SELECT pos, trim(unnest(string_split(task, '@'))) AS prompt FROM prompts) GROUP BY prompt"))
def set_dedup_prompts(spark: SparkSession, sf: str) -> DataFrame:
    from episodelake.functions.scalars import bilingual_variants

    p = prompts(spark, sf).select("pos", F.explode(bilingual_variants(F.col("task"))).alias("prompt"))
    return U.ordered_distinct(p, "prompt", "pos")


@query(sql("log_lines", r"""t AS (SELECT regexp_extract(line, 'task=(\S+)', 1) AS task, min(line_no) AS f FROM log_lines GROUP BY 1)
SELECT task, row_number() OVER (ORDER BY f, task) AS place, CAST(substr(task, 6) AS bigint) % 4 <> 0 AS known FROM t"""))
def set_ordered_tasks(spark: SparkSession, sf: str) -> DataFrame:
    lines = log_lines(spark, sf).select(F.regexp_extract("line", r"task=(\S+)", 1).alias("task"), "line_no")
    known = lines.select("task").distinct().where("cast(substr(task, 6) as bigint) % 4 <> 0")
    return U.ordered_known(lines, "task", "line_no", known).withColumn("place", F.col("place").cast("long"))


@query(sql("catalog", "SELECT dataset FROM catalog WHERE task IN ('ASIA', 'EUROPE')"))
def set_union_task_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).where(F.col("task").isin("ASIA", "EUROPE")).select("dataset")
