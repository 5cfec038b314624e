"""Queries of the projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.lenses import dataset_features, frames, prompts, sql, table, vectors
from episodelake.operators import columns as C
from episodelake.operators.windows import forward_replicate
from episodelake.operators.stats import exact_quantiles
from episodelake.registry import query


def state() -> Column:
    return F.array("value", "k")


def r6(c: Column | str) -> Column:
    """Rounded to six places, without negative zeros."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def numbers(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One row per number of a vector column."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumns({"pos": F.col("pos").cast("long"), "x": r6("x")})


@query(sql("frames", "SELECT episode_index, frame_index, index, round(timestamp, 6) AS timestamp, value FROM frames"))
def prj_required_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.required_columns(frames(spark, sf), ["value"]).withColumn("timestamp", F.round("timestamp", 6))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'observation.state' WHEN 'view' THEN 'action' ELSE 'observation.images' END
  || CASE WHEN user_id % 4 = 0 THEN '' ELSE '.k' || CAST(user_id % 4 AS varchar) END AS feature FROM events""")
def prj_feature_keys(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "state").when(F.col("event_type") == "view", "action").otherwise("images")
    key = F.when(F.col("user_id") % 4 == 0, "default").otherwise(F.concat(F.lit("k"), (F.col("user_id") % 4).cast("string")))
    return table(spark, sf, "events").select("event_id", C.feature_key(kind, key).alias("feature"))


@query(sql("frames", "SELECT episode_index, frame_index, k AS cam_wrist, value AS cam_high, value > 50 AS cam_high_is_pad FROM frames"))
def prj_canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).select("episode_index", "frame_index", F.col("value").alias("top_view"), (F.col("value") > 50).alias("top_view_is_pad"), F.col("k").alias("cam_wrist"), F.col("value").alias("wrist_view"))
    return C.canonical_names(f, {"top_view": "cam_high", "wrist_view": "cam_wrist"})


@query(sql("prompts", """SELECT pos, CASE WHEN contains(lower(task), 'src1') THEN 'src1' WHEN contains(lower(task), 'en task') THEN 'en task' WHEN contains(lower(task), 'src') THEN 'src' END AS source FROM prompts"""))
def prj_source_detect(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).select("pos", C.detect_source(F.upper("task"), ["src1", "en task", "src"]).alias("source"))


@query(sql("vectors", """c AS (SELECT vec_id, v[1:16 + label] AS w FROM vectors)
SELECT vec_id, CAST(i AS bigint) AS pos, round(w[i + 1], 6) + 0.0 AS x FROM c, LATERAL unnest(range(0, len(w))) t(i)"""))
def prj_dim_slice(spark: SparkSession, sf: str) -> DataFrame:
    return numbers(vectors(spark, sf).withColumn("w", C.cut_to(F.col("v"), F.col("label") + 16)), ["vec_id"], "w")


@query(sql("frames", "SELECT episode_index, frame_index, CASE WHEN source IN ('alpha', 'beta') THEN value ELSE k END AS action FROM frames"))
def prj_obs_as_action(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("episode_index", "frame_index", F.when(F.col("source").isin("alpha", "beta"), F.col("value")).otherwise(F.col("k")).alias("action"))


@query(sql("frames", """SELECT episode_index, frame_index, CAST(i AS bigint) AS pos, [value, k, value, 0.0, 0.0][i + 1] AS x, i >= 3 AS is_pad
  FROM frames, LATERAL unnest(range(0, 5)) t(i)"""))
def prj_concat_left_align(spark: SparkSession, sf: str) -> DataFrame:
    whole, pad = C.concat_left_align([state(), F.array("value")], 5)
    f = frames(spark, sf).select("episode_index", "frame_index", F.posexplode(F.arrays_zip(whole.alias("x"), pad.alias("is_pad"))).alias("pos", "z"))
    return f.select("episode_index", "frame_index", F.col("pos").cast("long").alias("pos"), "z.x", "z.is_pad")


@query(sql("vectors", """SELECT vec_id, part, CAST(i AS bigint) AS pos, round(w[i + 1], 6) + 0.0 AS x
FROM (SELECT vec_id, 'arm' AS part, v[1:7] AS w FROM vectors UNION ALL SELECT vec_id, 'hand', v[8:8] FROM vectors UNION ALL SELECT vec_id, 'head', v[9:10] FROM vectors), LATERAL unnest(range(0, len(w))) t(i)"""))
def prj_split_vector(spark: SparkSession, sf: str) -> DataFrame:
    widths = {"arm": 7, "hand": 1, "head": 2}
    s = vectors(spark, sf).select("vec_id", C.split_vector(F.col("v"), widths).alias("s"))
    long = s.select("vec_id", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col(f"s.{n}").alias("w")) for n in widths])).alias("p"))
    return numbers(long.select("vec_id", "p.part", "p.w"), ["vec_id", "part"], "w")


@query(sql("vectors", """SELECT vec_id, round(list_sum(v[1:3]), 6) + 0.0 AS base, round(list_sum(v[4:7]), 6) + 0.0 AS torso, round(list_sum(v[8:14]), 6) + 0.0 AS left_arm, round(v[15], 6) + 0.0 AS left_gripper,
  round(list_sum(v[16:22]), 6) + 0.0 AS right_arm, round(v[23], 6) + 0.0 AS right_gripper, round(list_sum(v[24:25]), 6) + 0.0 AS head FROM vectors"""))
def prj_action_groups(spark: SparkSession, sf: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    s = vectors(spark, sf).select("vec_id", C.split_vector(C.cut_to(F.col("v"), 25), C.ACTION_GROUPS).alias("s"))
    return s.select("vec_id", *[r6(total(F.col(f"s.{g}"))).alias(g) for g in C.ACTION_GROUPS])


@query(sql("frames", "SELECT episode_index, frame_index, CAST(i AS bigint) AS pos, round([value, k, timestamp][i + 1], 6) + 0.0 AS x FROM frames, LATERAL unnest(range(0, 3)) t(i)"))
def prj_vector_from_names(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("v", F.array(*[F.col(n) for n in ("value", "k", "timestamp")]))
    return numbers(f, ["episode_index", "frame_index"], "v")


@query(sql("frames", """SELECT episode_index, frame_index, round(CASE WHEN contains(task, 'cli') THEN k ELSE value - 1 END, 6) + 0.0 AS first, k AS second FROM frames"""))
def prj_build_state(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.when(F.col("task").contains("cli"), "base_vel").otherwise("base_pos")
    built = C.build_state([F.array("value"), F.array("k")], F.array("k"), F.array(F.lit(1.0)), mode)
    return frames(spark, sf).select("episode_index", "frame_index", built.alias("s")).select("episode_index", "frame_index", r6(F.col("s")[0]).alias("first"), F.col("s")[1].alias("second"))


@query("""SELECT o_orderkey AS "id", o_custkey AS "who/cust", o_orderstatus AS "what/status/code", o_totalprice AS "what/price" FROM orders""")
def prj_flatten_nested(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    what = F.struct(F.struct(F.col("o_orderstatus").alias("code")).alias("status"), F.col("o_totalprice").alias("price"))
    return C.flatten_nested(o.select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("cust")).alias("who"), what.alias("what")))


@query("SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS code FROM orders")
def prj_unflatten(spark: SparkSession, sf: str) -> DataFrame:
    nested = C.unflatten(prj_flatten_nested(spark, sf))
    return nested.select("id", F.col("who.cust").alias("cust"), F.col("what.status.code").alias("code"))


@query(sql("frames", """SELECT episode_index, frame_index, round(k * 2 - 1, 6) + 0.0 AS scaled, 0.0 - k AS negated, CAST(sign(k) AS double) AS signed, CASE WHEN k > 0.5 THEN 1.0::double ELSE 0.0::double END AS closed FROM frames"""))
def prj_gripper(spark: SparkSession, sf: str) -> DataFrame:
    last = lambda mode: F.element_at(C.gripper(state(), mode), -1) + F.lit(0.0)
    return frames(spark, sf).select(
        "episode_index", "frame_index", r6(last("scale")).alias("scaled"), last("negate").alias("negated"), last("sign").alias("signed"), last("binary").alias("closed")
    )


@query(sql("frames", """SELECT a.episode_index, a.frame_index, CAST(o AS bigint) AS pos, b.value AS x FROM frames a, LATERAL unnest(range(0, 3)) t(o)
JOIN frames b ON b.episode_index = a.episode_index AND b.frame_index = least(a.frame_index + o, a.ep_len - 1)"""))
def prj_drop_last_step(spark: SparkSession, sf: str) -> DataFrame:
    f = forward_replicate(frames(spark, sf), "value", 4, ["episode_index"], "frame_index")
    return numbers(f.withColumn("w", C.drop_last(F.col("window"))), ["episode_index", "frame_index"], "w").withColumn("x", F.col("x"))


@query(sql("frames", """SELECT a.episode_index, a.frame_index, CAST(o AS bigint) AS step, CASE WHEN a.frame_index + o >= a.ep_len THEN 0.0 ELSE b.value END AS delta, b.k AS grip FROM frames a, LATERAL unnest(range(0, 4)) t(o)
JOIN frames b ON b.episode_index = a.episode_index AND b.frame_index = least(a.frame_index + o, a.ep_len - 1)"""))
def prj_zero_padded_delta(spark: SparkSession, sf: str) -> DataFrame:
    f = forward_replicate(frames(spark, sf).withColumn("s", state()), "s", 4, ["episode_index"], "frame_index")
    z = C.zero_padded(F.col("window"), F.col("is_pad"), F.array(F.lit(True), F.lit(False)))
    out = f.select("episode_index", "frame_index", F.posexplode(z).alias("step", "v"))
    return out.select("episode_index", "frame_index", F.col("step").cast("long").alias("step"), F.col("v")[0].alias("delta"), F.col("v")[1].alias("grip"))


@query(sql("vectors", """SELECT vec_id, CAST(i AS bigint) AS row, round(CASE WHEN i < label % 5 THEN list_sum(v[i * 16 + 1:i * 16 + 16]) ELSE 0.0 END, 6) + 0.0 AS total, true AS mask
FROM vectors, LATERAL unnest(range(0, 4)) t(i)"""))
def prj_zero_masked_context(spark: SparkSession, sf: str) -> DataFrame:
    context = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 16 + 1, 16))
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("label") % 5)
    z = vectors(spark, sf).select("vec_id", F.posexplode(C.zero_masked(context, mask)).alias("row", "v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return z.select("vec_id", F.col("row").cast("long").alias("row"), r6(total).alias("total"), F.lit(True).alias("mask"))


@query(sql("frames", """s AS (SELECT CASE source WHEN 'alpha' THEN 'observation.state' WHEN 'beta' THEN 'action' ELSE 'action.gripper' END AS key, source, min(value) AS mn, max(value) AS mx, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, CASE WHEN source = 'alpha' THEN quantile_cont(value, 0.01) END AS q01 FROM frames GROUP BY source),
w AS (SELECT * FROM (VALUES ('observation.state.left', 'observation.state'), ('observation.state', 'observation.state'), ('action.arm', 'action'), ('action.gripper', 'action.gripper')) t(feature, key)),
l AS (SELECT feature, key AS found, unnest(['min', 'max', 'mean', 'std', 'q01', 'q99']) AS stat, unnest([mn, mx, mean, std, coalesce(q01, mn), mx]) AS value FROM s JOIN w USING (key))
SELECT feature, found, stat, round(value, 6) AS value, scope FROM l, (VALUES ('global'), ('stepwise')) t(scope)"""))
def prj_stats_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's statistics stand under a key; wanted features fall back to their parent key."""
    f = frames(spark, sf)
    key = F.when(F.col("source") == "alpha", "observation.state").when(F.col("source") == "beta", "action").otherwise("action.gripper")
    wide = f.groupBy("source").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))
    q01 = F.when(F.col("source") == "alpha", F.col("q")[0])
    wide = wide.join(exact_quantiles(f, ["source"], "value", [0.01]), "source").select(key.alias("feature"), "min", "max", "mean", "std", q01.alias("q01"), F.lit(None).cast("double").alias("q99"))
    wanted = spark.createDataFrame([("observation.state.left",), ("observation.state",), ("action.arm",), ("action.gripper",)], "feature string")
    return C.with_parent_stats(wanted, C.stats_fields(wide)).withColumn("value", F.round("value", 6))


@query(sql("prompts", """SELECT pos, CASE WHEN pos % 3 <> 0 THEN CASE WHEN dataset IN ('src1', 'src2') THEN 'pretrained' ELSE 'meta' END
  WHEN contains(lower(task), 'src1') OR contains(lower(task), 'src2') THEN 'pretrained' ELSE 'meta' END AS stats FROM prompts"""))
def prj_norm_source(spark: SparkSession, sf: str) -> DataFrame:
    p = prompts(spark, sf).withColumn("src", F.when(F.col("pos") % 3 != 0, F.col("dataset")))
    return p.select("pos", C.norm_source("mixed", F.col("src"), F.col("task"), ["src1", "src2"]).alias("stats"))


@query(sql("dataset_features", """s AS (SELECT feature, dataset_id AS pos, CASE WHEN feature = 'BUILDING' AND dataset_id = 3 THEN 'int64' ELSE 'float32' END AS dtype, feature = 'MACHINERY' AS image, 'd' || CAST(dataset_id % 4 AS varchar) AS name FROM dataset_features),
f AS (SELECT feature, name, min(pos) AS pos, max(pos) AS newest FROM s GROUP BY ALL),
c AS (SELECT feature, count(DISTINCT dtype) > 1 AND NOT bool_or(image) AS dtype_clash, arg_max(dtype, pos) AS dtype, bool_or(image) AS image, max(pos) AS last FROM s GROUP BY feature)
SELECT feature, name, row_number() OVER (PARTITION BY feature ORDER BY pos, name) - 1 AS at, dtype, dtype_clash FROM f JOIN c USING (feature) WHERE NOT image OR newest = last"""))
def prj_merge_feature_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors but for one feature of images, of which the last dataset's spec counts; one dtype clashes."""
    d = dataset_features(spark, sf)
    odd = (F.col("feature") == "BUILDING") & (F.col("dataset_id") == 3)
    dims = F.when(F.col("feature") == "MACHINERY", 3).otherwise(1)
    specs = d.select("feature", F.col("dataset_id").alias("pos"), F.when(odd, "int64").otherwise("float32").alias("dtype"), dims.alias("n_dims"), F.concat(F.lit("d"), (F.col("dataset_id") % 4).cast("string")).alias("name"))
    return C.merge_specs(specs, strict=False).withColumn("at", F.col("at").cast("long"))
