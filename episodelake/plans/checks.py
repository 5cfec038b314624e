"""Queries of the filters and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodelake.functions.scalars import describe_source
from episodelake.lenses import catalog, chunks, dataset_features, frames, prompts, sql, vectors
from episodelake.operators import checks as K
from episodelake.operators import columns as C
from episodelake.operators.windows import episode_offsets
from episodelake.paths import put_bytes
from episodelake.plans.sources import chunk_files
from episodelake.plans.windows import episodes
from episodelake.registry import query
from episodelake.sources.guarded import quarantined, read_footers, read_guarded, read_json_guarded


@query(sql("frames", "SELECT episode_index, frame_index, value FROM frames WHERE episode_index IN (1, 5) OR episode_index BETWEEN 10 AND 12"))
def flt_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return K.keep_episodes(frames(spark, sf), [1, 5, [10, 12]]).select("episode_index", "frame_index", "value")


@query(sql("frames", "SELECT episode_index, frame_index FROM frames WHERE frame_index + 7 < ep_len"))
def flt_unpadded_windows(spark: SparkSession, sf: str) -> DataFrame:
    # whether a window of 8 is padded is known from the episode's length
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("frame_index") + i >= F.col("ep_len"))
    return K.unpadded(frames(spark, sf).select("episode_index", "frame_index", mask.alias("is_pad"))).select("episode_index", "frame_index")


@query(sql("frames", """g AS (SELECT episode_index, frame_index, timestamp - lag(timestamp) OVER (PARTITION BY episode_index ORDER BY frame_index) AS gap FROM frames)
SELECT episode_index, frame_index, round(gap, 6) AS gap FROM g WHERE abs(gap - 30000) > 25000"""))
def chk_timestamp_sync(spark: SparkSession, sf: str) -> DataFrame:
    bad = K.timestamp_offenders(frames(spark, sf), ["episode_index"], "frame_index", "timestamp", 30000.0, 25000.0)
    return bad.select("episode_index", "frame_index", F.round("gap", 6).alias("gap"))


@query(sql("catalog", """d AS (SELECT dataset_id, fps, i * CAST(0.02 AS double) AS delta FROM catalog, LATERAL unnest(range(0, 8)) t(i))
SELECT dataset_id, round(delta, 6) AS delta, abs(delta * fps - CAST(round_even(delta * fps, 0) AS double)) / fps > 1e-4 AS bad FROM d"""))
def chk_delta_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    d = catalog(spark, sf).select("dataset_id", "fps", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).withColumn("delta", F.col("i") * F.lit(0.02))
    return d.select("dataset_id", F.round("delta", 6).alias("delta"), K.off_grid(F.col("delta"), F.col("fps"), 1e-4).alias("bad"))


@query(sql("dataset_features", """h AS (SELECT dataset_id, CASE WHEN dataset_id % 7 = 0 THEN feature || '/x' ELSE feature END AS feature FROM dataset_features WHERE NOT (dataset_id % 5 = 0 AND feature = 'BUILDING')),
s AS (SELECT DISTINCT feature FROM dataset_features WHERE feature <> 'MACHINERY')
SELECT DISTINCT dataset_id, s.feature, 'missing' AS problem FROM (SELECT DISTINCT dataset_id FROM h) d, s WHERE (dataset_id, s.feature) NOT IN (SELECT (dataset_id, feature) FROM h)
UNION ALL SELECT dataset_id, feature, 'extra' FROM h WHERE feature NOT IN (SELECT feature FROM s) UNION ALL SELECT dataset_id, feature, 'slash' FROM h WHERE contains(feature, '/')"""))
def chk_feature_presence(spark: SparkSession, sf: str) -> DataFrame:
    d = dataset_features(spark, sf)
    name = F.when(F.col("dataset_id") % 7 == 0, F.concat("feature", F.lit("/x"))).otherwise(F.col("feature"))
    have = d.where("not (dataset_id % 5 = 0 and feature = 'BUILDING')").select("dataset_id", name.alias("feature"))
    return K.feature_presence(have, d.select("feature").distinct().where("feature <> 'MACHINERY'"))


@query(sql("vectors", """w AS (SELECT vec_id, label, len(v[1:60 + label]) AS got FROM vectors), a AS (SELECT vec_id, CAST(got AS int) AS got, 64 AS expected, 'width' AS problem FROM w WHERE got <> 64),
b AS (SELECT vec_id, NULL::int, NULL::int, 'image' FROM vectors WHERE vec_id % 3 = 2), c AS (SELECT NULL::bigint, NULL::int, NULL::int, unnest(['label: integer for int64', 'v: 1 levels of arrays for the shape [4, 16]', 'wrist: missing']))
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""))
def chk_dtype_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Widths of vectors, shapes of images (every third is neither CHW nor HWC), and the schema against its spec."""
    v = vectors(spark, sf)
    widths = K.width_errors(v.withColumn("w", C.cut_to(F.col("v"), F.col("label") + 60)), "w", F.lit(64)).select("vec_id", "got", "expected", F.lit("width").alias("problem"))
    cut = lambda x, n: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / n).cast("int") - 1), lambda i: F.slice(x, i * n + 1, n))
    chw, hwc, odd = cut(cut(F.slice("v", 1, 48), 4), 4), cut(cut(F.slice("v", 1, 48), 3), 4), cut(cut(F.slice("v", 1, 48), 6), 4)
    pixels = F.when(F.col("vec_id") % 3 == 0, chw).when(F.col("vec_id") % 3 == 1, hwc).otherwise(odd)
    images = v.where(~K.image_shape_ok(pixels, 3, 4, 4)).select("vec_id", F.lit(None).cast("int").alias("got"), F.lit(None).cast("int").alias("expected"), F.lit("image").alias("problem"))
    spec = {"vec_id": {"dtype": "int64", "shape": [1]}, "label": {"dtype": "int64", "shape": [1]}, "v": {"dtype": "float64", "shape": [4, 16]}, "pose7": {"dtype": "float64", "shape": [7]}, "wrist": {"dtype": "image", "shape": [3, 4, 4]}}
    schema = spark.createDataFrame([(None, None, None, e) for e in K.declared_dtype_errors(v, spec)], "vec_id long, got int, expected int, problem string")
    return widths.unionByName(images).unionByName(schema)


@query(sql("frames", """o AS (SELECT episode_index, sum(n) OVER (ORDER BY episode_index) - n AS f FROM (SELECT episode_index, count(*) AS n FROM frames GROUP BY 1)),
x AS (SELECT * FROM frames WHERE NOT (episode_index % 10 = 3 AND frame_index = 2))
SELECT episode_index, count(*) AS n, min(frame_index) = 0 AND max(frame_index) = count(*) - 1 AND count(DISTINCT frame_index) = count(*) AS gapless, min(index) = any_value(f) AS index_ok, count(*) FILTER (WHERE value IS NULL OR k IS NULL) AS null_rows
FROM x JOIN o USING (episode_index) GROUP BY 1"""))
def chk_episode_integrity(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).where("not (episode_index % 10 = 3 and frame_index = 2)")
    return K.episode_integrity(f, "episode_index", "frame_index", "index", episode_offsets(episodes(spark, sf)), ["value", "k"])


@query(sql("chunks", """a AS (SELECT episode_index, count(*) AS p FROM chunks WHERE offset_in_chunk = 0 GROUP BY 1), t AS (SELECT episode_index, count(*) FILTER (WHERE frame_index % 4 = 0 AND NOT (episode_index % 6 = 0 AND frame_index = 0)) AS t FROM frames GROUP BY 1)
SELECT episode_index, p AS n_pred, t AS n_truth, p = t AS ok FROM a JOIN t USING (episode_index)"""))
def chk_equal_lengths(spark: SparkSession, sf: str) -> DataFrame:
    pred = chunks(spark, sf).where("offset_in_chunk = 0").groupBy("episode_index").agg(F.count("pred").alias("n_pred"))
    truth = frames(spark, sf).where("frame_index % 4 = 0 and not (episode_index % 6 = 0 and frame_index = 0)").groupBy("episode_index").agg(F.count("value").alias("n_truth"))
    return pred.join(truth, "episode_index").withColumn("ok", K.equal_counts([F.col("n_pred"), F.col("n_truth")]))


@query("""WITH e AS (SELECT user_id, CAST(floor(user_id / 50) AS bigint) AS chunk, event_id FROM events),
a AS (SELECT concat('chunk ', chunk) AS part, count(*) AS actual FROM e WHERE event_id % 97 <> 0 OR chunk <> 1 GROUP BY 1), d AS (SELECT concat('chunk ', chunk) AS part, count(*) AS declared FROM e WHERE user_id <> 7 GROUP BY 1),
r AS (SELECT concat('rank ', event_id % 4) AS part, count(*) AS actual FROM e WHERE event_id % 97 <> 0 OR chunk <> 1 GROUP BY 1)
SELECT part, actual, declared, coalesce(actual = declared, false) AS ok FROM a FULL JOIN d USING (part)
UNION ALL SELECT part, actual, first_value(actual) OVER (ORDER BY part), actual = first_value(actual) OVER (ORDER BY part) FROM r""")
def chk_row_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by the footers of a lake against its episodes' lengths, some of both left out, and the rows of four ranks."""
    stored = frames(spark, sf).where("index % 97 <> 0 or floor(episode_index / 50) <> 1")
    root = chunk_files(stored)
    footers = read_footers(spark, f"{root}/data")
    part = F.concat(F.lit("chunk "), F.regexp_extract("file", r"chunk=0*(\d+)", 1))
    actual = footers.groupBy(part.alias("part")).agg(F.sum("rows").alias("rows"))
    declared = episodes(spark, sf).where("episode_index <> 7").groupBy(F.concat(F.lit("chunk "), F.floor(F.col("episode_index") / 50).cast("string")).alias("part")).agg(F.sum("length").alias("rows"))
    ranks = spark.read.parquet(f"{root}/data").select((F.col("index") % 4).alias("rank"))
    same = K.equal_ranks(ranks, "rank").select(F.concat(F.lit("rank "), F.col("rank").cast("string")).alias("part"), "actual", "declared", "ok")
    return K.reconcile(actual, declared, ["part"]).unionByName(same)


@query(sql("catalog", "SELECT fps, count(*) AS datasets, count(*) = (SELECT count(*) FROM catalog) AS only_one FROM catalog GROUP BY fps"))
def chk_fps_consistency(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark, sf)
    total = c.agg(F.count(F.lit(1)).alias("n"))
    by_fps = c.groupBy("fps").agg(F.count(F.lit(1)).alias("datasets"))
    return by_fps.crossJoin(F.broadcast(total)).select("fps", "datasets", (F.col("datasets") == F.col("n")).alias("only_one"))


@query(sql("vectors", "SELECT vec_id, len(v[1:7]) = 7 AS raw_ok, len(v[1:label]) = 5 AS shaped_ok FROM vectors"))
def chk_vector_width(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return v.select("vec_id", (F.size("pose7") == 7).alias("raw_ok"), (F.size(F.slice("v", 1, F.col("label"))) == 5).alias("shaped_ok"))


@query(sql("prompts", """p AS (SELECT pos, CASE WHEN pos % 50 = 0 THEN '' ELSE concat(dataset, '/', pos % 300) END AS path FROM prompts), e AS (SELECT DISTINCT path FROM p WHERE path <> '' AND pos % 9 <> 0),
r AS (SELECT pos, path, row_number() OVER (PARTITION BY path ORDER BY pos) AS r, path IN (SELECT path FROM e) AS there FROM p)
SELECT pos, path, CASE WHEN path = '' THEN 'empty' WHEN r > 1 THEN 'duplicate' ELSE 'missing' END AS problem FROM r WHERE path = '' OR r > 1 OR NOT there"""))
def chk_dataset_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("pos") % 50 == 0, "").otherwise(F.concat("dataset", F.lit("/"), (F.col("pos") % 300).cast("string")))
    p = prompts(spark, sf).select("pos", path.alias("path"))
    return K.path_problems(p, p.where("path <> '' and pos % 9 <> 0").select("path").distinct())


@query(sql("frames", """b AS (SELECT 'frame' AS kind, index, CASE WHEN value > 120 THEN 'value too large' WHEN k > 8 THEN 'k too large' END AS reason,
  concat('dataset=', source, ' episode=', episode_index, ' frame=', frame_index) AS described FROM frames WHERE floor(episode_index / 50) <> 0 AND (value > 120 OR k > 8)
  UNION ALL SELECT DISTINCT 'frame', NULL, 'unreadable file', 'file=chunk=000000' FROM frames WHERE floor(episode_index / 50) = 0
  UNION ALL SELECT DISTINCT 'episode', NULL, 'not a record', concat('{"episode_index":', episode_index, ',"length"') FROM frames WHERE episode_index % 40 = 0),
n AS (SELECT kind, index, reason, described, count(*) OVER (PARTITION BY kind, reason) AS n FROM b)
SELECT * FROM n UNION ALL SELECT 'frame', NULL, '', '', count(*) FROM frames WHERE floor(episode_index / 50) <> 0 AND NOT (value > 120 OR k > 8)
UNION ALL SELECT 'episode', NULL, '', '', count(DISTINCT episode_index) FROM frames WHERE episode_index % 40 <> 0"""))
def qrn_bad_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A lake with a cut data file, frames against the rules and cut lines of metadata: each bad row or file with its reason and its reason's count, and the good ones' number."""
    root = chunk_files(frames(spark, sf))
    cut = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{root}/data/chunk=000000").select("path", "content").first()
    if cut:
        put_bytes(spark, cut["path"], bytes(cut["content"])[:-100])
    kind = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("episode_index", T.LongType()), ("frame_index", T.LongType()), ("index", T.LongType()), ("value", T.DoubleType()), ("k", T.DoubleType()))])
    rules = {"unreadable file": F.col("problem").isNotNull(), "value too large": F.col("value") > 120, "k too large": F.col("k") > 8}
    unreadable = F.concat(F.lit("file="), F.regexp_extract("file", r"(chunk=\d+)", 1))
    described = F.when(F.col("problem").isNotNull(), unreadable).otherwise(describe_source(F.col("source"), F.col("episode_index"), F.col("frame_index")))
    _, bad, counts = quarantined(read_guarded(spark, f"{root}/data", kind), rules, described)

    line = F.to_json(F.struct("episode_index", "length"))
    lines = episodes(spark, sf).select(F.when(F.col("episode_index") % 40 == 0, F.regexp_extract(line, '^(.*"length")', 1)).otherwise(line).alias("value"))
    lines.write.text(f"{root}/meta/episodes.jsonl")
    records = read_json_guarded(spark, f"{root}/meta/episodes.jsonl", T.StructType.fromDDL("episode_index long, length long"))
    _, bad_lines, line_counts = quarantined(records, {"not a record": F.col("problem").isNotNull()}, F.regexp_replace("problem", "^not a record: ", ""))

    def told(kind: str, rows: DataFrame, index: str, counts: dict[str, int]) -> DataFrame:
        n = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
        good = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("index"), F.lit("").alias("reason"), F.lit("").alias("described"), F.lit(counts[""]).cast("long").alias("n"))
        return rows.select(F.lit(kind).alias("kind"), F.expr(index).alias("index"), "reason", "described", n[F.col("reason")].cast("long").alias("n")).unionByName(good)

    return told("frame", bad, "index", counts).unionByName(told("episode", bad_lines, "cast(null as long)", line_counts))
