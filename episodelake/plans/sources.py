"""Queries of sources and sinks: what they write comes from the tables, and is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.lenses import catalog, eval_results, frames, log_lines, prompts, sql
from episodelake.operators.evals import suite_summary
from episodelake.operators.stats import feature_stats
from episodelake.operators.windows import episode_offsets, places
from episodelake.paths import scratch
from episodelake.plans.projections import state
from episodelake.plans.windows import episodes
from episodelake.registry import query
from episodelake.sources import lake as L
from episodelake.sources.discovery import discover
from episodelake.sources.guarded import read_footers

FEATURES = {n: {"dtype": d, "shape": s} for n, d, s in (("episode_index", "int64", [1]), ("frame_index", "int64", [1]), ("index", "int64", [1]), ("timestamp", "float64", [1]), ("observation.state", "float64", [2]))}


@query(sql("frames", """SELECT episode_index, frame_index, index, round(timestamp, 6) AS timestamp, value, k, episode_index IN (1, 5) OR episode_index BETWEEN 10 AND 12 AS chosen FROM frames"""))
def src_frames(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "lake")
    L.write_frames(frames(spark, sf).withColumn("observation.state", state()), root, 50)
    s = F.col("`observation.state`")
    f = L.read_frames(spark, root, FEATURES | {"observation.images.top": {"dtype": "video", "shape": [3, 8, 8]}})
    # the selected episodes are read by themselves
    chosen = L.read_frames(spark, root, FEATURES, [1, 5, [10, 12]]).select("episode_index", "frame_index", F.lit(True).alias("chosen"))
    f = f.join(chosen, ["episode_index", "frame_index"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return f.select("episode_index", "frame_index", "index", F.round("timestamp", 6).alias("timestamp"), s[0].alias("value"), s[1].alias("k"), "chosen")


@query("""WITH e AS (SELECT user_id AS episode_index, count(*) AS length FROM events GROUP BY user_id)
SELECT episode_index, length, CAST(sum(length) OVER w - length AS bigint) AS dataset_from_index, CAST(sum(length) OVER w AS bigint) AS dataset_to_index FROM e WINDOW w AS (ORDER BY episode_index)""")
def src_episodes(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "lake")
    e = episode_offsets(episodes(spark, sf)).withColumnsRenamed({"from_index": "dataset_from_index", "to_index": "dataset_to_index"}).withColumn("stats/x", F.lit(1.0))
    e.write.parquet(f"{root}/meta/episodes/chunk-000")
    return L.read_episodes(spark, root).select("episode_index", "length", "dataset_from_index", "dataset_to_index")


@query(sql("prompts", "SELECT row_number() OVER (ORDER BY task) - 1 AS task_index, task FROM (SELECT DISTINCT task FROM prompts)"))
def src_tasks(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "lake")
    L.write_tasks(places(prompts(spark, sf).select("task").distinct(), ["task"]).select(F.col("place").alias("task_index"), "task"), root)
    return L.read_tasks(spark, root)


def info_files(spark: SparkSession, sf: str, root: str) -> None:
    """One info.json per dataset of the catalogue."""
    names = F.transform(F.sequence(F.lit(0).cast("long"), F.col("dataset_id")), lambda i: F.concat(F.lit("n"), i.cast("string")))
    spec = F.struct(F.lit("float32").alias("dtype"), F.array(F.col("dataset_id") + 1).alias("shape"), names.alias("names"))
    value = F.to_json(F.struct("fps", F.col("task").alias("robot_type"), F.create_map(F.lit("action"), spec, F.concat(F.lit("x"), "dataset"), spec).alias("features")))
    catalog(spark, sf).select(value.alias("value"), F.concat(F.lit("d"), "dataset_id").alias("ds"), F.lit("info.json").alias("meta")).write.partitionBy("ds", "meta").text(root)


@query(sql("catalog", """SELECT concat('d', dataset_id) AS ds, fps, task AS robot_type, feature, 'float32' AS dtype, dataset_id + 1 AS width, array_to_string(list_transform(range(dataset_id + 1), lambda i: concat('n', i)), ',') AS names FROM catalog, LATERAL (SELECT unnest(['action', 'x' || dataset]) AS feature)"""))
def src_info(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "info")
    info_files(spark, sf, root)
    i = L.read_info(spark, f"{root}/*/*/*.txt")
    return i.select(F.regexp_extract("root", r"ds=(d\d+)", 1).alias("ds"), "fps", "robot_type", "feature", "dtype", F.col("shape")[0].alias("width"), F.array_join("names", ",").alias("names"))


STATS = "SELECT source AS feature, unnest(['max', 'mean', 'min']) AS stat, CAST(i AS bigint) AS dim, unnest([round(max([value, k][i + 1]), 6), round(avg([value, k][i + 1]), 6), round(min([value, k][i + 1]), 6)]) + 0.0 AS value FROM frames, LATERAL unnest(range(0, 2)) t(i) GROUP BY source, i"
STEPWISE = "SELECT source AS feature, 'stepwise_max' AS stat, frame_index % 4 AS step, CAST(i AS bigint) AS dim, round(max([value, k][i + 1]), 6) + 0.0 AS value FROM frames, LATERAL unnest(range(0, 2)) t(i) GROUP BY source, frame_index % 4, i"


def long_stats(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    f = frames(spark, sf).select(*keys, F.posexplode(state()).alias("dim", "x"))
    wide = feature_stats(f, [*keys, "dim"])
    stats = F.array(*[F.struct(F.lit(n).alias("stat"), (F.round(n, 6) + F.lit(0.0)).alias("value")) for n in ("max", "mean", "min")])
    return wide.select(*keys, "dim", F.explode(stats).alias("s")).select(*keys, F.col("s.stat").alias("stat"), "dim", F.col("s.value").alias("value"))


def stats_file(spark: SparkSession, sf: str) -> str:
    """Statistics of each source, by dimension and by step and dimension."""
    root = scratch(spark, "stats")
    plain = long_stats(spark, sf, ["source"]).withColumn("step", F.lit(None).cast("long"))
    f = frames(spark, sf).select("source", (F.col("frame_index") % 4).alias("step"), F.posexplode(state()).alias("dim", "x"))
    stepwise = f.groupBy("source", "step", "dim").agg((F.round(F.max("x"), 6) + F.lit(0.0)).alias("value")).withColumn("stat", F.lit("stepwise_max"))
    L.stats_tree(plain.unionByName(stepwise).withColumnRenamed("source", "feature")).write.text(root)
    return root


@query(sql("frames", f"SELECT feature, stat, NULL AS step, dim, value FROM ({STATS}) UNION ALL SELECT feature, stat, step, dim, value FROM ({STEPWISE})"))
def src_stats_json(spark: SparkSession, sf: str) -> DataFrame:
    step = F.when(F.size("at") > 1, F.col("at")[0]).cast("long")
    return L.read_stats_json(spark, stats_file(spark, sf)).select("feature", "stat", step.alias("step"), F.col("dim").cast("long").alias("dim"), "value")


@query(sql("frames", STATS.replace("source AS feature", "episode_index, 'state' AS feature").replace("GROUP BY source, i", "GROUP BY episode_index, i")))
def src_episode_stats(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "episode-stats")
    s = long_stats(spark, sf, ["episode_index"])
    arrays = s.groupBy("episode_index", "stat").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v"))
    rows = arrays.groupBy("episode_index").agg(F.map_from_entries(F.collect_list(F.struct("stat", "v"))).alias("m"))
    rows.select("episode_index", F.create_map(F.lit("state"), "m").alias("stats")).write.json(root)
    return L.read_episode_stats(spark, root).withColumn("dim", F.col("dim").cast("long"))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """All kinds of annotations of all events, written and read back."""
    from episodelake.lenses import table

    root = scratch(spark, "annotations")
    e = table(spark, sf, "events")
    for kind, file in L.ANNOTATIONS.items():
        e.select(F.col("event_id").alias(f"{kind}_index"), F.concat("event_type", F.lit(f" {kind}")).alias(kind)).write.json(f"{root}/{file}")
    return L.read_annotations(spark, root)


@query("""SELECT kind, event_id AS index, concat(event_type, ' ', kind) AS text FROM events, (VALUES ('subtask'), ('scene'), ('gripper_mode'), ('gripper_activity'), ('eef_velocity'), ('eef_acc_mag'), ('eef_direction')) t(kind)""")
def src_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return annotations(spark, sf)


@query(sql("catalog", """d AS (SELECT concat('d', dataset_id) AS dataset, CASE WHEN dataset_id % 3 = 2 THEN 'beta' ELSE 'alpha' END AS root FROM catalog)
SELECT row_number() OVER (ORDER BY root, dataset) - 1 AS place, root, dataset FROM d"""))
def src_discover_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Three roots: one lists datasets that lie elsewhere, by absolute and relative paths, twice or not at all there; one has children; one is a dataset of the first's list."""
    top = scratch(spark, "roots")
    c = catalog(spark, sf).select(F.concat(F.lit("d"), "dataset_id").alias("d"), (F.col("dataset_id") % 3).alias("r"), F.to_json(F.struct("fps")).alias("text"))
    folder = F.when(F.col("r") == 2, "beta/").otherwise("pool/")
    L.write_texts(c.select(F.concat(folder, "d", F.lit("/meta/info.json")).alias("path"), "text"), top)
    L.write_texts(c.where("r = 2").select(F.concat(F.lit("beta/"), "d", F.lit("x/data/readme.json")).alias("path"), "text"), top)
    absolute = F.array(F.concat(F.lit(f"{top}/pool/"), "d"), F.concat(F.lit(f"{top}/none/"), "d"))
    relative = F.array(F.concat(F.lit("../pool/./x/../"), "d"), F.concat(F.lit("../pool/"), "d", F.lit("/")))
    paths = c.where("r < 2").agg(F.flatten(F.collect_list(F.when(F.col("r") == 0, absolute).otherwise(relative))).alias("dataset_paths"))
    L.write_texts(paths.select(F.lit("alpha/dataloader.json").alias("path"), F.to_json(F.struct("dataset_paths")).alias("text")), top)
    found = discover(spark, [f"{top}/alpha", f"{top}/beta/", f"{top}/pool/d3", f"{top}/nowhere"])
    last = lambda p: F.regexp_extract(p, "([^/]+)/?$", 1)
    return found.select("place", last("root").alias("root"), last("dataset").alias("dataset"))


@query(sql("catalog", "SELECT task, dataset FROM catalog"))
def src_catalog(spark: SparkSession, sf: str) -> DataFrame:
    text = catalog(spark, sf).groupBy("task").agg(F.concat(F.lit("\n"), F.array_join(F.collect_list("dataset"), "\n \n"), F.lit("\n")).alias("lines"))
    return L.catalogue(text, "task", "lines")


@query(sql("eval_results", "SELECT suite, trial, success, CAST(task_id AS int) AS task_id FROM eval_results"))
def src_eval_results(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "results")
    eval_results(spark, sf).select("suite", "trial", "success", "file_name").repartition("file_name").write.partitionBy("file_name").json(root)
    return L.read_eval_results(spark, root).select("suite", "trial", "success", "task_id")


@query(sql("log_lines", "SELECT run, CAST(sum(length(line) + 1) AS bigint) AS chars, count(*) AS lines FROM log_lines GROUP BY run"))
def src_eval_logs(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "logs")
    log_lines(spark, sf).select(F.col("line").alias("value"), "run").repartition("run").write.partitionBy("run").text(root)
    logs = L.read_logs(spark, f"{root}/*/*.txt").withColumn("run", F.regexp_extract("path", r"run=(\d+)", 1).cast("long"))
    return logs.groupBy("run").agg(F.sum(F.length("line") + 1).alias("chars"), F.count(F.lit(1)).alias("lines"))


def chunk_files(frames_: DataFrame) -> str:
    """The root of a lake with a data file for each fifty episodes."""
    root = scratch(frames_.sparkSession, "chunks")
    rows = frames_.withColumn("chunk", F.format_string("%06d", F.floor(F.col("episode_index") / 50))).repartition("chunk")
    rows.sortWithinPartitions("chunk", "index").write.partitionBy("chunk").parquet(f"{root}/data")
    return root


@query("""SELECT printf('%06d', CAST(floor(user_id / 50) AS bigint)) AS chunk, count(*) AS rows, min(event_id) AS first_index, max(event_id) AS last_index, count(*) FILTER (WHERE value IS NULL) AS null_values, true AS sizes_ok FROM events GROUP BY 1""")
def src_file_footprint(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, bounds and sizes of data files from their footers; compressed data is smaller than its file."""
    f = read_footers(spark, f"{chunk_files(frames(spark, sf))}/data")
    c = F.col("columns")
    sizes = (F.col("compressed") < F.col("bytes")) & (F.col("uncompressed") > 0) & (F.col("row_groups") > 0) & F.col("problem").isNull()
    return f.select(F.regexp_extract("file", r"chunk=(\d+)", 1).alias("chunk"), "rows", c["index"]["min"].cast("long").alias("first_index"), c["index"]["max"].cast("long").alias("last_index"), c["value"]["nulls"].alias("null_values"), sizes.alias("sizes_ok"))


def appended(spark: SparkSession, sf: str) -> str:
    """A lake to which the episodes of each source were appended in turn."""
    root = scratch(spark, "append")
    f = frames(spark, sf).select(F.col("episode_index").alias("episode"), "frame_index", "value", "source", "task")
    for source in ("alpha", "beta", "gamma"):
        L.append_episodes(spark, f.where(F.col("source") == source), root, 20, ["value"], cameras=2, bytes_per_file=40_000, task="task")
    return root


@query(sql("frames", """t AS (SELECT count(DISTINCT episode_index) AS n, count(*) AS total_frames, count(DISTINCT task) AS total_tasks, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM frames)
SELECT source, count(DISTINCT episode_index) AS episodes, count(*) AS frames, any_value(n) AS total_episodes, any_value(total_frames) AS total_frames, CAST(ceil(any_value(n) / 20.0) AS bigint) AS total_chunks, any_value(n) * 2 AS total_videos, any_value(total_tasks) AS total_tasks, count(DISTINCT (task, episode_index)) AS episode_tasks, bool_and(true) AS tasks_ok,
concat('0:', any_value(n)) AS split, any_value(mean) AS mean, any_value(std) AS std, any_value(min) AS min, any_value(max) AS max FROM frames, t GROUP BY source"""))
def sink_append_episodes(spark: SparkSession, sf: str) -> DataFrame:
    root = appended(spark, sf)
    stored = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data")
    s = L.read_stats_json(spark, f"{root}/meta/stats.json")
    stats = s.agg(*[F.round(F.max(F.when(F.col("stat") == n, F.col("value"))), 6).alias(n) for n in ("mean", "std", "min", "max")])
    meta = L.read_episodes(spark, root).select("episode_index", "tasks")
    named = stored.join(L.read_tasks(spark, root), "task_index").join(meta, "episode_index")
    per = named.groupBy("source").agg(
        F.countDistinct("episode_index").alias("episodes"), F.countDistinct("index").alias("frames"), F.countDistinct("task", "episode_index").alias("episode_tasks"), F.bool_and(F.array_contains("tasks", F.col("task"))).alias("tasks_ok")
    )
    return per.crossJoin(F.broadcast(L.read_totals(spark, root))).crossJoin(F.broadcast(stats))  # one row each


@query("""WITH e AS (SELECT user_id AS episode_index, count(*) AS length FROM events GROUP BY user_id),
r AS (SELECT *, CAST(floor((sum(length * 24) OVER (ORDER BY episode_index) - length * 24) / 5000) AS bigint) AS stretch FROM e),
f AS (SELECT *, dense_rank() OVER (ORDER BY stretch) - 1 AS file FROM r)
SELECT episode_index, length, printf('data/chunk-%03d/episode_%06d.parquet', CAST(floor(episode_index / 10) AS bigint), episode_index) AS path, printf('data/chunk-%03d/file-%03d.parquet', CAST(floor(file / 10) AS bigint), file % 10) AS rolled FROM f""")
def sink_chunked_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Both layouts are written, a file for each episode and files of some 5,000 bytes, ten to a chunk, and every episode is looked for where it is."""
    f = frames(spark, sf).select("episode_index", "frame_index", "value")
    e = L.rolled_files(f.groupBy("episode_index").agg(F.sum(L.row_bytes(f, f.columns)).alias("bytes")), 10, 5000)
    paths = e.select("episode_index", L.chunk_paths(F.col("episode_index"), 10).alias("path"), F.format_string("data/chunk-%03d/file-%03d.parquet", "data/chunk_index", "data/file_index").alias("rolled"))
    found = []
    for column in ("path", "rolled"):
        root = scratch(spark, "layout")
        L.write_files(f.join(paths.select("episode_index", column), "episode_index"), root, column).write.format("noop").mode("overwrite").save()
        stored = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data")
        where = F.regexp_extract(F.col("_metadata.file_path"), "(data/chunk-.*)$", 1)
        found.append(stored.groupBy("episode_index", where.alias(column)).agg(F.count(F.lit(1)).alias("length")))
    return found[0].join(found[1], ["episode_index", "length"])


@query(sql("frames", f"SELECT feature, stat, dim, value FROM ({STATS})"))
def sink_stats_json(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of the written tree at their JSON paths."""
    text = spark.read.text(stats_file(spark, sf), wholetext=True)
    at = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(s).alias("stat"), F.lit(d).cast("long").alias("dim"), F.get_json_object("value", f"$.{f}.{s}[{d}]").cast("double").alias("value")) for f in ("alpha", "beta", "gamma") for s in ("max", "mean", "min") for d in (0, 1)])
    return text.select(F.explode(at).alias("x")).select("x.*")


@query(sql("eval_results", """t AS (SELECT suite, task_id, 100.0::double * count(*) FILTER (WHERE success) / count(*) AS rate, avg(psnr) AS psnr, min(file_name) AS file_name, count(*) AS trials, count(*) FILTER (WHERE success) AS successes FROM (SELECT * REPLACE (success AND task_id <> 3 AS success, CASE WHEN task_id <> 4 THEN psnr END AS psnr) FROM eval_results) GROUP BY ALL)
SELECT 'suite' AS kind, suite, NULL AS task_id, concat(CAST(sum(trials) AS bigint), ' ', CAST(sum(successes) AS bigint)) AS text FROM t GROUP BY suite
UNION ALL SELECT 'task', suite, task_id, concat(printf('%.2f', rate), ' ', coalesce(printf('%.4f', psnr), 'N/A')) FROM t UNION ALL SELECT 'failed', suite, task_id, '' FROM t WHERE rate = 0 UNION ALL SELECT 'manifest', suite, task_id, file_name FROM t"""))
def sink_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """All files of a summary, read back as text."""
    root = scratch(spark, "summary")
    r = eval_results(spark, sf).withColumns({"success": F.col("success") & (F.col("task_id") != 3), "psnr": F.when(F.col("task_id") != 4, F.col("psnr"))})
    tasks = r.groupBy("suite", "task_id").agg((100.0 * F.count_if("success") / F.count(F.lit(1))).alias("rate"), F.avg("psnr").alias("psnr"), F.min("file_name").alias("file_name"))
    L.write_summaries(suite_summary(r).select("suite", "trials", "successes"), tasks, root)
    read = lambda file, kind, sep=",": spark.read.schema(kind).option("sep", sep).option("header", True).csv(f"{root}/{file}")
    row = lambda df, kind, text, task="task_id": df.select(F.lit(kind).alias("kind"), "suite", F.expr(task).cast("long").alias("task_id"), text.alias("text"))
    suites = "suite string, trials long, successes long"
    both = read("summary.csv", suites).intersect(spark.read.schema(suites).json(f"{root}/summary.json"))
    out = row(both, "suite", F.concat_ws(" ", "trials", "successes"), "null")
    out = out.unionByName(row(read("task_success_rates.csv", "suite string, task_id long, rate string, psnr string"), "task", F.concat_ws(" ", "rate", "psnr")))
    out = out.unionByName(row(read("failed.csv", "suite string, task_id long"), "failed", F.lit("")))
    return out.unionByName(row(read("manifest.tsv", "suite string, task_id long, file_name string", "\t"), "manifest", F.col("file_name")))


@query(sql("catalog", "SELECT dataset, i AS task_index, dataset AS task FROM catalog, LATERAL unnest(range(0, greatest(1, dataset_id % 4))) t(i)"))
def sink_fill_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return L.filled_tasks(catalog(spark, sf).withColumn("n", F.col("dataset_id") % 4), "n")
