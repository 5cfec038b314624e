"""Episode lakes on disk: readers and writers of frames, episodes, dictionaries, statistics, logs and catalogues."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodelake.operators.checks import keep_episodes
from episodelake.operators.stats import feature_stats, merge_stats
from episodelake.operators.windows import episode_offsets, places
from episodelake.paths import exists, put_text, scratch
from episodelake.sources.commits import EPISODES, STATS, TASKS, begin, commit, settle

#: The annotation dictionaries and their files.
ANNOTATIONS = {
    "subtask": "annotations/subtask_annotations.jsonl",
    "scene": "annotations/scene_annotations.jsonl",
    "gripper_mode": "annotations/gripper_mode_annotation.jsonl",
    "gripper_activity": "annotations/gripper_activity_annotation.jsonl",
    "eef_velocity": "annotations/eef_velocity_annotation.jsonl",
    "eef_acc_mag": "annotations/eef_acc_mag_annotation.jsonl",
    "eef_direction": "annotations/eef_direction_annotation.jsonl",
}
#: Levels of objects and of lists that a statistics tree may have.
OBJECTS, LISTS = 5, 5
#: Uncompressed bytes after which a data file is closed.
BYTES_PER_FILE = 100 << 20
PRIMITIVES = {"float32": T.FloatType(), "float64": T.DoubleType(), "int64": T.LongType(), "int32": T.IntegerType(), "bool": T.BooleanType(), "string": T.StringType(), "image": T.BinaryType()}


# --- schemas ---------------------------------------------------------------


def schema_of(features: dict[str, dict]) -> T.StructType:
    """The frame schema of a feature map {name: {dtype, shape}}; videos are not in the files."""
    fields = []
    for name, spec in features.items():
        if spec["dtype"] == "video":
            continue
        kind: T.DataType = PRIMITIVES[spec["dtype"]]
        shape = list(spec.get("shape") or [1])
        if spec["dtype"] != "image" and shape != [1]:
            for _ in shape:
                kind = T.ArrayType(kind)
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


# --- readers ---------------------------------------------------------------


def read_frames(spark: SparkSession, root: str, features: dict[str, dict], episodes: list[int | list[int]] | None = None) -> DataFrame:
    """All frames of a dataset in the declared schema: extra columns are dropped, order is fixed, types are cast.

    ``episodes`` selects by ints and inclusive [start, end] ranges; the bounds
    are pushed to the scan, which skips files and row groups without them.
    """
    settle(spark, root)
    want = schema_of(features)
    have = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data")
    if episodes is not None:
        have = keep_episodes(have, episodes)
    return have.select(*[(F.col(f"`{f.name}`") if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])


def stored_index(spark: SparkSession, root: str, episodes: list[int | list[int]] | None = None, section: str | None = None) -> DataFrame:
    """(file, row, index) of the stored frames: the file's path under the root and the row's place in the file.

    With ``episodes`` only the rows of those (ints and inclusive [start, end]
    ranges), with ``section`` also the column that names the parts of a file.
    """
    settle(spark, root)
    have = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data")
    rows = have.select(F.regexp_extract(F.col("_metadata.file_path"), "/(data/.*)$", 1).alias("file"), F.col("_metadata.row_index").alias("row"), "index", *[section] * (section is not None), *["episode_index"] * (episodes is not None))
    return rows if episodes is None else keep_episodes(rows, episodes).drop("episode_index")


def read_episodes(spark: SparkSession, root: str, version: str = "v3.0") -> DataFrame:
    """Episode metadata of either layout, without per-episode statistics columns."""
    settle(spark, root)
    df = spark.read.json(f"{root}/meta/episodes.jsonl") if version == "v2.1" else spark.read.option("recursiveFileLookup", True).parquet(f"{root}/meta/episodes")
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("stats/")])


def read_tasks(spark: SparkSession, root: str, version: str = "v3.0") -> DataFrame:
    """(task_index, task); the parquet form keeps the text in its pandas index column."""
    settle(spark, root)
    if version == "v2.1":
        return spark.read.schema("task_index long, task string").json(f"{root}/meta/tasks.jsonl")
    return spark.read.parquet(f"{root}/meta/tasks.parquet").withColumnRenamed("__index_level_0__", "task").select("task_index", "task")


def read_info(spark: SparkSession, pattern: str) -> DataFrame:
    """(root, fps, robot_type, feature, dtype, shape, names) of all info.json files of a path or glob."""
    kind = "fps int, robot_type string, features map<string, struct<dtype: string, shape: array<int>, names: array<string>>>"
    # one JSON object per file, of any layout
    info = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", kind).alias("i"))
    root = F.regexp_replace("path", "/meta/.*$", "")
    return info.select(root.alias("root"), "i.fps", "i.robot_type", F.explode("i.features").alias("feature", "f")).select("root", "fps", "robot_type", "feature", "f.dtype", "f.shape", "f.names")


def read_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """(feature, stat, at, dim, value) of a JSON tree of objects and lists of numbers of any depth up to OBJECTS and LISTS.

    The last name on the way is the stat, those before it, joined by '/', the
    feature; ``at`` has the places in the lists, of which dim is the last.
    """
    tree = spark.read.text(path, wholetext=True).select(F.array().cast("array<string>").alias("names"), F.array().cast("array<int>").alias("at"), F.trim("value").alias("v"))
    for _ in range(OBJECTS):
        inner = F.when(F.col("v").startswith("{"), F.map_entries(F.from_json("v", "map<string, string>")))
        e = tree.select("names", "at", "v", F.explode_outer(inner).alias("e"))
        tree = e.select(F.when(F.col("e").isNull(), F.col("names")).otherwise(F.concat("names", F.array("e.key"))).alias("names"), "at", F.coalesce("e.value", F.when(~F.col("v").startswith("{"), F.col("v"))).alias("v")).where("v is not null")
    for _ in range(LISTS):
        e = tree.select("names", "at", "v", F.posexplode_outer(F.when(F.col("v").startswith("["), F.from_json("v", "array<string>"))).alias("i", "e"))
        tree = e.select("names", F.when(F.col("i").isNull(), F.col("at")).otherwise(F.concat("at", F.array("i"))).alias("at"), F.coalesce("e", F.when(~F.col("v").startswith("["), F.col("v"))).alias("v")).where("v is not null")
    feature = F.array_join(F.slice("names", 1, F.greatest(F.lit(0), F.size("names") - 1)), "/")
    return tree.select(feature.alias("feature"), F.element_at("names", -1).alias("stat"), "at", F.try_element_at("at", F.lit(-1)).alias("dim"), F.col("v").try_cast("double").alias("value"))


def read_episode_stats(spark: SparkSession, path: str) -> DataFrame:
    """(episode_index, feature, stat, dim, value) of a JSON-lines file of episodes' statistics."""
    kind = "episode_index long, stats map<string, map<string, array<double>>>"
    df = spark.read.schema(kind).json(path).select("episode_index", F.explode("stats").alias("feature", "s"))
    return df.select("episode_index", "feature", F.explode("s").alias("stat", "values")).select("episode_index", "feature", "stat", F.posexplode("values").alias("dim", "value"))


def read_annotations(spark: SparkSession, root: str, kinds: list[str] | None = None) -> DataFrame:
    """(kind, index, text) of the annotation dictionaries under a root, each a file or a folder of that name."""
    kinds = list(ANNOTATIONS) if kinds is None else kinds
    kind = F.regexp_extract(F.col("_metadata.file_path"), r"/annotations/(\w+)_annotations?\.jsonl", 1)
    lines = spark.read.text([f"{root}/{ANNOTATIONS[k]}" for k in kinds]).select(kind.alias("kind"), "value").where("trim(value) <> ''")
    made = lines.select("kind", F.from_json("value", "map<string, string>").alias("m"))
    return made.select("kind", F.expr("m[concat(kind, '_index')]").cast("long").alias("index"), F.expr("m[kind]").alias("text"))


def catalogue(text: DataFrame, task: str, lines: str) -> DataFrame:
    """(task, dataset) of newline-separated lists, without empty lines."""
    return text.select(task, F.explode(F.split(lines, "\n")).alias("dataset")).select(task, F.trim("dataset").alias("dataset")).where("dataset <> ''")


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows with the task id of their file's name."""
    df = spark.read.json(path)
    name = F.regexp_extract(F.regexp_replace(F.col("_metadata.file_path"), "%3D", "="), r"gpu(\d+)_task(\d+)_results", 2)
    return df.select("*", name.cast("int").alias("task_id"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of log files of any size, line by line; lines of one file come from several tasks."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


# --- writers ---------------------------------------------------------------


def write_frames(frames: DataFrame, root: str, chunk_size: int) -> None:
    """Frames under data/chunk=N; an episode is in one file, a chunk's episodes are dealt to several tasks."""
    some = F.pmod(F.xxhash64("episode_index"), F.lit(8))
    rows = frames.withColumn("chunk", F.floor(F.col("episode_index") / chunk_size)).repartition("chunk", some)
    rows.sortWithinPartitions("chunk", "episode_index", "frame_index").write.mode("append").partitionBy("chunk").parquet(f"{root}/data")


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """Uncompressed bytes of a value: eight for a number, its bytes for a text or binary, its elements' for an array."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.ArrayType, T.StringType, T.BinaryType)):
            return F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + value_bytes(x, kind.elementType)), F.lit(0))
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)).cast("long") * 8
    return F.lit(8).cast("long")


def row_bytes(df: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [value_bytes(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns], F.lit(0).cast("long"))


def rolled_files(episodes: DataFrame, chunk_size: int, bytes_per_file: int = BYTES_PER_FILE, first_file: int = 0) -> DataFrame:
    """Adds data/chunk_index and data/file_index to episodes (episode_index, bytes): a chunk has chunk_size files.

    Episodes stay whole, in their order: a file has those that begin in one
    stretch of bytes_per_file bytes of all, so at most that and one more
    episode. Files are numbered without gaps from ``first_file`` over all chunks.
    """
    placed = episode_offsets(episodes, "bytes").withColumn("__stretch", F.floor(F.col("from_index") / bytes_per_file)).drop("from_index", "to_index")
    stretches = placed.select("__stretch").distinct()
    number = F.row_number().over(Window.orderBy("__stretch")) - 1 + first_file  # a row for each file
    files = stretches.select("__stretch", F.floor(number / chunk_size).alias("data/chunk_index"), (number % chunk_size).cast("long").alias("data/file_index"))
    return placed.join(files, "__stretch").drop("__stretch")


def at_store(root: str, path: str):
    """(file system, name on it) of a path under a root, for tasks that write files themselves."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(root) if re.match(r"\w+:/", root) else (fs.LocalFileSystem(), root)
    return store, f"{top}/{path}"


def write_files(frames: DataFrame, root: str, path: str) -> DataFrame:
    """Writes the frames of each value of the column ``path`` to the parquet file of that name under the root; (path, rows).

    A file's rows come sorted by episode and frame and are written as they
    come, a batch at a time. A file appears whole under its name or not at all,
    so a repeated task replaces its own file.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        name, out, begun, store, rows = None, None, "", None, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            out.close()
            store.move(begun, final)
            done.append((name, rows))

        for batch in batches:
            names = batch.column(path).to_pylist()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if names[a] != name:
                    if out is not None:
                        close()
                    name, rows = names[a], 0
                    store, final = at_store(root, name)
                    folder = final.rsplit("/", 1)[0]
                    store.create_dir(folder)
                    begun = f"{folder}/_{uuid.uuid4().hex}"  # readers skip such names
                    out = parquet.ParquetWriter(begun, batch.schema.remove(batch.schema.get_field_index(path)), filesystem=store)
                out.write_batch(batch.slice(a, b - a).drop_columns([path]))
                rows += b - a
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())], names=["path", "rows"])

    ordered = frames.repartition(path).sortWithinPartitions(path, "episode_index", "frame_index")
    return ordered.mapInArrow(save, "path string, rows long")


def write_texts(files: DataFrame, root: str) -> None:
    """Writes each row's text to the small file ``path`` under the root, by tasks; a file appears whole or not at all."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = at_store(root, path)
                store.create_dir(name.rsplit("/", 1)[0])
                begun = f"{name.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
                with store.open_output_stream(begun) as f:
                    f.write(text.encode())
                store.move(begun, name)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    files.select("path", "text").mapInArrow(save, "path string").write.format("noop").mode("overwrite").save()


def append_episodes(spark: SparkSession, frames: DataFrame, root: str, chunk_size: int, features: list[str], cameras: int = 0, bytes_per_file: int = BYTES_PER_FILE, task: str | None = None) -> DataFrame:
    """Appends finished episodes to a v3.0 lake as one version and returns the metadata of all.

    ``frames`` has episode, frame_index, the numeric ``features`` and other
    values, and in the column ``task`` the text of each frame's task, stored as
    its number. New episodes follow the stored ones in the order of ``episode``;
    the global index goes on where it ended, new files after the last one, new
    tasks after the known ones in the order in which they first stand.
    Episodes' metadata hold their tasks and their own statistics
    (stats/FEATURE/STAT); meta/stats.json and the totals, chunks and split of
    meta/info.json are of all episodes.

    All is staged first and committed in one step (``commits``): a writer that
    stops leaves the lake as it was, and one whose lake has changed meanwhile
    fails with LakeChanged.
    """
    append = begin(spark, root)
    stored = read_episodes(spark, root) if exists(spark, f"{root}/{EPISODES}") else None
    last = stored.agg(F.max("episode_index").alias("e"), F.max("dataset_to_index").alias("i"), F.max(F.struct("data/chunk_index", "data/file_index")).alias("f")).first() if stored else None
    base, start, first_file = (last["e"] + 1, last["i"], last["f"][0] * chunk_size + last["f"][1] + 1) if last and last["e"] is not None else (0, 0, 0)

    values = [c for c in frames.columns if c not in ("episode", task)]
    size = row_bytes(frames, values) + 16  # and the episode's and the row's numbers
    kinds = [F.array_sort(F.collect_set(task)).alias("tasks")] if task else []
    per_episode = frames.groupBy("episode").agg(F.count(F.lit(1)).alias("length"), F.sum(size).alias("bytes"), *kinds)
    numbered = places(per_episode, ["episode"]).withColumn("episode_index", F.col("place") + base).drop("place")
    offsets = episode_offsets(numbered).withColumns({"dataset_from_index": F.col("from_index") + start, "dataset_to_index": F.col("to_index") + start}).drop("from_index", "to_index")
    path = scratch(spark, "episodes")
    rolled_files(offsets, chunk_size, bytes_per_file, first_file).drop("bytes").write.parquet(path)
    meta = spark.read.parquet(path)
    file = F.format_string("data/chunk-%03d/file-%03d.parquet", "data/chunk_index", "data/file_index")
    rows = frames.join(meta.select("episode", "episode_index", "dataset_from_index", file.alias("__path")), "episode").withColumn("index", F.col("dataset_from_index") + F.col("frame_index"))
    total_tasks = 0
    if task:
        tasks = known_tasks(spark, root, rows, task)
        total_tasks = tasks.count()
        tasks.withColumnRenamed("task", "__index_level_0__").write.parquet(f"{append.folder}/{TASKS}")
        rows = rows.join(tasks.withColumnRenamed("task", task), task).drop(task)
    write_files(rows.drop("dataset_from_index", "episode"), append.folder, "__path").write.format("noop").mode("overwrite").save()

    names = ["min", "max", "mean", "std", "count"]
    vectors = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f) if frames.schema[f].dataType.typeName() == "array" else F.array(f)).cast("array<double>").alias("v")) for f in features])
    long = frames.select("episode", F.explode(vectors).alias("x")).select("episode", "x.feature", F.posexplode("x.v").alias("dim", "x"))
    each = feature_stats(long, ["episode", "feature", "dim"])
    stats = each.groupBy("episode", "feature").agg(F.sort_array(F.collect_list(F.struct("dim", *names))).alias("s"))
    per = stats.groupBy("episode").agg(*[F.max(F.when(F.col("feature") == f, F.col(f"s.{n}").cast("array<double>"))).alias(f"stats/{f}/{n}") for f in features for n in names])
    meta.join(per, "episode").drop("episode").write.parquet(f"{append.folder}/{EPISODES}/version-{append.base + 1:010d}")

    # what is stored counts as one part, so no older episode is read again
    parts = each.select("feature", "dim", *[F.col(n).cast("double").alias(n) for n in names])
    if exists(spark, f"{root}/{STATS}"):
        old = read_stats_json(spark, f"{root}/{STATS}").where(F.col("stat").isin(names)).groupBy("feature", F.col("dim").cast("int").alias("dim")).pivot("stat", names).agg(F.first("value"))
        parts = parts.unionByName(old)
    merged = merge_stats(parts, ["feature", "dim"])
    tree = stats_tree(merged.select("feature", "dim", F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names])).alias("s")).select("feature", "dim", "s.*"))
    put_text(spark, f"{append.folder}/{STATS}", tree.first()["value"])
    t = meta.agg(F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("frames")).first()
    info = {"codebase_version": "v3.0", "chunks_size": chunk_size} | append.info
    n = base + t["episodes"]
    totals = {"total_episodes": n, "total_frames": start + t["frames"], "total_chunks": -(-n // chunk_size), "total_videos": n * cameras, "splits": {"train": f"0:{n}"}}
    commit(spark, append, info | totals | ({"total_tasks": total_tasks} if task else {}))
    settle(spark, root)
    return read_episodes(spark, root)


def known_tasks(spark: SparkSession, root: str, rows: DataFrame, task: str) -> DataFrame:
    """(task_index, task) of a lake's dictionary with the new texts of frames (episode_index, frame_index) behind the known ones."""
    fresh = rows.groupBy(F.col(task).alias("task")).agg(F.min(F.struct("episode_index", "frame_index")).alias("first")).where("task is not null")
    if not exists(spark, f"{root}/{TASKS}"):
        return places(fresh, ["first", "task"]).select(F.col("place").alias("task_index"), "task")
    known = read_tasks(spark, root)
    start = known.agg(F.coalesce(F.max("task_index") + 1, F.lit(0)).alias("start")).first()["start"]
    new = places(fresh.join(known.select("task"), "task", "left_anti"), ["first", "task"])
    return known.unionByName(new.select((F.col("place") + start).alias("task_index"), "task"))


def read_totals(spark: SparkSession, root: str) -> DataFrame:
    """One row of the totals and the split of a dataset's info.json."""
    settle(spark, root)
    kind = "total_episodes long, total_frames long, total_chunks long, total_videos long, total_tasks long, splits map<string, string>"
    i = spark.read.text(f"{root}/meta/info.json", wholetext=True).select(F.from_json("value", kind).alias("i"))
    return i.select("i.total_episodes", "i.total_frames", "i.total_chunks", "i.total_videos", "i.total_tasks", F.col("i.splits")["train"].alias("split"))


def write_tasks(tasks: DataFrame, root: str) -> None:
    tasks.withColumnRenamed("task", "__index_level_0__").write.parquet(f"{root}/meta/tasks.parquet")


def stats_tree(long: DataFrame) -> DataFrame:
    """One row with a JSON tree feature -> stat -> numbers by dimension, or lists of them by step; statistics are few.

    ``long`` has feature, stat, dim, value and optionally step (null for plain lists).
    """
    long = long if "step" in long.columns else long.withColumn("step", F.lit(None).cast("int"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
    joined = lambda c, left, right: F.concat(F.lit(left), F.array_join(c, ","), F.lit(right))
    row = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]))
    rows = long.groupBy("feature", "stat", "step").agg(row.alias("v"))
    steps = F.transform(F.sort_array(F.collect_list(F.struct("step", "v"))), lambda s: s["v"])
    arrays = rows.groupBy("feature", "stat").agg(steps.alias("s"), F.max("step").alias("last")).select("feature", "stat", F.when(F.col("last").isNull(), F.col("s")[0]).otherwise(joined("s", "[", "]")).alias("v"))
    entry = lambda name: F.concat(quoted(name), F.lit(":"), F.col("v"))
    features = arrays.groupBy("feature").agg(joined(F.sort_array(F.collect_list(entry("stat"))), "{", "}").alias("v"))
    return features.agg(joined(F.sort_array(F.collect_list(entry("feature"))), "{", "}").alias("value"))


def write_summaries(suites: DataFrame, tasks: DataFrame, path: str) -> None:
    """The suites as CSV with a header and as JSON lines, the tasks' success rates as CSV, tasks without a success as the failed list, and a manifest of the tasks' files.

    ``tasks`` has suite, task_id, rate (percent), psnr and file_name; a missing PSNR is written as N/A.
    """
    suites.write.option("header", True).csv(f"{path}/summary.csv")
    suites.write.json(f"{path}/summary.json")
    rates = tasks.select("suite", "task_id", F.format_string("%.2f", F.bround("rate", 2)).alias("rate"), F.when(F.col("psnr").isNull(), "N/A").otherwise(F.format_string("%.4f", F.bround("psnr", 4))).alias("psnr"))
    rates.repartitionByRange("suite", "task_id").sortWithinPartitions("suite", "task_id").write.option("header", True).csv(f"{path}/task_success_rates.csv")
    tasks.where("rate = 0").select("suite", "task_id").write.option("header", True).csv(f"{path}/failed.csv")
    tasks.select("suite", "task_id", "file_name").write.option("sep", "\t").option("header", True).csv(f"{path}/manifest.tsv")


def chunk_paths(episode: Column, chunk_size: int) -> Column:
    """data/chunk-CCC/episode_EEEEEE.parquet of an episode."""
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(episode / chunk_size), episode)


def filled_tasks(dirs: DataFrame, rows: str) -> DataFrame:
    """(dataset, task_index, task): each directory's task table rewritten to its name, with as many rows as before or one."""
    n = F.greatest(F.lit(1), F.coalesce(rows, F.lit(0)))
    return dirs.select("dataset", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("task_index"), F.col("dataset").alias("task"))
