"""Reading lakes that may hold damaged files: footers, and rows with the reason where there are none."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from episodelake.paths import scratch

#: Rows of a batch that is read from a file.
BATCH_ROWS = 4096
#: Bytes and files that one task reads, about; a single file may be larger.
TASK_BYTES, TASK_FILES = 16 << 20, 64


def data_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file, bytes) of the files under a path, listed by Spark; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def _opened(path: str):
    """A seekable file of a path as Spark lists it."""
    from pyarrow import fs

    if match := re.match(r"file:/*(/.*)", path):
        return fs.LocalFileSystem().open_input_file(match[1])
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _dealt(files: DataFrame) -> DataFrame:
    """Files (file, bytes) spread over tasks, whatever their order in the listing.

    The number of tasks is given, since paths are short: by their bytes all of
    them would be put together into one task, which then reads all files.
    """
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES), -(-n // TASK_FILES))
    return files.repartition(max(1, min(n, tasks)), "file")


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows, row_groups, compressed, uncompressed, columns, problem) of the parquet files under a path, from their footers alone.

    ``columns`` maps a column's path to (min, max, nulls): its bounds as text,
    null where the footer has none, and its null values. A file whose footer
    cannot be read has a problem instead. Files are opened by tasks, which read
    a footer each and no page of data; a cut file is told from a short one.
    """
    schema = "file string, bytes long, rows long, row_groups long, compressed long, uncompressed long, columns map<string, struct<min: string, max: string, nulls: long>>, problem string"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def footer(file: str, size: int) -> dict:
        from pyarrow import parquet

        out = dict.fromkeys(arrow.names) | {"file": file, "bytes": size}
        try:
            with _opened(file) as f:
                m = parquet.read_metadata(f)
            groups = [m.row_group(i) for i in range(m.num_row_groups)]
            chunks = [g.column(j) for g in groups for j in range(g.num_columns)]
            columns: dict[str, list] = {}
            for c in chunks:
                columns.setdefault(c.path_in_schema, []).append(c.statistics)
        except Exception as e:  # whatever is wrong with the file is its problem
            return out | {"problem": f"{type(e).__name__}: {e}"}
        bounds = {}
        for name, stats in columns.items():
            known = all(s is not None and s.has_min_max for s in stats)
            nulls = sum(s.null_count for s in stats) if all(s is not None and s.has_null_count for s in stats) else None
            bounds[name] = {"min": str(min(s.min for s in stats)) if known else None, "max": str(max(s.max for s in stats)) if known else None, "nulls": nulls}
        sizes = {"compressed": sum(c.total_compressed_size for c in chunks), "uncompressed": sum(c.total_uncompressed_size for c in chunks)}
        return out | sizes | {"rows": m.num_rows, "row_groups": len(groups), "columns": list(bounds.items())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([footer(row["file"], row["bytes"])], arrow)

    return _dealt(data_files(spark, path)).mapInArrow(read, schema)


def read_guarded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the parquet files under a path in a schema, with file and problem.

    Extra columns are dropped, missing ones are null, types are cast. Where a
    file cannot be opened, read on or cast, the rows before stay and one more
    row follows, null but for its file and problem; other files are not
    touched by it. A file is read by one task, BATCH_ROWS rows at a time.
    """
    whole = T.StructType([*schema.fields, T.StructField("file", T.StringType()), T.StructField("problem", T.StringType())])
    arrow = to_arrow_schema(whole)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        for batch in batches:
            for file in batch.column(0).to_pylist():
                try:
                    with _opened(file) as f:
                        source = parquet.ParquetFile(f)
                        there = [n for n in schema.fieldNames() if n in source.schema_arrow.names]
                        for part in source.iter_batches(BATCH_ROWS, columns=there):
                            n = len(part)
                            columns = [part.column(x.name).cast(x.type) if x.name in there else pa.nulls(n, x.type) for x in list(arrow)[:-2]]
                            yield pa.RecordBatch.from_arrays([*columns, pa.array([file] * n, pa.string()), pa.nulls(n, pa.string())], schema=arrow)
                except Exception as e:  # noqa: BLE001  the reason is the result
                    yield pa.RecordBatch.from_pylist([dict.fromkeys(arrow.names) | {"file": file, "problem": f"{type(e).__name__}: {e}"}], arrow)

    return _dealt(data_files(spark, path)).select("file").mapInArrow(read, whole)


def read_json_guarded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of JSON-lines files in a schema, with file and problem: a line that is not such a record is kept as its own problem."""
    whole = T.StructType([*schema.fields, T.StructField("problem", T.StringType())])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "problem").json(path)
    return rows.select(*schema.fieldNames(), F.col("_metadata.file_path").alias("file"), F.when(F.col("problem").isNotNull(), F.concat(F.lit("not a record: "), "problem")).alias("problem"))


def quarantined(df: DataFrame, rules: dict[str, Column], source: Column) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, bad rows with reason and described, rows for each reason; good ones under "").

    A row's reason is the first rule (name -> is bad) that holds, a rule without
    an answer counts as held. The rows are read once: they are written apart in
    the shared folder, and counted on the way.
    """
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()])
    marked = df.withColumn("reason", reason).withColumn("described", F.when(F.col("reason").isNotNull(), source)).withColumn("__bad", F.col("reason").isNotNull())
    counts = Observation()
    each = [F.count_if(F.col("reason") == name).alias(f"r{i}") for i, name in enumerate(rules)]
    path = scratch(df.sparkSession, "quarantine")
    marked.observe(counts, F.count_if(~F.col("__bad")).alias("good"), *each).write.partitionBy("__bad").parquet(path)
    schema = T.StructType([*marked.schema.fields])
    both = df.sparkSession.read.schema(schema).parquet(path)
    got = counts.get
    return both.where("not __bad").select(df.columns), both.where("__bad").drop("__bad"), {"": got["good"]} | {name: got[f"r{i}"] for i, name in enumerate(rules)}
