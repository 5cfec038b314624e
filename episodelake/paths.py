"""Where intermediate tables and small files go."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Folders given out in this process, for ``clear``.
_given: list[str] = []


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), or on one machine a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.gettempdir()
    # tasks that write files themselves must mean the same store as Spark
    store, path = _hadoop(spark, top)
    if ":" not in top.split("/")[0] and store.getUri().getScheme() != "file":
        top = store.makeQualified(path).toString()
    _given.append(f"{top.rstrip('/')}/episodelake-{name}-{uuid.uuid4().hex}")
    return _given[-1]


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written to the shared folder, for plans that read it more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _hadoop(spark, path)
    return store.exists(p)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file under its exact name."""
    store, p = _hadoop(spark, path)
    out = store.create(p, True)
    out.write(bytearray(data))
    out.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of metadata under its exact name."""
    put_bytes(spark, path, text.encode())


def clear(spark: SparkSession) -> int:
    """Deletes the tables given out so far, once the results that read them are saved; how many there were."""
    n = 0
    while _given:
        store, p = _hadoop(spark, _given.pop())
        n += bool(store.delete(p, True))
    return n
