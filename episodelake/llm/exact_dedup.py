"""Exact de-duplication with two-pass Bloom filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodelake.llm.bloom import hash_filter, may_hold
from episodelake.llm.common import attach_groups, written

def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    Columns: id_col, keep_id, group_size, kept, text_sha256. Texts are equal
    when equal after ``normalised``. The row with the smallest id stays; a null
    id sorts after every other. Null texts equal empty ones. Rows that repeat
    an id count as rows of their group, and all rows with the kept id are kept.
    An empty table gives no rows; other columns are ignored.

    Only digests are written and only rows whose hash may repeat are shuffled;
    the others pass straight through as groups of one.
    """
    spark = docs.sparkSession
    sha = F.sha2(normalised(F.col(text_col)), 256)
    digests = written(docs.select(F.col(id_col).alias("id"), F.unhex(sha).alias("sha")).withColumn("h", F.xxhash64("sha")))
    total = digests.count()
    shared = spark.sparkContext.broadcast(hash_filter(digests, total, times=2))

    def flagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(suspect=may_hold(shared.value, batch["h"].to_numpy(np.int64)))

    rows = written(digests.mapInPandas(flagged, f"id {dict(docs.dtypes)[id_col]}, sha binary, h long, suspect boolean").drop("h"))
    suspects = rows.where("suspect").drop("suspect")
    groups = suspects.groupBy("sha").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = attach_groups(suspects, written(groups), "sha", "group_size", total)
    alone = rows.where("not suspect").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return repeated.select(*alone.columns).unionAll(alone).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
