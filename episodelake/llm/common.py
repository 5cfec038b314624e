"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.paths import scratch

#: ASCII bytes that end a word: all but digits, letters and what is above 0x7F.
WORD_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group counts as hot with more than HOT_ROWS rows, or at over HOT_ROWS * HOT_GROUPS rows in all with more than 1 / HOT_GROUPS of them.
HOT_ROWS, HOT_GROUPS = 1000, 100_000
#: Rows of a side that is broadcast after its size was counted.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``; where that is
    unset (tests, one machine) a temporary folder of this machine serves.
    """
    return scratch(spark, "corpus")


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends here and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has BROADCAST_ROWS rows at most; a larger one joins by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def words_of(text: Column) -> Column:
    """Lower-case (A-Z only) words of a text as an array; null and empty texts have none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WORD_BREAKS)
    return F.filter(parts, lambda w: w != "")


def hot_limit(total: int) -> int:
    """Rows above which a group is hot, so that HOT_GROUPS groups at most are."""
    return max(HOT_ROWS, total // HOT_GROUPS)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows to one row per group, safe when one group holds most rows.

    Hot groups are few and broadcast; every other group is small and goes by a shuffle.
    """
    limit = hot_limit(total)
    hot = groups.where(F.col(size) > limit)
    at_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return at_hot.unionByName(rest.join(groups.where(F.col(size) <= limit), key, "left"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows to one row per group, safe when one group holds most rows; groups is a written table."""
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key)
    limit = hot_limit(total)
    return rows.join(F.broadcast(groups.where(F.col(size) > limit)), key).unionByName(rows.join(groups.where(F.col(size) <= limit), key))


def shingle_hash(words: Column, at: Column, size: int) -> Column:
    """64-bit hash of ``size`` words from position ``at`` (0-based); equals xxhash64 of that slice."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])
