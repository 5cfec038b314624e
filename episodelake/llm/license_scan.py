"""License notices in texts: MinHash bands over text windows, then exact containment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.llm.common import words_of, written
from episodelake.llm.decontaminate import looked_up
from episodelake.llm.license_texts import TEMPLATES

SHINGLE, CONTAINED = 5, 0.8
#: Bands of one row. A notice of T shingles lies whole in a window of 2T, so their
#: Jaccard is 0.5 or more and all bands miss it with a chance of 2**-BANDS; at a
#: containment of 0.8 the Jaccard is 0.36 or more and the chance 0.64**BANDS.
BANDS = 24


def templates_frame(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(license, tw, t): the words of each notice of five words or more, and how many shingles it has."""
    rows = spark.createDataFrame(templates, "license string, text string").select("license", words_of(F.col("text")).alias("tw"))
    return rows.where(F.size("tw") >= SHINGLE).withColumn("t", F.size("tw") - SHINGLE + 1)


def band_value(h: Column, band: Column) -> Column:
    return F.xxhash64(h, band)


def texts_of(words: Column, start: Column, end: Column) -> Column:
    """The shingles that start in [start, end), as texts."""
    return F.transform(F.sequence(start, end - 1), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_words, n_licenses, licenses (names, sorted, comma-joined), n_windows.

    A notice is found when a window of twice its shingles, taken at every
    multiple of its length, holds 0.8 or more of its distinct five-word
    shingles; n_windows counts such windows. Null, empty and short texts have
    none. Null and repeated ids are rows of their own, other columns are
    ignored. Templates of fewer than five words are left out; an empty list of
    them finds nothing.

    A band's value for a window is the least band hash of its shingles. A
    window can share it with a template only if it has that very shingle, so
    positions are first joined to the templates' least shingles, and only
    windows around these are hashed.
    """
    spark = docs.sparkSession
    t = templates_frame(spark, TEMPLATES if templates is None else templates)
    own = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda i: F.xxhash64(F.slice("tw", i + 1, SHINGLE)))
    bands = t.withColumn("own", own).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    least = F.array_min(F.transform("own", lambda h: F.struct(band_value(h, F.col("band")).alias("v"), h.alias("h"))))
    bands = written(bands.select("license", "tw", "t", "band", least.alias("m")).select("license", "tw", "t", "band", F.col("m.v").alias("v"), F.col("m.h").alias("h")))
    at_end = F.col("at") == F.size("words")
    near = looked_up(docs, id_col, text_col, [SHINGLE], bands)
    near = near.where(at_end | (F.col("license").isNotNull() & (F.col("at") + SHINGLE <= F.size("words"))))
    # the two windows that hold the position; a text's own row has none
    k = F.floor(F.col("at") / F.col("t")).cast("int")
    windows = F.when(at_end, F.array(F.lit(-1))).otherwise(F.filter(F.array((k - 1) * F.col("t"), k * F.col("t")), lambda s: s >= 0))
    rows = near.withColumn("start", F.explode(windows))
    end = F.least(F.col("start") + 2 * F.col("t"), F.size("words") - SHINGLE + 1)
    seen = F.transform(F.sequence(F.col("start"), end - 1), lambda i: band_value(F.xxhash64(F.slice("words", i + 1, SHINGLE)), F.col("band")))
    ours = F.array_distinct(texts_of(F.col("tw"), F.lit(0), F.col("t")))
    share = F.size(F.array_intersect(texts_of(F.col("words"), F.col("start"), end), ours)) / F.size(ours)
    hit = F.when(F.col("start") < 0, F.lit(None)).otherwise((F.array_min(seen) == F.col("v")) & (share >= CONTAINED))
    found = rows.withColumn("hit", hit).where("hit is null or hit").select("rid", "id", F.size("words").alias("n_words"), "license", "start", "hit")
    at = F.when(F.col("hit"), F.struct("license", "start"))
    per_row = found.groupBy("rid").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.collect_set(at).alias("spans"))
    names = F.sort_array(F.array_distinct(F.transform("spans", lambda s: s["license"])))
    return per_row.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.size(names).cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
        F.size("spans").cast("long").alias("n_windows"),
    )
