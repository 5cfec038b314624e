"""Benchmark decontamination as a prefix-filtered set join. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodelake.llm.common import BROADCAST_ROWS, shingle_hash, words_of, written

#: Words of a window, and of the shingles that stand for it in the join.
WINDOW, SHINGLE = 10, 4


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, w, len): every run of ``window`` words of an item; an item of fewer words, but not none, is one run."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window))
    runs = words.select("item_id", "words", F.explode(starts).alias("at"))
    return runs.select("item_id", F.slice("words", F.col("at") + 1, window).alias("w")).withColumn("len", F.size("w")).distinct()


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, words): the words of each row under a number of its own."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))


def positions(words: DataFrame) -> DataFrame:
    """(rid, id, words, at): one row for each word of a text and one past its end."""
    return words.select("rid", "id", "words", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("at"))


def shingles(at: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds h: the shingle that starts at each position, for each size; a row for each where there are several."""
    made = [shingle_hash(F.col("words"), F.col("at"), s) for s in sizes]
    return at.withColumn("h", made[0]) if len(made) == 1 else at.withColumn("h", F.explode(F.array(*made)))


def looked_up(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], table: DataFrame) -> DataFrame:
    """The positions of all texts with the rows of a written table of the same shingle (h), and a row at each text's end.

    A small table is broadcast, and texts are read once. For a large one the
    texts' words are written under their numbers, only numbers, places and
    hashes are shuffled, and words come back to the places that were found.
    """
    if table.count() <= BROADCAST_ROWS:
        return shingles(positions(numbered(docs, id_col, text_col)), sizes).join(F.broadcast(table), "h", "left")
    words = written(numbered(docs, id_col, text_col))
    places = shingles(positions(words), sizes).select("rid", "at", "h").join(table, "h")
    return words.join(places, "rid").unionByName(words.withColumn("at", F.size("words")), allowMissingColumns=True)


def rare_shingles(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(h, off, wid, w, len): each distinct window (wid, w, len) by the one of its shingles that is rarest over all documents.

    Containment has to be whole, so one shingle of a window is prefix enough.
    Windows with a shingle that no document has cannot occur and are left out.
    """
    sizes = sorted(r[0] for r in distinct.select(F.least(F.lit(SHINGLE), "len")).distinct().collect())  # SHINGLE values at most

    def hashed(size: int) -> DataFrame:
        of_size = distinct.where(F.least(F.lit(SHINGLE), "len") == size)
        offs = of_size.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - size)))
        return offs.withColumn("h", shingle_hash(F.col("w"), F.col("off"), size))

    if not sizes:
        return distinct.withColumns({"off": F.lit(0), "h": F.lit(0).cast("long")}), [SHINGLE]
    parts = written(reduce(DataFrame.unionByName, map(hashed, sizes)))
    keys = written(parts.select("h").distinct())
    every, count = shingles(positions(numbered(docs, id_col, text_col)), sizes), F.count(F.lit(1)).alias("n")
    few = keys.count() <= BROADCAST_ROWS
    # beyond that all shingles are counted before they meet the keys, so a frequent one is no hot key
    counts = written(every.join(F.broadcast(keys), "h").groupBy("h").agg(count) if few else every.groupBy("h").agg(count).join(keys, "h"))
    rarest = Window.partitionBy("wid").orderBy("n", "off")
    ranked = parts.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(rarest))
    return ranked.where("r = 1 and n > 0").select("h", "off", "wid", "w", "len"), sizes


def covered(spans: Column) -> Column:
    """How many positions an array of (start, len) spans covers, overlaps once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["start"] + x["len"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(s["end"], x["start"]))).alias("n")
    )
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words inside occurrences of benchmark windows, and the items they come from.

    Columns: id_col, n_words, n_hit, n_items, items_sha256, contaminated.
    Null texts have no words; rows that repeat an id, and null ids, are rows of
    their own; items with a null or wordless text match nothing; an empty
    benchmark marks nothing; item ids that repeat count once. Other columns of
    either table are ignored.

    Two scans: the first counts the benchmark's shingles over all documents,
    the second joins each window's rarest shingle, bounds the place it implies
    and compares the whole window. Windows are broadcast up to BROADCAST_ROWS
    of them and shuffled beyond (``looked_up``).
    """
    windows = written(item_windows(benchmark))
    distinct = written(windows.select("w", "len").distinct().withColumn("wid", F.monotonically_increasing_id()))
    prefix, sizes = rare_shingles(distinct, docs, id_col, text_col)
    rows = looked_up(docs, id_col, text_col, sizes, written(prefix))
    at_end = F.col("at") == F.size("words")
    start = F.col("at") - F.col("off")
    # the place lies in the text and the whole window is there; a row of its own keeps each text
    same = (start >= 0) & (start + F.col("len") <= F.size("words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("w"))
    hit = F.coalesce(same, F.lit(False))
    span, wid = F.when(hit, F.struct(start.alias("start"), "len")).alias("span"), F.when(hit, F.col("wid")).alias("wid")
    found = written(rows.where(hit | at_end).select("rid", "id", F.size("words").alias("n_words"), span, wid))
    per_row = found.groupBy("rid").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.collect_set("span").alias("spans"))
    names = windows.join(distinct, ["w", "len"]).select("wid", F.col("item_id").cast("string").alias("item")).distinct()
    items = found.where("wid is not null").select("rid", "wid").distinct().join(names, "wid").groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return per_row.join(items, "rid", "left").select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
