"""Near-duplicate classes: ProbMinHash signatures of weighted shingles, banding, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodelake.llm.bloom import hash_filter, may_hold
from episodelake.llm.common import attach_groups, join_groups, near, written
from episodelake.llm.components import components
from episodelake.llm.textbytes import BASE, Words, mix, shingle_hashes, text_blocks, word_texts, words_of_block

SHINGLE, SIMILAR = 5, 0.8
#: A sum of doubles this much below the threshold still reaches it.
ROUNDING = 1e-9
#: 24 bands of 6 registers: two texts of similarity 0.8 meet in no band with a chance of 0.07 %, at 0.85 of 0.001 %.
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Texts of a bucket that every other text of it is compared with before classes are made.
CENTRES = 3
#: Pairs of one text that go to one task.
HOT_PAIRS = 1024
#: Bytes of shingle sets that meet in one task: of texts outside their bucket's largest class, and of any of its texts.
OUTSIDE_BYTES, MEMBER_BYTES = 1 << 20, 4 << 20
#: A digest's first eight bytes as a number, in SQL.
DIGEST_HASH = "cast(conv(hex(substring(digest, 1, 8)), 16, -10) as bigint)"


def counted_shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, text number) of the distinct shingles of each text, by text and hash."""
    h, doc = shingle_hashes(words, SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.r_[new, len(h)]), doc[new]


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle's weight: 1 + ln(count)."""
    return 1.0 + np.log(counts)


def prob_minhash(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures (n_docs, k): two texts agree in a register with the chance of their probability Jaccard.

    Each element is a Poisson process of the rate of its weight whose arrivals
    fall into random registers; a register keeps the element that came first.
    All elements of all texts draw their next arrival together, and an element
    stops when its arrival is later than every register of its text is filled.
    """
    first = np.full((n_docs, k), np.inf)
    sig = np.zeros(n_docs * k, np.uint64)
    time, turn = np.zeros(len(h)), 0
    while len(h):
        turn += 1
        draw = mix(h + np.full(1, turn, np.uint64) * BASE)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        cell = doc * k + (mix(draw) % np.uint64(k)).astype(np.int64)
        flat = first.reshape(-1)
        np.minimum.at(flat, cell, time)
        won = time == flat[cell]
        sig[cell[won]] = h[won]
        texts = doc[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])]
        last = np.zeros(n_docs)
        last[texts] = first[texts].max(axis=1)
        live = time < last[doc]
        h, weight, doc, time = h[live], weight[live], doc[live], time[live]
    return sig.reshape(n_docs, k)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * BASE + rows[:, :, i])
    return key


def word_keys(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each text's words in order, by their bytes."""
    return [hashlib.blake2b(t, digest_size=16).digest() for t in word_texts(data, offsets)]


def prob_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """The exact probability Jaccard of two weighted sets with distinct, sorted hashes."""
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a_only, b_only = np.delete(wa, ia).sum(), np.delete(wb, ib).sum()
    a, b = wa[ia], wb[ib]
    order = np.argsort(-(a / b), kind="stable")
    a, b = a[order], b[order]
    # a's ratio falls: to the left a decides the maxima, to the right b does
    left, right = a_only + np.cumsum(a), b_only + b.sum() - np.cumsum(b)
    return float((1 / (left / a + right / b)).sum())


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, bands): the digest of a text's words and its band keys; null and empty for texts without words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                words = words_of_block(data, offsets)
                some = np.diff(words.offsets) > 0
                h, count, doc = counted_shingles(words)
                keys = band_keys(prob_minhash(h, weights(count), doc, b - a))[some].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some * BANDS)], pa.int32()), pa.array(keys.reshape(-1)))
                digests = [k if s else None for k, s in zip(word_keys(data, offsets), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), lists], names=["id", "digest", "bands"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(made, f"id {dict(slim.dtypes)['id']}, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, h, c): the shingles of the nodes (node, digest), 8 bytes each, and their counts if any is over one.

    They are read from the texts again; a bounded Bloom filter of the nodes
    saves the other texts their work.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hash_filter(nodes.select(F.expr(DIGEST_HASH).alias("h")), nodes.count()))
    marked = docs.select(F.col(text_col).cast("string").alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                words = words_of_block(data, offsets)
                keys = word_keys(data, offsets)
                asked = np.flatnonzero(np.diff(words.offsets) > 0)
                asked = asked[may_hold(shared.value, digest_hash([keys[i] for i in asked]))]
                h, count, doc = counted_shingles(words)
                ends = np.searchsorted(doc, np.arange(len(offsets)))
                sets = [(h[ends[d] : ends[d + 1]].tobytes(), packed_counts(count[ends[d] : ends[d + 1]])) for d in asked]
                columns = [keys[d] for d in asked], [x for x, _ in sets], [x for _, x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["digest", "h", "c"])

    rows = marked.mapInArrow(keyed, "digest binary, h binary, c binary")
    return rows.join(near(nodes), "digest").groupBy("node").agg(F.first("h").alias("h"), F.first("c").alias("c"))


def packed_counts(count: np.ndarray) -> bytes:
    """Counts of shingles, four bytes each; nothing if all are one."""
    return count.astype("<u4").tobytes() if (count > 1).any() else b""


def unpacked(h: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of a set."""
    hashes = np.frombuffer(h, np.uint64)
    return hashes, weights(np.frombuffer(c, "<u4")) if len(c) else np.ones(len(hashes))


def digest_hash(keys: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest as a number, as DIGEST_HASH has it."""
    return np.frombuffer(b"".join(k[:8] for k in keys), ">i8").astype(np.int64)


def verify(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose probability Jaccard is ``similar`` or more."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [prob_jaccard(*unpacked(ha, ca), *unpacked(hb, cb)) >= similar - ROUNDING for ha, ca, hb, cb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = with_sets(with_sets(pairs.select("a", "b"), sets, "b"), sets, "a")
    return both.select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(checked, "a long, b long")


def with_sets(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """Adds the shingle set of one side of pairs (a, b); a text of more than HOT_PAIRS pairs has its set copied for every HOT_PAIRS of them."""
    counts = written(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") > HOT_PAIRS))
    named = sets.select(F.col("node").alias(side), F.col("h").alias(f"h{side}"), F.col("c").alias(f"c{side}"))
    if counts.isEmpty():
        return pairs.join(named, side)
    parts = F.coalesce(F.ceil(F.col("pairs") / HOT_PAIRS), F.lit(1)).cast("int")
    dealt = attach_groups(pairs, counts, side, "pairs", pairs.count()).withColumn("part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("pairs")
    copied = named.join(near(counts), side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("pairs")
    return dealt.join(copied, [side, "part"]).drop("part")


def candidate_buckets(groups: DataFrame) -> DataFrame:
    """(key, node, n, c0, c1, ...): the members of the buckets of two texts or more, with the bucket's centres.

    Centres are the first texts of the bucket in CENTRES random orders that
    all buckets share, so a text meets few different ones. Of buckets with the
    same texts (equal size and exclusive-or of two hashes) one stays.
    """
    members = groups.select("node", F.explode("bands").alias("key"))
    order = lambda salt: F.xxhash64("node", F.lit(salt))
    centres = [f"c{i}" for i in range(CENTRES)]
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(order(-1)).alias("x"), F.bit_xor(order(-2)).alias("y"), *[F.min_by("node", order(i)).alias(c) for i, c in enumerate(centres)]
    )
    unique = written(buckets.where("n > 1").groupBy("n", "x", "y", *centres).agg(F.min("key").alias("key")).select("key", "n", *centres))
    return join_groups(members, unique, "key", "n", groups.count() * BANDS)


def links_between(part: pd.DataFrame, similar: float) -> pd.DataFrame:
    """(a, b): classes that a verified pair links: one text outside the largest class with any other here.

    The probability Jaccard is at most the common mass of the two sets scaled
    to a sum of one, so only pairs with enough of that are computed exactly.
    """
    sets = [unpacked(h, c) for h, c in zip(part["h"], part["c"], strict=True)]
    node, label, outside, top = (part[c].to_list() for c in ("node", "label", "outside", "top"))
    ours, theirs = [i for i, o in enumerate(outside) if o], [i for i, o in enumerate(outside) if not o]
    found: set[tuple[int, int]] = set()
    if ours and theirs:
        vocabulary, place = np.unique(np.concatenate([sets[i][0] for i in theirs]), return_inverse=True)
        mass = np.concatenate([sets[i][1] / sets[i][1].sum() for i in theirs])
        sizes = np.array([len(sets[i][0]) for i in theirs])
        starts, mine = np.cumsum(sizes) - sizes, np.zeros(len(vocabulary))
        for i in ours:
            h, w = sets[i]
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            has = vocabulary[at] == h
            mine[at[has]] = w[has] / w.sum()
            common = np.add.reduceat(np.minimum(mine[place], mass), starts)
            mine[at[has]] = 0.0
            close = np.flatnonzero(common >= similar - 1e-6)
            for j in (theirs[k] for k in close[np.argsort(-common[close], kind="stable")]):
                # of two texts outside the largest class only the smaller one asks
                pair = min(label[i], label[j]), max(label[i], label[j])
                if label[j] != label[i] and pair not in found and (label[j] == top[j] or node[i] < node[j]) and prob_jaccard(h, w, *sets[j]) >= similar - ROUNDING:
                    found.add(pair)
    return pd.DataFrame(sorted(found), columns=["a", "b"])


def remaining_links(found: DataFrame, labels: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b): verified links between the classes that share a bucket, with no pair of its texts left out.

    Pairs with a centre have been compared. In the buckets whose other texts
    are of several classes, the texts outside the largest class meet all the
    others in a grid of blocks of bounded bytes, so no task grows with the bucket.
    """
    centres = [f"c{i}" for i in range(CENTRES)]
    rest = found.where(~F.col("node").isin(*map(F.col, centres))).select("key", "node", "n")
    rest = rest.join(near(labels), "node", "left").select("key", "n", "node", F.coalesce("label", "node").alias("label"))
    by_class = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    mixed = written(by_class.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.max("n").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes"))
    open_ = join_groups(rest.drop("n"), mixed, "key", "n", found.count())
    rows = written(open_.join(near(written(sets.select("node", F.length("h").alias("size")))), "node"))
    parts = lambda what, limit: F.ceil(F.sum(what) / limit).cast("int")
    grid = rows.groupBy("key").agg(parts(F.when(F.col("label") != F.col("top"), F.col("size")).otherwise(0), OUTSIDE_BYTES).alias("n_outside"), parts("size", MEMBER_BYTES).alias("n_members"), F.max("n").alias("n"))
    rows = join_groups(rows.drop("n"), written(grid), "key", "n", rows.count())
    dealt = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.where("label <> top").select("key", "node", "label", "top", F.lit(True).alias("outside"), dealt("n_outside", 1).alias("o"), every("n_members").alias("m"))
    asked = rows.select("key", "node", "label", "top", F.lit(False).alias("outside"), every("n_outside").alias("o"), dealt("n_members", 2).alias("m"))
    met = asking.unionByName(asked).join(sets, "node")
    return met.groupBy("key", "o", "m").applyInPandas(lambda part: links_between(part, similar), "a long, b long").distinct()


def link_labels(docs: DataFrame, text_col: str, groups: DataFrame, similar: float) -> DataFrame | None:
    """(node, label) of the distinct texts with a verified link, label naming the class; None without candidates.

    Every bucket of a band is first a few stars: all its texts are compared
    with its centres, so these candidates grow with the rows and not with the
    pairs. Their links make classes; pairs of different classes that share a
    bucket and were not compared yet are compared then, each once in a bucket,
    and the links found so join whole classes. All pairs that share a bucket
    are thus either in one class or compared.
    """
    found = written(candidate_buckets(groups))
    nodes = written(found.select("node").distinct().join(groups.select("node", "digest"), "node"))
    if nodes.isEmpty():
        return None
    sets = written(shingle_sets(docs, text_col, nodes))
    stars = found.select("node", F.explode(F.array_distinct(F.array(*[f"c{i}" for i in range(CENTRES)]))).alias("centre")).where("node <> centre")
    pairs = written(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    labels = components(written(verify(pairs, sets, similar)))
    more = components(written(remaining_links(found, labels, sets, similar)))
    joined = nodes.select("node").join(near(labels), "node", "left").select("node", F.coalesce("label", "node").alias("first"))
    return written(joined.join(near(more.select(F.col("node").alias("first"), "label")), "first", "left").select("node", F.coalesce("label", "first").alias("label")))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, class_id, class_size, kept.

    Texts whose weighted five-word shingles have a probability Jaccard of
    ``similar`` or more are linked, and linked texts form a class; class_id is
    its smallest id and kept marks that row. Words are as in
    ``common.words_of``; a text of one to four words has one shingle of all of
    them. Texts of equal words are one node, so their copies cost one row each.
    Null, empty and wordless texts are classes of their own. Null ids sort
    last; rows that repeat an id are rows of their own, and all rows of the
    class with its smallest id are kept. Other columns are ignored.
    """
    sig = written(signatures(docs, id_col, text_col))
    total = sig.count()
    distinct = sig.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    groups = written(distinct.withColumn("node", F.monotonically_increasing_id()))
    labels = link_labels(docs, text_col, groups, similar)
    named = groups.drop("bands").withColumn("label", F.col("node")) if labels is None else groups.drop("bands").join(near(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named)
    classes = written(named.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts")))
    by_digest = written(attach_groups(named, classes, "label", "texts", total).select("digest", "copies", "class_id", "class_size"))
    found = attach_groups(sig.where("digest is not null").select("id", "digest"), by_digest, "digest", "copies", total).select("id", "class_id", "class_size")
    alone = sig.where("digest is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
