"""The trie of conversations' prefixes, its subtrees summed along an Euler tour.

A prefix of turns is named by a polynomial hash of its turns' digests modulo
2**127 - 1, which pieces of a long conversation can compute apart. A node has an
enter arc and an exit arc. An enter arc is followed by the enter arc of its
node's first child, or by its own exit arc; an exit arc by the enter arc of the
next child of the same parent, or by the parent's exit arc. List ranking along
these arcs gives prefix sums at every arc, and a subtree's leaves and savings
are what was added between its two arcs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodelake.llm.common import attach_groups, join_groups, near, written
from episodelake.llm.digests import joined_ids_sha256
from episodelake.llm.list_rank import list_sums
from episodelake.operators.windows import places

#: Modulus and base of prefix names, and turns of a piece of a conversation.
PRIME, BASE, PIECE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15, 4096
ROOT = bytes(16)


def numbered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, n, digest, chars): each turn's place (from 1) among the n of its conversation; texts stay behind, their digests go on."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(spaced[0]).cast("string"), *spaced), 256), 1, 32))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(spaced[1]).cast("long").alias("chars"))
    placed = written(places(rows, ["conv", "turn", "digest"]).drop("turn"))
    per = written(placed.groupBy("conv").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
    return join_groups(placed, per, "conv", "n", placed.count()).select("conv", (F.col("place") - F.col("first") + 1).alias("pos"), "n", "digest", "chars")


def entry_names(pieces: DataFrame) -> DataFrame:
    """(conv, piece, entry): the prefix name in front of each piece but the first of conversations with several."""

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                name = 0
                for t in row["turns"]:
                    name = (name * BASE + int.from_bytes(t["digest"], "big")) % PRIME
                out.append((row["conv"], row["piece"], len(row["turns"]), name.to_bytes(16, "big")))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["conv", "piece", "n", "name"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                name = 0
                for p in row["pieces"]:
                    out.append((row["conv"], p["piece"], name.to_bytes(16, "big")))
                    name = (name * pow(BASE, p["n"], PRIME) + int.from_bytes(p["name"], "big")) % PRIME
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["conv", "piece", "entry"])

    long = near(written(pieces.where("piece = 1").select("conv")))
    names = pieces.join(long, "conv", "left_semi").mapInArrow(shifted, "conv long, piece long, n long, name binary")
    together = names.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", "n", "name"))).alias("pieces"))
    return together.mapInArrow(summed, "conv long, piece long, entry binary").where("piece > 0")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, name, parent, chars, last) of turns (conv, depth, digest, chars, total), total being the last depth."""
    piece = F.floor((F.col("depth") - 1) / PIECE).alias("piece")
    pieces = written(turns.groupBy("conv", piece).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "chars", (F.col("depth") == F.col("total")).alias("last")))).alias("turns")))
    entered = pieces.join(near(written(entry_names(pieces))), ["conv", "piece"], "left")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                name = int.from_bytes(row["entry"] or ROOT, "big")
                for t in row["turns"]:
                    parent, name = name, (name * BASE + int.from_bytes(t["digest"], "big")) % PRIME
                    out.append({"conv": row["conv"], "depth": t["depth"], "name": name.to_bytes(16, "big"), "parent": parent.to_bytes(16, "big"), "chars": t["chars"], "last": t["last"]})
                if len(out) >= 8192:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("name", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])
    return entered.mapInArrow(named, "conv long, depth long, name binary, parent binary, chars long, last boolean")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations' prefixes, all longs but the digest.

    ``turns`` has conv, depth (1, 2, … in each conversation), digest (16 bytes
    that stand for a turn's content), chars (its size) and total (the
    conversation's turns); ``convs`` has conv and total of every conversation,
    also of those without turns. Columns: conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the size of each node's
    last turn) and ends_sha256 (of the ids of the members that end here,
    ascending and joined by commas). Without conversations there is no row.

    No group is brought together: members are counted before they are shuffled,
    children are ordered by range partitions, and a parent's row meets those of
    many children by a broadcast of such parents, which are few.
    """
    made = written(prefixes(turns))
    nodes = made.groupBy("name").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(F.lit(ROOT).alias("name"), "conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("chars"))
    placed = written(places(nodes.unionByName(root), ["parent", "conv"]))
    n = placed.count()
    kids = placed.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.min("place").alias("child"), F.count(F.lit(1)).alias("n_children"))
    after = placed.select((F.col("place") - 1).alias("place"), F.col("parent").alias("after_parent"))
    known = written(placed.join(kids, "name", "left").join(after, "place", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = written(known.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"), F.col("place").alias("parent_place"), F.col("n_children").alias("size")))
    full = written(attach_groups(known, parents, "parent", "size", n))

    enter, leave = F.col("place") * 2, F.col("place") * 2 + 1
    inside = F.when(F.col("n_children") > 0, F.col("child") * 2).otherwise(leave)
    beside = F.when(F.col("after_parent") == F.col("parent"), enter + 2).otherwise(F.col("parent_place") * 2 + 1)
    zero = F.lit(0).cast("long")
    arcs = F.array(
        F.struct(enter.alias("id"), inside.alias("next"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")),
        F.struct(leave.alias("id"), beside.alias("next"), zero.alias("leaves"), zero.alias("saved")),
    )
    tour = full.select("conv", "depth", F.explode(arcs).alias("a")).select("a.*", "conv", "depth")
    sums = list_sums(tour, ["leaves", "saved"], ["conv", "depth"])
    sign = F.when(F.col("id") % 2 == 1, 1).otherwise(-1)
    subtree = sums.groupBy(F.floor(F.col("id") / 2).alias("place")).agg(F.sum(sign * F.col("before_leaves")).alias("n_leaves"), F.sum(sign * F.col("before_saved")).alias("saved_tokens"))
    ends = joined_ids_sha256(made.where("last").select("name", "conv").unionByName(convs.where("total = 0").select(F.lit(ROOT).alias("name"), "conv")), "name", "conv")
    out = full.join(subtree, "place").join(ends, "name", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def rebuilt(turns: DataFrame, shared: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) for ``prefix_trie`` of conversations that begin like the first of their group.

    Conversation c takes the first h turns of c - c % group (none if there is no
    such one), then its own behind its first h; h is the CRC-32 of c in decimal
    modulo ``shared``. % has the sign of c.
    """
    turns = written(turns)
    base, h = F.col("conv") - F.col("conv") % group, F.crc32(F.col("conv").cast("string")) % shared
    per = turns.groupBy("conv").agg(F.max("n").alias("n")).select("conv", "n", base.alias("base"), h.alias("h"))
    lengths = per.where("conv = base").select("base", F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = written(per.join(lengths, "base", "left").select("conv", "base", "h", taken.alias("taken"), "n", (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total")))
    firsts = turns.where((F.col("conv") == base) & (F.col("pos") < shared)).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "digest", "chars")
    from_base = convs.where("taken > 0").join(firsts, "base").where("depth <= taken").select("conv", "depth", "digest", "chars", "total")
    own = join_groups(turns.drop("n"), convs, "conv", "n", turns.count()).where("pos > h").select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars", "total")
    return from_base.unionByName(own), convs.select("conv", "total")
