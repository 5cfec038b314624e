"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Only DataFrame and SQL functions: the draws, the permutations and the
exchange all run as Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodelake.llm.common import near, written

#: Rows that one local permutation is meant to hold.
ROWS_PER_PART = 20_000
#: Parts of a group whose counts are drawn one after the other, and groups at most.
GROUP = 1024


def unit(*cols: Column) -> Column:
    """A repeatable uniform number in [0, 1) from the hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def ln_factorial(n: Column) -> Column:
    """ln(n!): exact products up to 15, Stirling's series above (error under 1e-13)."""
    x = n.cast("double") + 1.0
    series = (x - 0.5) * F.ln(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n > 15, series).otherwise(F.ln(F.factorial(F.when(n > 15, F.lit(0)).otherwise(n).cast("int")).cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a plain Column would be computed at each mention."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(u: Column, total: Column, good: Column, draws: Column) -> Column:
    """The u-quantile of how many of ``draws`` from ``total`` items, ``good`` of them marked, are marked.

    The law is summed over all values within 12 standard deviations of the
    mean; what lies outside has a chance below 1e-30.
    """

    def of(x: Column) -> Column:
        share = x["good"] / F.greatest(x["total"], F.lit(1))
        mean = x["draws"] * share
        spread = 12 * F.sqrt(mean * (1 - share) + 1) + 12
        low = F.greatest(F.lit(0), x["draws"] - (x["total"] - x["good"]), F.floor(mean - spread)).cast("long")
        high = F.least(x["draws"], x["good"], F.ceil(mean + spread)).cast("long")
        return let(F.struct(low.alias("low"), high.alias("high"), F.least(high, F.greatest(low, F.round(mean).cast("long"))).alias("peak")), lambda at: within(x, at))

    def log_weight(x: Column, k: Column) -> Column:
        return -(ln_factorial(k) + ln_factorial(x["good"] - k) + ln_factorial(x["draws"] - k) + ln_factorial(x["total"] - x["good"] - x["draws"] + k))

    def within(x: Column, at: Column) -> Column:
        law = let(log_weight(x, at["peak"]), lambda top: F.transform(F.sequence(at["low"], at["high"]), lambda k: F.exp(log_weight(x, k) - top)))
        return F.least(at["high"], at["low"] + let(law, lambda w: let(x["u"] * F.aggregate(w, F.lit(0.0), lambda s, y: s + y), lambda goal: passed(w, goal))))

    def passed(law: Column, goal: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
        return F.aggregate(law, start, lambda s, w: F.struct((s["sum"] + w).alias("sum"), (s["below"] + F.when(s["sum"] + w <= goal, 1).otherwise(0)).alias("below")))["below"]

    return let(F.struct(u.alias("u"), total.alias("total"), good.alias("good"), draws.alias("draws")), of)


def draw_counts(cells: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, counts array<long>) of each row of (cells array<struct<part, n>>, room array<long>), drawn exactly.

    The draw goes part by part: a part's row is multivariate hypergeometric
    given the room that is left in the shards.
    """

    def draw_part(state: Column, cell: Column) -> Column:
        # over the shards: rows of this part still to deal, room in later shards, counts so far
        begin = F.struct(
            cell["n"].cast("long").alias("left"), F.aggregate(state["room"], F.lit(0).cast("long"), lambda a, r: a + r).alias("ahead"), F.array().cast("array<long>").alias("counts")
        )
        dealt = F.aggregate(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            begin,
            lambda d, s: let(
                hypergeometric(unit(F.lit(seed), cell["part"], s), d["ahead"], F.get(state["room"], s), d["left"]),
                lambda k: F.struct((d["left"] - k).alias("left"), (d["ahead"] - F.get(state["room"], s)).alias("ahead"), F.concat(d["counts"], F.array(k)).alias("counts")),
            ),
        )["counts"]
        return let(
            dealt,
            lambda c: F.struct(
                F.zip_with(state["room"], c, lambda r, k: r - k).alias("room"),
                F.concat(state["out"], F.array(F.struct(cell["part"].cast("long").alias("part"), c.alias("counts")))).alias("out"),
            ),
        )

    first = F.struct(F.col("room"), F.array().cast("array<struct<part:bigint,counts:array<bigint>>>").alias("out"))
    drawn = cells.select(F.explode(F.aggregate(F.col("cells"), first, draw_part)["out"]).alias("c"))
    return drawn.select("c.part", "c.counts")


def communication_matrix(parts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, upto array<long>): how many rows of each part (part, n) go to shards 0..s, drawn exactly.

    Shard sizes differ by one at most. The counts of groups of GROUP parts are
    drawn first; then each group's counts are the room of its parts, so groups
    are rows that Spark draws side by side.
    """
    grouped = parts.withColumn("group", F.floor(F.col("part") / GROUP))
    in_order = lambda name: F.sort_array(F.collect_list(F.struct(F.col(name).alias("part"), "n"))).alias("cells")
    sums = grouped.groupBy("group").agg(F.sum("n").alias("n"))
    top = sums.agg(in_order("group"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0)).cast("long"))
    rooms = draw_counts(top.withColumn("room", room), shards, seed).select(F.col("part").alias("group"), F.col("counts").alias("room"))
    drawn = draw_counts(grouped.groupBy("group").agg(in_order("part")).join(rooms, "group"), shards, seed + 1)
    return drawn.select("part", F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("long"), lambda a, k: a + k)).alias("upto"))


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its shard and its slot in the shard, uniformly at random.

    Columns: id_col, size (UTF-8 bytes of the text plus 1), text_crc32, law
    ('rows': shard counts differ by one at most), shard, slot (0.. without
    gaps in each shard), grown_shard (null: this law has none).

    Rows get numbers, which are written once so that retries see the same, are
    dealt to logical parts by a hash of the number and the seed, permuted inside
    their part, cut by the drawn counts, exchanged, and permuted again in blocks
    of a shard. Null texts have size 1 and checksum 0; null or repeated ids and
    repeated rows are rows like any other; empty tables give no rows. Equal
    texts are spread like other rows, so a large group cannot make a shard large.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    slim = written(sizes.withColumn("row", F.monotonically_increasing_id()))
    n_parts = max(1, min(GROUP * GROUP, slim.count() // ROWS_PER_PART))
    slim = slim.withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n_parts)))
    parts = slim.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    local = Window.partitionBy("part").orderBy(F.xxhash64("row", F.lit(seed + 1)), "row")
    placed = (
        slim.withColumn("rank", F.row_number().over(local))
        .join(near(written(communication_matrix(parts, shards, seed))), "part")
        .withColumn("shard", F.size(F.filter("upto", lambda u: u < F.col("rank"))))
        .withColumn("key", F.xxhash64("row", F.lit(seed + 2)))
        .withColumn("block", F.pmod(F.shiftrightunsigned("key", 20), F.lit(n_parts)))
    )
    # the same rows again for the sizes of the blocks, which are shards x parts rows at most
    blocks = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = blocks.withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    inside = Window.partitionBy("shard", "block").orderBy("key", "row")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(near(written(offsets)), ["shard", "block"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
