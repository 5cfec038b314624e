"""Prefix sums along linked lists, without a task that has a whole list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodelake.llm.common import near, written

#: Elements that one task is meant to hold, and of a list short enough for one task.
ELEMENTS, LAST = 1 << 19, 1 << 14


def contract(df: DataFrame, weights: list[str]) -> DataFrame:
    """Adds head and before_* to each element, and at heads after and total_*: the runs of elements that follow each other within a partition.

    head is the first of an element's run, before_* the weights of the run in
    front of it; after is the element behind a run, total_* its weights.
    """
    names = ["id", "next", *weights]
    extra = [f"before_{w}" for w in weights], [f"total_{w}" for w in weights]
    rest = [c for c in df.columns if c not in names]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n = len(table)
        ids = table.column("id").to_numpy()
        following = table.column("next").fill_null(-1).to_numpy()
        order = np.argsort(ids)
        at = np.minimum(np.searchsorted(ids[order], following), max(0, n - 1))
        here = ids[order][at] == following if n else np.zeros(0, bool)
        before = np.arange(n)  # the element in front, or itself at a head
        before[order[at[here]]] = np.flatnonzero(here)
        head = before == np.arange(n)
        values = np.stack([table.column(w).to_numpy() for w in weights]) if n else np.zeros((len(weights), 0), np.int64)
        sums = np.where(head, 0, values[:, before])
        up = before.copy()
        while not (up[up] == up).all():  # each step doubles how far back it looks
            sums = sums + sums[:, up]
            up = up[up]
        last = np.flatnonzero(~here)  # the last element of each run
        after, total = np.full(n, -1), np.zeros((len(weights), n), np.int64)
        after[up[last]] = following[last]
        total[:, up[last]] = sums[:, last] + values[:, last]
        columns = [*(table.column(c) for c in ("id", *rest)), pa.array(ids[up] if n else ids, pa.int64()), pa.array(after, pa.int64(), mask=~(head & (after >= 0))), *(pa.array(s, pa.int64()) for s in sums), *(pa.array(t, pa.int64()) for t in total)]
        for batch in pa.table(columns, names=["id", *rest, "head", "after", *extra[0], *extra[1]]).to_batches(8192):
            yield batch

    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.mapInArrow(runs, f"id long{kinds}, head long, after long" + "".join(f", {c} long" for c in [*extra[0], *extra[1]]))


def list_sums(df: DataFrame, weights: list[str], near_by: list[str], last: int = LAST) -> DataFrame:
    """(id, before_*): for each element of linked lists the sum of each weight over the elements in front of it; a weight of 1 gives ranks.

    ``df`` has id (0 or more, unique), next (null at the end), the weights, and
    the columns ``near_by``, by whose order many elements stand in one task with
    their next one. Lists are contracted: first the runs that each task has of a
    range of that order, then in rounds elements chosen by coins, a quarter of
    them each time, so all rounds together move a few times the elements. What
    is left, at most ``last`` elements, is summed in one task; then the rounds
    are taken back. Coins come from hashes, so a repeated task gives the same.
    """
    rows = df.select(*dict.fromkeys(["id", "next", *weights, *near_by]))
    n = rows.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ELEMENTS + 1)
    first = written(contract(rows.repartitionByRange(parts, *near_by), weights))
    now = first.where("head = id").select("id", F.col("after").alias("next"), *[F.col(f"total_{w}").alias(w) for w in weights])
    before = [f"before_{w}" for w in weights]
    rounds: list[DataFrame] = []
    while now.count() > last:

        def coin(c: str, turn: int = len(rounds)) -> Column:
            return F.xxhash64(F.col(c), F.lit(turn)) % 2 == 0

        taken = now.where(coin("id") & F.col("next").isNotNull() & ~coin("next")).select(F.col("next").alias("id"), F.col("id").alias("head"), *[F.col(w).alias(f"before_{w}") for w in weights])
        both = written(now.join(taken, "id", "left"))
        gone = both.where("head is not null")
        rounds.append(gone.select("id", "head", *before))
        bridge = gone.select(F.col("head").alias("id"), F.col("next").alias("__next"), F.lit(True).alias("__gone"), *[F.col(w).alias(f"__{w}") for w in weights])
        stay = both.where("head is null").select("id", "next", *weights).join(bridge, "id", "left")
        joined = [F.when(F.col("__gone"), F.col("__next")).otherwise(F.col("next")).alias("next"), *[(F.col(w) + F.coalesce(f"__{w}", F.lit(0))).alias(w) for w in weights]]
        now = written(stay.select("id", *joined))
    sums = written(contract(now.coalesce(1), weights).select("id", *before))
    for gone in reversed(rounds):
        sums = written(sums.unionByName(added(gone, sums, before)))
    return added(first, sums, before)


def added(members: DataFrame, sums: DataFrame, before: list[str]) -> DataFrame:
    """(id, before_*) of members from those of their heads."""
    heads = near(sums.select(F.col("id").alias("head"), *[F.col(b).alias(f"__{b}") for b in before]))
    return members.join(heads, "head").select("id", *[(F.col(b) + F.col(f"__{b}")).alias(b) for b in before])
