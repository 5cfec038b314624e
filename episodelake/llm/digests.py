"""Digests of texts that come in many pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodelake.llm.common import written


def ordered_sha256(pieces: DataFrame, key: str, order: str, text: str, join: str) -> DataFrame:
    """(key, sha256): lower-case hex digest of a key's texts in their order, with ``join`` between them; null texts are left out.

    Texts of one key run through one task in order, since the digest is of their
    sequence, but only one of them is in memory.
    """
    kind = pieces.schema[key].dataType.simpleString()
    rows = pieces.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t")).repartition("k").sortWithinPartitions("k", "o").select("k", "t")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun, out = None, None, False, []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state, begun = k, hashlib.sha256(), False
                if t is not None:
                    state.update((join * begun + t).encode())
                    begun = True
            if len(out) >= 1024:
                yield made(out, batch.schema.field(0).type)
                out = []
        if state is not None:
            yield made([*out, (key, state.hexdigest())], batch.schema.field(0).type)

    def made(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], names=["k", "sha256"])

    return rows.mapInArrow(digested, f"k {kind}, sha256 string").withColumnRenamed("k", key)


def joined_ids_sha256(rows: DataFrame, key: str, value: str, most: int = 8192) -> DataFrame:
    """(key, sha256) of each key's integers in ascending order, in decimal, joined by commas.

    Integers are range-partitioned by key and value and written out in pieces
    of ``most`` by as many tasks as there are; only keys of several pieces have
    those run through one task.
    """
    kind = rows.schema[key].dataType.simpleString()
    ordered = rows.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).repartitionByRange("k", "v").sortWithinPartitions("k", "v")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, key, held = TaskContext.get().partitionId() << 32, None, []
        out: list[tuple] = []
        kind = pa.null()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((kind, pa.int64(), pa.string()))], names=["k", "piece", "t"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != key or len(held) >= most):
                    out.append((key, number, ",".join(map(str, held))))
                    number, held = number + 1, []
                key = k
                held.append(v)
            if len(out) >= 1024:
                yield made()
                out.clear()
        if held:
            out.append((key, number, ",".join(map(str, held))))
        if out:
            yield made()

    pieces = written(ordered.mapInArrow(cut, f"k {kind}, piece long, t string"))
    per_key = pieces.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))
    one = per_key.where("n = 1").select("k", F.sha2("t", 256).alias("sha256"))
    more = ordered_sha256(pieces.join(per_key.where("n > 1").select("k"), "k", "left_semi"), "k", "piece", "t", ",")
    return one.unionByName(more).withColumnRenamed("k", key)
