"""Recording of episodes from a stream of frames, and statistics that grow with each closed episode."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from episodelake.operators.stats import merge_stats
from episodelake.paths import exists

#: State of the operators here is in RocksDB, which alone has timers, lists and maps; a batch saves its changes, not the whole state.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
STATISTICS = ["min", "max", "mean", "std"]
#: A frame as it waits, with its key: time, number (or none), value, whether it closes.
FRAME = ["us", "id", "none", "value", "done"]
#: A key's open episode, and what its count and moments are when nothing is open.
OPEN = ["episode", "count", "lo", "hi", "mean", "squares", "last"]
NOTHING = (0, np.inf, -np.inf, 0.0, 0.0)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def _rows(packed: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(p)).read_all() for p in packed], promote_options="permissive")


class Recorder(StatefulProcessor):
    """Frames of a bucket of keys, held until the watermark has passed them, then numbered in each key's order.

    Calls for each key would take nearly all the time, so keys share them by
    buckets. Frames wait packed, in pieces of one slice of time each, so
    a step holds one slice of a bucket at most. Of a key only its open episode's
    number, count, moments and newest time are kept. A bucket has one timer, at
    its first waiting frame or the first end of an idle episode.
    """

    def __init__(self, key: str, fps: float, slice_us: int, idle_us: int) -> None:
        self.key, self.fps, self.slice_us, self.idle_us = key, fps, slice_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _struct(piece=T.LongType()), _struct(frames=T.BinaryType()))
        # the keys with their open episodes; each piece's number and first time; the timer
        self.bucket = handle.getValueState("bucket", _struct(open=T.BinaryType(), pieces=T.BinaryType(), timer=T.LongType()))

    def held(self) -> tuple[pa.Table | None, dict[int, int], int | None]:
        if not self.bucket.exists():
            return None, {}, None
        known, pieces, timer = self.bucket.get()
        return _rows([known]) if known else None, {int(n): int(first) for n, first in np.frombuffer(pieces, np.int64).reshape(-1, 2)}, timer

    def hold(self, known: pa.Table | None, pieces: dict[int, int], timer: int | None, due: int | None) -> None:
        at = None if due is None else -(-due // 1000)
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        self.bucket.update((_packed(known) if known is not None else None, np.array(list(pieces.items()), np.int64).tobytes(), at))

    def keep(self, frames: pa.Table, pieces: dict[int, int]) -> None:
        """Frames of one slice become a piece."""
        number = max(pieces, default=-1) + 1
        self.waiting.updateValue((number,), (_packed(frames),))
        pieces[number] = int(frames["us"].to_numpy().min())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, pieces, timer = self.held()
        for part in rows:
            frames = pa.Table.from_pandas(part[[self.key, *FRAME]], preserve_index=False).replace_schema_metadata(None)
            slices = frames["us"].to_numpy() // self.slice_us
            order = np.argsort(slices, kind="stable")
            cuts = np.flatnonzero(np.diff(slices[order])) + 1
            for some in np.split(order, cuts):
                self.keep(frames.take(some), pieces)
        first = min(pieces.values(), default=None)
        self.hold(known, pieces, timer, first if timer is None else min(first, timer * 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000  # no frame up to here will come any more
        known, pieces, _ = self.held()
        due: dict[int, list[int]] = {}
        for number, first in pieces.items():
            if first <= now:
                due.setdefault(first // self.slice_us, []).append(number)
        for name in sorted(due):
            frames = _rows([self.waiting.getValue((n,))[0] for n in due[name]])
            for n in due[name]:
                self.waiting.removeKey((n,))
                del pieces[n]
            ready = frames["us"].to_numpy() <= now
            if not ready.all():
                self.keep(frames.filter(pa.array(~ready)), pieces)
                frames = frames.filter(pa.array(ready))
            out, known = self.number(frames, known)
            yield out
        ends = [*pieces.values()]
        if known is not None:
            open_, last = (known[c].to_numpy() for c in ("count", "last"))
            idle = (open_ > 0) & (last + self.idle_us <= now)  # what still waits is later
            if idle.any():
                out, known = self.close_idle(known, idle)
                yield out
            ends += (last + self.idle_us)[(open_ > 0) & ~idle].tolist()
        self.hold(known, pieces, None, min(ends, default=None))

    def close_idle(self, known: pa.Table, idle: np.ndarray) -> tuple[pd.DataFrame, pa.Table]:
        """(the rows that close episodes without a last frame, the keys with nothing open there)."""
        state = {c: known[c].to_numpy().copy() for c in OPEN}
        n = np.flatnonzero(idle)
        out = self.ends(known[self.key].take(n), *(state[c][n] for c in OPEN[:-1]))
        state["episode"][n] += 1
        for c, v in zip(OPEN[1:-1], NOTHING, strict=True):
            state[c][n] = v
        return out, pa.table({self.key: known[self.key], **state})

    def ends(self, keys: Any, episode: np.ndarray, count: np.ndarray, lo: np.ndarray, hi: np.ndarray, mean: np.ndarray, squares: np.ndarray) -> pd.DataFrame:
        return self.frame(keys, {"id": None, "episode": episode, "frame_index": None, "timestamp": np.nan, "closed": True, "length": count, "min": lo, "max": hi, "mean": mean, "std": np.sqrt(squares / count)})

    def number(self, frames: pa.Table, known: pa.Table | None) -> tuple[pd.DataFrame, pa.Table]:
        """(frames in order with their numbers, all keys with the open episodes behind them)."""
        m = 0 if known is None else len(known)
        own = frames.select([self.key])
        named = (pa.concat_tables([known.select([self.key]), own], promote_options="permissive") if m else own)[self.key].combine_chunks().dictionary_encode("encode")
        code, names = named.indices.to_numpy()[m:].astype(np.int64), named.dictionary  # known keys have their places as codes
        new = np.arange(len(names)) >= m
        state = {c: np.full(len(names), v) for c, v in zip(OPEN, (0, *NOTHING, 0), strict=True)}
        for c in OPEN if m else ():
            state[c][:m] = known[c].to_numpy()
        at, ids, none, done = (frames[c].to_numpy() for c in ("us", "id", "none", "done"))
        order = np.lexsort((ids, none, at, code))
        code, at, ids, none, ends, x = code[order], at[order], ids[order], none[order], done[order].astype(bool), frames["value"].to_numpy().astype(float)[order]

        # episodes: a key's first begins with its first frame, others behind a last frame or a gap
        head = np.r_[True, code[1:] != code[:-1]]
        before = np.where(head, np.where(new[code], at, state["last"][code]), np.r_[at[0], at[:-1]])
        gap = at - before >= self.idle_us
        left = head & gap & (state["count"][code] > 0)  # an episode open before has ended idle
        begins = np.where(head, left, np.r_[False, ends[:-1]] | gap)
        starts = np.flatnonzero(head | begins)
        part = np.cumsum(head | begins) - 1
        step = np.cumsum(begins)
        heads = np.flatnonzero(head)
        of_key = np.cumsum(head) - 1
        episode = state["episode"][code] + step - (step - begins)[heads][of_key]

        # these frames' moments, then the open episodes' joined to the first of their keys
        owner, goes_on = code[starts], (head & ~left)[starts]
        stored = {c: np.where(goes_on, state[c][owner], v) for c, v in zip(OPEN[1:-1], NOTHING, strict=True)}
        counts = np.diff(np.r_[starts, len(x)])
        begun = stored["count"]
        frame = np.arange(len(x)) - starts[part] + begun[part]
        means = np.bincount(part, x) / counts
        squares = np.bincount(part, (x - means[part]) ** 2)
        total = counts + begun
        shift = means - stored["mean"]
        squares += stored["squares"] + shift * shift * begun * counts / total
        means = stored["mean"] + shift * counts / total
        least, most = np.minimum(np.minimum.reduceat(x, starts), stored["lo"]), np.maximum(np.maximum.reduceat(x, starts), stored["hi"])
        stats = {"length": total.astype(float), "min": least, "max": most, "mean": means, "std": np.sqrt(squares / total)}
        out = [self.frame(names.take(pa.array(code)), {"id": pd.arrays.IntegerArray(ids, none), "episode": episode, "frame_index": frame, "timestamp": frame / self.fps, "closed": ends, **{k: np.where(ends, v[part], np.nan) for k, v in stats.items()}})]

        # idle ends: of stored episodes, and of those that a gap ended here
        gone = code[left]
        if len(gone):
            out.append(self.ends(names.take(pa.array(gone)), *(state[c][gone] for c in OPEN[:-1])))
        last = np.r_[starts[1:], len(x)] - 1
        tails = np.r_[owner[1:] != owner[:-1], True]
        cut = ~tails & ~ends[last]
        if cut.any():
            out.append(self.ends(names.take(pa.array(owner[cut])), episode[last][cut], total[cut], least[cut], most[cut], means[cut], squares[cut]))

        k, shut = owner[tails], ends[last][tails]
        state["episode"][k] = episode[last][tails] + shut
        state["last"][k] = at[last][tails]
        for (c, v), now in zip(zip(OPEN[1:-1], NOTHING, strict=True), (total, least, most, means, squares), strict=True):
            state[c][k] = np.where(shut, v, now[tails])
        return pd.concat(out) if len(out) > 1 else out[0], pa.table({self.key: names, **state})

    def frame(self, keys: Any, columns: dict) -> pd.DataFrame:
        return pd.DataFrame({self.key: keys.to_pandas(), **columns}).astype({"id": "Int64", "frame_index": "Int64", "length": "Int64", "timestamp": float})


def record_episodes(stream: DataFrame, key: str, frame: str, at: str, done: str, value: str, fps: float, late: str = "1 minute", idle_seconds: float = 3600.0, slice_seconds: float = 3600.0, buckets: int = 256) -> DataFrame:
    """Frames numbered in episodes, in the order of their times, whatever order they come in.

    Columns: key, id (of the frame), episode (0.. of the key), frame_index,
    timestamp (frame_index / fps), closed, and where closed length, min, max,
    mean and std (population) of the episode's values. A frame that is ``done``
    closes its key's episode and the next one opens another; an episode after
    whose newest frame none comes for ``idle_seconds`` closes too, with a row of
    its own that has no frame. Frames are given out when the watermark, ``late`` behind
    the newest time of all, has passed them; later ones are dropped. Equal times
    go by id. Keys are dealt to ``buckets``, which share their state: a task holds
    one bucket's frames of one slice of time, and a batch reads and writes the
    open episodes of the buckets that have frames or timers in it. Start the query
    with ROCKS set; more state partitions than buckets stay empty.
    """
    when = F.col(at).cast("timestamp")
    # pandas has no whole numbers beside nulls: nulls are marked, and the null key has a bucket of its own
    frames = stream.select(
        F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int").alias("__bucket"), F.col(key), when.alias("at"), F.coalesce(F.unix_micros(when), F.lit(-(1 << 63))).alias("us"), F.coalesce(F.col(frame).cast("long"), F.lit(0)).alias("id"),
        F.col(frame).isNull().alias("none"), F.col(value).cast("double").alias("value"), F.coalesce(F.col(done), F.lit(False)).alias("done"),
    )
    kind = T.StructType([stream.select(key).schema[0], *(T.StructField(n, t) for n, t in (("id", T.LongType()), ("episode", T.LongType()), ("frame_index", T.LongType()), ("timestamp", T.DoubleType()), ("closed", T.BooleanType()), ("length", T.LongType()), *[(s, T.DoubleType()) for s in STATISTICS]))])
    recorder = Recorder(key, fps, int(slice_seconds * 1e6), int(idle_seconds * 1e6))
    return frames.withWatermark("at", late).groupBy("__bucket").transformWithStateInPandas(recorder, kind, "append", "eventtime")


def recorded_totals(rows: DataFrame) -> DataFrame:
    """One row of what was recorded: episodes and frames that are closed, the split string, and frames of open episodes."""
    t = rows.agg(F.count_if("closed").alias("episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("frames"), F.count("id").alias("n"))
    return t.select("episodes", "frames", F.concat(F.lit("0:"), F.col("episodes").cast("string")).alias("split"), (F.col("n") - F.col("frames")).alias("open_frames"))


def merge_batch(batch: DataFrame, number: int, store: str, keys: list[str]) -> None:
    """Merges a micro-batch's statistics (keys, min, max, mean, std, count) into the stored ones, once for each batch number.

    The store has a table for each batch, made from the last one before it and
    the batch: a batch that is done again replaces its own table, so nothing
    counts twice, and no row is read again that an earlier batch had.
    """
    spark = batch.sparkSession
    names = [*keys, "min", "max", "mean", "std", "count"]
    parts = batch.select(names)
    last = stored_batch(spark, store, number)
    if last is not None:
        parts = parts.unionByName(spark.read.schema(parts.schema).parquet(f"{store}/batch={last}"))
    merge_stats(parts, keys).select(names).write.mode("overwrite").parquet(f"{store}/batch={number}")


def stored_batch(spark: Any, store: str, before: int | None = None) -> int | None:
    """The newest finished batch of a store, or the newest before a number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/batch=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    numbers = [int(s.getPath().getName().split("=")[1]) for s in found if exists(spark, f"{s.getPath()}/_SUCCESS")]
    return max((n for n in numbers if before is None or n < before), default=None)


def stored_stats(spark: Any, store: str) -> DataFrame:
    """The merged statistics of all batches so far."""
    return spark.read.parquet(f"{store}/batch={stored_batch(spark, store)}")
