"""Bloom filters put together by Spark tasks, of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bits of a filter: so many for each row, between the two bounds (the upper one is 32 MB).
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
PROBES = 3
#: A filter is put together in segments of so many bits.
SEGMENT_BITS = 1 << 16
#: A task sorts its bits anew when it holds so many more, or as many more as it had.
MERGED_BITS = 1 << 20


def probe_bits(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """PROBES bit numbers for each 64-bit hash, by double hashing; shape (PROBES, n)."""
    h = hashes.view(np.uint64)
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * step) % np.uint64(n_bits) for i in range(PROBES)]).astype(np.int64)


def may_hold(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash."""
    at = probe_bits(hashes, len(filled) * 8)
    return ((filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0).astype(bool)


def hash_filter(hashes: DataFrame, n_rows: int, times: int = 1) -> np.ndarray:
    """A filter of the hashes (column h) that occur ``times`` (1 or 2) times or more.

    Each task keeps which bits its rows set once and which they set for two
    rows or more, and sends both by segment. For ``times`` 2, a bit of the
    result is set when two tasks set it, or one task set it twice: all bits of
    a repeated hash are set (no misses). The filter has MOST_BITS at most
    whatever the input, and a fuller filter only lets more rows through.
    """
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ROW * max(1, n_rows) - 1).bit_length()))

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merge() -> None:
            nonlocal once, twice
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            # bits met again: by other rows held, or by an earlier merge
            twice = np.union1d(twice, np.union1d(values[counts > 1], np.intersect1d(once, values, assume_unique=True)))
            once = np.union1d(once, values)
            held.clear()

        for batch in batches:
            held.append(probe_bits(batch["h"].to_numpy(np.int64), n_bits).ravel())
            if sum(map(len, held)) > max(MERGED_BITS, len(once)):
                merge()
        if held:
            merge()
        for kind, found in ((1, once), (2, twice)):
            segment = found // SEGMENT_BITS
            cuts = np.flatnonzero(np.diff(segment)) + 1
            for part in np.split(found, cuts) if len(found) else []:
                yield pd.DataFrame({"segment": [int(part[0]) // SEGMENT_BITS], "kind": [kind], "bits": [(part % SEGMENT_BITS).astype("<u2").tobytes()]})

    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(SEGMENT_BITS, np.int64)
        for kind, bits in zip(part["kind"], part["bits"], strict=True):
            seen[np.frombuffer(bits, "<u2")] += kind
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(seen >= times).tobytes()]})

    parts = hashes.select("h").mapInPandas(of_task, "segment long, kind int, bits binary")
    filled = np.zeros(n_bits // 8, np.uint8)
    for segment, bits in parts.groupBy("segment").applyInPandas(merged, "segment long, bits binary").toLocalIterator():
        start = segment * SEGMENT_BITS // 8
        filled[start : start + SEGMENT_BITS // 8] = np.frombuffer(bits, np.uint8)
    return filled
