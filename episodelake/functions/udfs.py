"""Named transforms, batch embedding, SSIM and the table function of task variants."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from episodelake.functions.scalars import wrap_angle
from episodelake.paths import exists


@dataclass(frozen=True)
class Transform:
    """A column function and the one that undoes it."""

    forward: Callable[[Column], Column]
    backward: Callable[[Column], Column]


#: Transforms that a configuration may name, with their parameters.
TRANSFORMS: dict[str, Callable[..., Transform]] = {
    "scale": lambda factor: Transform(lambda c: c * factor, lambda c: c / factor),
    "shift": lambda by: Transform(lambda c: c + by, lambda c: c - by),
    "signed_sqrt": lambda: Transform(lambda c: F.signum(c) * F.sqrt(F.abs(c)), lambda c: F.signum(c) * c * c),
    "wrap": lambda: Transform(wrap_angle, lambda c: c),
}


def pipeline(config: list[dict], backward: bool = False) -> Callable[[Column], Column]:
    """The configured transforms in order, or undone in reverse order."""
    chain = [TRANSFORMS[c["name"]](**{k: v for k, v in c.items() if k != "name"}) for c in config]

    def apply(column: Column) -> Column:
        for t in reversed(chain) if backward else chain:
            column = t.backward(column) if backward else t.forward(column)
        return column

    return apply


class HashEmbedder:
    """Stands in for a text encoder: a repeatable unit vector for each of the first ``length`` words, a batch at a time."""

    def __init__(self, length: int, width: int) -> None:
        self.length, self.width = length, width

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context [n, length, width], mask [n, length], whether a text is longer)."""
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        mask = np.arange(self.length) < sizes[:, None]
        context = np.zeros((len(texts), self.length, self.width))
        held = [w for some in words for w in some[: self.length]]
        if held:
            raw = b"".join(hashlib.shake_128(w.encode()).digest(4 * self.width) for w in held)
            x = np.frombuffer(raw, "<u4").reshape(-1, self.width) / 2.0**31 - 1
            context[mask] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return context, mask, sizes > self.length


def embed(prompts: DataFrame, length: int = 8, width: int = 4, batch: int = 16) -> DataFrame:
    """(key, context, mask, over_length) of each (key, prompt), encoded in batches; the encoder starts once for each task."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = HashEmbedder(length, width)
        for part in parts:
            for a in range(0, part.num_rows, batch):
                some = part.slice(a, batch)
                context, mask, over = model(some.column(1).to_pylist())
                n = some.num_rows
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n * length + 1) * width, pa.int32()), pa.array(context.reshape(-1)))
                steps = np.arange(n + 1) * length
                columns = [some.column(0), pa.ListArray.from_arrays(pa.array(steps, pa.int32()), rows), pa.ListArray.from_arrays(pa.array(steps, pa.int32()), pa.array(mask.reshape(-1))), pa.array(over)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "context", "mask", "over_length"])

    return prompts.select("key", "prompt").mapInArrow(encode, "key string, context array<array<double>>, mask array<boolean>, over_length boolean")


def embed_missing(prompts: DataFrame, cache: str, length: int = 8, width: int = 4) -> DataFrame:
    """Encodes the prompts (key, prompt) that the cache lacks, adds them to it and returns the cache.

    Keys count once. The cache is a table by key; a call that is repeated after
    a failure encodes only what is still missing.
    """
    spark = prompts.sparkSession
    todo = prompts.dropDuplicates(["key"])
    if exists(spark, cache):
        todo = todo.join(spark.read.parquet(cache).select("key"), "key", "left_anti")
    embed(todo, length, width).write.mode("append").parquet(cache)
    return spark.read.parquet(cache)


def ssim(width: int, peak: float = 1.0, size: int = 11, sigma: float = 1.5) -> Callable[[Column, Column], Column]:
    """Mean structural similarity of two grey frames, arrays of rows of ``width`` numbers, under a Gaussian window; null if one is null."""

    @F.pandas_udf(T.DoubleType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        lengths = np.array([-1 if x is None or y is None else len(x) for x, y in zip(a, b, strict=True)])
        for n in np.unique(lengths[lengths > 0]):  # frames of one size together
            some = np.flatnonzero(lengths == n)
            stack = [np.stack(c.iloc[some].to_numpy()).reshape(len(some), -1, width).astype(float) for c in (a, b)]
            out[some] = batch_ssim(*stack, peak, size, sigma)
        return pd.Series(out).astype(object).where(lengths > 0, None)

    return of


def batch_ssim(a: np.ndarray, b: np.ndarray, peak: float, size: int, sigma: float) -> np.ndarray:
    """SSIM of each pair of frames [n, height, width]; the Gaussian runs over rows, then over columns."""
    n = min(size, *a.shape[1:])
    at = np.arange(n) - (n - 1) / 2
    g = np.exp(-(at**2) / (2 * sigma**2))
    g /= g.sum()
    along = lambda x, axis: np.lib.stride_tricks.sliding_window_view(x, n, axis=axis) @ g
    blur = lambda x: along(along(x, 1), 2)
    ma, mb = blur(a), blur(b)
    va, vb, ab = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return (((2 * ma * mb + c1) * (2 * ab + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean(axis=(1, 2))


@udtf(returnType=T.StructType([T.StructField("variant", T.StringType())]))
class TaskVariants:
    """Rows of a bilingual task; the SQL twin of scalars.bilingual_variants."""

    def eval(self, task: str | None) -> Iterator[tuple[str]]:
        seen = dict.fromkeys(s.strip(" ") for s in (task or "").split("@", 1))
        yield from ((s,) for s in seen if s)
