"""Text quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodelake.llm.common import written
from episodelake.llm.textbytes import text_blocks, words_of_block

#: The model is fitted on so many labelled rows at most, those with the smallest id hashes; each gives PAIRS pairs.
SAMPLE_ROWS, PAIRS = 20_000, 8
CUT = 0.7
FEATURES = [
    "log_bytes", "letters", "upper", "digits", "high", "space", "lines", "punct", "marks", "bang", "bars", "stops", "brackets", "word_len", "word_sd", "log_words",
    "unique", "top_word", "pairs_unique", "runs",
]


def _classes() -> dict[str, np.ndarray]:
    def chars(text: str) -> np.ndarray:
        out = np.zeros(256, np.float64)
        out[[ord(c) for c in text]] = 1
        return out

    letters = "abcdefghijklmnopqrstuvwxyz"
    high = np.zeros(256)
    high[128:] = 1
    return {
        "letters": chars(letters + letters.upper()) + high, "upper": chars(letters.upper()), "digits": chars("0123456789"), "high": high, "space": chars(" \t"), "lines": chars("\n"),
        "punct": chars(",;:'\"-"), "marks": chars("#$%&*~^=+<>@_/\\"), "bang": chars("!?"), "bars": chars("|"), "stops": chars("."), "brackets": chars("()[]{}"),
    }


CLASSES = _classes()


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many distinct keys it has, and how often the commonest stands in it."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[new, len(k)])
    most = np.zeros(n_docs)
    np.maximum.at(most, d[new], counts)
    return np.bincount(d[new], minlength=n_docs).astype(float), most


def block_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text of a block; an empty text has zeros."""
    n_docs, size = len(offsets) - 1, np.diff(offsets).astype(float)
    w = words_of_block(data, offsets)
    n_words = np.diff(w.offsets).astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(n_words, 1)
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(n_words)}
    cell = np.repeat(np.arange(n_docs, dtype=np.int64) * 256, np.diff(offsets)) + data
    byte_counts = np.bincount(cell, minlength=n_docs * 256).reshape(n_docs, 256)
    for name, table in CLASSES.items():
        out[name] = byte_counts @ table / per_byte
    length = (w.end - w.start).astype(float)
    out["word_len"] = _per_doc(length, w.offsets) / per_word
    out["word_sd"] = np.sqrt(np.maximum(0, _per_doc(length**2, w.offsets) / per_word - out["word_len"] ** 2))
    unique, most = _repeats(w.hash, w.doc, n_docs)
    out["unique"], out["top_word"] = unique / per_word, most / per_word
    same = w.doc[1:] == w.doc[:-1]
    pairs, _ = _repeats((w.hash[:-1] * np.uint64(3) + w.hash[1:])[same], w.doc[1:][same], n_docs)
    out["pairs_unique"] = pairs / np.maximum(n_words - 1, 1)
    again = np.r_[False, (data[1:] == data[:-1])] if len(data) else np.zeros(0, bool)
    out["runs"] = _per_doc(again.astype(float), offsets) / per_byte
    return np.stack([out[f] for f in FEATURES], axis=1)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and FEATURES of every whole text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                x = block_features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], names=[id_col, *FEATURES])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(made, f"`{id_col}` {dict(slim.dtypes)[id_col]}, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class QualityModel:
    """A linear score of scaled features and their squares; ``threshold`` is the raw score that maps to CUT."""

    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    threshold: float = 0.0
    spread: float = 1.0

    def raw(self) -> Column:
        """The score of the feature columns as one expression."""
        total = F.lit(0.0)
        for i, f in enumerate(FEATURES[: len(self.mean)]):
            z = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col(f) - self.mean[i]) / self.scale[i]))
            total = total + self.weights[2 * i] * z + self.weights[2 * i + 1] * z * z
        return total

    def score(self, raw: Column) -> Column:
        if not self.weights:
            return F.lit(0.5)
        return 1 / (1 + F.exp(-(float(np.log(CUT / (1 - CUT))) + (raw - self.threshold) / self.spread)))


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 5, penalty: float = 1e-4, steps: int = 400) -> QualityModel:
    """Logistic loss on the feature differences of (label 1, label 0) pairs, by accelerated gradient descent."""
    if not ((y == 1).any() and (y == 0).any()):
        return QualityModel()
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -4, 4)
    z = np.stack([z, z * z], axis=2).reshape(len(z), -1)
    rng = np.random.default_rng(seed)
    good, bad = z[y == 1], z[y == 0]
    n = PAIRS * max(len(good), len(bad))
    n = min(n, PAIRS * SAMPLE_ROWS)
    diff = (good[rng.integers(len(good), size=n)] - bad[rng.integers(len(bad), size=n)]).astype(np.float32)
    w = ahead = np.zeros(diff.shape[1], np.float32)
    step = 4.0 / float((diff**2).sum(axis=1).mean())
    for i in range(steps):
        grad = -(diff.T @ (1 / (1 + np.exp(np.minimum(diff @ ahead, 30))))) / n + penalty * ahead
        new = ahead - step * grad
        ahead, w = new + i / (i + 3) * (new - w), new
    return QualityModel([float(v) for v in mean], [float(v) for v in scale], [float(v) for v in w])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> QualityModel:
    """Weights from a bounded sample of the labelled rows, the threshold from all of them.

    Rows that are held out give no label. The threshold is the score quantile
    at the share of label 0: half-way between its neighbours 0.2 % on either side.
    """
    known = feats.join(labels.where("quality in (0, 1)").groupBy(id_col).agg(F.min("quality").alias("quality")).where(~held_out(id_col)), id_col)
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).toPandas()
    model = fit_pairs(sample[FEATURES].to_numpy(np.float64), sample["quality"].to_numpy())
    if model.weights:
        raw = known.select("quality", model.raw().alias("raw"))
        share = raw.agg(F.avg(1 - F.col("quality")).alias("s")).first()["s"]
        at = [min(1.0, max(0.0, share + d)) for d in (-0.002, 0.002)]
        row = raw.agg(F.percentile_approx("raw", at, 100_000).alias("q"), F.stddev_pop("raw").alias("sd")).first()
        model.threshold, model.spread = sum(row["q"]) / 2, max(1e-6, row["sd"] / 2)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, held_out, score (0 to 1), predicted (1 if score >= CUT), whatever its text.

    Null texts count as empty and are scored. Null ids are never held out and
    never give labels; of labels that repeat an id, the lower one counts; null
    labels and labels of unknown ids are left out. Without labels of both kinds every
    score is 0.5. Other columns of either table are ignored.
    """
    feats = written(features(docs, id_col, text_col))
    model = fit(feats, labels, id_col)
    score = model.score(model.raw()).cast("double")
    return feats.select(id_col, held_out(id_col).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
