"""Token counts of whole texts with a public tokenizer, in Arrow batches."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are encoded in batches of about so many bytes.
BATCH_BYTES = 4 << 20
#: Counts of pieces that a Python worker keeps; the table starts anew when it is full.
KEPT_PIECES = 400_000
#: Characters above which a piece without white space is cut.
LONG_PIECE = 1 << 16
#: Fixed value: the pre-tokenizer's pattern that makes the boundaries below safe.
WORDS_AND_NUMBERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Between a digit and a digit or letter, and between an ideograph and a full stop or comma: neither composes, and both patterns end there.
SAFE = re.compile("(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[\u4e00-\u9fff])(?=[\u3001\u3002\uff0c])")


def in_batches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def safe_boundaries(path: str) -> bool:
    """Whether a tokenizer file is of the kind for which SAFE and white space are boundaries.

    Its normalizer composes characters, folds white space and lowers letters at
    most; its pre-tokenizer keeps runs of letters, single numbers and runs of
    other characters and drops white space; no added token holds white space or
    digits or takes in its surroundings.
    """
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal = made["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    lowers = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in steps)
    parts = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    splits = [(p["type"], p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in parts]
    plain = all(not re.search(r"[\s\d]", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in made["added_tokens"])
    return lowers and plain and splits == [("Split", {"Regex": WORDS_AND_NUMBERS}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]


def cut_piece(text: str) -> list[str]:
    """A long piece in parts of about LONG_PIECE characters, cut at SAFE boundaries only."""
    parts, start = [], 0
    while len(text) - start > LONG_PIECE:
        found = SAFE.search(text, start + LONG_PIECE)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    return [*parts, text[start:]]


class PieceCounter:
    """Tokens of a text as the sum over its pieces between safe boundaries.

    Where ``safe_boundaries`` holds, no token reaches over ASCII white space:
    the normalizer composes no character with it, no added token holds any, and
    the pre-tokenizer drops it. Texts come apart there, a piece met before is
    not encoded again, and a long piece without white space comes apart at SAFE
    boundaries, if it has any. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.safe = safe_boundaries(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text, in batches of about equal size."""
        out: list[int] = []
        for a, b in in_batches(np.fromiter(map(len, texts), np.int64, len(texts)), BATCH_BYTES):
            out += map(len, self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False))
        return out

    def lengths(self, pieces: list[str]) -> list[int]:
        missing = [p for p in pieces if p not in self.known]
        cut = [cut_piece(p) if len(p) > LONG_PIECE else [p] for p in missing]
        counts = np.r_[0, np.cumsum(self.encoded([x for parts in cut for x in parts]), dtype=np.int64)]
        ends = np.cumsum([0, *map(len, cut)])
        fresh = dict(zip(missing, np.diff(counts[ends]).tolist(), strict=True))
        out = [fresh[p] if p in fresh else self.known[p] for p in pieces]
        if len(self.known) + len(fresh) > KEPT_PIECES:
            self.known = {}
        self.known.update((p, n) for p, n in fresh.items() if len(p) <= 64)
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.safe:
            return np.asarray(self.encoded(texts.to_pylist()), np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
        per_piece = np.asarray(self.lengths(coded.dictionary.to_pylist()), np.int64)
        per_token = per_piece[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum(per_token)]
        offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
        return np.diff(ends[offsets])


_counters: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Texts are counted whole, without added begin, end or special tokens, and
    with special strings inside texts as the tokenizer has them by default.
    Null and empty texts have 0 bytes and 0 tokens. Null or repeated ids pass
    through, an empty table gives no rows, other columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one for each Python worker, with its table of pieces, over all its tasks
        counter = _counters.setdefault(tokenizer_path, None) or PieceCounter(tokenizer_path)
        _counters[tokenizer_path] = counter
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            sizes = np.asarray(pc.binary_length(texts), np.int64)
            counts = [counter.count(texts.slice(a, b - a)) for a, b in in_batches(sizes, BATCH_BYTES)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))], names=[id_col, "n_bytes", "n_tokens"]
            )

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    out = slim.mapInArrow(counted, f"`{id_col}` {dict(slim.dtypes)[id_col]}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
