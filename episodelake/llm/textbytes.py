"""Arrow text batches as numpy bytes: words, their hashes and shingles, without per-text loops."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lower case for A-Z, and which bytes belong to words: digits, letters, all above 0x7F.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True
#: The low bytes of a number of eight that a word of so many bytes fills; bytes above which a word is hashed by itself.
MASK, LONG_WORD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64), 64
#: Texts are worked on in blocks of about so many bytes.
BLOCK_BYTES = (2 << 20) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of whole texts; null is empty, a text over ``most`` bytes is a block of its own."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, b, raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word, mixed after every eight bytes, so no words of a regular make share one; ``data`` has eight more bytes than its words."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = size.astype(np.uint64)
    active = np.flatnonzero(size <= LONG_WORD)
    for step in range(0, LONG_WORD, 8):
        active = active[size[active] > step]
        if not len(active):
            break
        h[active] = mix(h[active] * BASE + (eight[start[active] + step] & MASK[np.minimum(size[active] - step, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    """Words of a block: byte range, text number and hash of each, in order; and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray


def words_of_block(data: np.ndarray, offsets: np.ndarray) -> Words:
    n_docs = len(offsets) - 1
    inside = IS_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.r_[False, inside[:-1]] & ~first[:-1] if len(data) else inside
    after = np.r_[inside[1:], False] & ~first[1:] if len(data) else inside
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    folded = np.r_[FOLD[data], np.zeros(8, np.uint8)]
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, end, doc, word_hashes(folded, start, end - start), np.searchsorted(doc, np.arange(n_docs + 1)))


def word_texts(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The words of each text, A-Z as a-z, with one space between them."""
    inside = IS_WORD[data]
    stay = inside | np.r_[False, inside[:-1]] if len(data) else inside
    out = np.where(inside, FOLD[data], np.uint8(0x20))[stay].tobytes()
    ends = np.r_[0, np.cumsum(stay)][offsets].tolist()
    return [out[a:b].strip(b" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all runs of ``size`` words; a text of fewer words, but not none, has one of all its words."""
    n = len(words.hash)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h[: n - i] = mix(h[: n - i] * BASE + words.hash[i:])
    counts = np.diff(words.offsets)
    whole = np.arange(n) + size <= words.offsets[1:][words.doc]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for d in short:
        a, b = words.offsets[d], words.offsets[d + 1]
        x = np.array([b - a], np.uint64)
        for w in words.hash[a:b]:
            x = mix(x * BASE + w)
        h[a], whole[a] = x[0], True
    return h[whole], words.doc[whole]
