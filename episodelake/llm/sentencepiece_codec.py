"""SentencePiece encoding and decoding in numpy, words of equal length together.

Words are encoded by a batched Viterbi search: substring hashes probe the
sorted piece keys, and vectorised maxima store the backpointers. Models of type
BPE define their result by merges in score order, which the best path by score
is not. But a sequence of pieces is the result of the merges exactly if every
two neighbours are what their own text merges to (``Transitions``), so the search
over pieces with that rule for neighbours has one path, and it is the library's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodelake.llm.textbytes import mix

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are searched in windows of so many characters that share OVERLAP.
WIDE, OVERLAP = 256, 64
#: A worker keeps the rules of 2 to so many pairs of pieces.
SLOT_BITS = 21
BATCH_BYTES, KEPT_WORDS = 4 << 20, 300_000
#: What a character costs that no piece holds, beyond the lowest score (as for unigram models in general).
UNKNOWN_COST = 10.0
WORDS = re.compile(" *[^ ]+| +")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ((8 if kind == 1 else 4), i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class Model:
    """Pieces, scores and kinds of a model file, with their keys sorted for probing."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, dummy_prefix: bool = True) -> None:
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        usable = [(i, p, s) for i, (p, s, k) in enumerate(pieces) if k in (NORMAL, USER)]
        keys = np.array([string_key(p) for _, p, _ in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for i, _, _ in usable], np.int32)[order]
        self.scores = np.array([s for _, _, s in usable])[order]
        if len(keys) and (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces share a key")
        self.longest = max((len(p) for _, p, _ in usable), default=1)
        self.lowest = float(self.scores.min()) if len(keys) else 0.0
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.by_text = {p: (s, i) for i, p, s in usable}
        texts = [usable[i][1] for i in order]
        self.rules = Transitions(self, texts) if kind == BPE else None
        # the keys of all beginnings of pieces, and which of them are pieces that a word can have
        places = {t: i for i, t in enumerate(texts) if not self.rules or self.rules.whole[i]}
        beginnings = sorted({t[:n] for t in places for n in range(1, len(t) + 1)}, key=len)
        keys = np.zeros(len(beginnings), np.uint64)
        ends = np.searchsorted([len(t) for t in beginnings], np.arange(1, self.longest + 2))
        for n, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True), 1):
            if a < b:
                keys[a:b] = Prefixes(beginnings[a:b]).between(np.arange(b - a), 0, n)
        order = np.argsort(keys)
        self.beginnings, self.beginning_place = keys[order], np.array([places.get(t, -1) for t in beginnings], np.int64)[order]
        if len(keys) and (np.diff(self.beginnings) == 0).any():
            raise ValueError("two beginnings of pieces share a key")
        out = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_ends = np.cumsum([0, *map(len, out)])

    @classmethod
    def read(cls, path: str) -> Model:
        """From a .model file. Only the identity normalizer without white-space clean-up is supported."""
        pieces, kind, normal = [], UNIGRAM, {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    got = dict(_fields(value))
                    pieces.append((got[1].decode(), float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]), got.get(3, NORMAL)))
                elif number == 2:
                    kind = dict(_fields(value)).get(3, UNIGRAM)
                elif number == 3:
                    normal = dict(_fields(value))
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("this model normalizes its input; only identity models are supported")
        return cls(pieces, kind, bool(normal.get(3, 1)))

    def find_beginning(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the sorted beginnings of pieces, whether it is there)."""
        at = np.minimum(np.searchsorted(self.beginnings, keys), max(0, len(self.beginnings) - 1))
        return at, (self.beginnings[at] == keys) if len(self.beginnings) else np.zeros(keys.shape, bool)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the sorted keys, whether it is there)."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(keys.shape, bool)


def string_key(text: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in text:
        h = h * STEP + np.uint64(ord(c) + 1)
    return mix(h + np.uint64(len(text)))[0]


class Prefixes:
    """Prefix hashes of words of equal length: the key of any substring in two operations."""

    def __init__(self, words: list[str]) -> None:
        n = len(words[0])
        self.chars = np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n)
        self.h = np.zeros((len(words), n + 1), np.uint64)
        for i in range(n):
            self.h[:, i + 1] = self.h[:, i] * STEP + self.chars[:, i] + np.uint64(1)
        self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, STEP, np.uint64)])

    def keys(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        return mix(self.h[rows, end] - self.h[rows, start] * self.up[n] + n.astype(np.uint64))

    def between(self, rows: np.ndarray, start: int, end: int) -> np.ndarray:
        """The keys of one place of some words."""
        return mix(self.h[rows, end] - self.h[rows, start] * self.up[end - start] + np.uint64(end - start))


class Transitions:
    """Which pieces may stand next to each other in the result of a BPE model.

    Each piece comes from two smaller ones by its own last merge. Between two
    neighbours a merge over their border is taken if both symbols at the border
    are there when its turn comes: after they were made, and before their own
    pieces take them in (at the same turn the left one goes first). The symbols
    at the border are the right ends of the first and the left ends of the second.
    """

    def __init__(self, model: Model, pieces: list[str]) -> None:
        """``pieces`` are the texts behind the model's sorted keys."""
        self.model, n = model, len(pieces)
        self.size = np.array([len(p) for p in pieces], np.int64)
        # pieces of one score have one turn, at which the leftmost goes first, like copies of one piece
        self.rank = np.where(self.size > 1, np.unique(-model.scores, return_inverse=True)[1], -1)
        self.raw = np.zeros(n, np.uint64)
        self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(1, model.longest), STEP, np.uint64)])
        self.left, self.right, self.whole = np.full(n, -1), np.full(n, -1), self.size == 1
        for length in np.unique(self.size):
            mine = np.flatnonzero(self.size == length)
            p = Prefixes([pieces[i] for i in mine])
            self.raw[mine] = p.h[:, length]
            if length > 1:
                last = np.zeros(len(mine), np.int64)
                cuts = merges(model, [pieces[i] for i in mine], last)
                made = cuts.sum(axis=1) == 1
                rows = np.flatnonzero(made)
                for side, start, end in ((self.left, np.zeros(len(rows), np.int64), last[rows]), (self.right, last[rows], np.full(len(rows), length))):
                    at, there = model.find(p.keys(rows, start, end))
                    side[mine[rows]] = np.where(there, at, -1)
                self.whole[mine] = made
        many = self.whole & (self.size > 1)
        parts = [side[many] for side in (self.left, self.right)]
        # the rule needs parts that are pieces and are made before the whole; texts that hold other pieces are merged
        odd = np.flatnonzero(many)[np.logical_or.reduce([(x < 0) | (self.rank[x] >= self.rank[many]) for x in parts])]
        shortest: list[str] = []
        for text in sorted((pieces[i] for i in odd), key=len):
            if not any(t in text for t in shortest):
                shortest.append(text)
        self.odd = re.compile("|".join(map(re.escape, shortest))) if shortest else None
        self.known, self.answers = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)

    def allowed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each two pieces (places among the sorted keys) may be neighbours.

        Answers are kept at a place given by a hash of the pair, the latest of those that share it.
        """
        code = first * len(self.size) + second
        slot = (mix(code.astype(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.answers[slot]
        missing = np.flatnonzero(self.known[slot] != code)
        if len(missing):
            new, which = np.unique(code[missing], return_inverse=True)
            out[missing] = self.compute(*np.divmod(new, len(self.size)))[which]
            self.known[slot[missing]], self.answers[slot[missing]] = code[missing], out[missing]
            # of two new pairs at one place the last one stays, with its own answer
        return out

    def compute(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        never = len(self.size)
        ok = np.ones(len(first), bool)
        rows, left, taken_left = np.arange(len(first)), first, np.full(len(first), never)
        while len(rows):
            inner, right, taken_right = np.arange(len(rows)), second[rows], np.full(len(rows), never)
            while len(inner):
                a = left[inner]
                size = self.size[a] + self.size[right]
                fits = size <= self.model.longest
                key = mix(self.raw[a] * self.up[np.where(fits, self.size[right], 0)] + self.raw[right] + size.astype(np.uint64))
                at, there = self.model.find(key)
                turn = np.maximum(np.maximum(self.rank[at], self.rank[a]), self.rank[right])
                ok[rows[inner[there & fits & (turn < taken_left[inner]) & (turn <= taken_right)]]] = False
                taken_right, right = self.rank[right], self.left[right]
                more = right >= 0
                inner, right, taken_right = inner[more], right[more], taken_right[more]
            taken_left, left = self.rank[left], self.right[left]
            more = (left >= 0) & ok[rows]
            rows, left, taken_left = rows[more], left[more], taken_left[more]
        return ok


def viterbi(model: Model, words: list[str]) -> np.ndarray:
    """Cuts of the best path of each word: a matrix that is true where a piece starts.

    All words have one length. From each start the pieces of all words grow
    together, a character at a time, as long as the keys of some piece's
    beginning hold theirs; the maxima at their ends keep the backpointers. Of
    equal scores the longer piece stays. In BPE models a piece also has to be
    allowed after the one before it.
    """
    p, count, n = Prefixes(words), len(words), len(words[0])
    rules = model.rules
    best, back = np.full((count, n + 1), -np.inf), np.zeros((count, n + 1), np.int64)
    last = np.full((count, n + 1), -1)  # the piece that ends there, -1 for a character that is none
    best[:, 0] = 0
    for start in range(n):
        rows = np.flatnonzero(best[:, start] > -np.inf)
        who, what, ends = [], [], []
        for end in range(start + 1, min(n, start + model.longest) + 1):
            at, alive = model.find_beginning(p.between(rows, start, end))
            rows, place = rows[alive], model.beginning_place[at[alive]]
            if end == start + 1:
                # a character that is no piece stands alone
                known = np.zeros(count, bool)
                known[rows[place >= 0]] = True
                alone = np.flatnonzero(~known & (best[:, start] > -np.inf))
                score = best[alone, start] + (model.lowest - UNKNOWN_COST)
                better = alone[score > best[alone, end]]
                best[better, end], back[better, end], last[better, end] = best[better, start] + (model.lowest - UNKNOWN_COST), start, -1
            piece = place >= 0
            who.append(rows[piece])
            what.append(place[piece])
            ends.append(np.full(len(who[-1]), end))
            if not len(rows):
                break
        r, at, end = np.concatenate(who), np.concatenate(what), np.concatenate(ends)
        if rules and start:
            before = last[r, start]
            ask = np.flatnonzero(before >= 0)
            fine = np.ones(len(r), bool)
            fine[ask] = rules.allowed(before[ask], at[ask])
            r, at, end = r[fine], at[fine], end[fine]
        score = best[r, start] + model.scores[at]
        better = score > best[r, end]
        r, at, end = r[better], at[better], end[better]
        best[r, end], back[r, end], last[r, end] = score[better], start, at
    cuts, at, rows = np.zeros((count, n + 1), bool), np.full(count, n), np.arange(count)
    while (at > 0).any():
        at = np.where(at > 0, back[rows, at], 0)
        cuts[rows, at] = True
    return cuts[:, :n]


def search_long(model: Model, words: list[str]) -> list[np.ndarray]:
    """Starts of the pieces of words longer than WIDE in a BPE model.

    Windows that overlap are searched together. Two of them join at a cut that
    both have and over which their pieces are allowed: then all neighbours are,
    and the whole is the result. A join looks at the overlap alone, so the work
    is linear in a word's length. Words whose windows do not join, such as long
    runs of one character, are merged with a heap.
    """
    step = WIDE - OVERLAP
    windows = [(i, a, w[a : a + WIDE]) for i, w in enumerate(words) for a in range(0, max(1, len(w) - OVERLAP), step)]
    cuts: dict[tuple[int, int], np.ndarray] = {}
    by_length: dict[int, list[int]] = {}
    for k, (_, _, text) in enumerate(windows):
        by_length.setdefault(len(text), []).append(k)
    for n, group in by_length.items():
        for a in range(0, len(group), max(1, (1 << 19) // n)):
            part = group[a : a + max(1, (1 << 19) // n)]
            for k, row in zip(part, viterbi(model, [windows[k][2] for k in part]), strict=True):
                cuts[windows[k][0], windows[k][1]] = np.flatnonzero(row) + windows[k][1]
    out = []
    for i, w in enumerate(words):
        parts = [cuts[i, 0]]
        for a in range(step, max(1, len(w) - OVERLAP), step):
            last, mine = parts[-1], cuts[i, a]
            # cuts that both have where they overlap, away from the first window's end, where its path may still be open
            joint = np.intersect1d(last[(last > a) & (last < a + OVERLAP)], mine[mine > a])
            at = next((int(x) for x in joint if joins(model, w, last, mine, int(x))), None)
            if at is None:
                parts.clear()
                break
            parts[-1] = last[last < at]
            parts.append(mine[mine >= at])
        out.append(np.concatenate(parts) if parts else np.array(merge_long(model, w)))
    return out


def joins(model: Model, word: str, before: np.ndarray, after: np.ndarray, at: int) -> bool:
    """Whether the piece that ends at a cut in one path may stand before the piece that begins there in another."""
    k, j = int(np.searchsorted(before, at)), int(np.searchsorted(after, at))
    end = int(after[j + 1]) if j + 1 < len(after) else len(word)
    keys = np.array([string_key(word[before[k - 1] : at]), string_key(word[at:end])], np.uint64)
    places, there = model.find(keys)
    return not there.all() or bool(model.rules.allowed(places[:1], places[1:])[0])


def merges(model: Model, words: list[str], last: np.ndarray | None = None) -> np.ndarray:
    """Cuts of each word after merging in score order, the leftmost of equals first; words have one length.

    ``last`` takes where the two symbols met of which a whole word was made.
    """
    p, count, n = Prefixes(words), len(words), len(words[0])
    bounds = np.tile(np.arange(n + 2), (count, 1))  # starts of the symbols, then n
    bounds[:, n + 1] = n
    score = np.full((count, n + 1), -np.inf)

    def pair(rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        end = bounds[rows, np.minimum(k + 2, n + 1)]
        at, there = model.find(p.keys(rows, bounds[rows, k], end))
        return np.where(there & (bounds[rows, k + 1] < end), model.scores[at], -np.inf)

    if n > 1:
        rows, k = np.divmod(np.arange(count * (n - 1)), n - 1)
        score[rows, k] = pair(rows, k)
    live = np.flatnonzero(score.max(axis=1) > -np.inf)
    columns = np.arange(n + 2)
    while len(live):
        k = score[live].argmax(axis=1)
        if last is not None:
            last[live] = np.where(bounds[live, 2] == n, bounds[live, 1], last[live])
        # symbol k takes in symbol k+1: what stands right of the gap moves left
        take = np.minimum(columns + (columns > k[:, None]), n + 1)
        bounds[live] = np.take_along_axis(bounds[live], take, axis=1)
        moved = np.take_along_axis(score[live], np.minimum(columns[:-1] + (columns[:-1] > k[:, None]), n), axis=1)
        moved[:, n] = -np.inf
        score[live] = moved
        score[live, k] = pair(live, k)
        left = k > 0
        score[live[left], k[left] - 1] = pair(live[left], k[left] - 1)
        live = live[score[live].max(axis=1) > -np.inf]
    cuts = np.zeros((count, n + 1), bool)
    np.put_along_axis(cuts, bounds, True, axis=1)
    return cuts[:, :n]


def merge_long(model: Model, word: str) -> list[int]:
    """Starts of the symbols of one long word, by a heap of pairs."""
    n = len(word)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    end, alive = list(range(1, n + 1)), [True] * n
    rank = lambda i: (-got[0], i, end[nxt[i]]) if nxt[i] < n and (got := model.by_text.get(word[i : end[nxt[i]]])) else None
    heap = [r for i in range(n) if (r := rank(i))]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = False, end[j], nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for k in (prev[i], i):
            if k >= 0 and (r := rank(k)):
                heappush(heap, r)
    return [i for i in range(n) if alive[i]]


def encode_words(model: Model, words: list[str]) -> list[bytes]:
    """int32 ids of each word, as bytes; spaces are already piece spaces."""
    out: list[bytes] = [b""] * len(words)
    by_length: dict[tuple[int, bool], list[int]] = {}
    odd = model.rules.odd if model.rules else None
    for i, w in enumerate(words):
        by_length.setdefault((len(w), odd is not None and odd.search(w) is not None), []).append(i)
    for (n, merged), group in by_length.items():
        step = len(group) if n == 0 else max(1, (1 << 19) // n)
        for a in range(0, len(group), step):
            part = group[a : a + step]
            texts = [words[i] for i in part]
            if n == 0:
                continue
            if model.kind == UNIGRAM or (not merged and n <= WIDE):
                cuts = viterbi(model, texts)
            elif n <= WIDE:
                cuts = merges(model, texts)
            else:
                cuts = np.zeros((len(part), n), bool)
                for r, starts in enumerate([merge_long(model, t) for t in texts] if merged else search_long(model, texts)):
                    cuts[r, starts] = True
            rows, start = np.nonzero(cuts)
            end = np.r_[start[1:], 0]
            end[np.r_[rows[1:] != rows[:-1], True]] = n
            at, there = model.find(Prefixes(texts).keys(rows, start, end))
            ids = np.where(there, model.ids[at], -1).astype(np.int32)
            ends = np.searchsorted(rows, np.arange(len(part) + 1))
            odd = set(rows[~there].tolist())
            flat = ids.tobytes()
            for r, i in enumerate(part):
                if r in odd:  # a character that no piece holds, as its bytes
                    got: list[int] = []
                    for k in range(ends[r], ends[r + 1]):
                        raw = texts[r][start[k] : end[k]].encode() if ids[k] < 0 else b""
                        got += [int(ids[k])] if ids[k] >= 0 else [model.bytes[b] for b in raw] if model.bytes else [model.unknown]
                    out[i] = np.array(got, np.int32).tobytes()
                else:
                    out[i] = flat[4 * ends[r] : 4 * ends[r + 1]]
    return out


class Codec:
    """Encoder and decoder of one worker, with the words it has met (KEPT_WORDS at most)."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and end).

        Where single spaces stand between words only, Arrow splits the texts.
        """
        column = pa.array(texts, pa.large_string())
        odd = [pc.match_substring(column, "  "), pc.match_substring(column, SPACE), pc.starts_with(column, " "), pc.ends_with(column, " "), pc.equal(column, "")]
        plain = ~np.logical_or.reduce([np.asarray(x) for x in odd]) if self.model.dummy_prefix and len(texts) else np.zeros(len(texts), bool)
        some, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        split = pc.split_pattern(column.take(pa.array(some)), " ")
        coded = split.flatten().dictionary_encode()
        prefix = " " if self.model.dummy_prefix else ""
        others = [WORDS.findall(prefix + t.replace(SPACE, " ")) if t else [] for t in (texts[i] for i in rest)]
        coded_others = pa.array([w for words in others for w in words], pa.large_string()).dictionary_encode()
        parts = [
            self.encode_coded([f" {w}" for w in coded.dictionary.to_pylist()], coded.indices, np.asarray(pc.list_value_length(split), np.int64)),
            self.encode_coded(coded_others.dictionary.to_pylist(), coded_others.indices, np.array([len(words) for words in others], np.int64)),
        ]
        begins, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for at, (_, ends), first in zip((some, rest), parts, (0, len(parts[0][0])), strict=True):
            begins[at], sizes[at] = ends[:-1] + first, np.diff(ends)
        return np.concatenate([ids for ids, _ in parts])[spread(begins, sizes)], np.r_[0, np.cumsum(sizes)]

    def encode_coded(self, words: list[str], indices: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of texts of so many words each, given as places among distinct words."""
        fresh = [w for w in words if w not in self.known]
        new = dict(zip(fresh, encode_words(self.model, [w.replace(" ", SPACE) for w in fresh]), strict=True))
        parts = [new[w] if w in new else self.known[w] for w in words]
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known = {}
        self.known.update((w, i) for w, i in new.items() if len(w) <= 32)
        flat = np.frombuffer(b"".join(parts), np.int32)
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        begins = np.r_[0, np.cumsum(sizes)]
        codes = np.asarray(indices, np.int64) if len(indices) else np.zeros(0, np.int64)
        ids = flat[spread(begins[codes], sizes[codes])] if len(codes) else np.zeros(0, np.int32)
        word_ends = np.r_[0, np.cumsum(sizes[codes])]
        return ids, word_ends[np.r_[0, np.cumsum(counts)]]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; the first space of a text goes if the model added one."""
        m = self.model
        sizes = (m.out_ends[1:] - m.out_ends[:-1])[ids]
        data = m.out[spread(m.out_ends[ids], sizes)].tobytes()
        at = np.r_[0, np.cumsum(sizes)][ends].tolist()
        texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return [t[1:] if m.dummy_prefix and t[:1] == b" " else t for t in texts]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0].. for size[0] numbers, then begin[1].. for size[1], and so on."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - (ends - size), size)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each Python worker and model."""
    if path not in _codecs:
        _codecs[path] = Codec(Model.read(path))
    return _codecs[path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, ids_sha256, decoded_sha256, round_trip; with keep_ids also ids.

    Every whole text is encoded without begin or end ids and its ids decoded
    again. ids_sha256 is over the ids as little-endian int32, decoded_sha256
    over the decoded bytes; round_trip says whether they are the text's, which
    fails only for texts that hold the space piece U+2581 itself. Null and
    empty texts have no ids. Null and repeated ids pass through, an empty
    table gives no rows, other columns are ignored.
    """
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    fields = "n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            sizes = np.asarray(pc.binary_length(texts), np.int64)
            ends = np.cumsum(sizes)
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH_BYTES, side="right")))
                part = texts.slice(a, b - a).to_pylist()
                ids, cuts = c.encode(part)
                back = c.decode(ids, cuts)
                raw, at = ids.astype("<i4").tobytes(), cuts.tolist()
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(sizes[a:b]),
                    pa.array(np.diff(cuts)),
                    pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                    pa.array([t == p.encode() for t, p in zip(back, part, strict=True)]),
                ]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(f.split()[0] for f in fields.split(", "))])
                a = b

    return slim.mapInArrow(coded, f"`{id_col}` {dict(slim.dtypes)[id_col]}, {fields}")
