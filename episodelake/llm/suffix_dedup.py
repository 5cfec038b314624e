"""Repeated byte strings across documents, by blockwise suffix sorting with difference-cover ranks.

Suffixes are dealt to buckets by the least hashed 20-byte string (the anchor)
of their first 50 bytes, so equal 50-byte strings always meet. Neighbouring
suffixes with one anchor travel as one short string, about four bytes for each
suffix. A first exchange of the anchors' hashes alone finds those that two
documents have; suffixes of other anchors are unique and travel no further. Of
anchors with very many strings every 50-byte string is dealt by itself, so no
bucket grows with a common passage. A bucket is one task's work: it ranks the
suffixes of a difference cover by doubling, then sorts one range of suffixes at
a time by their first eight bytes; where these tie, two suffixes are in the
order of the ranks at the least distance at which both are covered. Only
neighbours in that order are compared, byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodelake.llm.common import written
from episodelake.llm.textbytes import BASE, mix, text_blocks

#: Bytes of a repeated string, and of its anchor.
LENGTH, ANCHOR = 50, 20
#: Difference cover modulo 7: any two residues have a common distance, below 7, to covered ones.
PERIOD, COVER = 7, (0, 1, 3)
#: The least distance at which the suffixes of two residues are both covered.
DISTANCE = np.array([[next(d for d in range(PERIOD) if {(r + d) % PERIOD, (s + d) % PERIOD} <= {*COVER}) for s in range(PERIOD)] for r in range(PERIOD)])
#: Bytes of text in a block of documents, and of strings that a bucket is meant to hold.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 4 << 20, 32
#: Bytes of rows whose anchors are found at a time, and anchors that one task of the first exchange is meant to hold.
PART_BYTES, KEYS_AT_ONCE = 1 << 18, 1 << 20
#: Suffixes that are sorted at a time.
SORTED_AT_ONCE = 1 << 18
#: Strings of one anchor above which each of their suffixes is dealt by itself.
HOT_STRINGS = 1 << 15
#: Rows without an id sort after all others.
NO_ID = (1 << 63) - 1
PLACE = np.uint64(28)


def _pack(data: bytes | np.ndarray) -> bytes:
    raw = data if isinstance(data, bytes) else data.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)


# --- the strings of a block ------------------------------------------------


def anchors(data: np.ndarray) -> np.ndarray:
    """For each position, the place of the least hashed ANCHOR-byte string of the LENGTH bytes from it, the leftmost of equals."""
    one = data.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * BASE + one[1:]
    four = two[:-2] * np.uint64(int(BASE) ** 2 % (1 << 64)) + two[2:]
    eight = four[:-4] * np.uint64(int(BASE) ** 4 % (1 << 64)) + four[4:]
    sixteen = eight[:-8] * np.uint64(int(BASE) ** 8 % (1 << 64)) + eight[8:]
    h = mix(sixteen[:-4] * np.uint64(int(BASE) ** 4 % (1 << 64)) + four[16:])
    least = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    width, n = LENGTH - ANCHOR + 1, 1
    while n * 2 <= width:
        least, n = np.minimum(least[:-n], least[n:]), n * 2
    rest = width - n
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def cut_strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes of each anchor string, its anchor's place in it) for the rows of a block in order."""
    counts, at = [np.zeros(0, "u1")], [np.zeros(0, "u1")]
    row, last, begun = 0, len(offsets) - 1, 0
    while row < last:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART_BYTES, side="right")) - 1)
        # rows together, or a piece of a long row that shares LENGTH - 1 bytes with the next one
        base = int(offsets[row]) + begun
        stop = min(int(offsets[end]), base + PART_BYTES + LENGTH - 1)
        part = data[base:stop]
        if len(part) >= LENGTH:
            least = anchors(part)
            inside = np.ones(len(part) + 1, bool)
            ends = np.minimum(offsets[row + 1 : end + 1], stop) - base
            for e in range(1, LENGTH):  # no string reaches over a row's end
                inside[ends[ends >= e] - e] = False
            place = np.flatnonzero(inside[: len(least)])
            a = least[place] & np.uint64((1 << 28) - 1)
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (np.diff(place) != 1)]) if len(place) else np.zeros(0, np.int64)
            counts.append(np.diff(np.r_[new, len(place)]).astype("u1"))
            at.append((a[new].astype(np.int64) - place[new]).astype("u1"))
        row, begun = (end, 0) if stop == offsets[end] else (row, begun + PART_BYTES)
    return np.concatenate(counts), np.concatenate(at)


def eight_at(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place as numbers that sort as they do; it takes no memory."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), strides=(1,))


def anchor_keys(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the anchor at each place."""
    words, key = eight_at(data), np.zeros(len(place), np.uint64)
    for step in (0, 8, ANCHOR - 8):
        key = mix(key * BASE + words[place + step].astype(np.uint64)) if len(place) else key
    return key


def string_names(data: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A hash of each string and its anchor's place."""
    words, name = eight_at(data), (size * 128 + anchor).astype(np.uint64)
    for step in range(0, 2 * LENGTH - ANCHOR, 8):  # all its eight-byte words, the last ones overlapping
        name = mix(name * BASE + words[begin + np.minimum(step, size - 8)].astype(np.uint64)) if len(name) else name
    return name


def same_strings(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of one size at two places have the same bytes."""
    words, same = eight_at(data), np.ones(len(a), bool)
    for step in range(0, 2 * LENGTH - ANCHOR, 8):
        same &= words[a + np.minimum(step, size - 8)] == words[b + np.minimum(step, size - 8)] if len(a) else same
    return same


def first_of_equals(data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, name: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, name and id; where a string begins that differs from the one before in it)."""
    order = np.lexsort((ids, name, key))
    a, b = order[:-1], order[1:]
    fresh = np.ones(len(order), bool)
    near = np.flatnonzero((name[a] == name[b]) & (key[a] == key[b]) & (size[a] == size[b]))
    fresh[1 + near] = ~same_strings(data, begin[a[near]], begin[b[near]], size[a[near]])
    return order, fresh


class Block:
    """The anchor strings of a block in order: begin, row, size, anchor (its place in the string) and key (the anchor's hash)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray, at: np.ndarray) -> None:
        self.data, self.offsets, self.ids = data, offsets, ids
        counts = counts.astype(np.int64)
        windows = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        upto = np.r_[0, np.cumsum(windows)]
        ordinal = np.cumsum(counts) - counts
        self.row = np.searchsorted(upto, ordinal, side="right") - 1
        self.begin = offsets[self.row] + ordinal - upto[self.row]
        self.size, self.anchor = counts + LENGTH - 1, at.astype(np.int64)
        self.key = anchor_keys(data, self.begin + self.anchor)

    def short_keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys cut to so many bits, whether rows of several ids have it, which key each string has)."""
        keys, which = np.unique(self.key >> np.uint64(64 - bits), return_inverse=True)
        own = self.ids[self.row]
        low, high = np.full(len(keys), NO_ID), np.full(len(keys), -NO_ID)
        np.minimum.at(low, which, own)
        np.maximum.at(high, which, own)
        return keys, low < high, which

    def distinct(self, wanted: np.ndarray, hot: np.ndarray, n_buckets: int) -> Distinct:
        return Distinct(self, np.flatnonzero(wanted & ~hot), np.flatnonzero(wanted & hot), n_buckets)


class Distinct:
    """The distinct strings among some of a block's, by bucket and smallest id.

    Strings of hot anchors come apart into their suffixes of LENGTH bytes, dealt
    by a hash of all these bytes. Of each string: place (of one occurrence),
    size, anchor, least (the smallest id that has it) and bucket; which names
    the string of each occurrence (begin, row).
    """

    def __init__(self, block: Block, whole: np.ndarray, hot: np.ndarray, n_buckets: int) -> None:
        windows = block.size[hot] - LENGTH + 1
        parts = np.repeat(hot, windows)
        step = np.arange(len(parts)) - np.repeat(np.cumsum(windows) - windows, windows)
        both = np.r_[whole, parts]
        self.begin, self.row = np.r_[block.begin[whole], block.begin[parts] + step], block.row[both]
        size, anchor = np.r_[block.size[whole], np.full(len(parts), LENGTH)], np.r_[block.anchor[whole], block.anchor[parts] - step]
        key, own = block.key[both], block.ids[self.row]
        name = string_names(block.data, self.begin, size, anchor)
        order, fresh = first_of_equals(block.data, self.begin, size, key, name, own)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        one = order[fresh]  # the occurrence with the smallest id
        bucket = (mix(np.where(one < len(whole), key[one], name[one])) % np.uint64(n_buckets)).astype(np.int64)
        sort = np.lexsort((name[one], own[one], bucket))
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        one = one[sort]
        self.which, self.place, self.size, self.anchor = rank[which], self.begin[one], size[one], anchor[one]
        self.least, self.bucket = own[one], bucket[sort]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


# --- one bucket ------------------------------------------------------------


def cover_ranks(eight: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Ranks of the covered suffixes by their first 56 bytes, by doubling in steps of PERIOD; 0 elsewhere."""
    places = np.flatnonzero(covered)
    rank = np.zeros(len(covered) + 8 * PERIOD, np.uint32)
    _, got = np.unique(eight[places].astype(np.uint64) >> np.uint64(8), return_inverse=True)
    rank[places] = got + 1
    for step in (PERIOD, 2 * PERIOD, 4 * PERIOD):
        _, got = np.unique((rank[places].astype(np.uint64) << np.uint64(32)) | rank[places + step], return_inverse=True)
        rank[places] = got + 1
    return rank


def suffix_order(run: np.ndarray, suffix: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The order of suffixes of which those of a run tie in their first PERIOD bytes or more.

    The suffixes of each two residues are merged by the ranks at the distance at
    which both are covered: a suffix's place is the number of smaller ones of
    each residue. This is the order of the first 56 bytes at least; which of
    longer ties comes first does not matter.
    """
    residue, high = suffix % PERIOD, run.astype(np.uint64) << np.uint64(32)
    members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    codes = [{d: high[m] | ranks[suffix[m] + d] for d in set(DISTANCE[r].tolist())} for r, m in enumerate(members)]
    place = np.zeros(len(suffix), np.int64)
    for s in range(PERIOD):
        ordered = {d: np.sort(code) for d, code in codes[s].items()}
        for r in range(PERIOD):
            d = int(DISTANCE[r, s])
            place[members[r]] += np.searchsorted(ordered[d], codes[r][d], side="left" if r <= s else "right")
    return np.argsort(place, kind="stable")


def least_ids(text: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each suffix of each string (size - LENGTH + 1 of them), the smallest id of a string that has its first LENGTH bytes.

    Strings are laid out with their anchors at multiples of PERIOD. Equal
    50-byte strings have their anchor at the same distance, so they are
    neighbours of one residue in the order of the suffixes.
    """
    pad = (PERIOD - anchor) % PERIOD
    room = (pad + size + PERIOD - 1) // PERIOD * PERIOD
    start = np.cumsum(room) - room + pad
    x = np.zeros(int(room.sum()) + 64, np.uint8)
    x[_spread(start, size)] = text[_spread(begin, size)]
    counts = size - LENGTH + 1
    suffix = _spread(start, counts)
    owner = np.repeat(np.arange(len(size)), counts)
    out = least[owner]
    eight = eight_at(x)
    residue = suffix % PERIOD
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    ranks = cover_ranks(eight, np.tile(covered, len(x) // PERIOD + 1)[: len(eight)])
    first = eight[suffix].astype(np.uint64)
    # ranges of suffixes by their leading bytes, each of about SORTED_AT_ONCE
    n_ranges = max(1, len(suffix) // SORTED_AT_ONCE)
    marks = np.unique(np.sort(first[:: max(1, len(first) // (64 * n_ranges))])[64::64]) if n_ranges > 1 else np.zeros(0, np.uint64)
    range_of = np.searchsorted(marks, first, side="right")
    by_range = np.argsort(range_of, kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(range_of, minlength=len(marks) + 1))] if len(suffix) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine = by_range[a:b]
        order = mine[np.argsort(first[mine])]
        head = first[order]
        run = np.cumsum(np.r_[True, head[1:] != head[:-1]]) if len(order) else np.zeros(0, np.int64)
        # runs of equal first bytes are put in order by the ranks of covered suffixes
        again = np.flatnonzero((np.bincount(run) > 1)[run])
        some = order[again]
        order[again] = some[suffix_order(run[again], suffix[some], ranks)]
        i, j = suffix[order[:-1]], suffix[order[1:]]
        same = (first[order[:-1]] == first[order[1:]]) & (residue[order[:-1]] == residue[order[1:]])
        tied = np.flatnonzero(same)
        for d in (8, 16, 24, 32, 40, LENGTH - 8):
            tied = tied[eight[i[tied] + d] == eight[j[tied] + d]]
        equal = np.zeros(len(same), bool)
        equal[tied] = True
        group = np.flatnonzero(np.r_[True, ~equal])
        if len(order):
            out[order] = np.repeat(np.minimum.reduceat(least[owner[order]], group), np.diff(np.r_[group, len(order)]))
    return out


# --- Spark -----------------------------------------------------------------


def pack_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, n_bytes, ids, offsets, text, counts, anchors): rows in blocks of BLOCK_BYTES, compressed, with their anchor strings."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            texts = table.column(1).combine_chunks() if table.num_rows else pa.array([], pa.string())
            parts = [(data, offsets) for _, _, data, offsets in text_blocks(texts, 1 << 40)]
            data, offsets = parts[0]
            counts, at = cut_strings(data, offsets)
            columns = [[number], [len(data)], [table.column(0).to_pylist()], *([_pack(np.ascontiguousarray(x))] for x in (offsets, data, counts, at))]
            number, held, size = number + 1, [], 0
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "n_bytes", "ids", "offsets", "text", "counts", "anchors"])

        for batch in batches:
            for a, b, data, _ in text_blocks(batch.column(1), BLOCK_BYTES):
                if held and size + len(data) > BLOCK_BYTES:
                    yield flush()
                held.append(batch.slice(a, b - a))
                size += len(data)
        if held:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(packed, "block long, n_bytes long, ids array<long>, offsets binary, text binary, counts binary, anchors binary")


def block_of(row: dict) -> Block:
    ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
    return Block(_unpack(row["text"], "u1"), _unpack(row["offsets"], "<i8"), ids, _unpack(row["counts"], "u1"), _unpack(row["anchors"], "u1"))


def range_of(keys: np.ndarray, bits: int, n_ranges: int) -> np.ndarray:
    """Which of n_ranges even parts of the numbers of so many bits each key is in."""
    return ((keys >> np.uint64(max(0, bits - 32))) * np.uint64(n_ranges) >> np.uint64(min(bits, 32))).astype(np.int64)


def keys_of(blocks: DataFrame, bits: int, n_ranges: int) -> DataFrame:
    """(range, block, n, keys, several, strings): each block's distinct anchor hashes by range, whether several ids have them, and in how many strings."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, several, which = block_of(row).short_keys(bits)
                strings = np.minimum(np.bincount(which, minlength=len(keys)), 65535)
                some, cuts = np.unique(range_of(keys, bits, n_ranges), return_index=True)
                parts = [slice(a, b) for a, b in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True)]
                columns = [
                    pa.array(some, pa.int32()),
                    pa.array([row["block"]] * len(some), pa.int64()),
                    pa.array([p.stop - p.start for p in parts], pa.int64()),
                    pa.array([_pack(np.diff(keys[p], prepend=np.uint64(0)).astype("<u8")) for p in parts], pa.binary()),
                    pa.array([_pack(np.packbits(several[p])) for p in parts], pa.binary()),
                    pa.array([_pack(strings[p].astype("<u2")) for p in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "block", "n", "keys", "several", "strings"])

    return blocks.drop("n_bytes").mapInArrow(made, "range int, block long, n long, keys binary, several binary, strings binary")


def repeated_keys(part: pd.DataFrame, hot_strings: int) -> pd.DataFrame:
    """(block, range, n, bits, hot): which of the keys that each block sent are in several documents, and which in hot_strings strings or more."""
    keys = [np.cumsum(_unpack(x, "<u8")) for x in part["keys"]]
    several = [np.unpackbits(_unpack(x, "u1"), count=int(n)).astype(bool) for x, n in zip(part["several"], part["n"], strict=True)]
    values, which, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    repeated = counts > 1
    repeated[which[np.concatenate(several)]] = True
    hot = np.bincount(which, np.concatenate([_unpack(x, "<u2") for x in part["strings"]])) >= hot_strings
    marks = [[_pack(np.packbits(m)) for m in np.split(x[which], np.cumsum([len(k) for k in keys])[:-1])] for x in (repeated, hot)]
    return pd.DataFrame({"block": part["block"], "range": part["range"], "n": part["n"], "bits": marks[0], "hot": marks[1]})


def wanted_of(block: Block, marks: list[dict] | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of a block have an anchor that several documents have, and which a hot one."""
    _, _, which = block.short_keys(bits)
    marks = sorted(marks or [], key=lambda m: m["range"])
    answers = [[np.unpackbits(_unpack(m[kind], "u1"), count=m["n"]) for m in marks] for kind in ("bits", "hot")]
    return tuple(np.concatenate(a).astype(bool)[which] if a else np.zeros(len(which), bool) for a in answers)


def strings_of(blocks: DataFrame, bits: int, n_buckets: int) -> DataFrame:
    """(bucket, block, sizes, anchors, ids, text): the strings with repeated anchors that each block has in each bucket."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = block_of(row)
                s = block.distinct(*wanted_of(block, row["marks"], bits), n_buckets)
                buckets, cuts = np.unique(s.bucket, return_index=True)
                out = {k: [] for k in ("bucket", "block", "sizes", "anchors", "ids", "text")}
                for b, from_, to in zip(buckets, cuts, np.r_[cuts[1:], len(s.bucket)], strict=True):
                    part = slice(from_, to)
                    out["bucket"].append(int(b))
                    out["block"].append(row["block"])
                    out["sizes"].append(_pack(s.size[part].astype("u1")))
                    out["anchors"].append(_pack(s.anchor[part].astype("u1")))
                    out["ids"].append(_pack(np.diff(s.least[part], prepend=0).astype("<i8")))
                    out["text"].append(_pack(block.data[_spread(s.place[part], s.size[part])]))
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["block"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("sizes", "anchors", "ids", "text"))], names=list(out))

    return blocks.mapInArrow(made, "bucket int, block long, sizes binary, anchors binary, ids binary, text binary")


def answer_bucket(part: pd.DataFrame) -> pd.DataFrame:
    """(block, bucket, found): for the strings of each block, the suffixes that a smaller id has as well.

    Equal strings, compared by their bytes, are sorted once, and those whose anchor no other string has not at all.
    """
    sizes = [_unpack(x, "u1").astype(np.int64) for x in part["sizes"]]
    n = np.array([len(x) for x in sizes])
    size, anchor = np.concatenate(sizes), np.concatenate([_unpack(x, "u1").astype(np.int64) for x in part["anchors"]])
    least = np.concatenate([np.cumsum(_unpack(x, "<i8")) for x in part["ids"]])
    text = np.concatenate([_unpack(x, "u1") for x in part["text"]])
    begin = np.cumsum(size) - size
    key, name = anchor_keys(text, begin + anchor), string_names(text, begin, size, anchor)
    order, fresh = first_of_equals(text, begin, size, key, name, least)
    one = order[fresh]  # of equal strings, the one with the smallest id
    copy = np.empty(len(order), np.int64)
    copy[order] = np.cumsum(fresh) - 1
    shared = np.r_[False, key[one][1:] == key[one][:-1]] | np.r_[key[one][1:] == key[one][:-1], False]
    counts_one = size[one] - LENGTH + 1
    from_ = np.cumsum(counts_one) - counts_one
    best_one = np.repeat(least[one], counts_one)
    some = np.flatnonzero(shared)
    if len(some):
        best_one[_spread(from_[some], counts_one[some])] = least_ids(text, begin[one[some]], size[one[some]], anchor[one[some]], least[one[some]])
    # only strings with a suffix that a smaller id has are answered
    low = np.minimum.reduceat(best_one, from_) if len(one) else best_one
    some = np.flatnonzero(low[copy] < least)
    counts = size[some] - LENGTH + 1
    best = best_one[_spread(from_[copy[some]], counts)]
    owner = np.repeat(some, counts)
    step = np.arange(len(best)) - np.repeat(np.cumsum(counts) - counts, counts)
    less = np.flatnonzero(best < least[owner])
    # runs of neighbouring suffixes of one string with one smaller id
    new = np.flatnonzero(np.r_[True, (np.diff(less) != 1) | (np.diff(owner[less]) != 0) | (np.diff(best[less]) != 0)]) if len(less) else np.zeros(0, np.int64)
    run, length = less[new], np.diff(np.r_[new, len(less)])
    row = np.searchsorted(np.cumsum(n), owner[run], side="right")
    local = owner[run] - (np.cumsum(n) - n)[row]
    cuts = np.searchsorted(row, np.arange(len(part) + 1))
    out = []
    for r in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[r], cuts[r + 1]
        fields = [np.diff(local[a:b], prepend=0).astype("<u4"), step[run[a:b]].astype("u1"), length[a:b].astype("u1"), best[run[a:b]].astype("<i8")]
        out.append((int(part["block"].iloc[r]), int(part["bucket"].iloc[r]), int(b - a), _pack(b"".join(f.tobytes() for f in fields))))
    return pd.DataFrame(out, columns=["block", "bucket", "n", "found"])


def finish_block(block: Block, wanted: np.ndarray, hot: np.ndarray, answers: list[dict] | None, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes of a block go, and for each of its rows how many and in how many runs."""
    data, offsets, ids = block.data, block.offsets, block.ids
    s = block.distinct(wanted, hot, n_buckets)
    counts = s.size - LENGTH + 1
    base = np.cumsum(counts) - counts
    best = np.repeat(s.least, counts)
    for answer in answers or []:
        raw, n = _unpack(answer["found"], "u1").tobytes(), answer["n"]
        local, step, length = np.cumsum(np.frombuffer(raw[: 4 * n], "<u4").astype(np.int64)), np.frombuffer(raw[4 * n : 5 * n], "u1"), np.frombuffer(raw[5 * n : 6 * n], "u1")
        at = _spread(base[np.searchsorted(s.bucket, answer["bucket"]) + local] + step, length.astype(np.int64))
        best[at] = np.repeat(np.frombuffer(raw[6 * n :], "<i8"), length)
    repeated = np.zeros(len(data), np.int32)  # 1 where a string starts that a smaller id has
    for a in range(0, len(s.begin), 1 << 15):  # so many occurrences at a time
        part = slice(a, a + (1 << 15))
        which, size = s.which[part], counts[s.which[part]]
        gone = best[_spread(base[which], size)] < np.repeat(ids[s.row[part]], size)
        repeated[_spread(s.begin[part], size)[gone]] = 1
    upto = np.cumsum(repeated, dtype=np.int32)
    removed = upto > np.r_[np.zeros(min(LENGTH, len(upto)), np.int32), upto[:-LENGTH]]
    total = np.r_[0, np.cumsum(removed)]
    starts = removed & ~np.r_[False, removed[:-1]]
    starts[offsets[:-1][offsets[:-1] < len(data)]] = removed[offsets[:-1][offsets[:-1] < len(data)]]
    runs = np.r_[0, np.cumsum(starts)]
    return removed, np.diff(total[offsets]), np.diff(runs[offsets])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept (the bytes left).

    A byte goes when some 50-byte string over it also starts in a row with a
    smaller id; strings never reach over a row's end and are judged on the
    input. Ids are integers; rows that repeat an id do not remove each other's
    bytes, rows without an id come last. Null texts are empty; texts under 50
    bytes stay. An empty table gives no rows, other columns are ignored. Of
    anchors with ``hot_strings`` strings or more each suffix is dealt by itself.
    """
    kind = dict(docs.dtypes)[id_col]
    blocks = written(pack_blocks(docs, id_col, text_col))
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    n_buckets = max(LEAST_BUCKETS, int(total * 1.5) // BUCKET_BYTES)
    n_ranges = min(1 << 31, max(LEAST_BUCKETS, total // 18 // KEYS_AT_ONCE))
    # ten bits more than it takes to number the anchors: a chance match only sends a string on
    bits = min(64, max(1, total // 16).bit_length() + 10)
    marks = written(keys_of(blocks, bits, n_ranges).groupBy("range").applyInPandas(lambda part: repeated_keys(part, hot_strings), "block long, range int, n long, bits binary, hot binary"))
    marked = blocks.drop("n_bytes").join(marks.groupBy("block").agg(F.collect_list(F.struct("range", "n", "bits", "hot")).alias("marks")), "block", "left")
    found = strings_of(marked, bits, n_buckets).groupBy("bucket").applyInPandas(answer_bucket, "block long, bucket int, n long, found binary")
    answers = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "found")).alias("answers"))
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = block_of(row)
                removed, n_removed, n_spans = finish_block(block, *wanted_of(block, row["marks"], bits), row["answers"], n_buckets)
                left = block.data[~removed].tobytes()
                ends = (block.offsets - np.r_[0, np.cumsum(n_removed)]).tolist()
                kept = [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [pa.array(row["ids"], pa.int64()), pa.array(np.diff(block.offsets)), pa.array(n_removed), pa.array(n_spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_text, names=["id", *(f.split()[0] for f in fields.split(", "))])

    # blocks are already dealt by their number, so this join moves only the answers
    joined = marked.join(answers, "block", "left")
    return joined.mapInArrow(finished, f"id long, {fields}").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
