"""Repeated word sequences across documents, by prefix-partitioned suffix trees.

A suffix is a place with WINDOW words from it on. Suffixes are dealt by prefixes
of variable length: first by a GRAM-word prefix, that of the least hashed gram
inside the window, which all suffixes with one such gram share; they travel as
one string of words. Where a gram has more strings than a task's memory is meant
to hold, its suffixes are dealt one by one by their whole prefix of WINDOW words.
Grams that only one document has lead to no repeat, so a first exchange of the
grams' hashes leaves their suffixes where they are.

A bucket of suffixes is one task's work. It numbers the words exactly, ranks
runs of STEP words, and opens its suffix trees level by level, STEP words at a
time: a node whose suffixes part splits, a suffix left alone is a leaf and read
no further. The nodes of depth WINDOW that are left hold the suffixes of one
repeat; the smallest document id below such a node decides what goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodelake.llm.common import written
from episodelake.llm.textbytes import BASE, LONG_WORD, mix, text_blocks, word_hashes

#: Words of a repeated sequence, of the gram that deals it, and of one level of a tree.
WINDOW, GRAM, STEP = 50, 5, 8
#: Bytes and rows of a block of documents, bytes of strings that a bucket is meant to hold.
BLOCK_BYTES, BLOCK_ROWS, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 1 << 16, 6 << 20, 32
#: Strings of one gram above which each of their suffixes is dealt by itself.
HOT_STRINGS = 1 << 14
#: Words whose grams are compared at a time; words over LONG_WORD bytes travel as their digests.
PART_WORDS = 1 << 19
#: Rows without an id sort after all others.
NO_ID = (1 << 63) - 1
PLACE = np.uint64(28)
SPACE = 0x20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _pack(data: np.ndarray) -> bytes:
    raw = data.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, … of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)]


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Pieces of bytes that lie one after the other, as an Arrow array."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(_offsets(sizes).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


# --- a block of documents --------------------------------------------------


def least_grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each place with WINDOW words from it, the place of the least hashed gram of these, the leftmost of equals; the hash of each gram)."""
    n = len(h) - WINDOW + 1
    gram = np.zeros(len(h), np.uint64)
    for j in range(GRAM):
        gram[: len(h) - j] = mix(gram[: len(h) - j] * BASE + h[j:])
    at, width = np.zeros(max(0, n), np.int64), WINDOW - GRAM + 1
    for a in range(0, n, PART_WORDS):
        b = min(n, a + PART_WORDS)
        g = gram[a : b + width - 1]
        least, have = (g >> PLACE << PLACE) | np.arange(len(g), dtype=np.uint64), 1
        while have * 2 <= width:
            least, have = np.minimum(least[:-have], least[have:]), have * 2
        rest = width - have
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        at[a:b] = (least & np.uint64((1 << 28) - 1)).astype(np.int64) + a
    return at, gram


class Block:
    """The words of a block's rows (start, size, row; first: each row's first word) and its strings of suffixes (begin: the first word, count: suffixes, key: the gram's hash)."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        # rows are set apart by a space, and all white space is one
        data = np.insert(text, offsets[1:], SPACE)
        data[IS_SPACE[data]] = SPACE
        inside = np.r_[False, data != SPACE, False].view(np.int8)
        turn = np.diff(inside)
        self.start = np.flatnonzero(turn == 1)
        self.size = np.flatnonzero(turn == -1) - self.start
        self.ids = ids
        self.data = np.r_[data, np.zeros(8, np.uint8)]
        row_start = offsets[:-1] + np.arange(len(ids))
        self.first = np.r_[np.searchsorted(self.start, row_start), len(self.start)]
        self.row = np.repeat(np.arange(len(ids)), np.diff(self.first))
        at, gram = least_grams(word_hashes(self.data, self.start, self.size))
        place = np.flatnonzero(np.arange(len(at)) + WINDOW <= self.first[1:][self.row[: len(at)]])
        a = at[place]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (np.diff(place) != 1)]) if len(place) else np.zeros(0, np.int64)
        self.begin, self.count, self.key = place[new], np.diff(np.r_[new, len(place)]), gram[a[new]]

    def grams(self) -> tuple[np.ndarray, ...]:
        """(hash, smallest id, largest id, strings) of each distinct gram that deals strings."""
        order = np.argsort(self.key, kind="stable")
        key, own = self.key[order], self.ids[self.row[self.begin[order]]]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if not len(new):
            return key, own, own, new
        return key[new], np.minimum.reduceat(own, new), np.maximum.reduceat(own, new), np.diff(np.r_[new, len(key)])

    def texts(self, begin: np.ndarray, words: np.ndarray) -> pa.Array:
        """The bytes of strings of words, a space after each word; a long word is a tab, which no word has, and its digest."""
        which = _spread(begin, words)
        size = self.size[which] + 1
        data = self.data[_spread(self.start[which], size)]
        ends = _offsets(size)
        if (long := np.flatnonzero(size > LONG_WORD + 1)).size:
            parts, last = [], 0
            digests = {w: b"\t" + hashlib.sha256(self.data[self.start[w] : self.start[w] + self.size[w]]).hexdigest().encode() + b" " for w in set(which[long].tolist())}
            for i in long:
                parts += [data[last : ends[i]], np.frombuffer(digests[which[i]], np.uint8)]
                last = ends[i + 1]
            size[long] = len(digests[which[long[0]]])
            data, ends = np.concatenate([*parts, data[last:]]), _offsets(size)
        return binaries(data, np.diff(ends[_offsets(words)]))


class Distinct:
    """The distinct strings among a block's whose gram is wanted: text, words, least (the smallest id that has it) and bucket.

    Strings of hot grams come apart into their suffixes, which are dealt by a
    hash of all their words. which names the string of each occurrence (begin).
    """

    def __init__(self, block: Block, keys: np.ndarray, hot: np.ndarray, n_buckets: int) -> None:
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        at = np.minimum(np.searchsorted(keys, block.key), max(0, len(keys) - 1))
        wanted = keys[at] == block.key if len(keys) else np.zeros(len(block.key), bool)
        is_hot = wanted & hot[at] if len(keys) else wanted
        whole, apart = np.flatnonzero(wanted & ~is_hot), np.flatnonzero(is_hot)
        self.begin = np.r_[block.begin[whole], _spread(block.begin[apart], block.count[apart])]
        words = np.r_[block.count[whole] + WINDOW - 1, np.full(int(block.count[apart].sum()), WINDOW)]
        own = block.ids[block.row[self.begin]]
        # one text may be a string of a common gram and a suffix of a hot one; they are dealt apart
        kinds = [(slice(0, len(whole)), block.key[whole]), (slice(len(whole), len(words)), None)]
        self.which, text, self.words, self.least, bucket = np.zeros(len(words), np.int64), [], [], [], []
        n = 0
        for part, key in kinds:
            coded = block.texts(self.begin[part], words[part]).dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            one = np.zeros(len(coded.dictionary), np.int64)
            one[which] = np.arange(len(which))
            low = np.full(len(one), NO_ID)
            np.minimum.at(low, which, own[part])
            self.which[part] = which + n
            n += len(one)
            text.append(coded.dictionary)
            self.words.append(words[part][one])
            self.least.append(low)
            key = key[one] if key is not None else np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in coded.dictionary.to_pylist()], np.uint64)
            bucket.append((mix(key) % np.uint64(n_buckets)).astype(np.int64))
        self.text = pa.concat_arrays(text)
        self.words, self.least, self.bucket = np.concatenate(self.words), np.concatenate(self.least), np.concatenate(bucket)


# --- one bucket ------------------------------------------------------------


def deep_nodes(symbols: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes below nodes of depth WINDOW, each one's node): the trees of the suffixes, opened STEP words a level.

    Suffixes that share fewer words are leaves of shallower nodes and are left
    out; a level reads only the suffixes that are still together with others.
    """
    rank = symbols.astype(np.uint64)
    for have in (1, 2, 4):  # ranks of runs of STEP words
        beyond = np.r_[rank[have:], np.zeros(have, np.uint64)]
        rank = np.unique((rank << np.uint64(32)) | beyond, return_inverse=True)[1].astype(np.uint64)
    alive, node = np.arange(len(suffix)), np.zeros(len(suffix), np.uint64)
    for depth in [*range(0, WINDOW - STEP, STEP), WINDOW - STEP]:
        _, split, n = np.unique((node << np.uint64(32)) | rank[suffix[alive] + depth], return_inverse=True, return_counts=True)
        together = n[split] > 1
        alive, node = alive[together], split[together].astype(np.uint64)
    return alive, node.astype(np.int64)


def answer_bucket(table: pa.Table) -> pa.Table:
    """(block, at, step, length, best): runs of suffixes of the string ``at`` of a block that a smaller id, best, has as well."""
    text = table.column("text").combine_chunks()
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    coded = text.cast(pa.large_binary()).dictionary_encode()  # equal strings are read once
    which, strings = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    own = table.column("least").to_numpy()
    least = np.full(len(strings), NO_ID)
    np.minimum.at(least, which, own)
    words = np.zeros(len(strings), np.int64)
    words[which] = table.column("words").to_numpy()
    count = words - WINDOW + 1
    _, ends, data = strings.buffers()
    ends = np.frombuffer(ends, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    size = np.diff(np.r_[0, np.flatnonzero(data == SPACE) + 1])
    symbols = binaries(data, size).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    suffix = _spread(_offsets(words)[:-1], count)
    owner = np.repeat(np.arange(len(strings)), count)
    best = least[owner]
    alive, node = deep_nodes(symbols, suffix)
    low = np.full(int(node.max()) + 1 if len(node) else 0, NO_ID)
    np.minimum.at(low, node, best[alive])
    best[alive] = low[node]
    # only strings with a suffix that a smaller id has are answered
    from_ = _offsets(count)[:-1]
    smallest = np.minimum.reduceat(best, from_) if len(from_) else best
    some = np.flatnonzero(smallest[which] < own)
    n = count[which[some]]
    at, step = np.repeat(some, n), _spread(np.zeros(len(some), np.int64), n)
    value = best[_spread(from_[which[some]], n)]
    less = np.flatnonzero(value < own[at])
    new = np.flatnonzero(np.r_[True, (np.diff(less) != 1) | (np.diff(at[less]) != 0) | (np.diff(value[less]) != 0)]) if len(less) else np.zeros(0, np.int64)
    run, length = less[new], np.diff(np.r_[new, len(less)])
    rows = pa.array(at[run])
    return pa.table({"block": table.column("block").take(rows), "at": table.column("at").take(rows), "step": pa.array(step[run], pa.int32()), "length": pa.array(length, pa.int32()), "best": pa.array(value[run], pa.int64())})


# --- Spark -----------------------------------------------------------------


def pack_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, n_bytes, ids, offsets, text): rows in blocks of BLOCK_BYTES, compressed; a longer text is a block of its own."""
    kinds = {"block": pa.int64(), "n_bytes": pa.int64(), "ids": pa.list_(pa.int64()), "offsets": pa.binary(), "text": pa.binary()}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size, rows
            table = pa.Table.from_batches(held)
            parts = [(data, offsets) for chunk in table.column(1).chunks for _, _, data, offsets in text_blocks(chunk, 1 << 40)]
            data = np.concatenate([d for d, _ in parts])
            offsets = _offsets(np.concatenate([np.diff(o) for _, o in parts]))
            columns = [[number], [len(data)], [table.column(0).to_pylist()], [_pack(offsets)], [_pack(data)]]
            number, held, size, rows = number + 1, [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for a, b, data, _ in text_blocks(batch.column(1), BLOCK_BYTES):
                if held and (size + len(data) > BLOCK_BYTES or rows + b - a > BLOCK_ROWS):
                    yield flush()
                held.append(batch.slice(a, b - a))
                size, rows = size + len(data), rows + b - a
        if held:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(packed, "block long, n_bytes long, ids array<long>, offsets binary, text binary")


def block_of(row: dict) -> Block:
    return Block(_unpack(row["text"], "u1"), _unpack(row["offsets"], "<i8"), np.array([NO_ID if i is None else i for i in row["ids"]], np.int64))


def grams_of(blocks: DataFrame) -> DataFrame:
    """(key, block, low, high, strings): each block's distinct grams, the smallest and the largest id that have it, and its strings."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, low, high, n = block_of(row).grams()
                arrays = [key.view(np.int64), np.full(len(key), row["block"]), low, high, n]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["key", "block", "low", "high", "strings"])

    return blocks.select("block", "ids", "offsets", "text").mapInArrow(made, "key long, block long, low long, high long, strings long")


def wanted_of(batch: pa.RecordBatch, n_buckets: int) -> Iterator[tuple[int, Block, Distinct]]:
    """(block number, block, its wanted strings) of each row."""
    for i, row in enumerate(batch.select(["block", "ids", "offsets", "text"]).to_pylist()):
        marks = batch.column("marks").slice(i, 1).flatten()
        keys, hot = (marks.field(k).to_numpy(zero_copy_only=False) for k in ("key", "hot"))
        block = block_of(row)
        yield row["block"], block, Distinct(block, keys.astype(np.int64).view(np.uint64), hot.astype(bool), n_buckets)


def strings_of(marked: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, block, at, words, least, text): the distinct strings of each block whose gram several documents have."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, _, s in wanted_of(batch, n_buckets):
                n = len(s.words)
                arrays = [pa.array(s.bucket, pa.int64()), pa.array(np.full(n, number), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(s.words, pa.int32()), pa.array(s.least, pa.int64()), s.text.cast(pa.binary())]
                whole = pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", "at", "words", "least", "text"])
                for a in range(0, n, 4096):
                    yield whole.slice(a, 4096)

    return marked.mapInArrow(made, "bucket long, block long, at int, words int, least long, text binary")


def removed_words(block: Block, s: Distinct, answers: pa.StructArray) -> np.ndarray:
    """Which words of a block go."""
    count = s.words - WINDOW + 1
    base = _offsets(count)[:-1]
    best = np.repeat(s.least, count)
    if len(answers):
        at, step, length, low = (answers.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "step", "length", "best"))
        best[_spread(base[at] + step, length)] = np.repeat(low, length)
    repeated = np.zeros(len(block.start), np.int32)  # 1 where a window starts that a smaller id has
    for a in range(0, len(s.begin), 1 << 15):  # so many occurrences at a time
        part = slice(a, a + (1 << 15))
        which = s.which[part]
        gone = best[_spread(base[which], count[which])] < np.repeat(block.ids[block.row[s.begin[part]]], count[which])
        repeated[_spread(s.begin[part], count[which])[gone]] = 1
    upto = np.cumsum(repeated, dtype=np.int32)
    return upto > np.r_[np.zeros(min(WINDOW, len(upto)), np.int32), upto[:-WINDOW]]


def kept_texts(block: Block, removed: np.ndarray) -> list[bytes]:
    """Each row's words that stay, joined by one space."""
    stay = np.flatnonzero(~removed)
    size = block.size[stay] + 1
    data = block.data[_spread(block.start[stay], size)].tobytes()
    per_row = np.bincount(block.row[stay], size, len(block.ids)).astype(np.int64)
    ends = _offsets(per_row).tolist()
    return [data[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, n_spans, kept_sha256; with keep_text also kept (the words left, joined by one space).

    Words are what stands between bytes 0x20 and 0x09-0x0D, unchanged. A word
    goes when some run of 50 words over it also starts in a row with a smaller
    id; runs never reach over a row's end and are judged on the input. n_spans
    counts the maximal removed runs. Ids are integers; rows that repeat an id do
    not remove each other's words, rows without an id come last. Null texts have
    no words, texts under 50 words stay. An empty table gives no rows, other
    columns are ignored. Of grams with ``hot_strings`` strings or more each
    suffix is dealt by itself. A task holds a block of texts, or one longer text.
    """
    kind = dict(docs.dtypes)[id_col]
    blocks = written(pack_blocks(docs, id_col, text_col))
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    n_buckets = max(LEAST_BUCKETS, int(total * 1.5) // BUCKET_BYTES)
    grams = written(grams_of(blocks))
    per_gram = grams.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("strings").alias("n"))
    repeated = per_gram.where("low < high").select("key", (F.col("n") >= hot_strings).alias("hot"))
    marks = grams.select("key", "block").join(repeated, "key").groupBy("block").agg(F.collect_list(F.struct("key", "hot")).alias("marks"))
    marked = blocks.drop("n_bytes").join(marks, "block", "left")
    found = strings_of(marked, n_buckets).groupBy("bucket").applyInArrow(answer_bucket, "block long, at int, step int, length int, best long")
    answers = found.groupBy("block").agg(F.collect_list(F.struct("at", "step", "length", "best")).alias("answers"))
    fields = "n_words long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (_, block, s) in enumerate(wanted_of(batch, n_buckets)):
                removed = removed_words(block, s, batch.column("answers").slice(i, 1).flatten())
                starts = removed & ~np.r_[False, removed[:-1]]
                edge = block.first[:-1][np.diff(block.first) > 0]
                starts[edge] = removed[edge]
                n = [np.diff(_offsets(x)[block.first]) for x in (removed, starts)]
                kept = kept_texts(block, removed)
                columns = [batch.column("ids").slice(i, 1).flatten(), pa.array(np.diff(block.first)), *(pa.array(x.astype(np.int64)) for x in n), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary()).cast(pa.string())] * keep_text, names=["id", *(f.split()[0] for f in fields.split(", "))])

    # blocks are already dealt by their number, so this join moves only the answers
    joined = marked.join(answers, "block", "left")
    return joined.mapInArrow(finished, f"id long, {fields}").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
