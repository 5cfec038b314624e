"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodelake.llm import near_dedup, quality, sentencepiece_codec, sharding, suffix_dedup, token_counts, warc
from episodelake.llm.components import components
from episodelake.llm.corpus_queries import tokenizer_file
from episodelake.llm import decontaminate as decontamination
from episodelake.llm.decontaminate import decontaminate
from episodelake.llm.exact_dedup import exact_dedup
from episodelake.llm.license_scan import license_scan
from episodelake.llm.license_texts import TEMPLATES
from episodelake.llm.textbytes import text_blocks, word_texts, words_of_block
from episodelake.llm.token_counts import count_tokens

SCHEMA = "doc_id long, text string, lang string, id long, h long, node string, rid long, score double, shard int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def make(spark, texts, first=0):
    rows = [(i + first if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", 1, 2, "n", 3, 0.5, 4) for i, t in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


BASE = prose(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
LONG = prose(2, 20_000) + "\n" + BASE
TEXTS = [
    BASE, None, "", "  ", "a", BASE, BASE.replace(" ", " \t\n", 3), NEAR, LONG, prose(3, 40), prose(3, 40) + " " + BASE[:300], "x" * 3000, "é日本\U0001F600 ▁ \x00 <|endoftext|> it's I'LL 42",
    (5, BASE), (None, BASE), (None, None), "one two three", "One  two\nthree", "!!! ???", "ab " * 500, "q" + "z" * 49, "q" + "z" * 50,
]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, TEXTS).repartition(3).cache()


def ids_texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs):
    groups = {}
    for i, t in ids_texts(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    last = lambda x: (x is None, x)
    want = []
    for t, members in groups.items():
        keep = min(members, key=last)
        want += [(i, keep, len(members), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in members]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, exact_dedup(docs).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("n", [0, 1, 9, 1000])
def test_shards_are_exact(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text"))
    got = sharding.shard_rows(df).toPandas()
    assert sorted(got.doc_id) == list(range(n))
    counts = got.groupby("shard").size().reindex(range(8), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for s, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part))), s
    assert all(c == zlib.crc32(f"t{i % 7}".encode()) for i, c in zip(got.doc_id, got.text_crc32, strict=True))


def test_shards_of_odd_rows(docs):
    got = sharding.shard_rows(docs).toPandas()
    assert len(got) == len(TEXTS)
    sizes = sorted(len((t or "").encode()) + 1 for _, t in ids_texts(docs))
    assert sorted(got["size"]) == sizes


def test_shards_of_repeated_rows(spark):
    """Rows that are all alike are spread over the parts like others."""
    df = spark.createDataFrame([(7, "same")], "doc_id long, text string").crossJoin(spark.range(60_000)).repartition(3)
    got = sharding.shard_rows(df).toPandas()
    assert got.groupby("shard").size().tolist() == [7500] * 8
    assert all(sorted(p.slot) == list(range(7500)) for _, p in got.groupby("shard"))


def test_shards_are_uniform(spark, monkeypatch):
    """Over many shufflings every row meets every shard, and every tenth of a shard, equally often, in no order."""
    monkeypatch.setattr(sharding, "ROWS_PER_PART", 40)
    monkeypatch.setattr(sharding, "GROUP", 4)
    n, seeds = 400, 15
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(3).cache()
    got = [sharding.shard_rows(df, seed=s).toPandas().sort_values("doc_id") for s in range(seeds)]
    shard, slot = np.stack([g.shard for g in got]), np.stack([g.slot for g in got])
    # a tenth of the ids against the shards, and against the places within them
    for place, cells in ((shard, 8), (slot // 5, 10)):
        seen = np.stack([np.bincount(place[:, 40 * i : 40 * i + 40].ravel(), minlength=cells) for i in range(10)])
        want = n * seeds / (10 * cells)
        assert ((seen - want) ** 2 / want).sum() < 1.6 * 9 * (cells - 1)
    ids = np.arange(n)
    assert all(abs(np.corrcoef(ids, s)[0, 1]) < 0.2 for s in slot)
    assert len({tuple(s) for s in shard}) == seeds


@pytest.mark.parametrize("group", [1024, 3])
def test_communication_matrix_has_its_margins(spark, monkeypatch, group):
    monkeypatch.setattr(sharding, "GROUP", group)
    parts = spark.createDataFrame([(p, 37 * p + 1) for p in range(12)], "part long, n long")
    got = {r.part: r.upto for r in sharding.communication_matrix(parts, 8, 5).collect()}
    counts = np.array([np.diff([0, *got[p]]) for p in range(12)])
    assert (counts >= 0).all() and list(counts.sum(axis=1)) == [37 * p + 1 for p in range(12)]
    assert counts.sum(axis=0).max() - counts.sum(axis=0).min() <= 1


def test_hypergeometric_follows_its_law(spark):
    total, good, draws, n = 60, 20, 12, 4000
    df = spark.range(n).select(sharding.hypergeometric((F.col("id") + 0.5) / n, F.lit(total), F.lit(good), F.lit(draws)).alias("k"))
    seen = {r["k"]: r["count"] / n for r in df.groupBy("k").count().collect()}
    for k in range(draws + 1):
        law = math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
        assert abs(seen.get(k, 0) - law) <= 2 / n


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in ids_texts(docs))
    assert sorted((str(r[0]), *r[1:]) for r in count_tokens(docs, path).collect()) == want


def test_token_counts_of_long_pieces_and_other_tokenizers(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    long_ones = ["".join(rng.choice("abcXYZ0123456789'<|>.,é") for _ in range(200_000)), "ab" * 70_000, "1" * 150_000 + "<|endoftext|>" + "a2" * 50_000, ("天地玄黃。" * 20_000), "'s" * 40_000 + "4" + "x's" * 30_000, "A\u0301" * 40_000]
    assert [len(token_counts.cut_piece(t)) > 1 for t in long_ones] == [True, False, True, True, True, False]
    texts = [*long_ones, "it's 42", "a  b", None, "", " x\n"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = Tokenizer.from_file(tokenizer_file(name))
        want = {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
        assert {r.doc_id: r.n_tokens for r in count_tokens(make(spark, texts), tokenizer_file(name)).collect()} == want


def test_sentencepiece_equals_library(docs):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_codec.encode_texts(docs, path, keep_ids=True).collect()
    assert sorted(str((r.doc_id, r.ids)) for r in got) == sorted(str((i, sp.encode(t or ""))) for i, t in ids_texts(docs))
    text = dict(ids_texts(docs))
    for r in got:
        if r.doc_id is not None:
            assert r.round_trip == ("▁" not in (text[r.doc_id] or "")) and r.n_tokens == len(r.ids)


def test_sentencepiece_equals_library_on_documents(spark):
    import duckdb
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(3)
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["".join(rng.choice("abetheiniongs é日本\U0001F600▁\x00'_.,0123456789") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (255, 256, 257, 449, 3000)] + ["a" * 2000, "ab" * 900, "-" * 300 + "the" * 200, "日本語" * 300, "   x    y  ", " " * 40]
    c = sentencepiece_codec.codec(path)
    ids, ends = c.encode([t or "" for t in texts])
    assert all(ids[a:b].tolist() == library.encode(t or "", num_threads=1) for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True))
    assert not any(c.model.rules.odd.search(w) for w in c.known if "   " not in w)


def test_very_long_words_take_linear_time():
    """A word of 400,000 characters has the library's ids; ten times that, base64 or not spaced at all, takes ten times as long."""
    import time

    import sentencepiece

    path, rng = tokenizer_file("piece_bpe_32k.model"), random.Random(12)
    c, library = sentencepiece_codec.codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    word = "".join(rng.choices("etaoinshrdluETAOIN0123456789+/", k=400_000))
    chinese = "".join(rng.choices("日本語中文的一是不了人我在有他这", k=100_000))
    ids, ends = c.encode([word, chinese])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == library.encode([word, chinese], num_threads=1)
    times = []
    for n in (200_000, 1_600_000):
        some = "".join(rng.choices("etaoinshrdluETAOIN0123456789+/", k=n))
        began = time.process_time()
        c.encode([some])
        times.append(time.process_time() - began)
    assert times[1] < 20 * times[0] + 5


@pytest.mark.parametrize("seed", range(12))
def test_paths_of_allowed_neighbours_are_merges(seed):
    """On made-up vocabularies, with scores that tie; the plain twin takes the best and leftmost pair again and again."""
    rng = random.Random(seed)
    letters = "abc▁"
    made = list(letters)
    while len(made) < 40:
        x = rng.choice(made) + rng.choice(made)
        if x not in made and len(x) <= 7:
            made.append(x)
    scores = {p: -float(i if seed % 2 else i // 2) for i, p in enumerate(made)}
    pieces = [("<unk>", 0.0, 2), *((p, scores[p], 1) for p in made)]
    m = sentencepiece_codec.Model(pieces, sentencepiece_codec.BPE)

    def merged(w):
        parts = list(w)
        while True:
            pairs = [(-scores[a + b], k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in scores]
            if not pairs:
                return parts
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for n in (1, 2, 5, 9, 14):
        words_ = ["".join(rng.choice(letters + "z") for _ in range(n)) for _ in range(150)]
        got = sentencepiece_codec.encode_words(m, words_)
        index = {p: i for i, (p, _, _) in enumerate(pieces)}
        for w, raw in zip(words_, got, strict=True):
            assert np.frombuffer(raw, np.int32).tolist() == [index.get(x, 0) for x in merged(w)], w
    long = ["".join(rng.choice(letters) for _ in range(n)) for n in (300, 700)]
    for w, starts in zip(long, sentencepiece_codec.search_long(m, long) if not (m.rules.odd and any(map(m.rules.odd.search, long))) else [None, None], strict=True):
        assert starts is None or [w[a:b] for a, b in zip(starts, [*starts[1:], len(w)], strict=True)] == merged(w)


def test_viterbi_is_the_best_path():
    pieces = [("<unk>", 0.0, 2), *((c, -5.0, 1) for c in "abc"), ("ab", -3.0, 1), ("bc", -2.5, 1), ("abc", -6.0, 1), ("ca", -4.0, 1), ("▁", -1.0, 1)]
    m = sentencepiece_codec.Model(pieces, sentencepiece_codec.UNIGRAM)
    score = {p: s for p, s, k in pieces if k == 1}

    def best(w):
        top = [0.0] + [-math.inf] * len(w)
        for e in range(1, len(w) + 1):
            for a in range(max(0, e - 3), e):
                s = score.get(w[a:e], -16.0 if e - a == 1 else -math.inf)
                top[e] = max(top[e], top[a] + s)
        return top[-1]

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd▁") for _ in range(7)) for _ in range(200)]
    for w, cuts in zip(texts, sentencepiece_codec.viterbi(m, texts), strict=True):
        at = [*np.flatnonzero(cuts), len(w)]
        total = sum(score.get(w[a:b], -16.0) for a, b in zip(at[:-1], at[1:], strict=True))
        assert total == pytest.approx(best(w)), w


def brute_repeats(rows, n=50):
    first, texts = {}, [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(i, first.get(b[p : p + n], math.inf))
    out = []
    for (i, b), (own, _) in zip(texts, rows, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        runs = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append(str((own, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_STRINGS, 2])
def test_repeats_are_removed(docs, hot):
    assert sorted(str(tuple(r)) for r in suffix_dedup.remove_repeats(docs, hot_strings=hot).collect()) == brute_repeats(ids_texts(docs))


def test_suffixes_are_in_order():
    """Of the strings of one bucket, laid out with their anchors at equal residues, by their first 50 bytes."""
    rng = np.random.default_rng(4)
    x = rng.integers(97, 99, 3000).astype(np.uint8)
    x[500:700] = x[900:1100] = x[1500:1700]
    x = np.r_[x, np.zeros(64, np.uint8)]
    covered = np.isin(np.arange(len(x)) % suffix_dedup.PERIOD, suffix_dedup.COVER)
    eight = suffix_dedup.eight_at(x)
    ranks = suffix_dedup.cover_ranks(eight, covered[: len(eight)])
    at = rng.permutation(2900)
    run = np.unique(eight[at], return_inverse=True)[1]
    ordered = at[suffix_dedup.suffix_order(run, at, ranks)]
    heads = [x[i : i + 50].tobytes() for i in ordered]
    assert heads == sorted(heads) and sorted(ordered) == sorted(at)


def test_long_rows_are_cut_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data, offsets = rng.integers(97, 101, 9000).astype(np.uint8), np.array([0, 30, 7000, 7000, 7049, 7099, 9000])

    def windows():
        counts, at = suffix_dedup.cut_strings(data, offsets)
        step = np.concatenate([np.arange(c) for c in counts])
        return np.repeat(at.astype(int), counts) - step

    whole = windows()
    for size in (200, 1000, 4097):
        monkeypatch.setattr(suffix_dedup, "PART_BYTES", size)
        assert (windows() == whole).all()


def test_repeats_in_random_texts(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abc \n") for _ in range(rng.randint(45, 140))) for _ in range(8)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.3 else "".join(rng.choice("abé ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    df = make(spark, texts).repartition(5)
    for hot in (suffix_dedup.HOT_STRINGS, 3):
        assert sorted(str(tuple(r)) for r in suffix_dedup.remove_repeats(df, hot_strings=hot).collect()) == brute_repeats(ids_texts(df))


def brute_hits(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for win, names in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= names
        out.append(str((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))))
    return sorted(out)


@pytest.mark.parametrize("most", [200_000, 3])
def test_decontamination(spark, docs, monkeypatch, most):
    """With a broadcast table of windows, and with a shuffled one."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    items = [(1, " ".join(BASE.split()[10:30])), (2, "one TWO three"), (10, BASE), (10, BASE), (3, None), (4, "..."), (5, "ab ab"), (6, "never seen anywhere"), (7, prose(3, 11)), (None, "One two")]
    bench = spark.createDataFrame([(i, t, "x", 9) for i, t in items], "item_id long, text string, rid string, wid long")
    want = brute_hits(ids_texts(docs), items[:-1])
    assert sorted(str(tuple(r)) for r in decontaminate(docs, bench.where("item_id is not null")).collect()) == want
    none = decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r.contaminated for r in none)


def brute_licenses(rows, templates):
    """License names and windows of each row, by sets of shingles."""
    shingles = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    out = []
    for i, text in rows:
        have, found = shingles(words(text)), set()
        for name, t in templates:
            own = shingles(words(t))
            for start in range(0, len(have), max(1, len(own))):
                if own and len(set(own) & set(have[start : start + 2 * len(own)])) >= 0.8 * len(set(own)):
                    found.add((name, start))
        names = sorted({n for n, _ in found})
        out.append(str((i, len(words(text)), len(names), ",".join(names), len(found))))
    return sorted(out)


@pytest.mark.parametrize("most", [200_000, 5])
def test_licenses(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    whole = dict(TEMPLATES)
    cut = " ".join(whole["bsd-3-clause"].split()[:-30])
    texts = [
        "Released under the MIT License.", prose(4, 50) + " Licensed under CC BY-NC 4.0. " + prose(5, 3), "released under the MIT", "Licensed under the Apache License, Version 2.0. Released under the mit license", None, "", (3, "x"),
        prose(6, 70) + "\n" + whole["mit"].replace("Software", "Program", 1) + "\n" + prose(7, 400), whole["apache-2.0-notice"].upper() + whole["isc"], (None, cut), (None, None), (7, cut), (7, cut),
        "/* " + whole["zlib"].replace("\n", "\n * ") + " */", prose(2, 30_000) + " " + whole["gpl-3.0-notice"], whole["unlicense"][:300],
    ]
    df = make(spark, texts)
    got = sorted(str(tuple(r)) for r in license_scan(df).collect())
    assert got == brute_licenses(ids_texts(df), TEMPLATES)
    assert sum("''" not in r and ", 0, '', 0)" not in r for r in got) >= 10
    assert {r.n_licenses for r in license_scan(df, []).collect()} == {0}
    assert {r.n_licenses for r in license_scan(df, [("short", "MIT"), ("none", "")]).collect()} == {0}


def weighted(text):
    w, out = words(text), {}
    for i in range(len(w) - 4 if len(w) >= 5 else min(len(w), 1)):
        k = tuple(w[i : i + 5])
        out[k] = out.get(k, 0) + 1
    return {k: 1 + math.log(n) for k, n in out.items()}


def brute_jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in set(a) & set(b))


def test_prob_jaccard_and_its_estimate():
    texts = [BASE, NEAR, BASE + " " + BASE[:200], prose(9, 80), BASE[:400]]
    for _, _, data, offsets in text_blocks(__import__("pyarrow").array(texts)):
        h, count, doc = near_dedup.counted_shingles(words_of_block(data, offsets))
        w = near_dedup.weights(count)
    sig = near_dedup.prob_minhash(h, w, doc, len(texts), 4096)
    for i, j in combinations(range(len(texts)), 2):
        exact = near_dedup.prob_jaccard(h[doc == i], w[doc == i], h[doc == j], w[doc == j])
        assert exact == pytest.approx(brute_jaccard(weighted(texts[i]), weighted(texts[j])))
        assert abs((sig[i] == sig[j]).mean() - exact) < 0.04


def brute_classes(rows):
    sets = [weighted(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and (words(rows[i][1]) == words(rows[j][1]) or brute_jaccard(sets[i], sets[j]) >= 0.8):
            parent[root(i)] = root(j)
    last = lambda x: (x is None, x)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(root(i), []).append(rows[i][0])
    return sorted(str((rows[i][0], min(classes[root(i)], key=last), len(classes[root(i)]))) for i in range(len(rows)))


def test_near_duplicates(docs):
    small = docs.where("text is null or length(text) < 20000")
    got = sorted(str((r.doc_id, r.class_id, r.class_size)) for r in near_dedup.near_duplicates(small).collect())
    assert got == brute_classes(ids_texts(small))


def test_near_duplicate_groups(spark):
    rng, texts = random.Random(3), []
    for g in range(6):
        base = prose(100 + g, 90).split()
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(w))
    df = make(spark, texts).repartition(4)
    got = sorted(str((r.doc_id, r.class_id, r.class_size)) for r in near_dedup.near_duplicates(df).collect())
    assert got == brute_classes(ids_texts(df))


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    """All joins by a shuffle, and every group of more than three rows a hot one."""
    from episodelake.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng, texts = random.Random(9), []
    for g in range(5):
        base = prose(300 + g, 70).split()
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(w))
    df = make(spark, texts + texts[:6] + [None, ""]).repartition(4)
    got = sorted(str((r.doc_id, r.class_id, r.class_size)) for r in near_dedup.near_duplicates(df).collect())
    assert got == brute_classes(ids_texts(df))


def test_near_duplicates_of_long_texts(spark):
    long = prose(41, 60_000)
    words_ = long.split()
    texts = [long, " ".join([*words_[:100], "other", *words_[101:]]), long.upper(), " ".join(words_[:20_000]), prose(42, 60_000), " ".join(words_[5000:])]
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in near_dedup.near_duplicates(make(spark, texts)).collect()}
    assert got == {0: (0, 4, True), 1: (0, 4, False), 2: (0, 4, False), 3: (3, 1, True), 4: (4, 1, True), 5: (0, 4, False)}


@pytest.mark.parametrize(("common", "all_"), [(12, 15), (48, 60), (8, 10)])
def test_pairs_of_exactly_the_threshold_are_near(spark, common, all_):
    text = prose(55, all_ + 4).split()
    df = make(spark, [" ".join(text[: common + 4]), " ".join(text)])
    digests = near_dedup.signatures(df, "doc_id", "text").select(F.xxhash64("digest").alias("node"), "digest")
    sets = near_dedup.shingle_sets(df, "text", digests)
    a, b = (r.node for r in sets.collect())
    pairs = spark.createDataFrame([(a, b)], "a long, b long")
    assert near_dedup.verify(pairs, sets, 0.8).count() == 1
    found = sets.select(F.lit(1).alias("key"), "node", F.lit(2).alias("n"), *[F.lit(-1).alias(f"c{i}") for i in range(near_dedup.CENTRES)])
    labels = spark.createDataFrame([], "node long, label long")
    assert near_dedup.remaining_links(found, labels, sets, 0.8).count() == 1


def edited(text, seed, n, start=0, step=1):
    w, rng = text.split(), random.Random(seed)
    for i in rng.sample(range(start, len(w) - 5, step), n):
        w[i] = f"e{seed}x{i}"
    return " ".join(w)


def test_near_duplicates_at_the_fringe_of_a_large_group(spark):
    """Texts that are near to one text of a large group only, in buckets of hundreds."""
    base = prose(77, 200)
    group = [edited(base, i, 2, 5, 10) for i in range(300)]
    texts = group + [edited(group[i], 1000 + i, 4, 0, 10) for i in range(80)]
    for _, _, data, offsets in text_blocks(__import__("pyarrow").array(texts)):
        h, count, doc = near_dedup.counted_shingles(words_of_block(data, offsets))
        w = near_dedup.weights(count)
    sets = [(h[doc == i], w[doc == i]) for i in range(len(texts))]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if near_dedup.prob_jaccard(*sets[i], *sets[j]) >= 0.8]
    want = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(make(spark, texts).repartition(4)).collect()}
    wrong = [i for i in got if got[i] != want.get(i, i)]
    assert not wrong, wrong


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}


def test_pairs_are_fitted_to_the_least_loss():
    """Against plain gradient descent over all the same pairs, written from the definition."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 3)) + y[:, None] * np.array([1.0, 0.0, -0.5])
    model = quality.fit_pairs(x, y, seed=5, steps=3000)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -4, 4)
    z = np.stack([z, z * z], axis=2).reshape(300, -1)
    draw = np.random.default_rng(5)
    good, bad = z[y == 1], z[y == 0]
    n = quality.PAIRS * max(len(good), len(bad))
    diff = good[draw.integers(len(good), size=n)] - bad[draw.integers(len(bad), size=n)]
    w = np.zeros(6)
    for _ in range(20_000):
        w -= 0.05 * (-(diff * (1 / (1 + np.exp(diff @ w)))[:, None]).mean(axis=0) + 1e-4 * w)
    assert np.allclose(model.weights, w, atol=2e-3)
    raw = z @ w
    pairs = [(a, b) for a in raw[y == 1] for b in raw[y == 0]]
    assert np.mean([a > b for a, b in pairs]) > 0.76  # the best order of these two normal laws has 0.785
    assert quality.fit_pairs(x, np.ones(300)).weights == []


def test_features_of_whole_texts():
    text = "Ab ab 12!!\né,x"
    (row,) = [quality.block_features(d, o) for _, _, d, o in text_blocks(__import__("pyarrow").array([text]))][0]
    got, n = dict(zip(quality.FEATURES, row, strict=True)), len(text.encode())
    want = {"log_bytes": math.log1p(n), "letters": 7 / n, "upper": 1 / n, "digits": 2 / n, "high": 2 / n, "space": 2 / n, "lines": 1 / n, "bang": 2 / n, "punct": 1 / n, "log_words": math.log1p(5), "unique": 4 / 5, "top_word": 2 / 5, "pairs_unique": 1.0, "word_len": 9 / 5, "runs": 1 / n, "stops": 0.0}
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_clashing_labels_count_as_the_lower_one(spark):
    good, bad = prose(1, 80), "### $$$ " * 40
    docs = make(spark, [good if i % 2 else bad for i in range(200)])
    once = [(i, i % 2) for i in range(200)]
    labels = spark.createDataFrame([*once, *[(i, 1) for i in range(0, 200, 4)], (None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    want = quality.score_quality(docs, spark.createDataFrame(once, "doc_id long, quality int")).collect()
    for parts in (1, 5):
        got = {r.doc_id: r for r in quality.score_quality(docs, labels.repartition(parts)).collect()}
        assert all((got[r.doc_id].predicted, got[r.doc_id].score) == (r.predicted, pytest.approx(r.score)) for r in want)


def test_quality(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.score_quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.97


def test_quality_threshold_is_the_quantile_of_label_zero(spark):
    """The cut lies at the share of label 0 among the raw scores of all labelled rows that are not held out; predicted follows it."""
    docs = make(spark, [prose(i, 60) if i % 3 else "### $$$ " * 20 + prose(i, 5 + i % 7) for i in range(400)])
    labels = spark.createDataFrame([(i, 1 if i % 3 or i % 30 == 0 else 0) for i in range(0, 400)], "doc_id long, quality int")
    feats = quality.features(docs, "doc_id", "text").cache()
    model = quality.fit(feats, labels)
    raw = {r.doc_id: r.raw for r in feats.select("doc_id", model.raw().alias("raw")).collect()}
    known = {i: 1 if i % 3 or i % 30 == 0 else 0 for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2}
    ordered, share = sorted(raw[i] for i in known), 1 - sum(known.values()) / len(known)
    at = [ordered[max(0, math.ceil((share + d) * len(known)) - 1)] for d in (-0.002, 0.002)]
    assert model.threshold == pytest.approx(sum(at) / 2) and model.spread == pytest.approx(np.std([raw[i] for i in known]) / 2)
    for r in quality.score_quality(docs, labels).collect():
        assert r.predicted == int(raw[r.doc_id] >= model.threshold) and r.predicted == int(r.score >= 0.7)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(math.log(0.7 / 0.3) + (raw[r.doc_id] - model.threshold) / model.spread))))


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (8, 0, 0), (9, None, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    unlabelled = quality.score_quality(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in unlabelled} == {(0.5, 0)}


PAGES = "page_id long, url string, html string, sha string, copies long"


def test_warc_round_trip(spark):
    big, huge = "<p>" + "é" * 80, prose(8, 900_000)
    pages = [
        (3, "http://a/ b", big), (1, "http://b", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" + "x" * 200), (1, "again", big), (8, "u", big + "\r\n\r\n"),
        (None, "n", big), (None, "n", big), (None, "n", "y" * 300), (None, "m", "y" * 300), (None, None, None), (9, "h", huge), (10, "h", huge), (11, "w", ("WARC/1.1\r\n" * 40_000)),
    ]
    df = spark.createDataFrame([(*p, "s", 1) for p in pages], PAGES).repartition(3)
    got = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.archive_round_trip(df).collect())
    want, seen = [], set()
    for i, _, h in pages:
        raw = (h or "").encode()
        first = min((j for j, _, x in pages if (x or "") == (h or "") and j is not None), default=None)
        # of rows that repeat the smallest id one is the response
        again = len(raw) >= 100 and first is not None and (i != first or (i, h) in seen)
        seen.add((i, h))
        want.append(str((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None)))
    assert got == sorted(want)
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def test_one_response_of_rows_that_repeat_an_id(spark):
    big = "z" * 500
    pages = [(1, "b", big)] * 50 + [(1, "a", big)] * 3 + [(1, None, big)] * 2 + [(2, "c", big), (None, "d", big), (3, "e", "x" * 200), (3, "e", "x" * 200), (4, "s", "s"), (4, "s", "s")]
    df = spark.createDataFrame([(*p, "s", 1) for p in pages], PAGES).repartition(4)
    got = sorted(str((r.page_id, r.record_type, r.refers_to, r.target_uri)) for r in warc.archive_round_trip(df).collect())
    want = [(1, "revisit", 1, "b")] * 50 + [(1, "response", None, "a")] + [(1, "revisit", 1, "a")] * 2 + [(1, "revisit", 1, "about:blank")] * 2
    want += [(2, "revisit", 1, "c"), (None, "revisit", 1, "d"), (3, "response", None, "e"), (3, "revisit", 3, "e"), (4, "response", None, "s"), (4, "response", None, "s")]
    assert got == sorted(str(w) for w in want)


def morse(n, swap):
    word = "01" if not swap else "10"
    while len(word) < n:
        word += word.translate({48: 49, 49: 48})
    return word.translate({48: 97, 49: 98})


def test_words_of_a_regular_make_are_different(spark):
    """Words that any polynomial modulo a power of two takes for equal, short and long ones, are other words."""
    for n in (64, 2048):
        a, b = morse(n, False), morse(n, True)
        assert a != b and len(a) == len(b)
        common = prose(41, 3)
        rows = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(make(spark, [f"{common} {a}", f"{common} {b}", f"{common}, {a.upper()}!"])).collect()}
        assert rows == {0: 0, 1: 1, 2: 0}


def test_texts_of_words_are_told_by_their_bytes(spark):
    texts = ["One two", "one  TWO.", "(one) two", "onetwo", "one tw o", "", "!", "É x", "é x"]
    block = next(text_blocks(spark.createDataFrame([(t,) for t in texts], "t string").toArrow().column(0).combine_chunks()))
    assert word_texts(*block[2:]) == [b"one two"] * 3 + [b"onetwo", b"one tw o", b"", b"", "É x".encode(), "é x".encode()]


def test_pairs_of_a_hot_text_are_split(spark, monkeypatch):
    """A centre of most pairs goes to many tasks, with Spark's own splitting off; no pair is lost."""
    monkeypatch.setattr(near_dedup, "HOT_PAIRS", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 20_000
        pairs = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        sets = spark.range(n).select(F.col("id").alias("node"), F.lit(b"12345678").alias("h"), F.lit(b"").alias("c"))
        parts = near_dedup.with_sets(pairs, sets, "a").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in parts) == n - 1 and len(parts) > 40 and max(r["count"] for r in parts) < n // 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_headers_of_any_length(spark):
    """A data url of a megabyte is a header line like others."""
    pages = [(i, "data:" + "u" * n, f"page {i} " * 40) for i, n in enumerate((10, 70_000, 1_000_000, 5_000_000))]
    df = spark.createDataFrame([(*p, "s", 1) for p in pages], PAGES)
    assert {(r.page_id, r.target_uri) for r in warc.archive_round_trip(df).collect()} == {(i, u) for i, u, _ in pages}
    # headers without an end, and a record behind them
    cut = warc.page_record({"page_id": 8, "url": "u" * 3_000_000, "payload": b"b", "size": 1, "sha": "", "refers_to": None})[:2_000_000]
    assert numbers(warc.salvage(page(0) + cut + page(2))) == [0, 2]


def test_long_members_are_streamed(monkeypatch):
    """One gzip member of many records is read a record at a time, and damage in it costs what it hits."""
    import gzip

    monkeypatch.setattr(warc, "HELD_BYTES", 10_000)
    longest = []
    plain_forget = warc.Inflated.forget
    monkeypatch.setattr(warc.Inflated, "forget", lambda self, at: (longest.append(len(self.held)), plain_forget(self, at))[1])
    body = b"c" * 1_000_000
    records = [warc.page_record({"page_id": i, "url": "u", "payload": body, "size": 1, "sha": hashlib.sha256(body).hexdigest(), "refers_to": None}) for i in range(60)]
    assert numbers(warc.salvage(gzip.compress(b"".join(records), 1))) == [i % 10 for i in range(60)]
    assert 0 < max(longest) < 6_000_000
    bad = bytearray(records[7])
    bad[-2000] ^= 0xFF
    damaged = b"".join([*records[:7], bytes(bad), b"WARC/1.1\r\nContent-Length: 900000000\r\n\r\n", b"junk" * 500_000, *records[8:]])
    items = list(warc.salvage(gzip.compress(damaged, 1)))
    assert numbers(items) == [i % 10 for i in range(60) if i != 7]
    gap = next(x for x in items if x.headers is None)
    assert gap.inside == sum(map(len, records[:7]))
    cut = gzip.compress(b"".join(records), 1)
    items = list(warc.salvage(cut[: len(cut) // 2] + gzip.compress(page(3))))
    assert numbers(items)[-1] == 3 and 20 < len(numbers(items)) < 40 and [x.start for x in items if x.headers is None] == [0]


def test_a_member_of_more_than_a_gigabyte():
    import tracemalloc
    import zlib

    body = b"d" * (1 << 20)
    record = warc.page_record({"page_id": 1, "url": "u", "payload": body, "size": 1, "sha": hashlib.sha256(body).hexdigest(), "refers_to": None})
    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = b"".join([*(zipped.compress(record) for _ in range(1100)), zipped.flush()])
    tracemalloc.start()
    assert sum(x.headers is not None for x in warc.salvage(data)) == 1100
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_repeated_payloads_beyond_the_hot_limit_and_below_it(spark, monkeypatch):
    """Both branches of the join to groups: a payload in most rows, and some in a few."""
    from episodelake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    texts = ["h" * 150] * 60 + [f"{i % 12} " * 60 for i in range(40)] + [None, ""]
    pages = [(i, "u", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*p, "s", 1) for p in pages], PAGES).repartition(3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()}
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    assert got == {i: ("revisit", first[t]) if t and first[t] != i else ("response", None) for i, t in enumerate(texts)}
    kept = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(make(spark, texts)).collect()}
    blank = {100: (100, 2), 101: (100, 2)}
    assert kept == {i: (first[t], texts.count(t)) for i, t in enumerate(texts) if t} | blank


def test_damaged_archives_are_an_error_with_a_gap_log(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50, "s", 1) for i in range(20)], PAGES).coalesce(1)
    closed = spark.createDataFrame(warc.write_warc(df, str(tmp_path / "a")).collect())
    assert warc.read_back(spark, f"file://{tmp_path}/a", closed).count() == 20
    (file,) = (tmp_path / "a").iterdir()
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 0xFF
    file.write_bytes(data)
    with pytest.raises(ValueError, match="gaps"):
        warc.read_back(spark, f"file://{tmp_path}/a", closed)
    (gap,) = spark.read.parquet(f"{tmp_path}/a-gaps").collect()
    assert 0 < gap.start < gap.end < len(data) and gap.kind == "gap"


def page(i, digest=True):
    body = (f"body {i} " * 40).encode()
    made = warc.page_record({"page_id": i, "url": f"u{i}", "payload": body, "size": 1, "sha": hashlib.sha256(body).hexdigest(), "refers_to": None})
    return made if digest else re.sub(rb"WARC-Block-Digest[^\r]*\r\n", b"", made)


def numbers(items):
    return [int(x.headers["warc-record-id"][-2]) for x in items if x.headers is not None]


def test_a_member_of_several_records_loses_the_bad_one_only():
    import gzip

    good, bad = [page(i) for i in range(6)], bytearray(page(2))
    bad[-20] ^= 0xFF
    one = gzip.compress(b"".join([*good[:2], bytes(bad), *good[3:]]), 0)
    assert numbers(warc.salvage(one)) == [0, 1, 3, 4, 5]
    gap = next(x for x in warc.salvage(one) if x.headers is None)
    assert gap.inside == len(good[0] + good[1]) and (gap.start, gap.end) == (0, len(one))
    # a member that breaks off: records that pass a digest are taken, those without one are not
    parts = [page(0), page(1, digest=False), *good[2:]]
    whole = gzip.compress(b"".join(parts), 0)
    cut = whole[: len(whole) - len(good[5]) - 100] + gzip.compress(page(7))
    items = list(warc.salvage(cut))
    assert numbers(items) == [0, 2, 3, 7] and [x.start for x in items if x.headers is None] == [0]


@pytest.mark.parametrize("piece", ["WARC/1.1\r\n", "WARC/1.1\r\na: b\r\n", "a: WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 9\r\n\r\n", "WARC/1.1\r\nContent-Length: 5000000\r\n\r\n", "\x1f\x8b\x08"])
def test_salvage_is_linear(piece):
    import time

    data = page(0) + page(1)[:200] + piece.encode("latin-1") * (2_000_000 // len(piece)) + page(2)
    began = time.process_time()
    assert numbers(warc.salvage(data)) == [0, 2]
    assert time.process_time() - began < 30


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_finds_later_records(spark, tmp_path, packed):
    import gzip

    records = [page(i) for i in range(6)]
    parts = [gzip.compress(r) if packed else r for r in records]
    damaged = bytearray(parts[2])
    damaged[len(damaged) // 2] ^= 0xFF
    data = b"junk" + parts[0] + parts[1] + bytes(damaged) + parts[3] + parts[4][: len(parts[4]) // 2] + parts[5] + b"tail"
    (tmp_path / "a.warc").write_bytes(data)
    got = warc.read_warc(spark, str(tmp_path)).toPandas().sort_values("start")
    records_ = got[got.kind == "record"]
    assert [x[-2] for x in records_.record_id] == ["0", "1", "3", "5"] and records_.payload_ok.all()
    gaps = got[got.kind == "gap"]
    assert gaps.reason.str.len().min() > 0
    spans = sorted(zip(got.start, got.end, strict=True))
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_empty_tables(spark):
    e = empty(spark)
    bench = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    made = [
        exact_dedup(e), sharding.shard_rows(e), count_tokens(e, tokenizer_file("word_bpe_49k.json")), sentencepiece_codec.encode_texts(e, tokenizer_file("piece_bpe_32k.model")), suffix_dedup.remove_repeats(e),
        decontaminate(e, bench), license_scan(e), near_dedup.near_duplicates(e), quality.score_quality(e, labels),
    ]
    assert [df.count() for df in made] == [0] * len(made)
