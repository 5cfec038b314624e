"""Repeated word sequences against plain Python: nulls, ties, repeated rows and ids, odd white space, long words and texts, hot passages."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from test_operators import empty, make, prose

from episodelake.llm import substring_dedup
from episodelake.llm.substring_dedup import remove_repeated_words

WORD = re.compile("[^\x20\x09-\x0d]+")
LAST = (1 << 63) - 1


def plain(rows):
    """(id, words, removed, spans, digest, kept) of each row, from every window of 50 words."""
    texts = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in texts:
        for a in range(len(w) - 49):
            key = tuple(w[a : a + 50])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, w), (own, _) in zip(texts, rows, strict=True):
        gone = set()
        for a in range(len(w) - 49):
            if least[tuple(w[a : a + 50])] < i:
                gone.update(range(a, a + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((own, len(w), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def got(docs, **options):
    return sorted((tuple(r) for r in remove_repeated_words(docs, keep_text=True, **options).collect()), key=str)


PASSAGE = prose(70, 55)
MARKS = prose(71, 30) + " " + "w" * 70 + " " + "x" * 65 + " é日本\x00\x01 " + prose(72, 40)
TEXTS = [
    prose(1, 120), None, "", " \t\n", "one", PASSAGE, prose(2, 30) + " " + PASSAGE + " " + prose(3, 20), prose(4, 10) + "\n\n" + PASSAGE.replace(" ", " \t\x0b"), " ".join(PASSAGE.split()[:50]), " ".join(PASSAGE.split()[:49]),
    (3, prose(1, 120)), (None, PASSAGE), (None, PASSAGE), (5, PASSAGE), (-7, prose(5, 200)), prose(5, 200).replace(" ", " ", 1), prose(5, 200), MARKS, MARKS.replace("w" * 70, "w" * 71), MARKS + " " + MARKS,
    "a " * 300, "a " * 200 + "b", "a b " * 150, prose(6, 30_000), prose(7, 400) + " " + prose(6, 30_000)[:60_000], "y" * 300_000 + " " + prose(8, 100), "y" * 300_000 + " " + prose(8, 100),
]


@pytest.mark.parametrize("hot", [1, 4, 1 << 14])
def test_repeated_words(spark, hot):
    docs = make(spark, TEXTS).repartition(4).cache()
    assert got(docs, hot_strings=hot) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_of_nothing(spark):
    assert got(empty(spark)) == []
    assert got(make(spark, [None, "", (4, None)])) == plain([(0, None), (1, ""), (4, None)])


def test_hot_passage(spark, monkeypatch):
    """A passage in most rows, whose ends have other words around them in each, over many small blocks."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", 7)
    texts = [prose(1000 + i, i % 40) + " " + (PASSAGE if i % 3 else " ".join(PASSAGE.split()[3:])) + " " + prose(3000 + i, i % 23) for i in range(300)]
    docs = make(spark, texts).repartition(5).cache()
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs, hot_strings=20) == want == got(docs)


def test_random_copies(spark):
    """Pieces of a few texts put together at random, of a small vocabulary."""
    rng = random.Random(11)
    stock = [rng.choices("the of and a to in is it was for on as".split(), k=400) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            s, a = rng.choice(stock), rng.randrange(350)
            parts += s[a : a + rng.randint(20, 120)]
        texts.append(" ".join(parts))
    docs = make(spark, texts).repartition(3).cache()
    assert got(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_tree_levels():
    """deep_nodes joins suffixes that share 50 symbols and leaves out those that part before."""
    import numpy as np

    rng = np.random.default_rng(3)
    symbols = np.tile(rng.integers(0, 3, 200), 4).astype(np.int32)
    symbols[[130, 555]] = 9
    suffix = np.arange(len(symbols) - 49)
    alive, node = substring_dedup.deep_nodes(symbols, suffix)
    groups = {}
    for s in suffix:
        groups.setdefault(tuple(symbols[s : s + 50]), []).append(int(s))
    want = sorted(g for g in groups.values() if len(g) > 1)
    seen = {}
    for a, k in zip(alive, node, strict=True):
        seen.setdefault(int(k), []).append(int(suffix[a]))
    assert sorted(sorted(g) for g in seen.values()) == want
