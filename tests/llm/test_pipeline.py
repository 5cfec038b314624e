"""The stages of the corpus pipeline one by one against plain Python, and run() over them."""

from __future__ import annotations

import hashlib
import re

import pytest
from test_operators import brute_classes, brute_hits, ids_texts, prose

import corpus_pipeline
from episodelake.llm.corpus_queries import tokenizer_file
from episodelake.llm.quality import score_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
JUNK = "### $$$ %%% *** &&& " * 30
ITEM = prose(900, 25)


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def corpus():
    rows = [(i, prose(i, 80) if i % 3 else JUNK + prose(i, 5)) for i in range(120)]
    base = prose(500, 120).split()
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (10, 60, 100)]
    rows += [(200, " ".join(base)), *[(201 + k, t) for k, t in enumerate(near)], (210, prose(1, 80)), (211, prose(2, 80).replace(" ", "  \n")), (220, prose(7000, 30) + " " + ITEM + " " + prose(7001, 30))]
    return [*rows, (None, prose(8000, 60)), (None, prose(8000, 60)), (230, prose(8001, 60)), (230, prose(8001, 60)), (240, prose(8002, 30_000)), (250, None), (251, ""), (252, "  ")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    table_of(spark, corpus()).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1 if i % 3 else 0, 0) for i in range(0, 120)] + [(250, 0, 0), (None, 1, 0), (5, None, None), (777, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def key(r):
    return tuple((x is None, str(x)) for x in r)


def kept_by_id(rows, ids):
    return sorted([r for r in rows if r[0] in ids], key=key)


def least(x):
    return x is None, x


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {min(g, key=least) for g in groups.values()}


def plain_near(rows):
    found = {}
    for x in brute_classes(rows):
        i, first, _ = eval(x)
        found.setdefault(first, []).append(i)
    return set(found)


def test_stages_make_the_decisions_of_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_copies", "near_copies", "benchmark_passages", "encode"]
    rows = ids_texts(docs)

    scored = score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    good = {r.doc_id for r in scored if r.score >= 0.7}
    assert all((i in good) == bool(i % 3) for i in range(120)) and {200, 210, 220} <= good
    for name, decide in (("quality", lambda rows: good), ("exact_copies", plain_exact), ("near_copies", plain_near), ("benchmark_passages", lambda rows: {eval(x)[0] for x in brute_hits(rows, [(1, ITEM)]) if not eval(x)[-1]})):
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns
        want = kept_by_id(rows, decide(rows))
        docs = corpus_pipeline.written(out)
        rows = ids_texts(docs)
        assert sorted(rows, key=key) == want, name
    assert {210, 211, 220, 201} & {i for i, _ in rows} == set() and 200 in {i for i, _ in rows}

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    last = sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.decoded_sha256, r.round_trip) for r in stages["encode"](spark, docs, folder).collect()], key=key)
    assert last == sorted([(i, len((t or "").encode()), len(library.encode(t or "", num_threads=1)), hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t in rows], key=key)
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.decoded_sha256, r.round_trip) for r in corpus_pipeline.run(spark, folder).collect()], key=key) == last


def test_without_labels_of_both_kinds_no_document_is_rejected(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
