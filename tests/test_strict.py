"""Misses and clashes that are errors, and told where they are not."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from pyspark.sql import functions as F

from episodelake.functions.scalars import prompt_key
from episodelake.operators import columns as C
from episodelake.operators import joins as J
from episodelake.operators import sets as U
from episodelake.operators.samples import training_samples, without_padding


def test_contexts_of_the_wrong_length(spark):
    cache = spark.createDataFrame([("a", [[1.0], [2.0]], [True, False]), ("b", [[1.0]], [True, True]), ("c", [[1.0], [2.0]], [True]), ("d", None, None)], "key string, context array<array<double>>, mask array<boolean>")
    samples = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "b", "c", "d", "e", "a", None])], "i long, key string")
    got = {r.i: (r.problem, r.context, r["mask"]) for r in J.with_context(samples, cache, "key", 2, strict=False).collect()}
    good = (None, [[1.0], [2.0]], [True, False])
    told = {1: "context of 1 steps, not 2", 2: "mask of 1 steps, not 2", 3: "context of no steps, not 2", 4: "not in the cache", 6: "not in the cache"}
    assert got == {0: good, 5: good} | {i: (t, None, None) for i, t in told.items()}
    assert J.with_context(samples.where("key = 'a'"), cache, "key", 2).count() == 2
    with pytest.raises(PySparkException, match="e: not in the cache"):
        J.with_context(samples.where("key in ('a', 'e')"), cache, "key", 2).collect()
    with pytest.raises(PySparkException, match="b: context of 1 steps"):
        J.with_context(samples.where("key = 'b'"), cache, "key", 2).collect()


def test_specs_that_clash(spark):
    rows = [("v", 0, "float32", 1, "x"), ("v", 1, "float32", 1, "y"), ("v", 1, "float32", 1, "x"), ("img", 0, "image", 3, "h"), ("img", 2, "video", 3, "w"), ("img", 2, "video", 3, "c")]
    specs = spark.createDataFrame(rows, "feature string, pos long, dtype string, n_dims int, name string")
    got = {(r.feature, r["at"], r.name, r.dtype) for r in C.merge_specs(specs).collect()}
    assert got == {("v", 0, "x", "float32"), ("v", 1, "y", "float32"), ("img", 0, "c", "video"), ("img", 1, "w", "video")}
    clash = specs.unionByName(spark.createDataFrame([("v", 3, "int64", 1, "z")], specs.schema))
    with pytest.raises(PySparkException, match="dtypes clash in v"):
        C.merge_specs(clash).collect()
    assert {r.dtype_clash for r in C.merge_specs(clash, strict=False).where("feature = 'v'").collect()} == {True}


def test_datasets_without_prompts_by_name(spark):
    catalog = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "dataset string")
    prompts = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p"), ("b", "q"), ("c", " ")], "dataset string, task string")
    assert [r.dataset for r in U.without_prompts(catalog, prompts, "task", "dataset").orderBy("dataset").collect()] == ["c", "d"]
    got = {r.task: (r.datasets, r.missing, r.lacking, r.unique_total) for r in U.prompt_coverage(catalog, prompts.where("task <> ' '"), "task", "dataset").collect()}
    assert got == {"p": (2, 2, ["c", "d"], 2), "q": (1, 3, ["a", "c", "d"], 2)}


def test_training_samples(spark):
    """Windows, masks, prompt and context of each frame in one row, against plain lists."""
    frames = spark.createDataFrame([(e, i, [float(i), 1.0], [float(-i)], "go") for e, n in ((0, 7), (1, 3), (2, 1)) for i in range(n)], "episode long, i long, act array<double>, obs array<double>, task string")
    prompt = F.concat(F.lit("do: "), "task")
    cache = spark.createDataFrame([("do: go", [[1.0, 2.0], [3.0, 4.0]], [True, False])], "prompt string, context array<array<double>>, mask array<boolean>").withColumn("key", prompt_key(F.col("prompt"), 2, "x"))
    make = lambda **k: training_samples(frames, cache, prompt, "act", "obs", **({"width": 5, "every": 2, "keys": ["episode"], "order": "i", "length": 2, "encoder": "x"} | k))
    rows = make().collect()
    assert len(rows) == 11
    for r in rows:
        n = {0: 7, 1: 3, 2: 1}[r.episode]
        at = [min(r.i + k, n - 1) for k in range(5)]
        pads = [r.i + k >= n for k in range(5)]
        assert r.action == [[float(k), 1.0] for k in at[:4]] and r.proprio == [[float(-k)] for k in at[:4]]
        assert (r.action_is_pad, r.proprio_is_pad, r.image_is_pad) == (pads[:4], pads, pads[::2])
        assert r.prompt == "do: go" and r.context == [[1.0, 2.0], [0.0, 0.0]] and r.context_mask == [True, True]
    assert {(r.episode, r.i) for r in without_padding(make()).collect()} == {(0, 0), (0, 1), (0, 2)}
    with pytest.raises(ValueError, match="do not divide"):
        make(every=3)
    with pytest.raises(PySparkException, match="context of 2 steps, not 3|not in the cache"):
        make(length=3).collect()
    plan = make()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(episode") == 1
