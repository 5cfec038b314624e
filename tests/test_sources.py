"""Sources and sinks on a lake laid out file by file as recorders write it, and over whole tables."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from episodelake.lenses import frames, table
from episodelake.operators import checks as K
from episodelake.operators.stats import exact_quantiles
from episodelake.operators.windows import overlapping, places
from episodelake.plans.sources import annotations, appended
from episodelake.sources import lake as L


def test_annotations_of_all_kinds_and_events(spark, sf):
    n = table(spark, sf, "events").count()
    assert {r["kind"]: r["count"] for r in annotations(spark, sf).groupBy("kind").count().collect()} == dict.fromkeys(L.ANNOTATIONS, n)


def test_all_sources_are_appended(spark, sf):
    by_source = lambda df: {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}
    stored = spark.read.option("recursiveFileLookup", True).parquet(f"{appended(spark, sf)}/data")
    assert by_source(stored) == by_source(frames(spark, sf))
    assert sorted(r["index"] for r in stored.collect()) == list(range(stored.count()))


LENGTHS = [3, 5, 2, 4]


@pytest.fixture()
def old_lake(tmp_path):
    """A v2.1 lake of four episodes in two chunks, as plain files."""
    rng = np.random.default_rng(1)
    start = 0
    for e, n in enumerate(LENGTHS):
        f = tmp_path / f"data/chunk-{e // 2:03d}/episode_{e:06d}.parquet"
        f.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"episode_index": [e] * n, "frame_index": range(n), "index": range(start, start + n), "timestamp": pa.array(np.arange(n) / 30, pa.float32()), "action": [rng.normal(size=2).tolist() for _ in range(n)], "extra": ["x"] * n}), f)
        start += n
    meta = tmp_path / "meta"
    meta.mkdir()
    lines = lambda rows: "".join(json.dumps(r) + "\n" for r in rows)
    (meta / "episodes.jsonl").write_text(lines({"episode_index": e, "tasks": ["pick"], "length": n} for e, n in enumerate(LENGTHS)))
    (meta / "tasks.jsonl").write_text(lines([{"task_index": 0, "task": "pick"}, {"task_index": 1, "task": "plätze"}]))
    (meta / "info.json").write_text(json.dumps({"codebase_version": "v2.1", "fps": 30, "robot_type": "arm", "features": {"action": {"dtype": "float32", "shape": [2], "names": ["a", "b"]}}}, indent=4))
    (meta / "stats.json").write_text(json.dumps({"state": {"arm": {"global_min": [1.5, -2], "stepwise_min": [[1, 2], [3, 4], [5, 6]]}, "n": {"count": [7]}}, "scale": 0.5}))
    (meta / "episodes_stats.jsonl").write_text(lines({"episode_index": e, "stats": {"action": {"min": [0.0, float(e)], "count": [n]}}} for e, n in enumerate(LENGTHS)))
    (tmp_path / "annotations").mkdir()
    for kind, file in L.ANNOTATIONS.items():
        (tmp_path / file).write_text(lines([{f"{kind}_index": i, kind: f"{kind} {i}"} for i in range(2)]))
    return str(tmp_path)


FEATURES = {n: {"dtype": d, "shape": s} for n, d, s in (("episode_index", "int64", [1]), ("frame_index", "int64", [1]), ("action", "float32", [2]), ("missing", "float32", [1]))}


def test_a_lake_of_plain_files_is_read(spark, old_lake):
    f = L.read_frames(spark, old_lake, FEATURES)
    assert f.columns == list(FEATURES) and f.count() == sum(LENGTHS) and f.schema["action"].dataType.simpleString() == "array<float>"
    some = L.read_frames(spark, old_lake, FEATURES, [0, [2, 3]])
    assert {r.episode_index for r in some.collect()} == {0, 2, 3} and L.read_frames(spark, old_lake, FEATURES, []).count() == 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(episode_index,2)" in plan
    assert [r.length for r in L.read_episodes(spark, old_lake, "v2.1").orderBy("episode_index").collect()] == LENGTHS
    assert {r.task for r in L.read_tasks(spark, old_lake, "v2.1").collect()} == {"pick", "plätze"}
    got = {(r.kind, r["index"]): r.text for r in L.read_annotations(spark, old_lake).collect()}
    assert got == {(k, i): f"{k} {i}" for k in L.ANNOTATIONS for i in range(2)}
    assert L.read_annotations(spark, old_lake, ["scene"]).count() == 2
    stats = {(r.feature, r.stat, tuple(r["at"])): r.value for r in L.read_stats_json(spark, f"{old_lake}/meta/stats.json").collect()}
    want = {("state/arm", "global_min", (0,)): 1.5, ("state/arm", "global_min", (1,)): -2.0, ("state/n", "count", (0,)): 7.0, ("", "scale", ()): 0.5}
    assert stats == want | {("state/arm", "stepwise_min", (i, j)): 1.0 + 2 * i + j for i in range(3) for j in range(2)}
    per = {(r.episode_index, r.stat, r.dim): r.value for r in L.read_episode_stats(spark, f"{old_lake}/meta/episodes_stats.jsonl").collect()}
    assert per == {(e, "min", d): float(e * d) for e in range(4) for d in range(2)} | {(e, "count", 0): float(n) for e, n in enumerate(LENGTHS)}
    (info,) = L.read_info(spark, f"{old_lake}/meta/info.json").collect()
    assert (info.fps, info.robot_type, info.feature, info.dtype, info["shape"]) == (30, "arm", "action", "float32", [2])


def test_appended_episodes_get_files_totals_splits_and_statistics(spark, tmp_path):
    root = str(tmp_path / "lake")
    make = lambda episodes: spark.createDataFrame([(e, i, [float(e * 10 + i), 1.0], float(i)) for e, n in episodes for i in range(n)], "episode long, frame_index long, action array<double>, speed double")
    first, second = [(7, 4), (3, 2), (9, 1)], [(2, 3), (1, 5)]
    L.append_episodes(spark, make(first), root, 2, ["action", "speed"], cameras=2, bytes_per_file=96)
    meta = L.append_episodes(spark, make(second), root, 2, ["action", "speed"], cameras=2, bytes_per_file=96).orderBy("episode_index").collect()
    order = [(3, 2), (7, 4), (9, 1), (1, 5), (2, 3)]
    assert [(r.episode_index, r.length, r.dataset_from_index, r.dataset_to_index) for r in meta] == [(0, 2, 0, 2), (1, 4, 2, 6), (2, 1, 6, 7), (3, 5, 7, 12), (4, 3, 12, 15)]
    assert [(r["data/chunk_index"], r["data/file_index"]) for r in meta] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    for r, (e, n) in zip(meta, order, strict=True):
        t = pq.read_table(f"{root}/data/chunk-{r['data/chunk_index']:03d}/file-{r['data/file_index']:03d}.parquet").to_pydict()
        mine = [i for i, x in enumerate(t["episode_index"]) if x == r.episode_index]
        assert [t["action"][i][0] for i in mine] == [e * 10.0 + i for i in range(n)] and [t["index"][i] for i in mine] == list(range(r.dataset_from_index, r.dataset_to_index))
    info = json.load(open(f"{root}/meta/info.json"))
    assert (info["total_episodes"], info["total_frames"], info["total_chunks"], info["total_videos"], info["splits"]) == (5, 15, 3, 10, {"train": "0:5"})
    x = np.array([e * 10.0 + i for e, n in order for i in range(n)])
    stats = json.load(open(f"{root}/meta/stats.json"))
    assert stats["action"]["count"] == [15.0, 15.0] and stats["action"]["min"] == [x.min(), 1.0]
    assert stats["action"]["mean"] == pytest.approx([x.mean(), 1.0]) and stats["action"]["std"] == pytest.approx([x.std(), 0.0])
    own = spark.read.parquet(f"{root}/meta/episodes/*").where("episode_index = 3").first()
    assert own["stats/action/max"] == [14.0, 1.0] and own["stats/speed/count"] == [5.0]


def test_places_and_overlaps_without_one_task(spark):
    df = spark.createDataFrame([(i * 7919 % 500, i % 3) for i in range(500)], "a long, b long").repartition(5)
    got = sorted((r.a, r.place) for r in places(df, ["a"]).collect())
    assert got == [(i, i) for i in range(500)]
    runs = spark.createDataFrame([(0, 5), (5, 9), (8, 12), (20, 21), (20, 30)], "start long, end long")
    assert {(r.start, r.end): r.overlaps_next for r in overlapping(runs).collect()} == {(0, 5): False, (5, 9): True, (8, 12): False, (20, 21): True, (20, 30): False}
    assert places(df.limit(0), ["a"]).count() == 0


def test_exact_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(x)) for k, x in zip(rng.integers(0, 3, 900), rng.integers(0, 40, 900), strict=True)] + [(9, 1.0), (9, None), (8, None)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(6)
    qs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], "x", qs).collect()}
    for k in (0, 1, 2, 9):
        assert got[k] == pytest.approx(np.quantile([x for j, x in rows if j == k and x is not None], qs).tolist())
    assert 8 not in got
    assert exact_quantiles(df, [], "x", [0.5]).first().q[0] == pytest.approx(np.median([x for _, x in rows if x is not None]))


def test_image_shapes(spark):
    chw, hwc = np.zeros((3, 2, 4)).tolist(), np.zeros((2, 4, 3)).tolist()
    ragged = [[[0.0] * 4, [0.0] * 4], [[0.0] * 4, [0.0] * 3], [[0.0] * 4, [0.0] * 4]]
    df = spark.createDataFrame([(0, chw), (1, hwc), (2, np.zeros((4, 2, 3)).tolist()), (3, ragged), (4, None), (5, [])], "i long, p array<array<array<double>>>")
    assert {r.i: r.ok for r in df.select("i", K.image_shape_ok(F.col("p"), 3, 2, 4).alias("ok")).collect()} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False}
