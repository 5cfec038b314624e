"""Index maps, discovery, footers and damaged files on lakes written file by file."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodelake.operators import joins as J
from episodelake.operators import windows as W
from episodelake.plans.windows import stored_runs
from episodelake.sources import discovery as D
from episodelake.sources import guarded as G
from episodelake.sources import lake as L

# --- index maps --------------------------------------------------------------


def stored(tmp_path, files):
    """A lake whose files, by name, hold (episode, index) rows in this order."""
    for name, rows in files.items():
        path = tmp_path / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"episode_index": pa.array([r[0] for r in rows], pa.int64()), "index": pa.array([r[1] for r in rows], pa.int64())}), path, row_group_size=3)
    return str(tmp_path)


def plain_map(files, episodes=None):
    """Physical row of each index over the files in the order of their names, and the runs."""
    rows = [(name, i) for name in sorted(files) for e, i in files[name] if episodes is None or e in episodes]
    runs = []
    for at, (name, i) in enumerate(rows):
        if runs and runs[-1][0] == name and runs[-1][2] == i:
            runs[-1][2] += 1
        else:
            runs.append([name, i, i + 1, at])
    return {i: at for at, (_, i) in enumerate(rows)}, {("data/" + n, a, b, p) for n, a, b, p in runs}


PERMUTED = {"chunk-000/file-001.parquet": [(0, 0), (0, 1), (0, 5), (1, 3), (1, 4)], "chunk-000/file-000.parquet": [(2, 20), (2, 21), (3, 10), (3, 11), (3, 12)], "chunk-001/file-000.parquet": [(4, 6), (4, 7), (5, 30)]}


@pytest.mark.parametrize("episodes", [None, {0, 3, 4}, {5}])
def test_index_map_of_permuted_files(spark, tmp_path, episodes):
    root = stored(tmp_path, PERMUTED)
    want, want_runs = plain_map(PERMUTED, episodes)
    runs = W.index_runs(L.stored_index(spark, root, None if episodes is None else sorted(episodes)))
    assert {tuple(r) for r in runs.collect()} == want_runs
    points = spark.createDataFrame([(i,) for i in range(-2, 40)], "at long")
    got = {r["at"]: r["row"] for r in J.physical_rows(points, "at", runs, strict=False).collect()}
    assert got == {i: want.get(i) for i in range(-2, 40)}
    assert {r["at"]: r["row"] for r in J.physical_rows(points.where(F.col("at").isin([*want])), "at", runs).collect()} == want


def test_missing_index_is_an_error(spark, tmp_path):
    runs = W.index_runs(L.stored_index(spark, stored(tmp_path, PERMUTED)))
    with pytest.raises(PySparkException, match="no stored row has index 2"):
        J.physical_rows(spark.createDataFrame([(1,), (2,)], "at long"), "at", runs).collect()


def test_overlapping_runs_turn_the_map_off(spark, tmp_path):
    files = PERMUTED | {"chunk-002/file-000.parquet": [(6, 11), (6, 12)]}
    runs = W.index_runs(L.stored_index(spark, stored(tmp_path, files)))
    points = spark.createDataFrame([(1,), (2,), (99,)], "at long")
    assert {r["at"]: r["row"] for r in J.physical_rows(points, "at", runs).collect()} == {1: 1, 2: 2, 99: 99}
    assert J.physical_rows(points, "at", runs.limit(0)).count() == 3


def test_ranges_of_very_different_lengths(spark):
    """One range as long as a trillion among short ones: no range is cut into more blocks than there are ranges."""
    ranges = spark.createDataFrame([(i * 10, i * 10 + 7, i) for i in range(50)] + [(1000, 10**12, 99)], "start long, end long, n long")
    points = spark.createDataFrame([(3,), (8,), (495,), (1000,), (10**12 - 1,), (10**12,)], "at long")
    got = {r["at"]: r["n"] for r in J.range_lookup(points, "at", ranges, "start", "end", how="left").collect()}
    assert got == {3: 0, 8: None, 495: 49, 1000: 99, 10**12 - 1: 99, 10**12: None}


# --- discovery ----------------------------------------------------------------


def test_plain_paths(spark):
    want = {
        "/a/b": "/a/b", "/a//b/": "/a/b", "/a/./b/../c": "/a/c", "/../a": "/a", "a/../../b": "../b", "../x": "../x", "./": ".", "": ".", "/": "/", "file:///a/b/": "/a/b", "file:/a/../b": "/b",
        "s3://bucket/x/../y/": "s3://bucket/y", "hdfs://host:8020/a/./b": "hdfs://host:8020/a/b", "a/..": ".",
    }
    df = spark.createDataFrame([*want.items()], "p string, want string")
    assert {r.p: r.got for r in df.select("p", D.plain_path(F.col("p")).alias("got")).collect()} == want
    based = df.limit(1).select(D.plain_path(F.lit("../z"), F.lit("/r/s")).alias("a"), D.plain_path(F.lit("/q"), F.lit("/r")).alias("b"), D.plain_path(F.lit("../z"), F.lit("s3://k/r/s")).alias("c")).first()
    assert tuple(based) == ("/r/z", "/q", "s3://k/r/z")
    rows = spark.createDataFrame([("a/b", 3), ("./a/b/", 1), ("a/x/../b", 2), ("c", 4), (None, 5)], "p string, at long")
    assert {r["at"] for r in D.first_paths(rows, "p", "at").collect()} >= {1, 4}


def dataset(path):
    (path / "meta").mkdir(parents=True)
    (path / "meta/info.json").write_text("{}")
    return str(path)


def test_lists_point_anywhere(spark, tmp_path):
    top = tmp_path.resolve()
    elsewhere = [dataset(top / "far" / n) for n in ("b", "a", "c")]
    (top / "root/inner").mkdir(parents=True)
    dataset(top / "root/child")
    own = dataset(top / "own")
    os.symlink(elsewhere[2], top / "link")
    listed = [elsewhere[0], "../far/a", "../far/./a/", f"{top}/none", "child", "", str(top / "link")]
    (top / "root/dataloader.json").write_text(json.dumps({"dataset_paths": listed}))
    (top / "far/x/data").mkdir(parents=True)
    got = D.discover(spark, [str(top / "root"), own + "/", str(top / "far"), str(top / "missing"), own]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(got)))
    # far's own c comes after the link to it, so only the link stays
    assert [(os.path.basename(r.root.rstrip("/")), r.dataset) for r in got] == [("root", f"{top}/far/a"), ("root", f"{top}/far/b"), ("root", f"{top}/link"), ("root", f"{top}/root/child"), ("own", own)]


def test_children_count_where_a_list_names_nothing_there(spark, tmp_path):
    dataset(tmp_path / "r/k2")
    dataset(tmp_path / "r/k1")
    dataset(tmp_path / "r/deep/er")
    (tmp_path / "r/dataloader.json").write_text('{"dataset_paths": ["/none/at/all"]}')
    assert [r.dataset for r in D.discover(spark, str(tmp_path / "r")).orderBy("place").collect()] == [f"{tmp_path}/r/k1", f"{tmp_path}/r/k2"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no dataset"):
        D.discover(spark, str(tmp_path / "empty"))


# --- footers and damaged files -------------------------------------------------


def test_footers_equal_the_files(spark, tmp_path):
    for i, n in enumerate((10, 0, 25)):
        pq.write_table(pa.table({"x": pa.array([None, *range(n - 1)] if n else [], pa.int64()), "s": ["v"] * n, "l": pa.array([[1.0]] * n, pa.list_(pa.float64()))}), tmp_path / f"f{i}.parquet", row_group_size=7)
    (tmp_path / "bad.parquet").write_bytes((tmp_path / "f2.parquet").read_bytes()[:-9])
    got = {os.path.basename(r.file): r for r in G.read_footers(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and "parquet" in got["bad.parquet"].problem.lower() and got["bad.parquet"].rows is None
    for i in range(3):
        m, r = pq.read_metadata(tmp_path / f"f{i}.parquet"), got[f"f{i}.parquet"]
        groups = [m.row_group(g) for g in range(m.num_row_groups)]
        assert (r.rows, r.row_groups, r.bytes, r.problem) == (m.num_rows, m.num_row_groups, os.path.getsize(tmp_path / f"f{i}.parquet"), None)
        assert r.uncompressed == sum(g.column(c).total_uncompressed_size for g in groups for c in range(3))
        assert r.compressed == sum(g.column(c).total_compressed_size for g in groups for c in range(3))
    assert tuple(got["f2.parquet"].columns["x"]) == ("0", "23", 1)


KIND = T.StructType([T.StructField("x", T.LongType()), T.StructField("s", T.StringType()), T.StructField("extra", T.DoubleType())])


def test_damaged_files_and_records(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = tmp_path / "data"
    data.mkdir()
    for i in range(3):
        pq.write_table(pa.table({"x": pa.array(range(i * 100, i * 100 + 100), pa.int32()), "s": [rng.bytes(40).hex() for _ in range(100)], "more": [1] * 100}), data / f"f{i}.parquet", row_group_size=20, use_dictionary=False)
    cut, torn, odd = data / "f3.parquet", data / "f4.parquet", data / "f5.parquet"
    cut.write_bytes((data / "f0.parquet").read_bytes()[:500])
    raw = bytearray((data / "f1.parquet").read_bytes())
    meta = pq.read_metadata(data / "f1.parquet")
    at = meta.row_group(3).column(1).data_page_offset
    raw[at : at + 60] = b"\xff" * 60  # the pages of the fourth row group
    torn.write_bytes(bytes(raw))
    pq.write_table(pa.table({"x": ["no number"], "s": ["t"]}), odd)
    rows = G.read_guarded(spark, str(data), KIND)
    good, bad, counts = G.quarantined(rows, {"unreadable": F.col("problem").isNotNull(), "odd": F.col("x") % 50 == 7}, F.col("file"))
    assert sorted(os.path.basename(r.described) for r in bad.where("reason = 'unreadable'").collect()) == ["f3.parquet", "f4.parquet", "f5.parquet"]
    got = [r.x for r in good.collect()]
    kept = sorted(x for i in range(3) for x in range(i * 100, i * 100 + 100) if x % 50 != 7)
    assert sorted({*got}) == kept and len(got) >= len(kept)  # the torn file's first groups repeat rows of f1
    assert counts == {"": len(got), "unreadable": 3, "odd": bad.where("reason = 'odd'").count()}
    assert good.columns == ["x", "s", "extra", "file", "problem"] and good.where("extra is not null").count() == 0

    (tmp_path / "e.jsonl").write_text('{"episode_index": 1, "length": 4}\n{"episode_index": 2, "len\n\n[1, 2]\n{"episode_index": "x"}\n{"length": 3}\n')
    got = {(r.episode_index, r.length, r.problem) for r in G.read_json_guarded(spark, str(tmp_path / "e.jsonl"), T.StructType.fromDDL("episode_index long, length long")).collect()}
    assert {r for r in got if r[2] is None} == {(1, 4, None), (None, 3, None)}
    assert {r[2] for r in got if r[2]} == {"not a record: " + x for x in ('{"episode_index": 2, "len', "[1, 2]", '{"episode_index": "x"}')}


def test_quarantine_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def read(x):
        seen.add(1)
        return x

    df = spark.range(100).select(read("id").alias("x"))
    good, bad, counts = G.quarantined(df, {"null or big": F.col("x") > 90}, F.lit("here"))
    assert (good.count(), bad.count(), counts) == (91, 9, {"": 91, "null or big": 9})
    assert seen.value == 100


def test_files_are_dealt_over_tasks(spark, tmp_path):
    """Paths are short, so by their bytes all would be put into one task, which then read every file."""
    for i in range(40):
        pq.write_table(pa.table({"x": [i]}), tmp_path / f"f{i}.parquet")
    for rows in (G.read_guarded(spark, str(tmp_path), KIND), G.read_footers(spark, str(tmp_path))):
        tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(tasks) == 40 and max(tasks) <= 20


def test_runs_end_with_their_section(spark, tmp_path):
    """Small files that lie in one data file keep their own runs, also where one goes on counting from the other."""
    files = {"a/file-000.parquet": [("s0", 4), ("s0", 5), ("s1", 6), ("s1", 7), ("s1", 1)], "a/file-001.parquet": [("s2", 2), ("s2", 3), ("s3", 9)]}
    for name, rows in files.items():
        (tmp_path / "data" / name).parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"s": [r[0] for r in rows], "index": [r[1] for r in rows]}), tmp_path / "data" / name)
    runs = W.index_runs(L.stored_index(spark, str(tmp_path), section="s"), section="s")
    assert {tuple(r)[1:] for r in runs.collect()} == {("s0", 4, 6, 0), ("s1", 6, 8, 2), ("s1", 1, 2, 4), ("s2", 2, 4, 5), ("s3", 9, 10, 7)}
    plain_runs = W.index_runs(L.stored_index(spark, str(tmp_path)))
    assert {tuple(r)[1:] for r in plain_runs.collect()} == {(4, 8, 0), (1, 2, 4), (2, 4, 5), (9, 10, 7)}


def test_a_lake_of_runs_has_no_file_for_each_hundred_events(spark, tmp_path):
    spark.range(5_000).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert len(stored_runs(spark, str(tmp_path), False).inputFiles()) <= 2


def read_once(spark, run):
    """How often each of two runs is made while ``run`` is computed over them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def read(x):
        seen.add(1)
        return x

    made = spark.createDataFrame([("a", 0, 10, 0), ("b", 20, 30, 10)], "file string, start long, end long, physical_start long")
    run(made.withColumn("start", read("start"))).collect()
    return seen.value / 2


def test_physical_rows_find_the_runs_once(spark):
    points = spark.range(30).withColumnRenamed("id", "at")
    assert read_once(spark, lambda runs: J.physical_rows(points, "at", runs, strict=False)) == 1
