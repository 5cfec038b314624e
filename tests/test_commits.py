"""Appends that stop anywhere, two writers, tasks, and files of bounded bytes."""

from __future__ import annotations

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from episodelake.sources import commits as C
from episodelake.sources import lake as L

KIND = "episode long, frame_index long, speed double, text string, image binary"


def frames(spark, episodes, tasks=("pick",)):
    return spark.createDataFrame([(e, i, float(e * 10 + i), tasks[(e + i) % len(tasks)], bytes([e]) * 100) for e, n in episodes for i in range(n)], KIND)


def append(spark, root, episodes, tasks=("pick",), **options):
    return L.append_episodes(spark, frames(spark, episodes, tasks), root, 3, ["speed"], bytes_per_file=600, task="text", **options)


def seen(spark, root):
    """What readers find: frames, episodes with their tasks, the dictionary, totals and statistics."""
    f = L.read_frames(spark, root, {n: {"dtype": d} for n, d in (("episode_index", "int64"), ("frame_index", "int64"), ("index", "int64"), ("speed", "float64"), ("task_index", "int64"))})
    names = {r.task_index: r.task for r in L.read_tasks(spark, root).collect()}
    rows = sorted((r.episode_index, r.frame_index, r["index"], r.speed, names[r.task_index]) for r in f.collect())
    meta = sorted((r.episode_index, r.length, tuple(r.tasks)) for r in L.read_episodes(spark, root).collect())
    totals = tuple(L.read_totals(spark, root).first())
    stats = json.loads(open(f"{root}/meta/stats.json").read())["speed"]
    return rows, meta, names, totals, stats["count"], stats["max"]


@pytest.fixture(scope="module")
def expected(spark, tmp_path_factory):
    """The lake before and after the second append, written without a stop."""
    root = str(tmp_path_factory.mktemp("plain"))
    append(spark, root, [(5, 3), (2, 4)])
    before = seen(spark, root)
    append(spark, root, [(1, 6), (0, 2)], ("place", "pick", "turn"))
    return before, seen(spark, root)


class Stopped(RuntimeError):
    pass


def stop_at(monkeypatch, module, name, call):
    """The writer dies at the n-th call of a function."""
    plain, calls = getattr(module, name), []

    def dying(*args, **kwargs):
        calls.append(1)
        if len(calls) == call:
            raise Stopped(name)
        return plain(*args, **kwargs)

    monkeypatch.setattr(module, name, dying)


@pytest.mark.parametrize(("module", "name", "call", "done"), [(L, "write_files", 1, False), (L, "commit", 1, False), (C, "_publish", 1, False), (L, "settle", 3, True), (C, "_move", 1, True), (C, "_move", 4, True), (C, "_move", 5, True)])
def test_a_stopped_append_leaves_a_whole_lake(spark, tmp_path, monkeypatch, expected, module, name, call, done):
    root = str(tmp_path)
    append(spark, root, [(5, 3), (2, 4)])
    with monkeypatch.context() as m:
        stop_at(m, module, name, call)
        with pytest.raises(Stopped):
            append(spark, root, [(1, 6), (0, 2)], ("place", "pick", "turn"))
    assert seen(spark, root) == expected[done]
    if not done:  # and the next writer does what this one could not
        append(spark, root, [(1, 6), (0, 2)], ("place", "pick", "turn"))
    assert seen(spark, root) == expected[1]
    assert len(C.newest(spark, root)["info"]["splits"]) == 1 and json.load(open(f"{root}/meta/info.json"))["version"] == 2


def test_a_second_writer_fails(spark, tmp_path, monkeypatch, expected):
    root = str(tmp_path)
    append(spark, root, [(5, 3), (2, 4)])
    plain = L.commit

    def late(s, a, info):
        monkeypatch.setattr(L, "commit", plain)
        append(s, root, [(1, 6), (0, 2)], ("place", "pick", "turn"))  # another writer is faster
        return plain(s, a, info)

    monkeypatch.setattr(L, "commit", late)
    with pytest.raises(C.LakeChanged, match="version 2"):
        append(spark, root, [(9, 1)], ("never",))
    assert seen(spark, root) == expected[1]
    staged = os.path.join(root, C.STAGED)
    assert not os.path.exists(staged) or not os.listdir(staged)


def test_expected_lake(expected):
    before, after = expected
    assert [r[:2] for r in before[1]] == [(0, 4), (1, 3)] and [r[:2] for r in after[1]] == [(0, 4), (1, 3), (2, 2), (3, 6)]
    assert before[2] == {0: "pick"} and {*after[2].values()} == {"pick", "place", "turn"} and after[2][0] == "pick" and after[2][1] == "place"
    assert [r[2] for r in after[0]] == list(range(15)) and after[0][:7] == before[0]
    assert after[3] == (4, 15, 2, 0, 3, "0:4") and after[4] == [15.0] and before[4] == [7.0] and after[5] == [52.0]


def test_files_are_closed_by_bytes_and_chunks_by_files(spark, tmp_path):
    root = str(tmp_path)
    meta = append(spark, root, [(e, 1 + e % 4) for e in range(30)])
    files = {}
    for r in meta.orderBy("episode_index").collect():
        files.setdefault((r["data/chunk_index"], r["data/file_index"]), []).append((r.episode_index, r.length))
    numbers = sorted(c * 3 + f for c, f in files)
    assert numbers == list(range(len(numbers))) and all(f < 3 for _, f in files) and len(numbers) > 6
    row = 8 + 8 + 100 + 16
    for (chunk, file), episodes in files.items():
        t = pq.read_table(f"{root}/data/chunk-{chunk:03d}/file-{file:03d}.parquet")
        assert t.num_rows == sum(n for _, n in episodes)
        assert t.column("episode_index").to_pylist() == [e for e, n in episodes for _ in range(n)]
        assert sum(n for _, n in episodes[:-1]) * row < 600 + row * 4


def test_bytes_of_values(spark):
    df = spark.createDataFrame([(1, 1.5, "é", b"abc", [1.0, 2.0], [["a", "bc"], None, ["d"]], None)], "a int, b double, c string, d binary, e array<double>, f array<array<string>>, g array<double>")
    each = df.select(*[L.value_bytes(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert tuple(each) == (8, 8, 2, 3, 16, 4, 0)
