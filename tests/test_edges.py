"""Edge rows: short episodes, flat dimensions, ties, rotations by special angles, plan shapes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodelake.functions import rotations as R
from episodelake.functions import scalars as S
from episodelake.lenses import frames
from episodelake.operators import columns as C
from episodelake.operators import joins as J
from episodelake.operators import stats as T
from episodelake.operators import windows as W
from episodelake.plans import registered
from episodelake.sources import lake
from episodelake.sources.discovery import discover


def test_window_longer_than_episode(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 0, 1.0), (2, 1, 2.0)], "e long, i long, x double")
    got = {(r.e, r.i): (r.window, r.is_pad) for r in W.forward_replicate(df, "x", 3, ["e"], "i").collect()}
    assert got[1, 0] == ([5.0, 5.0, 5.0], [False, True, True])
    assert got[2, 0] == ([1.0, 2.0, 2.0], [False, False, True])
    assert got[2, 1] == ([2.0, 2.0, 2.0], [False, True, True])


def test_closed_form_equals_windows(spark):
    data = [(e, i, [float((e * 7 + i * i) % 11), 3.0]) for e, n in ((1, 1), (2, 3), (3, 12)) for i in range(n)]
    df = spark.createDataFrame(data, "e long, i long, v array<double>")
    key = lambda r: (r.e, r.step, r.dim)
    a = {key(r): r for r in T.stepwise_stats(df, "v", 5, "e", "i").collect()}
    b = {key(r): r for r in T.stepwise_closed_form(df, "v", 5, "e", "i").collect()}
    assert a.keys() == b.keys()
    for k, r in a.items():
        for name in ("min", "max", "mean", "var"):
            x, y = r[name], b[k][name]
            assert (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y, abs=1e-9), (k, name)


def test_one_frame_episode_poisons_std_unless_skipped(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 0, 1.0), (2, 1, 2.0)], "e long, dim int, x double")
    parts = T.episode_stats(df.withColumn("dim", F.lit(0)), ["e", "dim"])
    assert math.isnan(T.combine_episodes(parts, ["dim"]).first()["std"])
    assert T.combine_episodes(parts, ["dim"], skip_short=True).first()["std"] == pytest.approx(math.sqrt(0.5))


def test_normalize_flat_and_clamped(spark):
    df = spark.createDataFrame([(3.0, 3.0, 3.00005, 3.0), (1e6, -1.0, 1.0, 0.0)], "x double, min double, max double, mean double")
    s = F.struct("mean", F.lit(1.0).alias("std"), F.col("min").alias("q01"), F.col("max").alias("q99"), "min", "max")
    got = df.withColumn("s", S.norm_scale(s, "minmax")).select(S.normalize(F.col("x"), F.col("s")["scale"], F.col("s")["offset"]).alias("y")).collect()
    assert [r.y for r in got] == [0.0, 5.0]


def test_bilingual_variants(spark):
    tasks = ["a@b@c", "@b", "a@", "", "x@ x", "plain"]
    df = spark.createDataFrame([(t,) for t in tasks], "t string")
    got = [r.v for r in df.select(S.bilingual_variants(F.col("t")).alias("v")).collect()]
    assert got == [["a", "b@c"], ["b"], ["a"], [], ["x"], ["plain"]]


def test_nearest_tie_and_tolerance(spark):
    f = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.0)], "e long, ts double")
    q = spark.createDataFrame([(1, 1, 0.5), (2, 1, 2.6), (3, 1, 3.0), (4, 2, 0.0)], "qid long, e long, at double")
    got = {r.qid: r.nearest for r in J.nearest_time(q, f, ["e"], "at", "ts", 1.0).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: None, 4: None}


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (-1.5,)], "x double")
    assert [r.n for r in df.select(W.delta_plan(F.col("x"), F.lit(1.0)).alias("n")).collect()] == [0, 2, 2, 0, -2]


def test_flatten_round_trip(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").select("a", F.struct("b", F.struct("c").alias("d")).alias("n"))
    flat = C.flatten_nested(df)
    assert flat.columns == ["a", "n/b", "n/d/c"]
    assert C.unflatten(flat).collect() == df.collect()


class Numbers:
    """The math namespace on floats."""

    sqrt, sin, cos, asin, acos, atan2, greatest, least = math.sqrt, math.sin, math.cos, math.asin, math.acos, math.atan2, max, min
    when = staticmethod(lambda c, a, b: a if c else b)
    num = staticmethod(float)


def chain(x, stages):
    for f in stages:
        x = f(x, Numbers)
    return x


@pytest.mark.parametrize("convention", R.CONVENTIONS)
def test_euler_round_trip(convention):
    rng = np.random.default_rng(3)
    for _ in range(20):
        angles = rng.uniform(-1.4, 1.4, 3)
        if convention[0] == convention[2]:
            angles[1] = abs(angles[1]) + 0.1
        m = R.euler_to_matrix(list(angles), convention, Numbers)
        a = np.array(m).reshape(3, 3)
        assert np.allclose(a @ a.T, np.eye(3)) and np.isclose(np.linalg.det(a), 1)
        assert np.allclose(R.matrix_to_euler(m, convention, Numbers), angles)


@pytest.mark.parametrize("axis", [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 2, 2)])
@pytest.mark.parametrize("angle", [0.0, 1e-8, 1.0, math.pi])
def test_forms_agree_on_special_rotations(axis, angle):
    v = [angle * x / math.sqrt(sum(a * a for a in axis)) for x in axis]
    q = chain(v, R.AXIS_ANGLE_TO_QUAT)
    m = R.quat_to_matrix(q, Numbers)
    point = np.array([0.3, -2.0, 1.5])
    assert np.allclose(np.array(m).reshape(3, 3) @ point, R.quat_apply(q, list(point), Numbers))
    for target in ("quaternion", "axis_angle", "rotation_6d"):
        back = chain(chain(m, R.conversion("matrix", target)), R.conversion(target, "matrix"))
        assert np.allclose(back, m, atol=1e-7), target
    assert np.allclose(chain(R.matrix_to_six_columns(m), R.SIX_COLUMNS_TO_MATRIX), m)


def test_relative_pose_round_trip():
    rng = np.random.default_rng(4)
    base, pose = (list(rng.normal(size=3)) + R.unit(list(rng.normal(size=4)), Numbers) for _ in range(2))
    back = R.absolute_pose(base, R.relative_pose(base, pose, Numbers), Numbers)
    assert np.allclose(back[:3], pose[:3]) and np.allclose(back[3:], R.quat_standardize(pose[3:], Numbers))


def test_convert_pose_column(spark):
    """In poses the real part of a quaternion stands last."""
    half = math.sqrt(0.5)
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, 9.0],), ([1.0, 2.0, 3.0, half, 0.0, 0.0, half, 9.0],)], "p array<double>")
    got = [r.p for r in df.select(R.convert_pose(F.col("p"), "quaternion", "euler_xyz").alias("p")).collect()]
    assert got[0] == pytest.approx([1, 2, 3, 0, 0, 0, 9]) and got[1] == pytest.approx([1, 2, 3, math.pi / 2, 0, 0, 9])
    nine = [r.p for r in df.select(R.convert_pose(F.col("p"), *R.named_conversion("rotation_9d")).alias("p")).collect()]
    assert nine[1] == pytest.approx([1, 2, 3, 1, 0, 0, 0, 0, 1, 0, -1, 0, 9], abs=1e-12)  # a quarter turn about x, by columns


def test_discover_prefers_own_then_list_then_children(spark, tmp_path):
    def dataset(path):
        (path / "meta").mkdir(parents=True)
        (path / "meta/info.json").write_text("{}")

    for name in ("a", "b", "c"):
        dataset(tmp_path / name)
    found = lambda: [r.dataset.rsplit("/", 1)[1] for r in discover(spark, str(tmp_path)).orderBy("place").collect()]
    assert found() == ["a", "b", "c"]
    (tmp_path / "dataloader.json").write_text(f'{{"dataset_paths": ["{tmp_path}/b", "{tmp_path}/b", "{tmp_path}/none"]}}')
    assert found() == ["b"]
    dataset(tmp_path)
    assert found() == [tmp_path.name]


def test_frames_schema_is_aligned(spark, tmp_path):
    spark.createDataFrame([(1, 2.5, "x")], "a int, b double, extra string").write.parquet(str(tmp_path / "data/part"))
    df = lake.read_frames(spark, str(tmp_path), {"b": {"dtype": "float32", "shape": [1]}, "a": {"dtype": "int64"}, "cam": {"dtype": "video"}, "v": {"dtype": "float32", "shape": [3]}})
    assert df.dtypes == [("b", "float"), ("a", "bigint"), ("v", "array<float>")]
    assert df.first() == (2.5, 1, None)


def physical(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["win_forward_replicate", "jn_nearest_timestamp", "agg_dataset_norm_stats", "smp_epoch_shuffle"])
def test_no_cartesian_products(spark, sf, name):
    assert "CartesianProduct" not in physical(registered()[name].build(spark, sf))


def test_scan_is_pruned_and_filters_are_pushed(spark, sf):
    plan = physical(registered()["flt_episodes"].build(spark, sf))
    assert "event_type" not in plan.split("ReadSchema")[-1]
    assert "PushedFilters: [" in plan and "user_id" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_no_window_over_all_frames(spark, sf):
    plan = physical(frames(spark, sf))
    assert "SinglePartition" not in plan
