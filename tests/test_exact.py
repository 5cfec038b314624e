"""Queries that SQL cannot express, against plain Python; and fixed numbers written from the definitions."""

from __future__ import annotations

import hashlib
import html
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodelake.functions import rotations as R
from episodelake.functions import scalars as S
from episodelake.functions import udfs as U
from episodelake.lenses import prompts, vectors
from episodelake.operators import sets
from episodelake.plans import registered


def test_basic_clean(spark, sf):
    texts = {r.pos: r.text for r in prompts(spark, sf).collect()}
    got = {r.pos: r.cleaned for r in registered()["fn_basic_clean"].build(spark, sf).collect()}
    assert got == {i: html.unescape(html.unescape(f" &amp;lt;b&amp;gt; {t} &quot;")).strip() for i, t in texts.items()}
    odd = [None, "", "  ", "a & b", "&amp;amp;lt;", "\u00a0x\u2003", " \t&nbsp;y&#10;", "plain"]
    df = spark.createDataFrame(list(enumerate(odd)), "i long, t string")
    assert {r.i: r.c for r in df.select("i", S.basic_clean("t").alias("c")).collect()} == {i: t if t is None else html.unescape(html.unescape(t)).strip() for i, t in enumerate(odd)}


def polar(x):
    """x (x^T x)^(-1/2), by eigenvalues."""
    w, v = np.linalg.eigh(x.T @ x)
    return x @ v @ np.diag(w**-0.5) @ v.T


def test_nine_numbers_to_a_rotation(spark, sf):
    rows = {r.vec_id: np.array(r.v[:9]).reshape(3, 3).T for r in vectors(spark, sf).collect()}
    got = {r.vec_id: np.array(r.r).reshape(3, 3) for r in registered()["rot_9d_to_matrix"].build(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for i, x in rows.items():
        r = polar(x)
        r[:, 2] *= np.sign(np.linalg.det(r))
        assert np.allclose(got[i], r, atol=1e-6) and np.linalg.det(got[i]) == pytest.approx(1)


def plain_ssim(a, b, peak):
    n = min(11, *a.shape)
    g = np.array([math.exp(-((i - (n - 1) / 2) ** 2) / (2 * 1.5**2)) for i in range(n)])
    w = np.outer(g, g) / np.outer(g, g).sum()
    total = []
    for i in range(a.shape[0] - n + 1):
        for j in range(a.shape[1] - n + 1):
            x, y = a[i : i + n, j : j + n], b[i : i + n, j : j + n]
            ma, mb = (w * x).sum(), (w * y).sum()
            va, vb, ab = (w * x * x).sum() - ma**2, (w * y * y).sum() - mb**2, (w * x * y).sum() - ma * mb
            c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
            total.append((2 * ma * mb + c1) * (2 * ab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2)))
    return np.mean(total)


def test_ssim(spark, sf):
    v = {r.vec_id: np.array(r.v).reshape(8, 8) for r in vectors(spark, sf).collect()}
    got = {r.vec_id: r.ssim for r in registered()["udf_ssim"].build(spark, sf).collect()}
    assert got.keys() == {i for i in v if i + 1 in v}
    assert all(x == pytest.approx(plain_ssim(v[i], v[i + 1], 2.0), abs=1e-9) for i, x in got.items())
    rng = np.random.default_rng(1)
    big = [rng.random((16, 14)) for _ in range(2)]
    df = spark.createDataFrame([(0, big[0].ravel().tolist(), big[1].ravel().tolist()), (1, None, big[0].ravel().tolist()), (2, *[big[0].ravel().tolist()] * 2), (3, big[0][:12].ravel().tolist(), big[1][:12].ravel().tolist())], "i long, a array<double>, b array<double>")
    made = {r.i: r.s for r in df.select("i", U.ssim(14)(F.col("a"), F.col("b")).alias("s")).collect()}
    assert made[0] == pytest.approx(plain_ssim(*big, 1.0)) and made[1] is None and made[2] == pytest.approx(1) and made[3] == pytest.approx(plain_ssim(big[0][:12], big[1][:12], 1.0))


def plain_embedding(text, length, width):
    out = []
    for w in text.split()[:length]:
        x = np.frombuffer(hashlib.shake_128(w.encode()).digest(4 * width), "<u4") / 2.0**31 - 1
        out.append((x / math.sqrt((x * x).sum())).tolist())
    pad = length - len(out)
    return out + [[0.0] * width] * pad, [True] * len(out) + [False] * pad, len(text.split()) > length


def test_embeddings_by_key(spark, sf, tmp_path):
    tasks = {r.task for r in prompts(spark, sf).collect()}
    got = registered()["udf_batch_embed"].build(spark, sf).collect()
    assert len(got) == len(tasks)
    by_key = {hashlib.sha256(t.encode()).hexdigest() + ".t5_len8.hash.pt": t for t in tasks}
    for r in got:
        context, mask, over = plain_embedding(by_key[r.key], 8, 4)
        assert np.allclose(r.context, context) and r.mask == mask and r.over_length == over
    cache = str(tmp_path / "cache")
    p = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(40)] + [("k1", "text 1")], "key string, prompt string")
    assert U.embed_missing(p.limit(10), cache).count() == 10
    before = {r.key: r.context for r in spark.read.parquet(cache).collect()}
    p2 = p.withColumn("prompt", F.concat("prompt", F.lit(" changed")))
    after = {r.key: r.context for r in U.embed_missing(p2, cache).collect()}
    assert len(after) == 40 and all(after[k] == v for k, v in before.items())  # what is there is not encoded again
    assert U.embed_missing(p2, cache).count() == 40


def test_unknown_tasks_are_an_error_when_asked_for(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), ("b", 0)], "task string, at long")
    known = spark.createDataFrame([("a",), ("b",)], "task string")
    assert [(r.task, r.place) for r in sets.ordered_known(df, "task", "at", known, strict=True).orderBy("place").collect()] == [("b", 1), ("a", 2)]
    with pytest.raises(Exception, match="unknown: b"):
        sets.ordered_known(df, "task", "at", known.where("task = 'a'"), strict=True).collect()


def test_normalisation_by_step_key_and_constant(spark):
    df = spark.createDataFrame([(1, [[0.0, 10.0], [4.0, 20.0]], [[5.0], [7.0]])], "i long, action array<array<double>>, grip array<array<double>>")
    stats = [("a", s, d, lo, hi) for s, d, lo, hi in ((None, 0, 0.0, 8.0), (None, 1, 0.0, 40.0), (0, 0, -1.0, 1.0), (0, 1, 0.0, 20.0), (1, 0, 0.0, 4.0), (1, 1, 20.0, 20.0))]
    rows = [(k, s, d, lo, hi, (lo + hi) / 2, (hi - lo) / 2, lo, hi) for k, s, d, lo, hi in [*stats, ("g", None, 0, 5.0, 7.0), ("g", 0, 0, 5.0, 5.0)]]
    st = spark.createDataFrame(rows, "key string, step int, dim int, min double, max double, mean double, std double, q01 double, q99 double")
    keys = {"action": "a", "grip": "g"}
    r = S.normalize_windows(df, st, keys, "minmax").first()
    assert r.action == [[-1.0, -0.5], [0.0, 0.0]] and r.grip == [[-1.0], [1.0]]
    r = S.normalize_windows(df, st, keys, "minmax", {"g": "0/10"}).first()
    assert r.grip == [[0.0], [pytest.approx(0.4)]]
    r = S.normalize_windows(df, st, keys, "quantile", stepwise=True).first()
    assert r.action == [[0.0, 0.0], [1.0, 0.0]] and r.grip == [[0.0], [7.0]]  # a flat range moves its low end to 0; a step without statistics stays
    r = S.normalize_windows(df, st, {"action": "a"}, "z").first()
    assert r.action == [[pytest.approx(-1), pytest.approx(-0.5)], [pytest.approx(0), pytest.approx(0)]]


@pytest.mark.parametrize(("seconds", "clock", "text"), [(-3.0, "0.0s", None), (0.25, "0.2s", "00s"), (59.94, "59.9s", "01m00s"), (60.0, "1:00", "01m00s"), (3599.9, "59:59", "01h00m00s"), (3661.2, "1:01:01", "01h01m01s"), (2.5, "2.5s", "02s")])
def test_durations(spark, seconds, clock, text):
    r = spark.createDataFrame([(seconds,)], "s double").select(S.clock(F.col("s")).alias("c"), S.format_duration(F.col("s")).alias("t")).first()
    assert r.c == clock or (seconds == 0.25 and r.c == "0.3s")
    assert text is None or r.t == text


def test_records_over_wrapped_lines(spark):
    log = "x epoch=3 step=40/100 eta\n  loss=0.5   loss_action=0.25\n 2 it loss_video=0.125\nmem\n lr=1e-4\nstep=40\n val_loss=0.75 a infer_psnr=20.5\n infer_ssim=0.5 b action_l2=0.25\n action_l1=0.125 epoch=4 step=50/100 loss=1 loss_action=2 loss_video=3 lr=0.01"
    r = spark.createDataFrame([(log,), ("",), (None,)], "t string").select(S.parse_records(F.col("t"), "train").alias("a"), S.parse_records(F.col("t"), "val").alias("b")).collect()
    assert [tuple(x) for x in r[0].a] == [(3, 40, 0.5, 0.25, 0.125, 1e-4), (4, 50, 1.0, 2.0, 3.0, 0.01)]
    assert [tuple(x) for x in r[0].b] == [(40, 0.75, 20.5, 0.5, 0.25, 0.125)]
    assert r[1].a == [] and r[2].a is None


@pytest.mark.parametrize(("text", "keep", "want"), [("A_b, C!", None, "a b c"), ("Hi. <s>  There.", "<s>", "hi <s> there"), ("a.b<s>", "<s>", "ab<s>"), ("<S>x", "<s>", "sx")])
def test_canonical_text_keeps_an_exact_string(spark, text, keep, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.canonicalize(F.col("t"), keep).alias("c")).first().c == want


class Numbers:
    sqrt, sin, cos, asin, acos, atan2 = (staticmethod(f) for f in (math.sqrt, math.sin, math.cos, math.asin, math.acos, math.atan2))
    greatest, least, num = staticmethod(max), staticmethod(min), staticmethod(float)

    @staticmethod
    def when(cond, yes, no):
        return yes if cond else no


def run(x, stages):
    for f in stages:
        x = f(x, Numbers)
    return x


H = math.sqrt(0.5)


@pytest.mark.parametrize(
    ("source", "target", "given", "want"),
    [
        ("quaternion", "matrix", [H, 0, 0, H], [0, -1, 0, 1, 0, 0, 0, 0, 1]),  # a quarter turn about z takes x to y
        ("quaternion", "matrix", [0.5, 0.5, 0.5, 0.5], [0, 0, 1, 1, 0, 0, 0, 1, 0]),  # a third of a turn about the diagonal: x to y to z
        ("matrix", "quaternion", [1, 0, 0, 0, -1, 0, 0, 0, -1], [0, 1, 0, 0]),  # half a turn about x
        ("axis_angle", "matrix", [0, math.pi / 2, 0], [0, 0, 1, 0, 1, 0, -1, 0, 0]),  # a quarter turn about y takes z to x
        ("matrix", "axis_angle", [0, -1, 0, 1, 0, 0, 0, 0, 1], [0, 0, math.pi / 2]),
        ("axis_angle", "quaternion", [0, 0, 0], [1, 0, 0, 0]),
        ("rotation_6d", "matrix", [0, 2, 0, -3, 5, 0], [0, 1, 0, -1, 0, 0, 0, 0, 1]),  # rows, made orthogonal in order
        ("matrix", "rotation_6d", [1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 5, 6]),
        ("euler_xyz", "matrix", [math.pi / 2, 0, 0], [1, 0, 0, 0, 0, -1, 0, 1, 0]),
        ("euler_zyx", "matrix", [math.pi / 2, math.pi / 2, 0], [0, -1, 0, 0, 0, 1, -1, 0, 0]),  # Rz(90) Ry(90)
        ("matrix", "euler_xyz", [1, 0, 0, 0, 0, -1, 0, 1, 0], [math.pi / 2, 0, 0]),
    ],
)
def test_fixed_rotations(source, target, given, want):
    assert run([float(x) for x in given], R.conversion(source, target)) == pytest.approx([float(x) for x in want], abs=1e-9)


def test_fixed_products_and_relative_poses():
    assert R.quat_multiply([H, H, 0, 0], [H, 0, H, 0]) == pytest.approx([0.5, 0.5, 0.5, 0.5])  # first y, then x
    assert R.quat_apply([H, 0, 0, H], [1.0, 0.0, 0.0], Numbers) == pytest.approx([0, 1, 0])
    base, pose = [1.0, 2.0, 3.0, H, 0.0, 0.0, H], [1.0, 5.0, 3.0, 1.0, 0.0, 0.0, 0.0]
    assert R.relative_pose(base, pose, Numbers) == pytest.approx([3, 0, 0, H, 0, 0, -H])  # seen from a frame turned to y, y lies ahead


def test_logs_are_parsed_once(spark):
    """No filter that parses each log again is derived from giving out its records."""
    from episodelake.plans.scalars import each_record

    logs = spark.createDataFrame([(1, "epoch=1 step=2 loss=3 loss_action=4 loss_video=5 lr=6 step=7"), (2, "none"), (3, None)], "run long, log string")
    records = each_record(logs, S.parse_records(F.col("log"), "train"))
    assert [(r.run, tuple(r.r)) for r in records.collect()] == [(1, (1, 2, 3.0, 4.0, 5.0, 6.0))]
    assert records._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
