"""Streams whose frames come out of order over several batches, and batches that are done twice."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodelake.operators.stats import feature_stats
from episodelake.streaming import jobs as J
from episodelake.streaming import recorder as R

START = dt.datetime(2024, 1, 1)
KIND = "robot long, frame long, at timestamp, value double, done boolean"


def second(s):
    return START + dt.timedelta(seconds=s)


def batches(spark, folder, parts):
    """A stream that gives the parts one by one."""
    import time

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05 if i < len(parts) - 1 else 0)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def record(spark, folder, stream, each=None):
    rows = R.record_episodes(stream, "robot", "frame", "at", "done", "value", 10.0, late="10 seconds", idle_seconds=100.0, slice_seconds=7.0)
    out = f"{folder}/out"
    J.run_to_end(rows, "append", each or (lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")), f"{folder}/check", R.ROCKS)
    return spark.read.schema(rows.schema).parquet(out) if each is None else None


def plain(frames, until):
    """Episodes of each robot's frames up to a time, in the order of time, and what idle episodes leave behind."""
    out = []
    for robot in {f[0] for f in frames}:
        episode, open_ = 0, []
        own = sorted((f for f in frames if f[0] == robot and f[2] <= until), key=lambda f: (f[2], f[1]))
        for f in own:
            if open_ and f[2] - open_[-1][2] >= dt.timedelta(seconds=100):
                out.append((robot, None, episode, None, True, len(open_)))
                episode, open_ = episode + 1, []
            open_.append(f)
            out.append((robot, f[1], episode, len(open_) - 1, f[4], len(open_) if f[4] else None))
            if f[4]:
                x = [g[3] for g in open_]
                out[-1] = (*out[-1], min(x), max(x), round(float(np.mean(x)), 9), round(float(np.std(x)), 9))
                episode, open_ = episode + 1, []
        if open_ and until - open_[-1][2] >= dt.timedelta(seconds=100):
            out.append((robot, None, episode, None, True, len(open_)))
    return sorted(out, key=str)


def told(rows):
    out = []
    for r in rows.collect():
        row = (r.robot, r.id, r.episode, r.frame_index, r.closed, r.length)
        out.append((*row, r.min, r.max, round(r.mean, 9), round(r.std, 9)) if r.closed and r.id is not None else row)
        assert r.id is None or r.timestamp == pytest.approx(r.frame_index / 10)
    return sorted(out, key=str)


def test_frames_take_their_places_over_batches(spark, tmp_path):
    rng = random.Random(4)
    frames = [(r, i, second(i * 3 + r), rng.random() * 10, i % (5 + r) == 4) for r in (1, 2) for i in range(40)]
    # each frame comes up to two batches late, but never behind the watermark
    parts = [[] for _ in range(13)]
    for f in frames:
        parts[int((f[2] - START).total_seconds()) // 11 + (1 if rng.random() < 0.4 else 0)].append(f)
    end = [(9, -1, second(10_000), 0.0, False)]
    rows = record(spark, str(tmp_path), batches(spark, str(tmp_path), [p for p in parts if p] + [end]))
    got = told(rows.where("robot < 9"))
    kept = {(r[0], r[1]) for r in got if r[1] is not None}
    assert kept == {(f[0], f[1]) for f in frames}  # nothing was late
    assert got == plain(frames, second(9_000))


def test_idle_episodes_close_and_late_frames_are_dropped(spark, tmp_path):
    first = [(1, i, second(i), float(i), False) for i in range(4)]  # also in one batch with what comes behind the gap
    again = [(1, 10 + i, second(500 + i), 5.0, i == 1) for i in range(2)]
    late = [(1, 99, second(2), 7.0, False)]
    rows = record(spark, str(tmp_path), batches(spark, str(tmp_path), [first, again, [(9, 0, second(600), 0.0, False)], [*late, (9, 1, second(700), 0.0, False)]]))
    got = told(rows.where("robot = 1"))
    assert got == plain(first + again, second(650))
    idle = rows.where("robot = 1 and id is null").first()
    assert (idle.episode, idle.length, idle.min, idle.max, idle.mean) == (0, 4, 0.0, 3.0, 1.5)


def test_idle_gap_inside_a_batch(spark, tmp_path):
    frames = [(1, i, second(i + 200 * (i // 3)), float(i), i == 7) for i in range(12)]
    rows = record(spark, str(tmp_path), batches(spark, str(tmp_path), [frames, [(9, 0, second(5000), 0.0, False)]]))
    assert told(rows.where("robot = 1")) == plain(frames, second(4_000))


def test_keys_share_state(spark, tmp_path):
    """Timers and state rows do not grow with the keys."""
    frames = [(r, 1000 * r + i, second(7 * i + r % 5), float(r % 7 + i), i == r % 4) for r in range(1, 701) for i in range(4)] + [(None, i, second(3 * i), 1.0, False) for i in range(2)]
    random.Random(1).shuffle(frames)
    stream = batches(spark, str(tmp_path), [frames[:1500], frames[1500:], [(0, -1, second(5000), 0.0, False)]])
    rows = R.record_episodes(stream, "robot", "frame", "at", "done", "value", 10.0, late="60 seconds", idle_seconds=100.0, slice_seconds=7.0)
    out = f"{tmp_path}/out"
    for k, v in R.ROCKS.items():
        spark.conf.set(k, v)
    try:
        q = rows.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    finally:
        for k in R.ROCKS:
            spark.conf.unset(k)
    q.awaitTermination()
    got = spark.read.schema(rows.schema).parquet(out)
    assert told(got.where("robot > 0")) == plain([f for f in frames if f[0]], second(4_900))
    assert sorted((r.id, r.frame_index) for r in got.where("robot is null and id is not null").collect()) == [(0, 0), (1, 1)]
    for p in q.recentProgress:
        assert p.stateOperators[0].customMetrics["numRegisteredTimers"] <= 300


def test_files_in_no_order_of_time_lose_no_event(spark, duck, same, tmp_path):
    """More batches than two, each as old as the others; events before the epoch and without a time."""
    import __spark_entry__

    n = 40
    (tmp_path / "events.parquet").mkdir()
    events = "SELECT event_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE ts - INTERVAL 60 YEAR * (event_id % 2) END AS ts, user_id, event_type, value, props FROM events"
    for i in range(n):
        duck.sql(f"COPY (SELECT * FROM ({events}) WHERE hash(event_id) % {n} = {i}) TO '{tmp_path}/events.parquet/{i:03}.parquet' (FORMAT parquet)")
    sql = __spark_entry__.oracle_sql()["str_episode_recorder"]
    want = duck.sql(f"WITH events AS (FROM '{tmp_path}/events.parquet/*.parquet'), {sql.removeprefix('WITH ')}").df()
    same(__spark_entry__.queries()["str_episode_recorder"](spark, str(tmp_path)).toPandas(), want)


def test_open_frames_wait_for_the_next_run(spark, tmp_path):
    """A stream that is started again goes on with what it held."""
    stream = batches(spark, str(tmp_path), [[(1, 0, second(0), 1.0, False), (1, 2, second(8), 3.0, True)]])
    assert record(spark, str(tmp_path), stream).count() == 0  # the watermark has not passed them
    spark.createDataFrame([(1, 1, second(4), 2.0, False), (9, 0, second(60), 0.0, False)], KIND).write.mode("append").parquet(f"{tmp_path}/in")
    got = told(record(spark, str(tmp_path), stream).where("robot = 1"))
    assert got == plain([(1, 0, second(0), 1.0, False), (1, 1, second(4), 2.0, False), (1, 2, second(8), 3.0, True)], second(50))


def test_batches_done_twice_count_once(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(int(b), f"k{rng.integers(0, 3)}", int(e), float(x)) for b in range(4) for e in range(5) for x in rng.normal(1e6, 1, 9)]
    df = spark.createDataFrame(rows, "batch int, k string, episode int, x double").cache()
    store = str(tmp_path / "store")
    each = {b: feature_stats(df.where(F.col("batch") == b), ["k", "episode"]) for b in range(4)}
    for b in (0, 0, 1, 2, 1, 2, 3, 3):  # after a failure a stream begins again at the batch that was not committed
        R.merge_batch(each[b], b, store, ["k"])
    got = {r.k: r for r in R.stored_stats(spark, store).collect()}
    for k, r in got.items():
        x = np.array([v for _, key, _, v in rows if key == k])
        assert (r["count"], r["min"], r["max"]) == (len(x), x.min(), x.max())
        assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std(), rel=1e-9)
    assert R.stored_batch(spark, store) == 3 and R.stored_batch(spark, store, 2) == 1


def test_merged_batches_do_not_read_rows_again(spark, tmp_path):
    store = str(tmp_path / "store")
    for b in range(2):
        R.merge_batch(feature_stats(spark.range(b * 10, b * 10 + 10).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x")), ["k"]), b, store, ["k"])
    files = R.stored_stats(spark, store).inputFiles()
    assert files and all("/batch=1/" in f for f in files)
    assert R.stored_stats(spark, store).first()["count"] == 20


def test_ring_over_batches(spark, tmp_path):
    rng = random.Random(2)
    frames = [(r, i, second(i), rng.random(), False) for r in (1, 2, 3) for i in range(20) if r < 3 or i > 12]
    parts = [[f for f in frames if (f[1] // 6) == b] for b in range(4)]
    stream = batches(spark, str(tmp_path), parts)
    got = {(r.robot, r.frame, r.pos): r.x for r in J.ring_buffer(stream, "robot", "frame", "value", ["at"], 4).collect()}
    want = {}
    for robot in (1, 2, 3):
        x = [f[3] for f in frames if f[0] == robot]
        first = min(f[1] for f in frames if f[0] == robot)
        for i in range(len(x)):
            window = x[max(0, i - 3) : i + 1]
            for pos, v in enumerate([window[0]] * (4 - len(window)) + window):
                want[robot, first + i, pos] = v
    assert got == want
