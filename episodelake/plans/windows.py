"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodelake.functions.scalars import prompt_key, prompt_template
from episodelake.functions.udfs import embed
from episodelake.lenses import catalog, chunks, eval_results, frames, sql, table
from episodelake.operators import windows as W
from episodelake.operators.evals import capture_align, replan_select
from episodelake.operators.joins import running_rate
from episodelake.operators.samples import training_samples, without_padding
from episodelake.paths import kept, scratch
from episodelake.plans.projections import r6
from episodelake.registry import query
from episodelake.sources.lake import stored_index

EP, AT = ["episode_index"], "frame_index"


@query(sql("frames", """SELECT a.episode_index, a.frame_index, CAST(o AS bigint) AS step, b.value AS x, a.frame_index + o >= a.ep_len AS is_pad FROM frames a, LATERAL unnest(range(0, 5)) t(o)
JOIN frames b ON b.episode_index = a.episode_index AND b.frame_index = least(a.frame_index + o, a.ep_len - 1)"""))
def win_forward_replicate(spark: SparkSession, sf: str) -> DataFrame:
    w = W.forward_replicate(frames(spark, sf), "value", 5, EP, AT)
    z = w.select("episode_index", "frame_index", F.posexplode(F.arrays_zip(F.col("window").alias("x"), "is_pad")).alias("step", "z"))
    return z.select("episode_index", "frame_index", F.col("step").cast("long").alias("step"), "z.x", "z.is_pad")


@query(sql("frames", """d AS (SELECT * FROM (VALUES (0, -2), (1, 0), (2, 3), (3, 7)) t(step, delta))
SELECT a.episode_index, a.frame_index, CAST(step AS bigint) AS step, b.value AS x, a.frame_index + delta < 0 OR a.frame_index + delta >= a.ep_len AS is_pad FROM frames a, d
JOIN frames b ON b.episode_index = a.episode_index AND b.frame_index = least(greatest(a.frame_index + delta, 0), a.ep_len - 1)"""))
def win_delta_clamped(spark: SparkSession, sf: str) -> DataFrame:
    return W.delta_clamped(frames(spark, sf), "value", [-2, 0, 3, 7], EP, AT, "ep_len").select("episode_index", "frame_index", "step", "x", "is_pad")


@query(sql("catalog", "SELECT dataset_id, CAST(i AS bigint) AS step, CAST(round_even(i * CAST(0.05 AS double) * fps, 0) AS bigint) * 2 AS delta FROM catalog, LATERAL unnest(range(0, 9)) t(i)"))
def win_delta_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark, sf).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    return c.select("dataset_id", "step", W.delta_plan(F.col("step") * F.lit(0.05), F.col("fps"), 2).alias("delta"))


@query(sql("frames", """SELECT a.episode_index, a.frame_index, CAST(o / 4 AS bigint) AS step, b.value AS x FROM frames a, LATERAL unnest(range(0, 9, 4)) t(o)
JOIN frames b ON b.episode_index = a.episode_index AND b.frame_index = least(a.frame_index + o, a.ep_len - 1)"""))
def win_strided_obs(spark: SparkSession, sf: str) -> DataFrame:
    w = W.forward_replicate(frames(spark, sf), "value", 9, EP, AT)
    z = w.select("episode_index", "frame_index", F.posexplode(W.strided(F.col("window"), 4)).alias("step", "x"))
    return z.withColumn("step", F.col("step").cast("long"))


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("episode_index")).agg(F.count(F.lit(1)).alias("length"))


@query("""WITH e AS (SELECT user_id AS episode_index, count(*) AS length FROM events GROUP BY user_id)
SELECT episode_index, length, CAST(sum(length) OVER w - length AS bigint) AS from_index, CAST(sum(length) OVER w AS bigint) AS to_index FROM e WINDOW w AS (ORDER BY episode_index)""")
def win_episode_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return W.episode_offsets(episodes(spark, sf), block=64).select("episode_index", "length", "from_index", "to_index")


#: Files of a hundred events whose tens are stored in another order, every 13th event left out; files 5, 10, … count from three lower.
RUNS_SQL = """x AS (SELECT event_id, CAST(floor(event_id / 100) AS bigint) AS f, CAST(floor(event_id / 10) AS bigint) * 7 % 10 * 10 + event_id % 10 AS spot FROM events WHERE event_id % 13 <> 0),
i AS (SELECT *, printf('data/chunk-%06d', f) AS file, event_id - CASE WHEN {lower} THEN 3 ELSE 0 END AS idx, row_number() OVER (ORDER BY printf('%06d', f), spot) - 1 AS pos FROM x),
k AS (SELECT *, CASE WHEN idx - lag(idx) OVER w = 1 THEN 0 ELSE 1 END AS breaks FROM i WINDOW w AS (PARTITION BY f ORDER BY spot)),
n AS (SELECT *, sum(breaks) OVER (ORDER BY pos) AS run FROM k),
r AS (SELECT file, min(idx) AS start, max(idx) + 1 AS "end", min(pos) AS physical_start FROM n GROUP BY file, run)"""


def stored_runs(spark: SparkSession, sf: str, lower: bool) -> DataFrame:
    """The runs of a lake whose files are permuted and have gaps; with ``lower`` every fifth file also overlaps the one before.

    A file of a hundred events is a section of a data file, which holds up to a
    thousand of them in the order of their names: the lake's files grow with its
    bytes, where a file each would be a rename in the driver for every hundred events.
    """
    root = scratch(spark, "runs")
    e = table(spark, sf, "events").where("event_id % 13 <> 0")
    f = F.floor(F.col("event_id") / 100)
    index = F.col("event_id") - F.when(F.lit(lower) & (f % 5 == 0), 3).otherwise(0)
    rows = e.select(index.alias("index"), F.format_string("%06d", f).alias("chunk"), (F.floor(F.col("event_id") / 10) * 7 % 10 * 10 + F.col("event_id") % 10).alias("at"))
    # names that share their first three places are one task's, so one data file, and follow each other in it
    packed = rows.withColumn("pack", F.substring("chunk", 1, 3)).repartition("pack").sortWithinPartitions("pack", "chunk", "at")
    packed.drop("at").write.partitionBy("pack").parquet(f"{root}/data")
    runs = W.index_runs(stored_index(spark, root, section="chunk"), section="chunk")
    return runs.withColumn("file", F.concat(F.lit("data/chunk-"), "chunk")).drop("chunk")


@query(f'WITH {RUNS_SQL.format(lower="false")} SELECT file, start, "end", physical_start FROM r')
def win_runs(spark: SparkSession, sf: str) -> DataFrame:
    return stored_runs(spark, sf, False)


@query(f"""WITH {RUNS_SQL.format(lower="f % 5 = 0")} SELECT file, start, "end", physical_start, coalesce(lead(start) OVER (ORDER BY start, "end") < "end", false) AS overlaps_next FROM r""")
def win_run_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return W.overlapping(kept(stored_runs(spark, sf, True), "runs"))


@query("""WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), o AS (SELECT user_id, sum(n) OVER (ORDER BY user_id) - n AS f FROM e),
x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events)
SELECT event_id, user_id AS episode_index, frame_index, round(frame_index / CAST(30 AS double), 6) AS timestamp, CAST(f + frame_index AS bigint) AS index FROM x JOIN o USING (user_id)""")
def win_frame_numbering(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("episode_index"))
    n = W.number_frames(e, EP, ["ts", "event_id"], 30.0, W.episode_offsets(episodes(spark, sf)))
    return n.select("event_id", "episode_index", "frame_index", F.round("timestamp", 6).alias("timestamp"), "index")


@query(sql("frames", """m AS (SELECT episode_index, frame_index, ep_len, value, avg(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a FROM frames),
f AS (SELECT episode_index, a AS first_full FROM m WHERE frame_index = 4)
SELECT m.episode_index, frame_index, round(CASE WHEN ep_len < 5 THEN value WHEN frame_index < 4 THEN first_full ELSE a END, 6) + 0.0 AS avg FROM m LEFT JOIN f USING (episode_index)"""))
def win_moving_avg(spark: SparkSession, sf: str) -> DataFrame:
    return W.moving_average(frames(spark, sf), "value", 5, EP, AT).select("episode_index", "frame_index", r6("avg").alias("avg"))


@query(sql("frames", "SELECT episode_index, frame_index, round(1 + sum(value) OVER (PARTITION BY episode_index ORDER BY frame_index) * CAST(0.05 AS double), 5) + 0.0 AS position FROM frames"))
def win_integrate(spark: SparkSession, sf: str) -> DataFrame:
    return W.integrate(frames(spark, sf), "value", 0.05, F.lit(1.0), EP, AT).select("episode_index", "frame_index", (F.round("position", 5) + F.lit(0.0)).alias("position"))


@query(sql("chunks", """SELECT episode_index, chunk_start, offset_in_chunk, round(CASE WHEN o < 4 THEN s * (1 - w) + pred * w ELSE pred END, 6) + 0.0 AS blended
FROM (SELECT episode_index, chunk_start, offset_in_chunk, pred, offset_in_chunk AS o, (offset_in_chunk / CAST(4 AS double)) * (offset_in_chunk / CAST(4 AS double)) * (3 - 2 * (offset_in_chunk / CAST(4 AS double))) AS w,
  first_value(pred) OVER (PARTITION BY episode_index, chunk_start ORDER BY offset_in_chunk) AS s FROM chunks)"""))
def win_blend_start(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf).withColumn("s", F.first("pred").over(Window.partitionBy("episode_index", "chunk_start").orderBy("offset_in_chunk")))
    return c.select("episode_index", "chunk_start", "offset_in_chunk", r6(W.blend_start(F.col("offset_in_chunk"), F.col("s"), F.col("pred"), 4)).alias("blended"))


@query(sql("chunks", """SELECT c.episode_index, target, round(pred, 6) + 0.0 AS pred FROM chunks c JOIN (SELECT episode_index, any_value(ep_len) AS n FROM frames GROUP BY 1) e USING (episode_index)
WHERE chunk_start % 4 = 0 AND offset_in_chunk < 4 AND target < n"""))
def win_replan_select(spark: SparkSession, sf: str) -> DataFrame:
    lengths = episodes(spark, sf).withColumnRenamed("length", "ep_len")
    return replan_select(chunks(spark, sf).join(lengths, "episode_index"), 4, "ep_len").select("episode_index", "target", r6("pred").alias("pred"))


@query(sql("chunks", """e AS (SELECT episode_index, any_value(ep_len) AS n FROM frames GROUP BY 1), x AS (SELECT episode_index, n, 1 + CAST(floor(n / 3) AS bigint) AS expected FROM e)
SELECT c.episode_index, expected, count(*) AS kept, round(sum(pred), 5) AS total FROM chunks c JOIN x USING (episode_index) WHERE offset_in_chunk = 0 AND chunk_start / 4 < expected GROUP BY ALL"""))
def win_capture_align(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf).where("offset_in_chunk = 0").select("episode_index", (F.col("chunk_start") / 4).cast("long").alias("place"), "pred")
    out = capture_align(c, episodes(spark, sf).select("episode_index", F.col("length").alias("executed")), every=3)
    return out.groupBy("episode_index", "expected").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("pred"), 5).alias("total"))


@query(sql("frames", """SELECT a.episode_index, a.frame_index, CAST(i AS bigint) AS pos, b.value AS x FROM frames a, LATERAL unnest(range(0, 4)) t(i)
JOIN frames b ON b.episode_index = a.episode_index AND b.frame_index = greatest(a.frame_index - 3 + i, 0)"""))
def win_last_n_history(spark: SparkSession, sf: str) -> DataFrame:
    h = W.last_n(frames(spark, sf), "value", 4, EP, AT).select("episode_index", "frame_index", F.posexplode("history").alias("pos", "x"))
    return h.withColumn("pos", F.col("pos").cast("long"))


@query(sql("eval_results", """SELECT suite, trial, CAST(round_even(100.0::double * sum(success::int) OVER w / count(*) OVER w, 1) AS double) AS rate FROM eval_results WINDOW w AS (PARTITION BY suite, task_id ORDER BY trial)"""))
def win_running_success(spark: SparkSession, sf: str) -> DataFrame:
    return running_rate(eval_results(spark, sf), "success", ["suite", "task_id"], "trial").select("suite", "trial", "rate")


@query(sql("frames", """w AS (SELECT a.episode_index, a.frame_index, a.ep_len, a.task, list(b.value ORDER BY o) FILTER (WHERE o < 8) AS action, list(b.k ORDER BY o) FILTER (WHERE o < 8) AS proprio, list(a.frame_index + o >= a.ep_len ORDER BY o) AS pads
  FROM frames a, LATERAL unnest(range(0, 9)) t(o) JOIN frames b ON b.episode_index = a.episode_index AND b.frame_index = least(a.frame_index + o, a.ep_len - 1) GROUP BY ALL)
SELECT episode_index, frame_index, round(list_sum(action), 5) AS action, round(list_sum(proprio), 5) AS proprio, action[8] AS last_action, len(list_filter(pads[1:8], lambda p: p)) AS action_pads, len(list_filter(pads, lambda p: p)) AS proprio_pads,
  len(list_filter([pads[1], pads[5], pads[9]], lambda p: p)) AS image_pads, concat('do: ', task) AS prompt, len(string_split(task, ' ')) + 1 AS tokens, true AS all_true, ep_len - frame_index > 8 AS whole FROM w"""))
def win_training_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of eight steps and three images, with their prompts' contexts, the masks as counts."""
    f = frames(spark, sf).select("episode_index", "frame_index", "task", F.array("value").alias("act"), F.array("k").alias("obs"))
    prompt = prompt_template(F.col("task"), template="do: {task}")
    texts = f.select("task").distinct().select(prompt.alias("prompt"))
    cache = embed(texts.select(prompt_key(F.col("prompt"), 6, "hash").alias("key"), "prompt"), 6, 4)
    s = training_samples(f, cache, prompt, "act", "obs", 9, 4, EP, AT, 6, "hash")
    inside = without_padding(s).select("episode_index", "frame_index", F.lit(True).alias("whole"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v[0]), 5).alias(c)
    count = lambda c: F.size(F.filter(c, lambda p: p)).cast("long")
    tokens = F.size(F.filter("context", lambda row: F.exists(row, lambda x: x != 0))).cast("long")
    out = s.select(
        "episode_index", "frame_index", total("action"), total("proprio"), F.col("action")[7][0].alias("last_action"), count("action_is_pad").alias("action_pads"), count("proprio_is_pad").alias("proprio_pads"),
        count("image_is_pad").alias("image_pads"), "prompt", tokens.alias("tokens"), F.forall("context_mask", lambda m: m).alias("all_true"),
    )
    return out.join(inside, EP + [AT], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
