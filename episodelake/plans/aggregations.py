"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodelake.lenses import catalog, chunks, dataset_features, eval_results, frames, log_lines, prompts, sql, vectors
from episodelake.operators import evals as E
from episodelake.operators import sets as U
from episodelake.operators import stats as S
from episodelake.plans.projections import r6, state
from episodelake.registry import query

STATE = "SELECT episode_index, frame_index, ep_len, CAST(i AS bigint) AS dim, [value, k][i + 1] AS x FROM frames, LATERAL unnest(range(0, 2)) t(i)"
STEPS = f"""l AS ({STATE}), w AS (SELECT a.episode_index, CAST(o AS bigint) AS step, a.dim, b.x FROM l a, LATERAL unnest(range(0, 8)) t(o)
JOIN l b ON b.episode_index = a.episode_index AND b.dim = a.dim AND b.frame_index = least(a.frame_index + o, a.ep_len - 1)),
e AS (SELECT episode_index, step, dim, min(x) AS mn, max(x) AS mx, avg(x) AS mean, var_samp(x) AS var, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM w GROUP BY ALL)"""


def long_state(spark: SparkSession, sf: str) -> DataFrame:
    return S.long_vectors(frames(spark, sf).withColumn("s", state()), ["episode_index"], "s")


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns} | {c: F.col(c).cast("long") for c in ("dim", "step") if c in df.columns})


@query(sql("frames", f"l AS ({STATE}) SELECT episode_index, dim, min(x) AS min, max(x) AS max, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std, count(*) AS count FROM l GROUP BY ALL"))
def agg_episode_feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.feature_stats(long_state(spark, sf), ["episode_index", "dim"]), ["mean", "std"])


@query(sql("frames", f"l AS ({STATE}) SELECT dim, min(x) AS min, max(x) AS max, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std, count(*) AS count FROM l GROUP BY ALL"))
def agg_merge_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.merge_stats(S.feature_stats(long_state(spark, sf), ["episode_index", "dim"]), ["dim"]), ["mean", "std"])


@query(sql("frames", f"""l AS ({STATE}) SELECT episode_index, dim, min(x) AS min, max(x) AS max, round(avg(x), 6) + 0.0 AS mean, round(var_samp(x), 6) AS var,
round(quantile_cont(x, 0.01), 6) + 0.0 AS q01, round(quantile_cont(x, 0.99), 6) + 0.0 AS q99 FROM l GROUP BY ALL"""))
def agg_episode_state_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.episode_stats(long_state(spark, sf), ["episode_index", "dim"]), ["mean", "var", "q01", "q99"])


@query(sql("frames", f"{STEPS} SELECT episode_index, step, dim, mn AS min, mx AS max, round(mean, 6) + 0.0 AS mean, round(var, 6) AS var, round(q01, 6) + 0.0 AS q01, round(q99, 6) + 0.0 AS q99 FROM e"))
def agg_stepwise_action_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("s", state())
    return rounded(S.stepwise_stats(f, "s", 8, "episode_index", "frame_index"), ["mean", "var", "q01", "q99"])


@query(sql("frames", f"{STEPS} SELECT episode_index, step, dim, mn AS min, mx AS max, round(mean, 6) + 0.0 AS mean, round(var, 6) AS var FROM e"))
def agg_stepwise_closed_form(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("s", state())
    return rounded(S.stepwise_closed_form(f, "s", 8, "episode_index", "frame_index"), ["mean", "var"])


@query(sql("frames", f"""{STEPS}, ms AS (SELECT step, dim, avg(mean) AS m FROM e GROUP BY ALL), mg AS (SELECT dim, avg(mean) AS m FROM e GROUP BY ALL),
s AS (SELECT 'stepwise' AS scope, step, dim, min(mn) AS mn, max(mx) AS mx, any_value(m) AS mean, sqrt(avg(var + (mean - m) * (mean - m))) AS std, min(q01) AS q01, max(q99) AS q99 FROM e JOIN ms USING (step, dim) GROUP BY step, dim
UNION ALL SELECT 'global', NULL, dim, min(mn), max(mx), any_value(m), sqrt(avg(var + (mean - m) * (mean - m))), min(q01), max(q99) FROM e JOIN mg USING (dim) GROUP BY dim)
SELECT scope, step, dim, stat, round(value, 6) + 0.0 AS value FROM (SELECT scope, step, dim, unnest(['min', 'max', 'mean', 'std', 'q01', 'q99']) AS stat, unnest([mn, mx, mean, std, q01, q99]) AS value FROM s)"""))
def agg_dataset_norm_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.norm_stats(frames(spark, sf).withColumn("s", state()), "s", 8, "episode_index", "frame_index"), ["value"])


@query(sql("frames", f"""l AS ({STATE}), e AS (SELECT episode_index, dim, quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM l GROUP BY ALL)
SELECT dim, round(min(a), 6) + 0.0 AS q01, round(max(b), 6) + 0.0 AS q99, false AS skipped FROM e GROUP BY dim UNION ALL SELECT dim, min(x), max(x), true FROM l GROUP BY dim"""))
def agg_quantile_envelope(spark: SparkSession, sf: str) -> DataFrame:
    e = S.episode_stats(long_state(spark, sf), ["episode_index", "dim"])
    kinds = [S.quantile_envelope(e, ["dim"], skip).withColumn("skipped", F.lit(skip)) for skip in (False, True)]
    return rounded(kinds[0].unionByName(kinds[1]), ["q01", "q99"])


@query(sql("catalog", """SELECT task, count(*) AS datasets, CAST(sum(episodes) AS bigint) AS episodes, CAST(sum(frames) AS bigint) AS frames, round(sum(frames) / CAST(sum(sum(frames)) OVER () AS double), 6) AS share FROM catalog GROUP BY task"""))
def agg_task_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = catalog(spark, sf).groupBy("task").agg(F.count(F.lit(1)).alias("datasets"), F.sum("episodes").alias("episodes"), F.sum("frames").alias("frames"))
    total = t.agg(F.sum("frames").alias("all_frames"))  # one row, joined to one row per task
    return t.crossJoin(F.broadcast(total)).select("task", "datasets", "episodes", "frames", F.round(F.col("frames") / F.col("all_frames"), 6).alias("share"))


@query(sql("catalog", "SELECT task, dataset, episodes, frames, round(frames / CAST(episodes AS double), 6) AS avg_len, row_number() OVER (PARTITION BY task ORDER BY episodes DESC, dataset) AS place FROM catalog"))
def agg_task_avg_len(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("episodes"), "dataset")).cast("long")
    return catalog(spark, sf).select("task", "dataset", "episodes", "frames", F.round(F.try_divide("frames", "episodes"), 6).alias("avg_len"), place.alias("place"))


@query(sql("prompts", """c AS (SELECT DISTINCT dataset FROM prompts UNION ALL SELECT unnest(['zz1', 'zz2'])), p AS (SELECT DISTINCT dataset, task FROM prompts WHERE pos % 5 <> 0),
t AS (SELECT DISTINCT task AS t FROM p), z AS (SELECT string_agg(dataset, ',' ORDER BY dataset) AS none_at_all FROM c WHERE dataset NOT IN (SELECT dataset FROM p))
SELECT t.t AS task, count(p.task) AS datasets, count(*) - count(p.task) AS missing, string_agg(c.dataset, ',' ORDER BY c.dataset) FILTER (WHERE p.task IS NULL) AS lacking, (SELECT count(*) FROM t) AS unique_total, any_value(none_at_all) AS none_at_all
FROM t CROSS JOIN c CROSS JOIN z LEFT JOIN p ON p.task = t.t AND p.dataset = c.dataset GROUP BY t.t"""))
def agg_prompt_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of a catalogue that also names two datasets without any."""
    every = prompts(spark, sf).select("dataset", "task", "pos")
    catalog = every.select("dataset").distinct().unionByName(spark.range(1, 3).select(F.concat(F.lit("zz"), "id").alias("dataset")))
    p = every.where("pos % 5 <> 0")
    none = U.without_prompts(catalog, p, "task", "dataset").agg(F.array_join(F.array_sort(F.collect_set("dataset")), ",").alias("none_at_all"))
    c = U.prompt_coverage(catalog, p, "task", "dataset").withColumn("lacking", F.nullif(F.array_join("lacking", ","), F.lit("")))
    return c.crossJoin(F.broadcast(none))  # one row of names


SUITES = """s AS (SELECT suite, count(DISTINCT task_id) AS tasks, count(*) AS trials, count(*) FILTER (WHERE success) AS successes, 100.0::double * count(*) FILTER (WHERE success) / count(*) AS rate,
sum(duration) AS total_time, avg(duration) AS avg_time, max(duration) AS max_time, avg(psnr) AS psnr, sum(psnr) AS ps, count(psnr) AS pn FROM eval_results GROUP BY suite)"""
SHOWN = "round(rate, 6) AS rate, round(total_time, 2) AS total_time, round(avg_time, 4) AS avg_time, max_time, round(psnr, 6) AS psnr"


def shown(df: DataFrame) -> DataFrame:
    places = {"rate": 6, "total_time": 2, "avg_time": 4, "psnr": 6}
    return df.withColumns({c: F.round(c, n) for c, n in places.items()}).drop("psnr_sum", "psnr_n")


@query(sql("eval_results", f"{SUITES} SELECT suite, tasks, trials, successes, {SHOWN} FROM s"))
def agg_suite_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shown(E.suite_summary(eval_results(spark, sf)))


@query(sql("eval_results", f"""{SUITES}, a AS (SELECT suite, tasks, trials, successes, rate, total_time, avg_time, max_time, psnr FROM s UNION ALL
SELECT 'overall', CAST(sum(tasks) AS bigint), CAST(sum(trials) AS bigint), CAST(sum(successes) AS bigint), avg(rate), sum(total_time), sum(total_time) / sum(trials), max(max_time), sum(ps) / sum(pn) FROM s)
SELECT suite, tasks, trials, successes, {SHOWN} FROM a"""))
def agg_overall_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shown(E.overall_summary(E.suite_summary(eval_results(spark, sf))))


LOG = """p AS (SELECT run, regexp_extract(line, 'task=(\\S+)', 1) AS task, regexp_extract(line, 'phase=(\\S+)', 1) AS phase, CAST(regexp_extract(line, 'success_rate=([0-9.]+)', 1) AS double) AS rate FROM log_lines)"""


def parsed_log(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.regexp_extract("line", p, 1)
    return log_lines(spark, sf).select("run", part(r"task=(\S+)").alias("task"), part(r"phase=(\S+)").alias("phase"), part(r"success_rate=([0-9.]+)").cast("double").alias("rate"))


@query(sql("log_lines", f"{LOG}, b AS (SELECT task, max(rate) AS best FROM p GROUP BY task) SELECT task, best, (SELECT count(*) FROM b) AS num, (SELECT round(sum(best), 6) FROM b) AS total, (SELECT round(avg(best), 6) FROM b) AS avg FROM b"))
def agg_best_success(spark: SparkSession, sf: str) -> DataFrame:
    best = E.best_success(parsed_log(spark, sf))
    totals = best.agg(F.count(F.lit(1)).alias("num"), F.round(F.sum("best"), 6).alias("total"), F.round(F.avg("best"), 6).alias("avg"))
    return best.crossJoin(F.broadcast(totals))


@query(sql("log_lines", f"""{LOG}, t AS (SELECT task, avg(rate) FILTER (WHERE phase = 'clean') AS clean, avg(rate) FILTER (WHERE phase = 'random') AS random FROM p GROUP BY task)
SELECT task, round(clean, 6) AS clean, round(random, 6) AS random FROM (SELECT * FROM t UNION ALL SELECT '__overall__', avg(clean), avg(random) FROM t)"""))
def agg_phase_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return E.phase_pivot(parsed_log(spark, sf)).select("task", F.round("clean", 6).alias("clean"), F.round("random", 6).alias("random"))


@query(sql("chunks", """d AS (SELECT c.episode_index, pred - value AS d FROM chunks c JOIN frames f ON f.episode_index = c.episode_index AND f.frame_index = target)
SELECT episode_index, round(avg(abs(d)), 6) AS l1, round(avg(d * d), 6) AS l2, round(sqrt(avg(d * d)), 6) AS rmse, round(max(abs(d)), 6) AS max_abs FROM d GROUP BY 1"""))
def agg_action_error(spark: SparkSession, sf: str) -> DataFrame:
    truth = frames(spark, sf).select("episode_index", F.col("frame_index").alias("target"), "value")
    e = E.action_error(chunks(spark, sf).join(truth, ["episode_index", "target"]), ["episode_index"], "pred", "value")
    return e.select("episode_index", *[F.round(c, 6).alias(c) for c in ("l1", "l2", "rmse", "max_abs")])


STEP_MSE = "list_sum(list_transform(range(i * 16 + 1, i * 16 + 17), lambda j: (x[j] - y[j]) * (x[j] - y[j]))) / 16"
PAIRS = "p AS (SELECT a.vec_id, a.label, a.v AS x, b.v AS y FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1)"
ERR = """e AS (SELECT vec_id, label, x, y, list_sum(list_transform(range(17, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) / 48 AS mse, list_sum(list_transform(range(17, 65), lambda i: abs(x[i] - y[i]))) / 48 AS mae,
list_sum(list_transform(range(17, 65), lambda i: x[i] * y[i])) AS dot, sqrt(list_sum(list_transform(range(17, 65), lambda i: x[i] * x[i]))) AS nx, sqrt(list_sum(list_transform(range(17, 65), lambda i: y[i] * y[i]))) AS ny FROM p)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


def errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of each pair of four steps of 16 numbers, without the first step."""
    steps = lambda c: F.array(*[F.slice(c, 16 * i + 1, 16) for i in range(4)])
    return pairs(spark, sf).select("vec_id", "label", E.future_error(steps("v"), steps("w")).alias("e"))


@query(sql("vectors", f"""{PAIRS}, {ERR} SELECT vec_id, round(1 - dot / (greatest(nx, 1e-8) * greatest(ny, 1e-8)), 6) + 0.0 AS cosine, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae,
round(list_sum(list_transform(range(49, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) / 16, 6) AS final_mse,
round(1 - list_sum(list_transform(range(49, 65), lambda i: x[i] * y[i])) / (greatest(1e-8, sqrt(list_sum(list_transform(range(49, 65), lambda i: x[i] * x[i])))) * greatest(1e-8, sqrt(list_sum(list_transform(range(49, 65), lambda i: y[i] * y[i]))))), 6) + 0.0 AS final_cosine,
CAST(s AS bigint) AS step, round(list_sum(list_transform(range(s * 16 + 1, s * 16 + 17), lambda j: (x[j] - y[j]) * (x[j] - y[j]))) / 16, 6) AS step_mse FROM e, LATERAL unnest(range(1, 4)) t(s)"""))
def agg_latent_error(spark: SparkSession, sf: str) -> DataFrame:
    named = [r6(F.col(f"e.{c}")).alias(c) for c in ("cosine", "mse", "rmse", "mae", "final_mse", "final_cosine")]
    rows = errors(spark, sf).select("vec_id", *named, F.posexplode("e.step_mse").alias("step", "step_mse"))
    return rows.withColumns({"step": (F.col("step") + 1).cast("long"), "step_mse": F.round("step_mse", 6)})


@query(sql("vectors", f"{PAIRS}, {ERR} SELECT label, round(avg(mse), 6) AS mean, round(stddev_pop(mse), 6) AS std, round(quantile_cont(mse, 0.5), 6) AS median, round(min(mse), 6) AS min, round(max(mse), 6) AS max FROM e GROUP BY label"))
def agg_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = E.distribution(errors(spark, sf).select("label", F.col("e.mse").alias("mse")), ["label"], "mse")
    return d.select("label", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "min", "max")])


@query(sql("vectors", f"""{PAIRS}, s AS (SELECT vec_id % 100 AS sample, CAST(i AS bigint) AS step, {STEP_MSE} AS m FROM p, LATERAL unnest(range(0, 4)) t(i))
SELECT sample, step, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, count(*) AS seeds FROM s GROUP BY ALL"""))
def agg_seed_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    steps = pairs(spark, sf).select((F.col("vec_id") % 100).alias("sample"), "v", "w", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step"))
    at = F.col("step") * 16 + 1
    m = steps.select("sample", F.col("step").cast("long").alias("step"), E.latent_error(F.slice("v", at, 16), F.slice("w", at, 16))["mse"].alias("m"))
    return m.groupBy("sample", "step").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"), F.count(F.lit(1)).alias("seeds"))


@query(sql("vectors", f"{PAIRS}, g AS (SELECT label, CAST(i AS bigint) AS step, {STEP_MSE} AS m, list_sum(list_transform(range(i * 16 + 1, i * 16 + 17), lambda j: (x[(j - 1) % 16 + 1] - y[j]) * (x[(j - 1) % 16 + 1] - y[j]))) / 16 AS b FROM p, LATERAL unnest(range(1, 4)) t(i)) SELECT label, step, round(avg((b - m > 0)::int::double), 6) AS gain_fraction FROM g GROUP BY ALL"))
def agg_gain_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Each later step against persistence, which predicts the first step for all of them."""
    mse = lambda a, at: E.latent_error(F.slice("v", a, 16), F.slice("w", at, 16))["mse"]
    at = F.col("step") * 16 + 1
    steps = pairs(spark, sf).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return steps.groupBy("label", F.col("step").cast("long").alias("step")).agg(F.round(F.avg((mse(F.lit(1), at) - mse(at, at) > 0).cast("double")), 6).alias("gain_fraction"))


@query(sql("frames", "SELECT episode_index, round(sum(CASE WHEN k > 4 THEN value ELSE 0 END) / greatest(1, count(*) FILTER (WHERE k > 4)), 6) + 0.0 AS loss FROM frames GROUP BY 1"))
def agg_masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).groupBy("episode_index").agg(r6(E.masked_mean("value", F.col("k") > 4)).alias("loss"))


@query(sql("frames", """p AS (SELECT a.episode_index, a.frame_index, o AS step, a.frame_index + o >= a.ep_len AS pad FROM frames a, LATERAL unnest(range(0, 9)) t(o))
SELECT episode_index, frame_index, CASE WHEN step = 0 THEN 0 ELSE CAST(floor((step - 1) / 4) AS bigint) + 1 END AS latent_step, bool_and(pad) AS is_pad FROM p GROUP BY ALL"""))
def agg_pad_downsample(spark: SparkSession, sf: str) -> DataFrame:
    # the mask of a window of 9 steps is known from the episode's length
    steps = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.col("frame_index") + i >= F.col("ep_len"))
    w = frames(spark, sf).select("episode_index", "frame_index", steps.alias("is_pad"))
    return w.select("episode_index", "frame_index", F.posexplode(E.downsampled(F.col("is_pad"), 4)).alias("latent_step", "is_pad")).withColumn("latent_step", F.col("latent_step").cast("long"))


@query(sql("chunks", "SELECT episode_index, target, round(avg(pred), 6) + 0.0 AS action, count(*) AS n FROM chunks GROUP BY ALL"))
def agg_action_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return E.action_ensemble(chunks(spark, sf)).withColumn("action", r6("action"))


@query(sql("eval_results", """SELECT suite, task_id, round(avg(CASE WHEN trial % 4 <> 0 THEN duration / 10 END), 4) AS mean_latency, max(CASE WHEN trial % 4 <> 0 THEN duration / 10 END) AS max_latency,
round(coalesce(sum(CASE WHEN trial % 4 <> 0 THEN duration / 10 END), 0), 4) AS infer_s, round(sum(duration - coalesce(CASE WHEN trial % 4 <> 0 THEN duration / 10 END, 0)), 4) AS sim_s FROM eval_results GROUP BY ALL"""))
def agg_latency(spark: SparkSession, sf: str) -> DataFrame:
    """A step infers (a tenth of its time) or only goes on with the last chunk."""
    infer = F.when(F.col("trial") % 4 != 0, F.col("duration") / 10)
    steps = eval_results(spark, sf).select("suite", "task_id", infer.alias("infer_s"), (F.col("duration") - F.coalesce(infer, F.lit(0.0))).alias("sim_s"))
    r = E.rollout_times(steps, ["suite", "task_id"])
    return r.select("suite", "task_id", F.round("mean_latency", 4).alias("mean_latency"), "max_latency", F.round("infer_s", 4).alias("infer_s"), F.round("sim_s", 4).alias("sim_s"))


@query(sql("dataset_features", "SELECT max(w) AS max_dim FROM (SELECT dataset_id, CAST(sum(width) AS bigint) AS w FROM dataset_features GROUP BY 1)"))
def agg_max_embodiment_dim(spark: SparkSession, sf: str) -> DataFrame:
    return dataset_features(spark, sf).groupBy("dataset_id").agg(F.sum("width").alias("w")).agg(F.max("w").alias("max_dim"))


@query(sql("frames", "SELECT index % 4 AS rank, count(*) FILTER (WHERE value < 90) AS ok, count(*) FILTER (WHERE NOT value < 90) AS error FROM frames GROUP BY 1"))
def agg_scan_health(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).groupBy((F.col("index") % 4).alias("rank")).agg(F.count_if(F.col("value") < 90).alias("ok"), F.count_if(~(F.col("value") < 90)).alias("error"))


@query(sql("frames", "SELECT source, count(DISTINCT episode_index) AS episodes, count(*) AS frames, CAST(ceil(count(DISTINCT episode_index) / 10.0) AS bigint) AS chunks, count(DISTINCT episode_index) * 3 AS videos, concat('0:', CAST(count(DISTINCT episode_index) AS varchar)) AS split FROM frames GROUP BY source"))
def agg_dataset_totals(spark: SparkSession, sf: str) -> DataFrame:
    return S.dataset_totals(frames(spark, sf), ["source"], 10, 3)


@query(sql("prompts", """SELECT count(DISTINCT dataset) AS datasets, count(*) AS task_rows, count(DISTINCT task) AS unique_prompts, count(*) FILTER (WHERE len(string_split(text, ' ')) > 128) AS over_length FROM prompts"""))
def agg_prompt_counts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).agg(
        F.countDistinct("dataset").alias("datasets"), F.count(F.lit(1)).alias("task_rows"), F.countDistinct("task").alias("unique_prompts"), F.count_if(F.size(F.split("text", " ")) > 128).alias("over_length")
    )
