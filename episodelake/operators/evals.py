"""Evaluation: success summaries, action and latent errors, predicted chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodelake.operators.stats import exact_quantiles


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def latent_error(pred: Column, real: Column) -> Column:
    """A struct of errors of two equally long vectors: cosine divergence (each norm at least 1e-8), mse, rmse, mae."""
    square = _sum(F.zip_with(pred, real, lambda a, b: (a - b) * (a - b))) / F.size(pred)
    absolute = _sum(F.zip_with(pred, real, lambda a, b: F.abs(a - b))) / F.size(pred)
    norm = lambda v: F.greatest(F.sqrt(_sum(F.transform(v, lambda x: x * x))), F.lit(1e-8))
    cosine = _sum(F.zip_with(pred, real, lambda a, b: a * b)) / (norm(pred) * norm(real))
    return F.struct((1 - cosine).alias("cosine"), square.alias("mse"), F.sqrt(square).alias("rmse"), absolute.alias("mae"))


def future_error(pred: Column, real: Column) -> Column:
    """Errors of two windows (steps of equally long vectors) without their first, observed step.

    A struct of ``latent_error`` over all later steps, final_cosine and
    final_mse of the last step alone, and step_mse of each.
    """
    p, r = F.slice(pred, 2, F.size(pred) - 1), F.slice(real, 2, F.size(real) - 1)
    whole, last = latent_error(F.flatten(p), F.flatten(r)), latent_error(F.element_at(p, -1), F.element_at(r, -1))
    each = F.zip_with(p, r, lambda a, b: latent_error(a, b)["mse"])
    return F.struct(*[whole[n].alias(n) for n in ("cosine", "mse", "rmse", "mae")], last["cosine"].alias("final_cosine"), last["mse"].alias("final_mse"), each.alias("step_mse"))


def replan_select(chunks: DataFrame, replan: int, length: str) -> DataFrame:
    """The steps that are executed when a new chunk replaces the old one every ``replan`` steps, within the episode."""
    return chunks.where((F.col("chunk_start") % replan == 0) & (F.col("offset_in_chunk") < replan) & (F.col("target") < F.col(length)))


def capture_align(frames: DataFrame, executed: DataFrame, every: int) -> DataFrame:
    """Frames (episode_index, place) cut to the expected number: one, and one for each ``every`` executed steps."""
    expected = (1 + F.floor(F.col("executed") / every)).cast("long")
    return frames.join(executed.select("episode_index", expected.alias("expected")), "episode_index").where("place < expected")


def action_error(df: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """l1 (mean absolute), l2 (mean square), rmse and largest error."""
    d = F.col(pred) - F.col(truth)
    return df.groupBy(*keys).agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("l2"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_abs"))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, population std, median, min and max; null for groups without values. The median is exact, from ranks."""
    plain = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return plain.join(exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("median")), keys, "left")


def rollout_times(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Per rollout: mean and largest latency of inference, and the sums of inference and simulation times; null times count as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return steps.groupBy(*keys).agg(F.avg("infer_s").alias("mean_latency"), F.max("infer_s").alias("max_latency"), total("infer_s").alias("infer_s"), total("sim_s").alias("sim_s"))


def suite_summary(results: DataFrame) -> DataFrame:
    """Per suite: tasks, trials, successes, success percent, total, mean and longest time, mean PSNR of those that have one."""
    return results.groupBy("suite").agg(
        F.countDistinct("task_id").alias("tasks"),
        F.count(F.lit(1)).alias("trials"),
        F.count_if("success").alias("successes"),
        (100.0 * F.count_if("success") / F.count(F.lit(1))).alias("rate"),
        F.sum("duration").alias("total_time"),
        F.avg("duration").alias("avg_time"),
        F.max("duration").alias("max_time"),
        F.avg("psnr").alias("psnr"),
        F.sum("psnr").alias("psnr_sum"),
        F.count("psnr").alias("psnr_n"),
    )


def overall_summary(suites: DataFrame) -> DataFrame:
    """The suites and a row 'overall': the mean of the suites' rates (not pooled), time over all tasks, PSNR over all trials."""
    total = suites.agg(
        F.lit("overall").alias("suite"), F.sum("tasks").alias("tasks"), F.sum("trials").alias("trials"), F.sum("successes").alias("successes"), F.avg("rate").alias("rate"),
        F.sum("total_time").alias("total_time"), (F.sum("total_time") / F.sum("trials")).alias("avg_time"), F.max("max_time").alias("max_time"),
        F.try_divide(F.sum("psnr_sum"), F.sum("psnr_n")).alias("psnr"),
    )
    return suites.drop("psnr_sum", "psnr_n").unionByName(total)


def best_success(runs: DataFrame) -> DataFrame:
    """The best rate of each task over its runs."""
    return runs.groupBy("task").agg(F.max("rate").alias("best"))


def phase_pivot(runs: DataFrame) -> DataFrame:
    """task x (clean, random) mean rates, with a row __overall__ of the means of the tasks that have one."""
    tasks = runs.groupBy("task").pivot("phase", ["clean", "random"]).agg(F.avg("rate"))
    return tasks.unionByName(tasks.agg(F.lit("__overall__").alias("task"), F.avg("clean").alias("clean"), F.avg("random").alias("random")))


def masked_mean(value: str, valid: Column) -> Column:
    """Mean of the valid steps, over one step at least."""
    return F.sum(F.when(valid, F.col(value)).otherwise(0.0)) / F.greatest(F.lit(1), F.count_if(valid))


def downsampled(is_pad: Column, k: int) -> Column:
    """The pad mask of groups of k steps (padded when all are); the first step stays a group of its own."""
    starts = F.sequence(F.lit(2), F.size(is_pad), F.lit(k))
    groups = F.transform(starts, lambda a: F.forall(F.slice(is_pad, a, k), lambda x: x))
    return F.concat(F.slice(is_pad, 1, 1), F.when(F.size(is_pad) > 1, groups).otherwise(F.array().cast("array<boolean>")))


def action_ensemble(chunks: DataFrame) -> DataFrame:
    """Mean and number of all predictions that aim at the same step."""
    return chunks.groupBy("episode_index", "target").agg(F.avg("pred").alias("action"), F.count(F.lit(1)).alias("n"))
