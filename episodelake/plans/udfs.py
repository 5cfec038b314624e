"""Queries of the user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.functions import udfs as U
from episodelake.functions.scalars import prompt_key
from episodelake.lenses import frames, prompts, sql, vectors
from episodelake.paths import scratch
from episodelake.plans.projections import r6
from episodelake.plans.scalars import SIDES, odd_tasks
from episodelake.registry import query

CONFIG = [{"name": "scale", "factor": 0.5}, {"name": "shift", "by": -3.0}, {"name": "signed_sqrt"}]


@query(sql("frames", "SELECT index, round(sign(value * 0.5::double - 3) * sqrt(abs(value * 0.5::double - 3)), 6) + 0.0 AS forward, round(value, 6) + 0.0 AS back FROM frames"))
def udf_transform_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).select("index", U.pipeline(CONFIG)(F.col("value")).alias("forward"))
    return f.select("index", r6("forward").alias("forward"), r6(U.pipeline(CONFIG, backward=True)(F.col("forward"))).alias("back"))


@query()
def udf_batch_embed(spark: SparkSession, sf: str) -> DataFrame:
    """All tasks through the cache: those of two sources first, then the rest of all."""
    p = prompts(spark, sf).select("task", "dataset").distinct().select(prompt_key(F.col("task"), 8, "hash").alias("key"), F.col("task").alias("prompt"), "dataset")
    cache = scratch(spark, "embeddings")
    U.embed_missing(p.where("dataset in ('src1', 'src2')"), cache)
    return U.embed_missing(p, cache)


@query()
def udf_ssim(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return pairs.select("vec_id", U.ssim(8, peak=2.0)(F.col("v"), F.col("w")).alias("ssim"))


@query(sql("prompts", f"{SIDES} SELECT DISTINCT pos, unnest(v) AS variant FROM v"))
def udtf_task_variants(spark: SparkSession, sf: str) -> DataFrame:
    return odd_tasks(spark, sf).lateralJoin(U.TaskVariants(F.col("task").outer())).select("pos", "variant")
