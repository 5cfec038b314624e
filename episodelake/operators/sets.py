"""Unions, intersections and ordered distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodelake.operators.windows import places


def union_common(datasets: list[DataFrame], exempt: tuple[str, ...] = ("observation.images.",)) -> DataFrame:
    """All rows with dataset_index, on the columns that every dataset has; exempt prefixes stay and are null where missing."""
    shared = set.intersection(*[set(d.columns) for d in datasets])
    if not shared:
        raise ValueError("the datasets have no column in common")
    kept = lambda c: c in shared or c.startswith(exempt)
    parts = [d.select(*[f"`{c}`" for c in d.columns if kept(c)]).withColumn("dataset_index", F.lit(i)) for i, d in enumerate(datasets)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def feature_counts(features: DataFrame) -> DataFrame:
    """(feature, n, total): how many of all datasets have each feature."""
    total = features.agg(F.countDistinct("dataset_id").alias("total"))
    return features.groupBy("feature").agg(F.countDistinct("dataset_id").alias("n")).crossJoin(F.broadcast(total))


def feature_difference(features: DataFrame) -> DataFrame:
    """(dataset_id, feature) of features that not all datasets have."""
    partial = feature_counts(features).where("n < total").select("feature")
    return features.join(partial, "feature", "left_semi").select("dataset_id", "feature").distinct()


def feature_intersection(features: DataFrame) -> DataFrame:
    return feature_counts(features).where("n = total").select("feature")


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by arrival."""
    first = df.groupBy(key).agg(F.min(order).alias(order))
    return df.join(first, [key, order], "left_semi")


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with their first position."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def ordered_known(df: DataFrame, key: str, order: str, known: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct keys with their place (1..) in the order of arrival, and whether each is known; ``strict`` fails on unknown ones."""
    distinct = ordered_distinct(df, key, order).join(known.select(key, F.lit(True).alias("known")), key, "left")
    out = places(distinct, [order, key]).select(key, (F.col("place") + 1).alias("place"), F.coalesce("known", F.lit(False)).alias("known"))
    return out.where(F.assert_true("known", F.concat(F.lit("unknown: "), F.col(key))).isNull()) if strict else out


def prompt_coverage(catalog: DataFrame, prompts: DataFrame, prompt: str, dataset: str) -> DataFrame:
    """(prompt, datasets, missing, lacking, unique_total): in how many datasets each prompt stands and the names of those that lack it, in order.

    A catalogue's names are one row; a dataset without any prompt lacks all (``without_prompts``).
    """
    every = catalog.agg(F.array_sort(F.collect_set(dataset)).alias("__all"))
    each = prompts.groupBy(prompt).agg(F.collect_set(dataset).alias("__own"))
    totals = each.agg(F.count(F.lit(1)).alias("unique_total"))
    lacking = F.array_except("__all", "__own")
    return each.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(totals)).select(prompt, F.size("__own").cast("long").alias("datasets"), F.size(lacking).cast("long").alias("missing"), lacking.alias("lacking"), "unique_total")


def without_prompts(catalog: DataFrame, prompts: DataFrame, prompt: str, dataset: str) -> DataFrame:
    """The catalogue's rows of datasets that have no prompt, or only empty ones."""
    return catalog.join(prompts.where(F.trim(prompt) != "").select(dataset).distinct(), dataset, "left_anti")
