"""Training samples: a row with all that a step of training takes, for each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodelake.functions.scalars import prompt_key
from episodelake.operators.columns import zero_masked
from episodelake.operators.joins import with_context


def training_samples(frames: DataFrame, cache: DataFrame, prompt: Column, action: str, state: str, width: int, every: int, keys: list[str], order: str, length: int, encoder: str, strict: bool = True) -> DataFrame:
    """The frames with their windows, masks, prompt and context.

    Added columns: action and proprio, the vectors of the width - 1 steps from
    the frame on, the episode's last one held past its end; action_is_pad for
    these steps, proprio_is_pad for all ``width`` and image_is_pad for every
    ``every``-th of them; prompt; context, ``length`` vectors from the cache
    (key, context, mask), zero where the prompt has no token; context_mask, all
    true. Images stay where they are: a reader takes every ``every``-th frame
    from the frame on. The steps must divide into ``every``; a prompt that the
    cache lacks is an error unless ``strict`` is off (``with_context``).

    One window over each episode makes all of it, so frames are shuffled once.
    """
    if (width - 1) % every:
        raise ValueError(f"{width - 1} steps do not divide into {every}")
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, width - 1)
    held = frames.withColumn("__w", F.collect_list(F.struct(F.col(action).alias("a"), F.col(state).alias("s"))).over(ahead))
    steps = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    taken = lambda name: F.transform(steps(width - 1), lambda i: F.get("__w", F.least(i, F.size("__w") - 1))[name])
    pads = F.transform(steps(width), lambda i: i >= F.size("__w"))
    made = held.select(
        *frames.columns, taken("a").alias("__action"), taken("s").alias("__proprio"), F.slice(pads, 1, width - 1).alias("action_is_pad"), pads.alias("proprio_is_pad"), F.filter(pads, lambda _, i: i % every == 0).alias("image_is_pad"), prompt.alias("prompt")
    )
    named = made.drop(action, state).withColumnsRenamed({"__action": "action", "__proprio": "proprio"}).withColumn("key", prompt_key(F.col("prompt"), length, encoder))
    found = with_context(named, cache, "key", length, strict)
    return found.withColumns({"context": zero_masked(F.col("context"), F.col("mask")), "context_mask": F.transform("mask", lambda _: F.lit(True))}).drop("mask", "key")


def without_padding(samples: DataFrame) -> DataFrame:
    """Samples whose windows lie inside their episode."""
    padded = F.exists("action_is_pad", lambda p: p) | F.exists("proprio_is_pad", lambda p: p) | F.exists("image_is_pad", lambda p: p)
    return samples.where(~padded)
