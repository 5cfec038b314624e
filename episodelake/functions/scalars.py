"""Column functions on text, numbers and arrays, all on the JVM but for two."""

from __future__ import annotations

import html
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the prompt format.
PROMPT = "A video recorded from a robot's point of view executing the following instruction: {task}"
DATA_V21 = "data/chunk-%03d/episode_%06d.parquet"
DATA_V3 = "data/chunk-%03d/file-%03d.parquet"
VIDEO_V21 = "videos/chunk-%03d/%s/episode_%06d.mp4"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


def prompt_template(task: Column, override: Column | None = None, template: str = PROMPT) -> Column:
    before, after = template.split("{task}")
    return F.concat(F.lit(before), task if override is None else F.coalesce(override, task), F.lit(after))


def bilingual_variants(task: Column) -> Column:
    """Both sides of the first '@', trimmed, without empty ones and repeats; the whole text if there is none."""
    return F.array_distinct(F.filter(F.transform(F.split(task, "@", 2), lambda x: F.trim(x)), lambda x: x != ""))


def has_more_sides(task: Column) -> Column:
    """Whether a task has a second '@', which only the first split ignores."""
    return F.size(F.split(task, "@")) > 2


def augment(high: Column, low: Column, u: Column, p: Column | float, first_side: Column | bool = False, prefixed: bool = False) -> Column:
    """'[High]: h, [Low]: l' where u >= p, else the low text alone; without a low text '[high] h'.

    Of a low text with '@' one side stands: that before the first '@' where
    ``first_side``, else that after it. ``prefixed`` is the variant that puts
    '[Low]: ' before a low text that stands alone. A missing high text is empty.
    """
    h, sides = F.coalesce(high, F.lit("")), F.split(low, "@", 2)
    side = F.when(F.size(sides) < 2, low).when(F.lit(first_side) if isinstance(first_side, bool) else first_side, sides[0]).otherwise(F.try_element_at(sides, F.lit(2)))
    alone = F.concat(F.lit("[Low]: "), side) if prefixed else side
    return F.when(low.isNull(), F.concat(F.lit("[high] "), h)).when(u >= p, F.concat(F.lit("[High]: "), h, F.lit(", [Low]: "), side)).otherwise(alone)


def hash_unit(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the md5 of the columns; the same in any engine."""
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def prompt_key(prompt: Column, length: int, encoder: str) -> Column:
    return F.concat(F.sha2(prompt, 256), F.lit(f".t5_len{length}.{encoder}.pt"))


def whitespace_clean(text: Column, lower: bool = False) -> Column:
    out = F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))
    return F.lower(out) if lower else out


@F.pandas_udf(T.StringType())
def basic_clean(text: pd.Series) -> pd.Series:
    """HTML entities resolved twice, then trimmed; null stays null. Texts without '&' hold no entity and are trimmed by Arrow alone."""
    texts = pa.array(text, pa.large_string())
    some = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring(texts, "&"), False)))
    out = np.asarray(pc.utf8_trim_whitespace(texts).to_pandas(), object)
    out[some] = [html.unescape(html.unescape(t)).strip() for t in texts.take(pa.array(some)).to_pylist()]
    return pd.Series(out)


def canonicalize(text: Column, keep: str | None = None) -> Column:
    """'_' to space, punctuation deleted but for the exact string ``keep``, lower case, white space collapsed."""
    spaced = F.translate(text, "_", " ")
    if not keep:
        return whitespace_clean(F.lower(F.translate(spaced, PUNCTUATION, "")))
    parts = F.split(spaced, re.escape(keep), -1)
    return whitespace_clean(F.lower(F.array_join(F.transform(parts, lambda x: F.translate(x, PUNCTUATION, "")), keep)))


def pad_truncate(tokens: Column, n: int, pad: str = "<pad>") -> Column:
    """A struct (ids, mask) of exactly n tokens; texts that are too long have a full mask."""
    kept = F.slice(tokens, 1, n)
    ids = F.concat(kept, F.array_repeat(F.lit(pad), F.lit(n) - F.size(kept)))
    return F.struct(ids.alias("ids"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.size(kept)).alias("mask"))


def norm_scale(stats: Column, mode: str) -> Column:
    """A struct (scale, offset) such that x * scale + offset is normalised.

    Modes: 'z' (mean, std + 1e-8), 'minmax', 'quantile' (q01, q99) and a
    constant range 'LOW/HIGH' (each to -1..1). A range under 1e-4 gives scale 1
    and moves the low end to 0.
    """
    if mode == "z":
        scale = 1.0 / (stats["std"] + 1e-8)
        return F.struct(scale.alias("scale"), (-stats["mean"] * scale).alias("offset"))
    if "/" in mode:
        low, high = (F.lit(float(x)) for x in mode.split("/"))
    else:
        low, high = (stats["min"], stats["max"]) if mode == "minmax" else (stats["q01"], stats["q99"])
    flat = high - low < 1e-4
    scale = F.when(flat, 1.0).otherwise(2.0 / (high - low))
    return F.struct(scale.alias("scale"), F.when(flat, -low).otherwise(-1.0 - low * scale).alias("offset"))


def normalize(x: Column, scale: Column, offset: Column, clamp: float = 5.0) -> Column:
    """x * scale + offset, clamped; null stays null and NaN stays NaN."""
    y = x * scale + offset
    return F.when(y.isNull() | F.isnan(y), y).otherwise(F.greatest(F.lit(-clamp), F.least(F.lit(clamp), y)))


def normalize_windows(df: DataFrame, stats: DataFrame, keys: dict[str, str], mode: str, exceptions: dict[str, str] | None = None, stepwise: bool = False) -> DataFrame:
    """Each window column (steps of vectors) of ``keys`` (column -> key of its statistics) normalised.

    ``stats`` is wide: key, step (null for global ones), dim, min, max, mean,
    std, q01, q99; it is as small as the features are wide. A step or dimension
    that it lacks is left as it is. ``exceptions`` gives single keys a mode of
    their own; ``stepwise`` takes the statistics of each window step.
    """
    scope = stats.where(F.col("step").isNotNull() if stepwise else F.col("step").isNull())
    for column, key in keys.items():
        own = (exceptions or {}).get(key, mode)
        s = norm_scale(F.struct("min", "max", "mean", "std", "q01", "q99"), own)
        at = F.struct(F.coalesce("step", F.lit(0)).cast("int").alias("step"), F.col("dim").cast("int").alias("dim"))
        table = scope.where(F.col("key") == key).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), s.alias("v")))).alias("__scales"))

        def scaled(x: Column, step: Column, dim: Column) -> Column:
            place = F.struct((step if stepwise else F.lit(0)).cast("int").alias("step"), dim.cast("int").alias("dim"))
            found = F.try_element_at("__scales", place)
            return F.coalesce(normalize(x, found["scale"], found["offset"]), x)

        made = F.transform(column, lambda row, i: F.transform(row, lambda x, d: scaled(x, i, d)))
        df = df.crossJoin(F.broadcast(table)).withColumn(column, made).drop("__scales")  # one row
    return df


def denormalize(y: Column, scale: Column, offset: Column) -> Column:
    """Not clamped: it undoes normalize only inside the clamp."""
    return (y - offset) / scale


def wrap_angle(x: Column) -> Column:
    return F.atan2(F.sin(x), F.cos(x))


def format_duration(seconds: Column) -> Column:
    """05s, 02m05s or 01h02m05s, halves to even."""
    s = F.bround(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s < 60, F.format_string("%02ds", r)).when(s < 3600, F.format_string("%02dm%02ds", m, r)).otherwise(F.format_string("%02dh%02dm%02ds", h, m, r))


def clock(seconds: Column) -> Column:
    """5.0s, 2:05 or 1:02:05; whole seconds are cut, not rounded, and negative times are 0."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    n = F.floor(s)
    h, m, r = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    return F.when(s < 60, F.format_string("%.1fs", s)).when(n < 3600, F.format_string("%d:%02d", m, r)).otherwise(F.format_string("%d:%02d:%02d", h, m, r))


def slug(text: Column, n: int = 50) -> Column:
    return F.substring(F.translate(F.lower(text), " \n.", "___"), 1, n)


LOG_LINE = r"done task=(\S+) phase=(\S+) gpu=(\d+) success_rate=([0-9.]+)"


def parse_log(text: Column) -> Column:
    """All result lines of a log as an array of (task, phase, gpu, success_rate)."""
    lines = F.regexp_extract_all(text, F.lit(f"({LOG_LINE})"), F.lit(1))
    part = lambda line, i: F.regexp_extract(line, LOG_LINE, i)
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("task"), part(x, 2).alias("phase"), part(x, 3).cast("int").alias("gpu"), part(x, 4).cast("double").alias("success_rate")))


#: The fields that a record of each kind has, by the names in the log, the first of which opens it; what they are called here if otherwise.
RECORD_FIELDS = {"train": ["epoch", "step", "loss", "loss_action", "loss_video", "lr"], "val": ["step", "val_loss", "infer_psnr", "infer_ssim", "action_l2", "action_l1"]}
RENAMED = {"infer_psnr": "psnr", "infer_ssim": "ssim"}
WHOLE_NUMBERS = {"epoch", "step"}


def parse_records(text: Column, kind: str) -> Column:
    """All 'train' or 'val' records of a log as an array of structs of numbers; a record may be wrapped over lines.

    A record begins at its first field's name and ends at the next such; it
    counts if it has all its fields as numbers, whatever stands between them.
    """
    fields = RECORD_FIELDS[kind]
    # the name comes first, what stands before it after: most places of a text fail at its first letter
    field = lambda name: f"{name}=(?<![A-Za-z0-9_]{name}=)([-+0-9.eE]+)"
    # most parts of the other kind lack a name, which is known without a pattern
    parts = F.filter(F.split(text, f"(?={fields[0]}=)(?<![A-Za-z0-9_])"), lambda part: reduce(lambda x, y: x & y, [part.contains(f"{name}=") for name in fields]))

    def number(part: Column, name: str) -> Column:
        return F.regexp_extract(part, field(name), 1).try_cast("long" if name in WHOLE_NUMBERS else "double").alias(RENAMED.get(name, name))

    records = F.transform(parts, lambda part: F.struct(*[number(part, name) for name in fields]))
    names = [RENAMED.get(name, name) for name in fields]
    return F.filter(records, lambda r: reduce(lambda x, y: x & y, [r[n].isNotNull() for n in names]))


def last_number_line(text: Column) -> Column:
    """The last line of a text that is a number, or null."""
    numbers = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return F.try_element_at(numbers, F.lit(-1))


def task_id_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"_task(\d+)_results\.json$", 1).try_cast("int")


def normalize_tag(text: Column, default: str) -> Column:
    return F.coalesce(F.translate(F.lower(F.trim(text)), "-", "_"), F.lit(default))


def psnr(a: Column, b: Column, peak: float, eps: float = 1e-8) -> Column:
    """10 log10(peak^2 / (mse + eps)) of two frames given as arrays."""
    mse = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return 10 * F.log10(F.lit(peak * peak) / (mse + eps))


def psnr_8bit(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """10 log10(255^2 / max(mse, eps)) of two frames of bytes."""
    mse = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return 10 * F.log10(F.lit(255.0 * 255.0) / F.greatest(mse, F.lit(eps)))


def data_path(chunk: Column, number: Column, version: str = "v2.1") -> Column:
    return F.format_string(DATA_V21 if version == "v2.1" else DATA_V3, chunk, number)


def video_path(chunk: Column, camera: Column, episode: Column) -> Column:
    return F.format_string(VIDEO_V21, chunk, camera, episode)


def describe_source(dataset: Column, episode: Column, frame: Column) -> Column:
    """One line that names where a row comes from."""
    return F.concat_ws(" ", F.concat(F.lit("dataset="), dataset), F.concat(F.lit("episode="), episode.cast("string")), F.concat(F.lit("frame="), frame.cast("string")))
