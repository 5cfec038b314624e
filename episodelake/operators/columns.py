"""Projections on frame rows: naming, slicing, joining and splitting vectors, nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_COLUMNS = ["episode_index", "frame_index", "index", "timestamp"]
PREFIX = {"state": "observation.state", "action": "action", "images": "observation.images"}
#: Named groups of the 25-wide action layout, in order.
ACTION_GROUPS = {"base": 3, "torso": 4, "left_arm": 7, "left_gripper": 1, "right_arm": 7, "right_gripper": 1, "head": 2}


def required_columns(df: DataFrame, features: list[str]) -> DataFrame:
    """Index columns and the asked features; the scan reads no others."""
    return df.select(*INDEX_COLUMNS, *[f for f in features if f not in INDEX_COLUMNS])


def feature_key(kind: Column, key: Column) -> Column:
    """Full name of a feature: kind 'state', 'action' or 'images' and a key; 'default' names the kind itself."""
    full = reduce(lambda c, k: c.when(kind == k[0], F.lit(k[1])), list(PREFIX.items())[1:], F.when(kind == "state", F.lit(PREFIX["state"])))
    return F.when(key == "default", full).otherwise(F.concat(full, F.lit("."), key))


def canonical_names(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Source names become canonical ones, with their ``_is_pad`` twins; a column that already has the canonical name wins."""
    have, renames = set(df.columns), {}
    for alias, name in aliases.items():
        for end in ("", "_is_pad"):
            if alias + end in have and name + end not in have:
                renames[alias + end] = name + end
                have.add(name + end)
    dropped = [a + e for a in aliases for e in ("", "_is_pad") if a + e in df.columns and a + e not in renames]
    return df.drop(*dropped).withColumnsRenamed(renames)


def detect_source(root: Column, aliases: list[str]) -> Column:
    """The first alias that the lower-cased root contains, else null."""
    return F.coalesce(*[F.when(F.lower(root).contains(a), F.lit(a)) for a in aliases])


def cut_to(vector: Column, width: Column | int) -> Column:
    """The first ``width`` numbers of a vector that is longer."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(F.size(vector) > width, F.slice(vector, 1, width)).otherwise(vector)


def concat_left_align(parts: list[Column], width: int) -> tuple[Column, Column]:
    """(parts joined and padded with zeros on the right, which dimensions are padding)."""
    whole = F.concat(*parts)
    missing = F.greatest(F.lit(0), F.lit(width) - F.size(whole))
    padded = F.concat(whole, F.array_repeat(F.lit(0.0), missing))
    return padded, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i >= F.size(whole))


def split_vector(vector: Column, widths: dict[str, int]) -> Column:
    """A struct of named slices, one after the other; what is left over is dropped."""
    at, fields = 1, []
    for name, n in widths.items():
        fields.append(F.slice(vector, at, n).alias(name))
        at += n
    return F.struct(*fields)


def build_state(groups: list[Column], velocity: Column, origin: Column, mode: Column) -> Column:
    """The groups in a row, the first one as velocity in modes with 'vel', else relative to the origin."""
    first = F.when(mode.contains("vel"), velocity).otherwise(F.zip_with(groups[0], origin, lambda a, b: a - b))
    return F.concat(first, *groups[1:])


def flatten_columns(schema: T.StructType, prefix: str = "", sep: str = "/") -> list[tuple[str, str]]:
    """(path for col(), flat name) of every leaf of a nested schema."""
    out = []
    for f in schema.fields:
        path, flat = f"{prefix}`{f.name}`", (prefix.replace("`", "").replace(".", sep)) + f.name
        out += flatten_columns(f.dataType, f"{path}.", sep) if isinstance(f.dataType, T.StructType) else [(path, flat)]
    return out


def flatten_nested(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested records as flat columns a/b/c."""
    return df.select(*[F.col(p).alias(n) for p, n in flatten_columns(df.schema, sep=sep)])


def unflatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Columns a/b/c as nested records again."""
    tree: dict = {}
    for name in df.columns:
        at = tree
        *above, leaf = name.split(sep)
        for p in above:
            at = at.setdefault(p, {})
        at[leaf] = F.col(f"`{name}`")

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return df.select(*build(tree))


def gripper(vector: Column, mode: str) -> Column:
    """The last number of a vector as a gripper command: 'scale' (2x-1), 'negate', 'sign' or 'binary' (x > 0.5)."""
    last = F.element_at(vector, -1)
    new = {"scale": last * 2 - 1, "negate": -last, "sign": F.signum(last), "binary": (last > 0.5).cast("double")}[mode]
    return F.concat(F.slice(vector, 1, F.size(vector) - 1), F.array(new))


def drop_last(window: Column) -> Column:
    return F.slice(window, 1, F.greatest(F.size(window) - 1, F.lit(0)))


def zero_padded(window: Column, is_pad: Column, dims: Column) -> Column:
    """Zeros in the masked dimensions of the steps that are padding."""
    return F.zip_with(window, is_pad, lambda step, pad: F.zip_with(step, dims, lambda x, m: F.when(pad & m, 0.0).otherwise(x)))


def zero_masked(context: Column, mask: Column) -> Column:
    """Zeros in the rows of a matrix whose mask is false."""
    return F.zip_with(context, mask, lambda row, ok: F.when(ok, row).otherwise(F.transform(row, lambda x: F.lit(0.0))))


def stats_fields(wide: DataFrame) -> DataFrame:
    """Long statistics (…, scope, stat, value) of wide ones: q01 and q99 fall back to min and max, global is copied to stepwise."""
    names = ["min", "max", "mean", "std", "q01", "q99"]
    full = wide.withColumns({"q01": F.coalesce("q01", "min"), "q99": F.coalesce("q99", "max")})
    keys = [c for c in wide.columns if c not in names]
    long = full.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in names])).alias("s")).select(*keys, "s.stat", "s.value")
    return long.withColumn("scope", F.explode(F.array(F.lit("global"), F.lit("stepwise"))))


def parent_key(key: Column) -> Column:
    """observation.state.left -> observation.state, for statistics that only the parent has."""
    return F.regexp_replace(key, r"\.[^.]*$", "")


def with_parent_stats(features: DataFrame, stats: DataFrame) -> DataFrame:
    """The statistics rows of each wanted feature (column feature), or of its parent key where it has none; ``found`` names the key used.

    A feature without either has one row with null statistics. ``stats`` is one row per feature and statistic.
    """
    keys = features.select("feature", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("feature").alias("found")), F.struct(F.lit(1).alias("rank"), parent_key(F.col("feature")).alias("found")))).alias("k")).select("feature", "k.rank", "k.found")
    there = keys.join(stats.select(F.col("feature").alias("found")).distinct(), "found", "left_semi")
    best = features.join(there.groupBy("feature").agg(F.min_by("found", "rank").alias("found")), "feature", "left")
    return best.join(stats.withColumnRenamed("feature", "found"), "found", "left")


def norm_source(setting: str, source: Column, root: Column, pretrained: list[str]) -> Column:
    """'meta' or 'pretrained' statistics; 'mixed' asks the source, then the root's name."""
    if setting != "mixed":
        return F.lit(setting)
    named = F.lit(False)
    for p in pretrained:
        named = named | F.lower(root).contains(p)
    return F.when(source.isin(pretrained), "pretrained").when(source.isNull() & named, "pretrained").otherwise("meta")


def merge_specs(specs: DataFrame, strict: bool = True) -> DataFrame:
    """Feature specs (feature, pos, dtype, n_dims, name) of many datasets as one: feature, name, at, dtype.

    A feature that is a vector (n_dims 1) everywhere has the names of all, in
    the order in which they are first seen, and a clash of dtypes is an error,
    or without ``strict`` marked in dtype_clash. Of any other feature the last
    dataset's spec counts as it is.
    """
    whole = specs.groupBy("feature").agg((F.countDistinct("dtype") > 1).alias("clash"), F.max_by("dtype", "pos").alias("dtype"), F.max("pos").alias("last"), F.bool_and(F.col("n_dims") == 1).alias("vector"))
    first = specs.groupBy("feature", "name").agg(F.min("pos").alias("pos"), F.max("pos").alias("newest")).join(whole, "feature").where("vector or newest = last")
    order = F.row_number().over(Window.partitionBy("feature").orderBy("pos", "name")) - 1
    clash = F.col("vector") & F.col("clash")
    out = first.withColumn("at", order).withColumn("dtype_clash", clash)
    if strict:
        return out.where(F.assert_true(~F.col("dtype_clash"), F.concat(F.lit("dtypes clash in "), "feature")).isNull()).select("feature", "name", "at", "dtype")
    return out.select("feature", "name", "at", "dtype", "dtype_clash")
