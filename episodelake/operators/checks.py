"""Filters and data-quality rules; each report says what is wrong, nothing is dropped silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def episode_ids(spark: SparkSession, wanted: list[int | list[int]]) -> DataFrame:
    """episode_index of ints and inclusive [start, end] ranges."""
    spans = [(w, w) if isinstance(w, int) else (w[0], w[1]) for w in wanted]
    rows = spark.createDataFrame(spans, "a long, b long")
    return rows.select(F.explode(F.sequence("a", "b")).alias("episode_index")).distinct()


def keep_episodes(df: DataFrame, wanted: list[int | list[int]]) -> DataFrame:
    """Rows of the wanted episodes; range bounds are pushed to the scan."""
    tests = [F.col("episode_index") == w if isinstance(w, int) else F.col("episode_index").between(*w) for w in wanted]
    return df.where(reduce(lambda a, b: a | b, tests)) if tests else df.limit(0)


def unpadded(df: DataFrame, mask: str = "is_pad") -> DataFrame:
    return df.where(~F.exists(mask, lambda x: x))


def timestamp_offenders(df: DataFrame, keys: list[str], order: str, ts: str, period: float, tolerance: float) -> DataFrame:
    """Frames whose distance to the one before, in the same episode, is off the period by more than the tolerance."""
    gap = F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("gap", gap).where(F.abs(F.col("gap") - period) > tolerance)


def off_grid(seconds: Column, fps: Column, tolerance: float) -> Column:
    """Whether a time is no multiple of 1/fps within the tolerance."""
    frames = seconds * fps
    return F.abs(frames - F.bround(frames)) / fps > tolerance


def feature_presence(have: DataFrame, spec: DataFrame) -> DataFrame:
    """(dataset, feature, problem): features missing from a dataset, in excess of the spec, or with '/' in the name."""
    # a dataset's own features and the spec's as one array each: both are as long as a dataset is wide
    names = spec.agg(F.collect_set("feature").alias("__spec"))
    own = have.groupBy("dataset_id").agg(F.collect_set("feature").alias("__own"))
    missing = own.crossJoin(F.broadcast(names)).select("dataset_id", F.explode(F.array_except("__spec", "__own")).alias("feature")).withColumn("problem", F.lit("missing"))
    extra = have.select("dataset_id", "feature").join(spec, "feature", "left_anti").select("dataset_id", "feature", F.lit("extra").alias("problem"))
    slash = have.where(F.col("feature").contains("/")).select("dataset_id", "feature", F.lit("slash").alias("problem"))
    return missing.unionByName(extra).unionByName(slash)


def width_errors(df: DataFrame, vector: str, expected: Column) -> DataFrame:
    """Rows whose vector has another width, with got and expected."""
    return df.withColumns({"got": F.size(vector), "expected": expected}).where(F.col("got") != F.col("expected"))


#: Spark's type names of the dtypes that a feature may declare.
DTYPES = {"float32": "float", "float64": "double", "int64": "long", "int32": "integer", "bool": "boolean", "string": "string", "image": "binary"}


def declared_dtype_errors(df: DataFrame, spec: dict[str, dict]) -> list[str]:
    """What the schema has against the spec {feature: {dtype, shape}}: missing features, other dtypes, other depths of arrays."""
    errors = []
    for name, want in spec.items():
        if name not in df.columns:
            errors.append(f"{name}: missing")
            continue
        kind, depth = df.schema[name].dataType, 0
        while kind.typeName() == "array":
            kind, depth = kind.elementType, depth + 1
        wanted = "double" if want["dtype"] == "image" and depth else DTYPES.get(want["dtype"], want["dtype"])
        if want["dtype"] == "image" and depth and kind.typeName() not in ("float", "double", "short", "integer"):
            errors.append(f"{name}: {kind.typeName()} is no pixel type")
        elif want["dtype"] != "image" and kind.typeName() != wanted:
            errors.append(f"{name}: {kind.typeName()} for {want['dtype']}")
        if want["dtype"] != "image" and depth != (0 if list(want["shape"]) == [1] else len(want["shape"])):
            errors.append(f"{name}: {depth} levels of arrays for the shape {list(want['shape'])}")
    return errors


def image_shape(pixels: Column) -> Column:
    """Sizes of a three-level array; -1 where rows or channels differ in size, which no shape has."""
    rows = F.flatten(pixels)
    even = lambda a: F.when(F.size(F.array_distinct(F.transform(a, lambda x: F.size(x)))) == 1, F.size(F.element_at(a, 1))).otherwise(-1)
    return F.array(F.size(pixels), even(pixels), even(rows))


def image_shape_ok(pixels: Column, channels: int, height: int, width: int) -> Column:
    """Whether a three-level array is of the shape channels x height x width, or of height x width x channels."""
    made = image_shape(pixels)
    either = [made == F.array(*map(F.lit, shape)) for shape in ((channels, height, width), (height, width, channels))]
    return F.coalesce(either[0] | either[1], F.lit(False))


def episode_integrity(df: DataFrame, episode: str, frame: str, index: str, offsets: DataFrame, required: list[str]) -> DataFrame:
    """Per episode: frames counted 0.. without gaps, the index starting at its offset, and no required column null."""
    nulls = F.count_if(sum((F.col(c).isNull().cast("int") for c in required), F.lit(0)) > 0)
    per = df.groupBy(episode).agg(F.count(F.lit(1)).alias("n"), F.min(frame).alias("lo"), F.max(frame).alias("hi"), F.countDistinct(frame).alias("distinct"), F.min(index).alias("first_index"), nulls.alias("null_rows"))
    joined = per.join(offsets.select(episode, "from_index"), episode, "left")
    gapless = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("distinct") == F.col("n"))
    return joined.select(episode, "n", gapless.alias("gapless"), F.coalesce(F.col("first_index") == F.col("from_index"), F.lit(False)).alias("index_ok"), "null_rows")


def equal_lengths(required: list[str], optional: tuple[str, ...] = ()) -> Column:
    """Whether the arrays are all there and equally long; of ``optional`` ones (first wins) one counts if it is there."""
    sizes = [F.size(a) for a in required]
    if optional:
        sizes.append(F.coalesce(*[F.when(F.col(a).isNotNull(), F.size(a)) for a in optional], sizes[0]))
    return F.coalesce(F.greatest(*sizes) == F.least(*sizes), F.lit(False)) & (F.least(*sizes) >= 0)


def equal_counts(counts: list[Column]) -> Column:
    """Whether the counted rows of all parts of an episode are there and equal."""
    return F.coalesce((F.greatest(*counts) == F.least(*counts)) & (F.least(*counts) > 0), F.lit(False)) & F.forall(F.array(*counts), lambda c: c.isNotNull())


def reconcile(actual: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts in files (rows) against metadata (rows); either side may miss a key."""
    a, d = actual.withColumnRenamed("rows", "actual"), declared.withColumnRenamed("rows", "declared")
    return a.join(d, keys, "full").withColumn("ok", F.coalesce(F.col("actual") == F.col("declared"), F.lit(False)))


def equal_ranks(df: DataFrame, rank: str) -> DataFrame:
    """(rank, actual, declared, ok): the rows of each rank against those of the first one; all ranks must have as many."""
    counts = df.groupBy(rank).agg(F.count(F.lit(1)).alias("actual"))
    first = counts.agg(F.min_by("actual", rank).alias("declared"))
    return counts.crossJoin(F.broadcast(first)).withColumn("ok", F.col("actual") == F.col("declared"))


def path_problems(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """(pos, path, problem) of a catalogue's empty, repeated and missing entries."""
    first = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    seen = paths.withColumn("r", first).join(existing.select("path", F.lit(True).alias("there")), "path", "left")
    problem = F.when(F.trim("path") == "", "empty").when(F.col("r") > 1, "duplicate").when(F.col("there").isNull(), "missing")
    return seen.withColumn("problem", problem).where("problem is not null").select("pos", "path", "problem")
