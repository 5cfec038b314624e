"""Queries of the rotations; their SQL is generated from the formulas, which the tests hold against numpy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodelake.functions import rotations as R
from episodelake.lenses import frames, sql, vectors
from episodelake.paths import scratch
from episodelake.plans.projections import numbers, r6
from episodelake.registry import query


class Sql(str):
    """A SQL expression with arithmetic."""

    def __add__(self, o: str) -> Sql:
        return Sql(f"({self} + {o})")

    def __sub__(self, o: str) -> Sql:
        return Sql(f"({self} - {o})")

    def __mul__(self, o: str) -> Sql:
        return Sql(f"({self} * {o})")

    def __truediv__(self, o: str) -> Sql:
        return Sql(f"({self} / {o})")

    def __lt__(self, o: str) -> Sql:
        return Sql(f"({self} < {o})")

    def __ge__(self, o: str) -> Sql:
        return Sql(f"({self} >= {o})")


def _call(name: str) -> Callable[..., Sql]:
    return lambda *a: Sql(f"{name}({', '.join(a)})")


class SqlMath:
    sqrt, sin, cos, asin, acos, atan2, greatest, least = (staticmethod(_call(n)) for n in ("sqrt", "sin", "cos", "asin", "acos", "atan2", "greatest", "least"))

    @staticmethod
    def when(cond: str, yes: str, no: str) -> Sql:
        return Sql(f"CASE WHEN {cond} THEN {yes} ELSE {no} END")

    @staticmethod
    def num(x: float) -> Sql:
        return Sql(f"CAST({x!r} AS double)")


S = SqlMath
#: q is the unit quaternion (real first), p the position, v the rotation as three small angles, o the next row's q.
UNIT_SQL = """a AS (SELECT vec_id, label, pose7, sqrt(pose7[4] ** 2 + pose7[5] ** 2 + pose7[6] ** 2 + pose7[7] ** 2) AS n FROM vectors),
u AS (SELECT vec_id, label, pose7[1:3] AS p, [pose7[7] / n, pose7[4] / n, pose7[5] / n, pose7[6] / n] AS q, pose7[4:6] AS v, pose7[1:6] AS d FROM a)"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pose7")
    n = F.sqrt(R.dot(R.parts(p, 4, 3), R.parts(p, 4, 3)))
    v = vectors(spark, sf).select("vec_id", "label", "pose7", n.alias("n"))
    q = F.array(p[6] / F.col("n"), p[3] / F.col("n"), p[4] / F.col("n"), p[5] / F.col("n"))
    return v.select("vec_id", "label", F.slice("pose7", 1, 3).alias("p"), q.alias("q"), F.slice("pose7", 4, 3).alias("v"), F.slice("pose7", 1, 6).alias("d"))


def steps(name: str, column: str, width: int, stages: list[Callable]) -> None:
    """Registers the stages over a column of ``width`` numbers; in SQL every stage is a named query."""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        made = R.staged(F.col(column), R.stage_widths(width, stages), stages)
        return numbers(units(spark, sf).withColumn("r", made), ["vec_id"], "r")

    texts, n = [f"s0 AS (SELECT vec_id, {column} AS r FROM u)"], width
    for i, f in enumerate(stages):
        made = f([Sql(f"r[{k + 1}]") for k in range(n)], S)
        texts.append(f"s{i + 1} AS (SELECT vec_id, [{', '.join(made)}] AS r FROM s{i})")
        n = len(made)
    body = f"{UNIT_SQL}, {', '.join(texts)} SELECT vec_id, CAST(i AS bigint) AS pos, round(r[i + 1], 6) + 0.0 AS x FROM s{len(stages)}, LATERAL unnest(range(0, {n})) t(i)"
    query(sql("vectors", body), name)(build)


MATRIX = R.quat_to_matrix
steps("rot_quat_to_matrix", "q", 4, [MATRIX])
steps("rot_matrix_to_quat", "q", 4, [MATRIX, *R.MATRIX_TO_QUAT])
steps("rot_euler_to_matrix", "v", 3, [lambda a, m: [x for c in R.CONVENTIONS for x in R.euler_to_matrix(a, c, m)]])
steps("rot_matrix_to_euler", "q", 4, [MATRIX, lambda r, m: [x for c in R.CONVENTIONS for x in R.matrix_to_euler(r, c, m)]])
steps("rot_quat_standardize", "q", 4, [R.quat_standardize])
steps("rot_quat_multiply", "q", 4, [lambda q, m: [*q, *q[1:], q[0]], lambda x, m: [*R.quat_multiply(x[:4], x[4:]), *R.quat_standardize(R.quat_multiply(x[:4], x[4:]), m)]])
steps("rot_quat_invert", "q", 4, [R.quat_invert])
steps("rot_quat_apply", "q", 4, [lambda q, m: R.quat_apply(q, [m.num(1), m.num(-2), m.num(0.5)], m)])
steps("rot_axis_angle_to_quat", "v", 3, R.AXIS_ANGLE_TO_QUAT)
steps("rot_quat_to_axis_angle", "q", 4, R.QUAT_TO_AXIS_ANGLE)
steps("rot_axis_angle_matrix", "v", 3, [*R.conversion("axis_angle", "matrix"), *R.conversion("matrix", "axis_angle")])
steps("rot_6d_to_matrix", "d", 6, R.SIX_TO_MATRIX)
steps("rot_matrix_to_6d", "q", 4, [MATRIX, lambda r, m: R.matrix_to_six(r)])
steps("rot_6d_columns", "q", 4, [MATRIX, lambda r, m: R.matrix_to_six_columns(r), *R.SIX_COLUMNS_TO_MATRIX])
steps("rot_quat_xyzw_axisangle", "q", 4, [lambda q, m: R.xyzw_to_axis_angle([*q[1:], q[0]], m)])


def stage_sql(start: str, width: int, stages: list[Callable], name: str) -> tuple[str, str, int]:
    """(named queries from the array ``start`` of u through the stages, the last one's name, its width)."""
    texts, n = [f"{name}0 AS (SELECT vec_id, {start} AS r FROM u)"], width
    for i, f in enumerate(stages):
        made = f([Sql(f"r[{k + 1}]") for k in range(n)], S)
        texts.append(f"{name}{i + 1} AS (SELECT vec_id, [{', '.join(made)}] AS r FROM {name}{i})")
        n = len(made)
    return ", ".join(texts), f"{name}{len(stages)}", n


POSE_FORMS = ["axis_angle", "rotation_6d", "rotation_9d", "euler_xyz", "euler_yzy"]


def _pose_sql() -> str:
    """Each form of a pose between its position and a gripper; on the way back every form gives the standard quaternion."""
    texts, rows = [], []
    for k, form in enumerate(POSE_FORMS):
        text, last, n = stage_sql("q", 4, [R.quat_to_matrix, *R.pose_stages(form)[2]], f"p{k}_")
        texts.append(text)
        rows.append(f"SELECT vec_id, '{form}' AS form, list_concat(p, r, [0.25::double]) AS r FROM u JOIN {last} USING (vec_id)")
    back = "SELECT vec_id, unnest([%s]) AS form, list_concat(p, list_transform([q[2], q[3], q[4], q[1]], lambda x: x * CASE WHEN q[1] < 0 THEN -1 ELSE 1 END), [0.25::double]) AS r FROM u" % ", ".join(f"'{f} back'" for f in POSE_FORMS)
    return f"{UNIT_SQL}, {', '.join(texts)}, o AS ({' UNION ALL '.join([*rows, back])}) SELECT vec_id, form, CAST(i AS bigint) AS pos, round(r[i + 1], 5) + 0.0 AS x FROM o, LATERAL unnest(range(0, len(r))) t(i)"


@query(sql("vectors", _pose_sql()))
def rot_pose_convert(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    pose = u.select("vec_id", F.concat("p", F.slice("q", 2, 3), F.slice("q", 1, 1), F.array(F.lit(0.25))).alias("pose"))
    # one table of all forms cuts the expressions in two; nested, they take longer to compile than to run
    path = scratch(spark, "poses")
    pose.select("vec_id", *[R.convert_pose(F.col("pose"), *R.named_conversion(f)).alias(f) for f in POSE_FORMS]).write.parquet(path)
    there = spark.read.parquet(path).select("*", *[R.convert_pose(F.col(f), *R.named_conversion(f"{f}_to_quaternion")).alias(f"{f} back") for f in POSE_FORMS])
    forms = F.array(*[F.struct(F.lit(f).alias("form"), F.col(f).alias("r")) for f in there.columns[1:]])
    rows = there.select("vec_id", F.explode(forms).alias("f")).select("vec_id", "f.form", F.posexplode("f.r").alias("pos", "x"))
    return rows.withColumns({"pos": F.col("pos").cast("long"), "x": F.round("x", 5) + F.lit(0.0)})


@query()
def rot_9d_to_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", R.nearest_rotation(F.slice("v", 1, 9)).alias("r"))


def _noise_sql() -> str:
    unit = lambda i, j: f"CAST(concat('0x', substr(md5(concat('11:', {2 * i + j}, ':', CAST(vec_id AS varchar))), 1, 8)) AS bigint) / 4294967296.0::double"
    noise = [f"sqrt(-2 * ln(1 - {unit(i, 0)})) * cos(2 * pi() * {unit(i, 1)}) * {sd}::double" for i, sd in enumerate([0.01] * 3 + [0.05] * 3)]
    over = [*R.pose_stages("axis_angle")[1], *R.pose_stages("axis_angle")[2]]
    first, last, _ = stage_sql("v", 3, over, "a")
    second, end, _ = stage_sql("r", 3, over, "b")
    second = second.replace("FROM u)", "FROM n)", 1)
    return f"""{UNIT_SQL}, {first}, n AS (SELECT vec_id, [{', '.join(f'r[{i + 1}] + {noise[3 + i]}' for i in range(3))}] AS r FROM {last}), {second},
o AS (SELECT vec_id, list_concat([{', '.join(f'p[{i + 1}] + {noise[i]}' for i in range(3))}], r, [0.25::double]) AS r FROM u JOIN {end} USING (vec_id)) SELECT vec_id, CAST(i AS bigint) AS pos, round(r[i + 1], 5) + 0.0 AS x FROM o, LATERAL unnest(range(0, 7)) t(i)"""


@query(sql("vectors", _noise_sql()))
def rot_pose_noise(spark: SparkSession, sf: str) -> DataFrame:
    pose = F.concat("p", "v", F.array(F.lit(0.25)))
    noisy = units(spark, sf).withColumn("r", R.pose_noise(pose, F.col("vec_id"), 0.01, 0.05, 11)).select("vec_id", F.posexplode("r").alias("pos", "x"))
    return noisy.withColumns({"pos": F.col("pos").cast("long"), "x": F.round("x", 5) + F.lit(0.0)})


_relative = R.relative_pose([Sql(f"b[{i}]") for i in range(1, 8)], [Sql(f"w[{i}]") for i in range(1, 8)], S)


@query(sql("vectors", f"""{UNIT_SQL}, w AS (SELECT vec_id, list_concat(p, q) AS w, last_value(list_concat(p, q)) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS b FROM u),
r AS (SELECT vec_id, [{', '.join(_relative)}] AS r FROM w) SELECT vec_id, CAST(i AS bigint) AS pos, round(r[i + 1], 6) + 0.0 AS x FROM r, LATERAL unnest(range(0, 7)) t(i)"""))
def rot_relative_pose(spark: SparkSession, sf: str) -> DataFrame:
    window = Window.partitionBy("label").orderBy("vec_id").rowsBetween(0, 3)
    w = units(spark, sf).select("vec_id", "label", F.concat("p", "q").alias("w")).withColumn("b", F.last("w").over(window))
    r = F.array(*R.relative_pose(R.parts(F.col("b"), 7), R.parts(F.col("w"), 7)))
    return numbers(w.withColumn("r", r), ["vec_id"], "r")


@query(sql("frames", """SELECT index, round(value - first_value(value) OVER w, 6) + 0.0 AS relative, round(value, 6) + 0.0 AS back
FROM frames WINDOW w AS (PARTITION BY episode_index, CAST(floor(frame_index / 8) AS bigint) ORDER BY frame_index)"""))
def rot_relative_joint(spark: SparkSession, sf: str) -> DataFrame:
    window = Window.partitionBy("episode_index", F.floor(F.col("frame_index") / 8)).orderBy("frame_index")
    f = frames(spark, sf).withColumn("first", F.first("value").over(window))
    relative: Column = F.zip_with(F.array("value"), F.array("first"), lambda a, b: a - b)
    f = f.withColumn("rel", relative)
    return f.select("index", r6(F.col("rel")[0]).alias("relative"), r6(F.zip_with("rel", F.array("first"), lambda a, b: a + b)[0]).alias("back"))
