"""Rotations as expressions over components; quaternions are real part first, matrices nine numbers by rows.

Every function takes and returns lists of expressions and a namespace of
functions, so one formula serves Spark columns and generated SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodelake.functions.scalars import hash_unit

E = Any
AXES = "XYZ"
#: The twelve conventions: neighbouring letters differ.
CONVENTIONS = ["".join(c) for c in product(AXES, repeat=3) if c[0] != c[1] != c[2]]
SMALL = 1e-6


class SparkMath:
    """Functions of Spark columns."""

    sqrt, sin, cos, asin, acos, atan2, greatest, least = (staticmethod(f) for f in (F.sqrt, F.sin, F.cos, F.asin, F.acos, F.atan2, F.greatest, F.least))

    @staticmethod
    def when(cond: Column, yes: Column, no: Column) -> Column:
        return F.when(cond, yes).otherwise(no)

    @staticmethod
    def num(x: float) -> Column:
        return F.lit(float(x))


def dot(a: list[E], b: list[E]) -> E:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def cross(a: list[E], b: list[E]) -> list[E]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def matmul(a: list[E], b: list[E]) -> list[E]:
    return [dot(a[3 * i : 3 * i + 3], [b[j], b[3 + j], b[6 + j]]) for i in range(3) for j in range(3)]


def unit(v: list[E], m: Any = SparkMath) -> list[E]:
    n = m.sqrt(dot(v, v))
    return [x / n for x in v]


def quat_to_matrix(q: list[E], m: Any = SparkMath) -> list[E]:
    """Any length: the squares are scaled by 2 / |q|^2."""
    w, x, y, z = q
    s = m.num(2) / dot(q, q)
    one = m.num(1)
    return [
        one - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), one - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), one - s * (x * x + y * y),
    ]


def quat_standardize(q: list[E], m: Any = SparkMath) -> list[E]:
    """The one of q and -q with a real part of zero or more."""
    flip = m.when(q[0] < m.num(0), m.num(-1), m.num(1))
    return [x * flip for x in q]


def _quat_sizes(r: list[E], m: Any = SparkMath) -> list[E]:
    """A matrix and the doubled sizes of its quaternion's components."""
    signs = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]
    return [*r, *[m.sqrt(m.greatest(m.num(0), m.num(1) + r[0] * m.num(a) + r[4] * m.num(b) + r[8] * m.num(c))) for a, b, c in signs]]


def _quat_from_sizes(x: list[E], m: Any = SparkMath) -> list[E]:
    """The quaternion by its largest component, the first of equals; the divisor is 0.2 at least."""
    r, size = x[:9], x[9:]
    at = lambda i, j: r[3 * i + j]
    minus = [at(2, 1) - at(1, 2), at(0, 2) - at(2, 0), at(1, 0) - at(0, 1)]

    def numerators(k: int) -> list[E]:
        if k == 0:
            return [size[0] * size[0], *minus]
        i = k - 1
        return [minus[i]] + [size[k] * size[k] if j == i else at(i, j) + at(j, i) for j in range(3)]

    most = m.greatest(*size)
    picked = numerators(3)
    for k in (2, 1, 0):
        picked = [m.when(size[k] >= most, a, b) for a, b in zip(numerators(k), picked, strict=True)]
    half = m.num(2) * m.greatest(most, m.num(0.1))
    return [p / half for p in picked]


#: Stages of the conversions: each takes the numbers of the one before.
MATRIX_TO_QUAT = [_quat_sizes, _quat_from_sizes, quat_standardize]


def axis_matrix(axis: str, angle: E, m: Any = SparkMath) -> list[E]:
    """Rotation about one axis: cosines in the two other axes' rows, the sine positive below the diagonal in cyclic order."""
    i = AXES.index(axis)
    j, k = (i + 1) % 3, (i + 2) % 3
    out = [m.num(0)] * 9
    out[3 * i + i] = m.num(1)
    out[3 * j + j] = out[3 * k + k] = m.cos(angle)
    out[3 * k + j], out[3 * j + k] = m.sin(angle), m.num(0) - m.sin(angle)
    return out


def euler_to_matrix(angles: list[E], convention: str, m: Any = SparkMath) -> list[E]:
    """The product of three rotations about the convention's axes, left to right."""
    first, second, third = (axis_matrix(c, a, m) for c, a in zip(convention, angles, strict=True))
    return matmul(matmul(first, second), third)


def matrix_to_euler(r: list[E], convention: str, m: Any = SparkMath) -> list[E]:
    """Angles of the convention.

    With axes i, j, k and the sign e of their order, distinct outer axes give
    R[i][k] = e sin b, R[j][k] = -e sin a cos b, R[i][j] = -e cos b sin c; equal
    outer axes give R[i][i] = cos b, R[j][i] = sin a sin b, R[k][i] = -e cos a sin b.
    """
    i, j = AXES.index(convention[0]), AXES.index(convention[1])
    k = 3 - i - j
    e = m.num(1 if (j - i) % 3 == 1 else -1)
    at = lambda a, b: r[3 * a + b]
    bound = lambda x: m.greatest(m.num(-1), m.least(m.num(1), x))
    neg = lambda x: m.num(0) - x
    if convention[0] != convention[2]:
        return [m.atan2(neg(e * at(j, k)), at(k, k)), m.asin(bound(e * at(i, k))), m.atan2(neg(e * at(i, j)), at(i, i))]
    return [m.atan2(at(j, i), neg(e * at(k, i))), m.acos(bound(at(i, i))), m.atan2(at(i, j), e * at(i, k))]


def quat_multiply(a: list[E], b: list[E]) -> list[E]:
    real = a[0] * b[0] - dot(a[1:], b[1:])
    turn = cross(a[1:], b[1:])
    return [real, *[a[0] * b[i] + a[i] * b[0] + turn[i - 1] for i in (1, 2, 3)]]


def quat_invert(q: list[E], m: Any = SparkMath) -> list[E]:
    """The conjugate (of unit quaternions the inverse)."""
    return [q[0], *[m.num(0) - x for x in q[1:]]]


def quat_apply(q: list[E], point: list[E], m: Any = SparkMath) -> list[E]:
    return quat_multiply(quat_multiply(q, [m.num(0), *point]), quat_invert(q, m))[1:]


def _sine_ratio(angle: E, m: Any) -> E:
    """sin(angle / 2) / angle, by its series near zero."""
    size = m.greatest(angle, m.num(0) - angle)
    safe = m.when(size < m.num(SMALL), m.num(1), angle)
    return m.when(size < m.num(SMALL), m.num(0.5) - angle * angle / m.num(48), m.sin(safe / m.num(2)) / safe)


def _with_length(v: list[E], m: Any = SparkMath) -> list[E]:
    return [*v, m.sqrt(dot(v, v))]


def _quat_of_angle(x: list[E], m: Any = SparkMath) -> list[E]:
    ratio = _sine_ratio(x[3], m)
    return [m.cos(x[3] / m.num(2)), *[c * ratio for c in x[:3]]]


def _with_angle(q: list[E], m: Any = SparkMath) -> list[E]:
    return [*q[1:], m.num(2) * m.atan2(m.sqrt(dot(q[1:], q[1:])), q[0])]


def _axis_of_angle(x: list[E], m: Any = SparkMath) -> list[E]:
    ratio = _sine_ratio(x[3], m)
    return [c / ratio for c in x[:3]]


AXIS_ANGLE_TO_QUAT = [_with_length, _quat_of_angle]
QUAT_TO_AXIS_ANGLE = [_with_angle, _axis_of_angle]


def _first_row(d: list[E], m: Any = SparkMath) -> list[E]:
    return [*unit(d[:3], m), *d[3:6]]


def _second_row(d: list[E], m: Any = SparkMath) -> list[E]:
    along = dot(d[:3], d[3:])
    return [*d[:3], *[x - along * f for x, f in zip(d[3:], d[:3], strict=True)]]


def _second_unit(d: list[E], m: Any = SparkMath) -> list[E]:
    return [*d[:3], *unit(d[3:], m)]


def _third_row(d: list[E], m: Any = SparkMath) -> list[E]:
    return [*d, *cross(d[:3], d[3:])]


#: Two rows made orthonormal, the third their cross product.
SIX_TO_MATRIX = [_first_row, _second_row, _second_unit, _third_row]


def matrix_to_six(r: list[E]) -> list[E]:
    return r[:6]


def matrix_to_six_columns(r: list[E]) -> list[E]:
    """The other convention: the first two columns, interleaved by row."""
    return [r[0], r[1], r[3], r[4], r[6], r[7]]


def _interleaved(d: list[E], m: Any = SparkMath) -> list[E]:
    return [d[0], d[2], d[4], d[1], d[3], d[5]]


def transpose(r: list[E], m: Any = SparkMath) -> list[E]:
    return [r[3 * j + i] for i in range(3) for j in range(3)]


SIX_COLUMNS_TO_MATRIX = [_interleaved, *SIX_TO_MATRIX, transpose]


def xyzw_to_axis_angle(q: list[E], m: Any = SparkMath) -> list[E]:
    """From x, y, z, w with w clipped to -1..1: 2 acos(w) / sqrt(1 - w^2), zeros near the identity."""
    w = m.greatest(m.num(-1), m.least(m.num(1), q[3]))
    length = m.sqrt(m.num(1) - w * w)
    near = length < m.num(1e-8)
    scale = m.when(near, m.num(0), m.num(2) * m.acos(w) / m.when(near, m.num(1), length))
    return [x * scale for x in q[:3]]


#: Width of each form, the stages that make it a matrix and those that make it of one.
FORMS: dict[str, tuple[int, list[Callable], list[Callable]]] = {
    "quaternion": (4, [quat_to_matrix], MATRIX_TO_QUAT),
    "axis_angle": (3, [*AXIS_ANGLE_TO_QUAT, quat_to_matrix], [*MATRIX_TO_QUAT, *QUAT_TO_AXIS_ANGLE]),
    "rotation_6d": (6, SIX_TO_MATRIX, [lambda r, m=SparkMath: matrix_to_six(r)]),
    "matrix": (9, [], []),
} | {f"euler_{c.lower()}": (3, [lambda a, m=SparkMath, c=c: euler_to_matrix(a, c, m)], [lambda r, m=SparkMath, c=c: matrix_to_euler(r, c, m)]) for c in CONVENTIONS}


def conversion(source: str, target: str) -> list[Callable]:
    """The stages from one form to another over the matrix."""
    return [*FORMS[source][1], *FORMS[target][2]]


def relative_pose(base: list[E], pose: list[E], m: Any = SparkMath) -> list[E]:
    """inv(base) x pose, both (x, y, z, unit quaternion): the rigid inverse in closed form."""
    back = quat_invert(base[3:], m)
    moved = quat_apply(back, [p - b for p, b in zip(pose[:3], base[:3], strict=True)], m)
    return [*moved, *quat_standardize(quat_multiply(back, pose[3:]), m)]


def absolute_pose(base: list[E], relative: list[E], m: Any = SparkMath) -> list[E]:
    """The inverse of relative_pose."""
    moved = quat_apply(base[3:], relative[:3], m)
    return [*[a + b for a, b in zip(moved, base[:3], strict=True)], *quat_standardize(quat_multiply(base[3:], relative[3:]), m)]


# --- on array columns ------------------------------------------------------


def parts(array: Column, n: int, start: int = 0) -> list[Column]:
    return [array[start + i] for i in range(n)]


def staged(array: Column, widths: list[int], stages: list[Callable]) -> Column:
    """An array column through the stages; each stage's numbers are computed once and bound to a name.

    ``widths`` has how many numbers go into each stage.
    """
    if not stages:
        return array
    made = lambda x: F.array(*stages[0](parts(x, widths[0]), SparkMath))
    return staged(F.transform(F.array(array), made)[0], widths[1:], stages[1:])


def stage_widths(n: int, stages: list[Callable]) -> list[int]:
    """How many numbers go into each stage when the first gets n."""
    class Count(str):
        __add__ = __sub__ = __mul__ = __truediv__ = __lt__ = __ge__ = lambda self, o: self

    class Names:
        def __getattr__(self, name: str) -> Callable:
            return lambda *a: Count("x")

    widths = [n]
    for f in stages:
        widths.append(len(f([Count("x")] * widths[-1], Names())))
    return widths


def convert_column(rot: Column, source: str, target: str) -> Column:
    """A rotation column of one form as another; forms are the keys of FORMS."""
    stages = conversion(source, target)
    return staged(rot, stage_widths(FORMS[source][0], stages), stages)


def _real_first(q: list[E], m: Any = SparkMath) -> list[E]:
    return [q[3], *q[:3]]


def _real_last(q: list[E], m: Any = SparkMath) -> list[E]:
    return [*q[1:], q[0]]


def pose_stages(form: str) -> tuple[int, list[Callable], list[Callable]]:
    """Width of a rotation as poses hold it, the stages that make it a matrix and those that make it of one.

    In poses a quaternion is x, y, z, w, and nine numbers (rotation_9d, matrix)
    are the columns; these are first made a rotation by ``nearest_rotation``.
    """
    if form in ("rotation_9d", "matrix"):
        return 9, [], [transpose]
    width, into, out = FORMS[form]
    return (width, [_real_first, *into], [*out, _real_last]) if form == "quaternion" else (width, into, out)


def convert_pose(pose: Column, source: str, target: str) -> Column:
    """[x, y, z, rotation, others] with its rotation in another form; others stay as they are. Swap the forms for the way back."""
    if source == target:
        return pose
    n, into, _ = pose_stages(source)
    rotation = F.slice(pose, 4, n)
    rotation = nearest_rotation(rotation) if source in ("rotation_9d", "matrix") else rotation
    stages = [*into, *pose_stages(target)[2]]
    others = F.slice(pose, 4 + n, F.greatest(F.size(pose) - (3 + n), F.lit(0)))
    return F.concat(F.slice(pose, 1, 3), staged(rotation, stage_widths(n, stages), stages), others)


def named_conversion(name: str) -> tuple[str, str]:
    """'A_to_B' as (A, B); one form alone is what a quaternion becomes."""
    source, to, target = name.partition("_to_")
    return (source, target) if to else ("quaternion", name)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def nearest_rotation(nine: pd.Series) -> pd.Series:
    """The orthogonal matrix nearest to one given by columns, by SVD; a reflection's last column is turned round.

    Null stays null.
    """
    out = pd.Series([None] * len(nine), dtype=object)
    some = np.flatnonzero(nine.notna())
    if len(some):
        u, _, vt = np.linalg.svd(np.stack(nine.iloc[some].to_numpy()).astype(float).reshape(-1, 3, 3).transpose(0, 2, 1))
        r = u @ vt
        r[:, :, 2] *= np.linalg.det(r)[:, None]
        out.iloc[some] = list(r.reshape(-1, 9))
    return out


def gaussian(key: Column, i: int, seed: int) -> Column:
    """A normal number from hashes of a row's key, so it does not depend on how rows are dealt to tasks."""
    u, v = (hash_unit(F.lit(seed), F.lit(2 * i + j), key) for j in (0, 1))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def pose_noise(pose: Column, key: Column, position_sd: float, rotation_sd: float, seed: int, form: str = "axis_angle") -> Column:
    """Gaussian noise on the position, and on the rotation as an axis-angle; others stay as they are.

    A rotation goes over its matrix on both ways, also from and to an axis-angle.
    """
    sd = [position_sd] * 3 + [rotation_sd] * 3
    noise = [gaussian(key, i, seed) * s for i, s in enumerate(sd)]
    n, into, out = pose_stages(form)
    rotation = nearest_rotation(F.slice(pose, 4, n)) if form in ("rotation_9d", "matrix") else F.slice(pose, 4, n)
    stages = [*into, *pose_stages("axis_angle")[2]]
    turned = F.zip_with(staged(rotation, stage_widths(n, stages), stages), F.array(*noise[3:]), lambda a, b: a + b)
    back = [*pose_stages("axis_angle")[1], *out]
    others = F.slice(pose, 4 + n, F.greatest(F.size(pose) - (3 + n), F.lit(0)))
    return F.concat(F.array(*[pose[i] + noise[i] for i in range(3)]), staged(turned, stage_widths(3, back), back), others)
