"""Vectors of three components as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(a: Column, b: Column, op) -> Column:
    return F.zip_with(a, b, op)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(_pairs(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def dist(a: Column, b: Column) -> Column:
    return norm(diff(a, b))


def diff(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x - y)


def ax(a: Column, alpha: Column | float) -> Column:
    return F.transform(a, lambda x: x * alpha)


def axpy(a: Column, b: Column, alpha: Column | float) -> Column:
    """b + alpha a"""
    return _pairs(a, b, lambda x, y: y + x * alpha)


def axb(a: Column, alpha: Column | float, beta: Column | float) -> Column:
    return F.transform(a, lambda x: x * alpha + beta)


def cross(a: Column, b: Column) -> Column:
    x = lambda v, i: F.get(v, F.lit(i))
    return F.array(*[x(a, i) * x(b, j) - x(a, j) * x(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def normalised(a: Column) -> Column:
    """Null for the zero vector."""
    n = norm(a)
    return F.when(n > 0, ax(a, 1 / n))


def parallelogram(a: Column, b: Column) -> Column:
    return norm(cross(a, b))


def parallelepiped(a: Column, b: Column, c: Column) -> Column:
    return F.abs(dot(cross(a, b), c))


def rescaled(a: Column, length: Column | float) -> Column:
    """The vector in the same direction with the given length; null for the zero vector."""
    return ax(normalised(a), length)


def equal(a: Column, b: Column, tolerance: float) -> Column:
    """Whether no component differs by more than the tolerance."""
    return F.forall(_pairs(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda same: same)


def cross_2d(a: Column, b: Column) -> Column:
    x = lambda v, i: F.get(v, F.lit(i))
    return x(a, 0) * x(b, 1) - x(a, 1) * x(b, 0)


def triangle_normal(a: Column, b: Column, c: Column) -> Column:
    """At right angles to a triangle, as long as twice its area."""
    return cross(diff(b, a), diff(c, a))


def tripod(a: Column) -> tuple[Column, Column]:
    """Two unit vectors at right angles to a vector and to each other: the first to the axis in which it is least."""
    x = lambda i: F.abs(F.get(a, F.lit(i)))
    axis = F.when((x(0) <= x(1)) & (x(0) <= x(2)), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(x(1) <= x(2), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    first = normalised(cross(a, axis))
    return first, normalised(cross(a, first))


def coplanar(a: Column, b: Column, c: Column, d: Column, tolerance: float) -> Column:
    """Whether four points lie in a plane: the box that they span has no height to speak of. Three points on a line are in a plane with any fourth."""
    n = triangle_normal(a, b, c)
    return F.coalesce(F.abs(dot(normalised(n), diff(d, a))) <= tolerance, F.lit(True))


def rotation(axis: int, angle: Column | float) -> Column:
    """The matrix, as an array of rows, that turns by an angle about the x, y or z axis (0, 1, 2)."""
    angle = angle if isinstance(angle, Column) else F.lit(float(angle))
    cos, sin, i, j = F.cos(angle), F.sin(angle), (axis + 1) % 3, (axis + 2) % 3
    m = [[F.lit(float(r == c)) for c in range(3)] for r in range(3)]
    m[i][i], m[i][j], m[j][i], m[j][j] = cos, -sin, sin, cos
    return F.array(*[F.array(*row) for row in m])


def matrix_times(m: Column, a: Column) -> Column:
    return F.transform(m, lambda row: dot(row, a))


def matrix_product(a: Column, b: Column) -> Column:
    column = lambda c: F.transform(b, lambda row: F.get(row, F.lit(c)))
    return F.transform(a, lambda row: F.array(*[dot(row, column(c)) for c in range(3)]))
