"""Element classes and what is fixed about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class, name, dimension, faces, vertices, edges, most children, VTK cell type, trees of a unit hypercube.
ROWS = [
    (0, "Vertex", 0, 0, 1, 0, 1, 1, 1),
    (1, "Line", 1, 2, 2, 1, 2, 3, 1),
    (2, "Quad", 2, 4, 4, 4, 4, 9, 1),
    (3, "Triangle", 2, 3, 3, 3, 4, 5, 2),
    (4, "Hex", 3, 6, 8, 12, 8, 12, 1),
    (5, "Tet", 3, 4, 4, 6, 8, 10, 6),
    (6, "Prism", 3, 5, 6, 9, 8, 13, 2),
    (7, "Pyramid", 3, 5, 5, 8, 10, 14, 3),
]
VERTEX, LINE, QUAD, TRIANGLE, HEX, TET, PRISM, PYRAMID = range(8)
#: Levels up to which ids and counts fit a signed 64-bit integer.
MAX_LEVEL = {VERTEX: 30, LINE: 30, QUAD: 29, TRIANGLE: 29, HEX: 20, TET: 20, PRISM: 20, PYRAMID: 20}


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, "eclass int, name string, dim int, n_faces int, n_vertices int, n_edges int, max_children int, vtk_type int, hypercube_trees int")


def power(base: int, exponent: Column) -> Column:
    """`base ** exponent` as an exact long, for a power of two as base."""
    bits = base.bit_length() - 1
    if 1 << bits != base:
        raise ValueError("the base has to be a power of two")
    return F.call_function("shiftleft", F.lit(1).cast("long"), (exponent * bits).cast("int"))


def count_leaves(eclass: Column, dim: Column, levels: Column) -> Column:
    """Leaves that an element has `levels` levels below it. A pyramid has 2 * 8^n - 6^n; all others 2^(dim * n)."""
    plain = F.call_function("shiftleft", F.lit(1).cast("long"), (dim * levels).cast("int"))
    six = F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1)).cast("int")), F.lit(1).cast("long"), lambda n, _: n * 6)
    pyramid = 2 * power(8, levels) - F.when(levels > 0, six).otherwise(F.lit(1).cast("long"))
    return F.when(eclass == PYRAMID, pyramid).otherwise(plain)
