"""Coarse meshes: `trees` (tree_id, eclass, vertices) and `tree_faces` (tree_id, face, neigh_tree, neigh_face, orientation, is_boundary)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import eclass, shapes, vec

DIM_CLASS = {1: eclass.LINE, 2: eclass.QUAD, 3: eclass.HEX}
FACE_SCHEMA = "tree_id long, face int, neigh_tree long, neigh_face int, orientation int, is_boundary boolean"


def _places(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """One row for each cell of a brick: tree_id and its integer place p0, p1, ..., x fastest."""
    rows = spark.range(reduce(int.__mul__, sizes)).withColumnRenamed("id", "tree_id")
    stride = 1
    for k, n in enumerate(sizes):
        rows = rows.withColumn(f"p{k}", F.expr(f"(tree_id div {stride}) % {n}"))
        stride *= n
    return rows


def _corners(dim: int) -> Column:
    return F.array(*[F.array(*[(F.col(f"p{k}") + (i >> k & 1)).cast("double") if k < dim else F.lit(0.0) for k in range(3)]) for i in range(1 << dim)])


def brick(spark: SparkSession, *sizes: int) -> DataFrame:
    """Trees of a brick of unit lines, quads or hexes, as many as `sizes` has numbers; corner i is bit-wise, x lowest."""
    dim = len(sizes)
    return _places(spark, list(sizes)).select("tree_id", F.lit(DIM_CLASS[dim]).alias("eclass"), _corners(dim).alias("vertices"))


def brick_faces(spark: SparkSession, *sizes: int, periodic: tuple[bool, ...] = ()) -> DataFrame:
    """Face connections of a brick, both directions; the outer faces of an axis are joined where it is periodic. A boundary face is joined to itself."""
    dim = len(sizes)
    periodic = periodic or (False,) * dim
    rows = _places(spark, list(sizes)).select("*", F.explode(F.array(*[F.lit(f) for f in range(2 * dim)])).alias("face"))
    there, out = F.lit(0).cast("long"), F.lit(False)
    stride = 1
    for k, n in enumerate(sizes):
        moved = F.col(f"p{k}") + F.when(F.col("face") == 2 * k, -1).when(F.col("face") == 2 * k + 1, 1).otherwise(0)
        if periodic[k]:
            moved = F.pmod(moved, F.lit(n))
        else:
            out = out | (moved < 0) | (moved >= n)
        there = there + moved * stride
        stride *= n
    neighbour, face = F.when(out, F.col("tree_id")).otherwise(there), F.when(out, F.col("face")).otherwise(F.col("face").bitwiseXOR(F.lit(1)))
    return rows.select("tree_id", "face", neighbour.cast("long").alias("neigh_tree"), face.cast("int").alias("neigh_face"), F.lit(0).alias("orientation"), out.alias("is_boundary"))


def single(spark: SparkSession, dim: int) -> DataFrame:
    """The unit line, square or cube as one tree."""
    return brick(spark, *[1] * dim)


def bigmesh(spark: SparkSession, dim: int, n: int) -> DataFrame:
    """n unconnected unit trees."""
    one = single(spark, dim).select("eclass", "vertices")
    return spark.range(n).withColumnRenamed("id", "tree_id").crossJoin(F.broadcast(one))  # `one` is one row


def translated(trees: DataFrame, by: tuple[float, float, float], scale: float = 1.0) -> DataFrame:
    """Vertices scaled, then shifted."""
    shift = F.array(*map(F.lit, map(float, by)))
    return trees.withColumn("vertices", F.transform("vertices", lambda v: F.zip_with(v, shift, lambda a, b: a * scale + b)))


def joined_by_vertices(trees: DataFrame, digits: int = 9) -> DataFrame:
    """All face connections found by equal corner coordinates (rounded to `digits`), of trees of any classes; each face is matched at most once.

    Faces are joined by an equi-join on their sorted corners. The orientation is the place that the first corner of the lesser face has among
    the corners of the greater: that of the lesser class, or of equal classes of the lesser number. A face without a partner is a
    boundary face, joined to itself.
    """
    point = lambda i: F.concat_ws(",", F.transform(F.get(F.col("vertices"), F.lit(i)), lambda x: (F.round(x, digits) + 0.0).cast("string")))
    one_face = lambda f, c: F.struct(F.lit(f).alias("face"), F.array(*map(point, c)).alias("corners"))
    all_faces = F.lit(None)
    for c, table in shapes.FACES.items():
        if table:
            all_faces = F.when(F.col("eclass") == c, F.array(*[one_face(f, x) for f, x in enumerate(table)])).otherwise(all_faces)
    rank = F.get(F.array(*[F.lit(shapes.RANK[c]) for c in sorted(shapes.RANK)]), F.col("eclass"))
    faces = trees.select("tree_id", rank.alias("rank"), F.explode(all_faces).alias("f")).select("tree_id", "rank", "f.*")
    faces = faces.withColumn("key", F.concat_ws(";", F.sort_array("corners")))
    other = faces.select(F.col("tree_id").alias("neigh_tree"), F.col("rank").alias("neigh_rank"), F.col("face").alias("neigh_face"), F.col("corners").alias("theirs"), "key")
    same = (F.col("tree_id") == F.col("neigh_tree")) & (F.col("face") == F.col("neigh_face"))
    # Compared within equal keys, of which a conforming mesh has two: the face itself and its partner.
    pairs = faces.join(other, "key").withColumn("own", same)
    best = pairs.groupBy("tree_id", "rank", "face").agg(F.min(F.struct("own", "neigh_tree", "neigh_face", "neigh_rank", "corners", "theirs")).alias("b"))
    lesser = (F.col("rank") < F.col("b.neigh_rank")) | ((F.col("rank") == F.col("b.neigh_rank")) & (F.col("face") <= F.col("b.neigh_face")))
    place = lambda small, large: F.array_position(F.col(large), F.get(F.col(small), F.lit(0))) - 1
    turn = F.when(lesser, place("b.corners", "b.theirs")).otherwise(place("b.theirs", "b.corners"))
    return best.select("tree_id", "face", "b.neigh_tree", "b.neigh_face", F.when(F.col("b.own"), 0).otherwise(turn).cast("int").alias("orientation"), F.col("b.own").alias("is_boundary"))


# The trees that a cube is cut into, by the numbers of its corners.
CUBE_TREES = {
    eclass.VERTEX: [[0]],
    eclass.LINE: [[0, 1]],
    eclass.QUAD: [[0, 1, 2, 3]],
    eclass.TRIANGLE: [[0, 1, 3], [0, 3, 2]],
    eclass.HEX: [[0, 1, 2, 3, 4, 5, 6, 7]],
    eclass.TET: [[0, 1, 5, 7], [0, 3, 1, 7], [0, 2, 3, 7], [0, 6, 2, 7], [0, 4, 6, 7], [0, 5, 4, 7]],
    eclass.PRISM: [[0, 1, 3, 4, 5, 7], [0, 3, 2, 4, 7, 6]],
    eclass.PYRAMID: [[1, 3, 0, 2, 7], [0, 2, 4, 6, 7], [1, 0, 5, 4, 7]],
}
#: Prisms of a cube that lie along x or y, as those of the table lie along z; all share the diagonals of the cube's tets.
PRISMS_ALONG = {0: [[0, 2, 6, 1, 3, 7], [0, 6, 4, 1, 7, 5]], 1: [[0, 5, 1, 2, 7, 3], [0, 4, 5, 2, 6, 7]], 2: CUBE_TREES[eclass.PRISM]}


def _trees(spark: SparkSession, rows: list[tuple[int, list]]) -> DataFrame:
    """A mesh of few trees, given as class and vertices."""
    return spark.createDataFrame([(k, c, [[float(x) for x in v] for v in vertices]) for k, (c, vertices) in enumerate(rows)], "tree_id long, eclass int, vertices array<array<double>>")


def _cube(at: tuple = (0, 0, 0), size: float = 1.0) -> list[list[float]]:
    return [[at[a] + size * (k >> a & 1) for a in range(3)] for k in range(8)]


def empty(spark: SparkSession) -> DataFrame:
    return _trees(spark, [])


def one(spark: SparkSession, kind: int) -> DataFrame:
    """The reference element of a class as a tree."""
    return _trees(spark, [(kind, [[*c, *[0] * (3 - len(c))] for c in shapes.corners(kind)])])


def hypercube(spark: SparkSession, kind: int) -> DataFrame:
    """The unit cube of the class's dimension, cut into trees of the class."""
    return padded(spark, kind, *[1] * shapes.DIM[kind])


def padded(spark: SparkSession, kind: int, *sizes: int) -> DataFrame:
    """A box of unit cells, each cut into trees of the class; made from a range of numbers, whatever the sizes."""
    if len(sizes) != shapes.DIM[kind]:
        raise ValueError("one size for each dimension")
    cuts = F.array(*[F.array(*[F.lit(c) for c in tree]) for tree in CUBE_TREES[kind]])
    rows = _places(spark, list(sizes)) if sizes else spark.range(1).withColumnRenamed("id", "tree_id")
    rows = rows.withColumn("_corners", _corners(len(sizes))).select("tree_id", "_corners", F.posexplode(cuts).alias("_k", "_cut"))
    return rows.select((F.col("tree_id") * len(CUBE_TREES[kind]) + F.col("_k")).alias("tree_id"), F.lit(kind).alias("eclass"), F.transform("_cut", lambda c: F.get(F.col("_corners"), c)).alias("vertices"))


def hypercube_hybrid(spark: SparkSession) -> DataFrame:
    """The unit cube of six tets at the origin, six prisms beside them along the axes, and four hexes."""
    rows, pick = [], lambda cut, cube: [cube[c] for c in cut]
    rows += [(eclass.TET, pick(cut, _cube(size=0.5))) for cut in CUBE_TREES[eclass.TET]]
    for axis in range(3):
        cube = _cube(tuple(0.5 * (a == axis) for a in range(3)), 0.5)
        rows += [(eclass.PRISM, pick(cut, cube)) for cut in PRISMS_ALONG[axis]]
    rows += [(eclass.HEX, _cube(at, 0.5)) for at in ((0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5), (0.5, 0.5, 0.5))]
    return _trees(spark, rows)


def prism_cake(spark: SparkSession, n: int) -> DataFrame:
    """n prisms around the z axis."""
    angle = lambda k: F.lit(2 * math.pi / n) * (F.col("id") + k)
    ring = lambda k, z: F.array(F.cos(angle(k)), F.sin(angle(k)), F.lit(z))
    points = [p for z in (0.0, 1.0) for p in (F.array(F.lit(0.0), F.lit(0.0), F.lit(z)), ring(0, z), ring(1, z))]
    return spark.range(n).select(F.col("id").alias("tree_id"), F.lit(eclass.PRISM).alias("eclass"), F.array(*points).alias("vertices"))


def pyramid_cake(spark: SparkSession, n: int) -> DataFrame:
    """n pyramids around the z axis, with their tips at the origin."""
    angle = lambda k: F.lit(2 * math.pi / n) * (F.col("id") + k)
    points = [F.array(F.cos(angle(k)), F.sin(angle(k)), F.lit(z)) for z in (-0.5, 0.5) for k in (1, 0)]
    return spark.range(n).select(F.col("id").alias("tree_id"), F.lit(eclass.PYRAMID).alias("eclass"), F.array(*points, F.array(*[F.lit(0.0)] * 3)).alias("vertices"))


def long_brick_of_pyramids(spark: SparkSession, n: int) -> DataFrame:
    """A row of n cubes along x, each of three pyramids."""
    return padded(spark, eclass.PYRAMID, n, 1, 1)


def disjoint_bricks(spark: SparkSession, n: int, *sizes: int, periodic: tuple[bool, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """n bricks that don't touch, one behind the other along x, and their connections."""
    trees, faces = brick(spark, *sizes), brick_faces(spark, *sizes, periodic=periodic)
    count, copies = reduce(int.__mul__, sizes), F.broadcast(spark.range(n).withColumnRenamed("id", "_copy"))  # n numbers
    moved = F.transform("vertices", lambda v: F.transform(v, lambda x, i: F.when(i == 0, x + F.col("_copy") * 2 * sizes[0]).otherwise(x)))
    shift = lambda c: (F.col(c) + F.col("_copy") * count).alias(c)
    return trees.crossJoin(copies).select(shift("tree_id"), "eclass", moved.alias("vertices")), faces.crossJoin(copies).select(shift("tree_id"), "face", shift("neigh_tree"), "neigh_face", "orientation", "is_boundary")


# Small meshes with corners of their own.
LINE_ZIGZAG = [[[1, 2, 0], [2, 4, 1]], [[1, 1, 2], [2, 4, 1]], [[1, 1, 2], [3, 2, 5]]]
PYRAMID_DEFORMED = [[-1, -2, 0.5], [2, -1, 0], [-1, 2, -0.5], [2, 2, 0], [3, 3, 3**0.5]]
PRISM_DEFORMED = [[-1, -0.5, 0.25], [1, 0, 0], [1, 1, 0], [0, 0, 0.75], [1.25, 0, 1], [2, 2, 2]]


def line_zigzag(spark: SparkSession) -> DataFrame:
    return _trees(spark, [(eclass.LINE, v) for v in LINE_ZIGZAG])


def pyramid_deformed(spark: SparkSession) -> DataFrame:
    return _trees(spark, [(eclass.PYRAMID, PYRAMID_DEFORMED)])


def prism_deformed(spark: SparkSession) -> DataFrame:
    return _trees(spark, [(eclass.PRISM, PRISM_DEFORMED)])


def full_hybrid(spark: SparkSession) -> DataFrame:
    """A hex, a pyramid on its top, and beside the hex a prism with a tet on it: one tree of each solid class, joined face to face."""
    cube, tip = _cube(), [1, 1, 2]
    prism = [[1, 0, 0], [2, 0, 0], [1, 1, 0], [1, 0, 1], [2, 0, 1], [1, 1, 1]]
    return _trees(spark, [(eclass.HEX, cube), (eclass.PYRAMID, [*cube[4:], tip]), (eclass.PRISM, prism), (eclass.TET, [prism[3], prism[5], prism[4], tip])])


def octahedron(radius: float = 1.0) -> list[list[list[float]]]:
    """Triangles of an octahedron's surface, counter-clockwise seen from outside."""
    return [[[x * radius, 0, 0], [0, y * radius, 0], [0, 0, z * radius]] if x * y * z > 0 else [[0, y * radius, 0], [x * radius, 0, 0], [0, 0, z * radius]] for x in (1, -1) for y in (1, -1) for z in (1, -1)]


def icosahedron(radius: float = 1.0) -> list[list[list[float]]]:
    """Triangles of an icosahedron's surface: the triples of its corners that lie an edge apart, counter-clockwise seen from outside."""
    g = (1 + 5**0.5) / 2
    points = [p for a in (-1, 1) for b in (-g, g) for p in ([0, a, b], [a, b, 0], [b, 0, a])]
    near = lambda p, q: abs(sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) - 4) < 1e-9
    out = []
    for p, q, r in combinations(points, 3):
        if near(p, q) and near(q, r) and near(p, r):
            turn = sum(p[i] * (q[j] * r[k] - q[k] * r[j]) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))
            size = radius / (1 + g * g) ** 0.5
            out.append([[x * size for x in v] for v in ((p, q, r) if turn > 0 else (p, r, q))])
    return out


def cube_surface(radius: float = 1.0) -> list[list[list[float]]]:
    """Quads of a cube's surface whose corners lie on the sphere, numbered so that their normals point out."""
    h = radius / 3**0.5
    out = []
    for axis, side in product(range(3), (-1, 1)):
        u, v = ((axis + 1) % 3, (axis + 2) % 3) if side > 0 else ((axis + 2) % 3, (axis + 1) % 3)
        out.append([[h * (side if a == axis else p if a == u else q if a == v else 0) for a in range(3)] for q in (-1, 1) for p in (-1, 1)])
    return out


def spherical_surface(spark: SparkSession, shape: str, radius: float = 1.0) -> DataFrame:
    """A sphere's surface from an `octahedron`, `icosahedron` or `cube`; its map is `sphere_surface`."""
    faces = {"octahedron": octahedron, "icosahedron": icosahedron, "cube": cube_surface}[shape](radius)
    return _trees(spark, [(eclass.QUAD if shape == "cube" else eclass.TRIANGLE, f) for f in faces])


def spherical_shell(spark: SparkSession, shape: str, inner: float, thickness: float, layers: int = 1) -> DataFrame:
    """Layers of prisms or hexes over such a surface; its map is `spherical_shell`."""
    surface, n = spherical_surface(spark, shape, 1.0), F.broadcast(spark.range(layers).withColumnRenamed("id", "_layer"))
    kind = eclass.HEX if shape == "cube" else eclass.PRISM
    at = lambda k: inner + thickness * (F.col("_layer") + k) / layers
    grown = lambda k: F.transform("vertices", lambda v: F.transform(v, lambda x: x * at(k)))
    return surface.crossJoin(n).select((F.col("tree_id") * layers + F.col("_layer")).alias("tree_id"), F.lit(kind).alias("eclass"), F.concat(grown(0), grown(1)).alias("vertices"))


def negative_volumes(trees: DataFrame) -> DataFrame:
    """Solid trees whose corners turn the wrong way: the first three edges from corner 0 span a negative volume."""
    ends = {eclass.HEX: (1, 2, 4), eclass.TET: (1, 2, 3), eclass.PRISM: (1, 2, 3), eclass.PYRAMID: (1, 2, 4)}
    edge = lambda k: vec.diff(F.get(F.col("vertices"), F.lit(k)), F.get(F.col("vertices"), F.lit(0)))
    bad = F.lit(False)
    for c, (i, j, k) in ends.items():
        volume = vec.dot(vec.cross(edge(i), edge(j)), edge(k))
        # A reference tet turns the other way.
        bad = F.when(F.col("eclass") == c, (volume > 0) if c == eclass.TET else (volume < 0)).otherwise(bad)
    return trees.where(bad)


def inconsistent_faces(tree_faces: DataFrame) -> DataFrame:
    """Connections that are not mirrored on the other side."""
    back = tree_faces.select(F.col("neigh_tree").alias("tree_id"), F.col("neigh_face").alias("face"), F.col("tree_id").alias("neigh_tree"), F.col("face").alias("neigh_face"), "orientation")
    return tree_faces.where("not is_boundary").join(back, ["tree_id", "face", "neigh_tree", "neigh_face", "orientation"], "left_anti")


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two meshes have equal trees: number, class and vertices."""
    keyed = lambda df, k: df.select("tree_id", "eclass", F.to_json("vertices").alias("v"), F.lit(k).alias("side"))
    return keyed(a, 0).unionByName(keyed(b, 1)).groupBy("tree_id", "eclass", "v").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("n")).where("n <> 0").isEmpty()


def with_global_vertices(trees: DataFrame, digits: int = 9) -> DataFrame:
    """Trees with `global_vertices`: a number for each corner, equal for corners at equal coordinates: a hash of these."""
    number = lambda v: F.xxhash64(F.concat_ws(",", F.transform(v, lambda x: (F.round(x, digits) + 0.0).cast("string"))))
    return trees.withColumn("global_vertices", F.transform("vertices", number))


def vertex_trees(trees: DataFrame) -> DataFrame:
    """(vertex, n_trees, trees): each global vertex with the trees and corners that meet there."""
    each = trees.select("tree_id", F.posexplode("global_vertices").alias("corner", "vertex"))
    return each.groupBy("vertex").agg(F.countDistinct("tree_id").alias("n_trees"), F.sort_array(F.collect_list(F.struct("tree_id", "corner"))).alias("trees"))


def displaced(trees: DataFrame, by: DataFrame) -> DataFrame:
    """Trees whose corners are moved by `by(vertex, shift)`, wherever the vertex occurs."""
    each = trees.select("tree_id", "eclass", "global_vertices", F.posexplode(F.arrays_zip("vertices", "global_vertices")).alias("corner", "z")).select("*", F.col("z.vertices").alias("v"), F.col("z.global_vertices").alias("vertex"))
    moved = each.join(by, "vertex", "left").withColumn("v", F.when(F.col("shift").isNotNull(), F.zip_with("v", "shift", lambda a, b: a + b)).otherwise(F.col("v")))
    return moved.groupBy("tree_id", "eclass", "global_vertices").agg(F.transform(F.sort_array(F.collect_list(F.struct("corner", "v"))), lambda s: s["v"]).alias("vertices")).select("tree_id", "eclass", "vertices", "global_vertices")


def bounding_box(trees: DataFrame) -> DataFrame:
    """Least and greatest coordinate of each axis over all trees."""
    points = trees.select(F.explode("vertices").alias("v"))
    return points.agg(*[f(F.get(F.col("v"), F.lit(k))).alias(f"{n}_{a}") for k, a in enumerate("xyz") for n, f in (("min", F.min), ("max", F.max))])
