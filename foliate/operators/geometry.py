"""Where elements lie in space: linear maps of every class, and the measures that follow from an element's corners.

Measures are those of the corners, as this kind of grid defines them: a quad counts as the parallelogram at its corner 0, a hex as the
parallelepiped at its corners 0, 1, 2 and 4, and a diameter is twice the mean distance of the corners from their mean. Leaves get their
tree's `vertices` by a join with the coarse mesh, which is left to Spark: a mesh may have any number of trees.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import elements, shapes, vec
from foliate.functions.eclass import HEX, LINE, PRISM, PYRAMID, QUAD, TET, TRIANGLE, VERTEX

Map = Callable[[Column, Column], Column]


def _corner(vertices: Column, k: int) -> Column:
    return F.get(vertices, F.lit(k))


def _combined(weights: list[Column], points: list[Column]) -> Column:
    """Sum of weight times point."""
    return F.array(*[sum((w * F.get(p, F.lit(a)) for w, p in zip(weights, points, strict=True)), F.lit(0.0)) for a in range(3)])


def multilinear(values: list[Column], p: list[Column]) -> Column:
    """Interpolation of values (points) at the 2^n corners of the unit cube, x fastest."""
    weights = []
    for bits in product((0, 1), repeat=len(p)):
        w = F.lit(1.0)
        for c, b in zip(reversed(p), bits, strict=True):
            w = w * (c if b else 1 - c)
        weights.append(w)
    return _combined(weights, values)


def barycentric(values: list[Column], p: list[Column]) -> Column:
    """Interpolation over the reference triangle or tet: from corner to corner along the coordinates in their falling order."""
    if len(p) == 2:
        weights = [1 - p[0], p[0] - p[1], p[1]]
    else:
        weights = [1 - p[0], p[0] - p[2], p[2] - p[1], p[1]]
    return _combined(weights, values)


def linear(eclass: int, vertices: Column, p: Column) -> Column:
    """The point in space of a point `p` (array of the class's dimension) of the reference tree."""
    c = [F.get(p, F.lit(a)) for a in range(shapes.DIM[eclass])]
    v = [_corner(vertices, k) for k in range(len(shapes.corners(eclass)))]
    if eclass == VERTEX:
        return v[0]
    if eclass in (LINE, QUAD, HEX):
        return multilinear(v, c)
    if eclass in (TRIANGLE, TET):
        return barycentric(v, c)
    if eclass == PRISM:
        low, high = barycentric(v[:3], c[:2]), barycentric(v[3:], c[:2])
        return _combined([1 - c[2], c[2]], [low, high])
    # Along the line from the base to the tip.
    base = [F.when(c[2] < 1, 1 - (1 - x) / (1 - c[2])).otherwise(F.lit(0.0)) for x in c[:2]]
    return _combined([1 - c[2], c[2]], [multilinear(v[:4], base), v[4]])


def axis_aligned(eclass: int, vertices: Column, p: Column) -> Column:
    """The box between the tree's first two vertices: only for lines, quads and hexes."""
    a, b = _corner(vertices, 0), _corner(vertices, 1)
    dim = shapes.DIM[eclass]
    part = [F.get(p, F.lit(k)) if k < dim else F.lit(0.0) for k in range(3)]
    return F.array(*[F.get(a, F.lit(k)) + part[k] * (F.get(b, F.lit(k)) - F.get(a, F.lit(k))) for k in range(3)])


def to_origin(eclass: int, vertices: Column, p: Column) -> Column:
    return F.array(*[F.lit(0.0)] * 3)


def _scaled(v: Column, length: Column | float) -> Column:
    return vec.ax(vec.normalised(v), length)


def sphere_surface(eclass: int, vertices: Column, p: Column) -> Column:
    """Triangles or quads on a sphere around the origin: the linear point, moved out to the radius of the corners."""
    return _scaled(linear(eclass, vertices, p), vec.norm(_corner(vertices, 0)))


def spherical_shell(eclass: int, vertices: Column, p: Column) -> Column:
    """Prisms or hexes between two spheres around the origin: the direction of the linear point on the inner face, at a radius between those of the corners."""
    n = 3 if eclass == PRISM else 4
    own = TRIANGLE if eclass == PRISM else QUAD
    inner = linear(own, F.slice(vertices, 1, n), p)
    a, b = vec.norm(_corner(vertices, 0)), vec.norm(_corner(vertices, n))
    return _scaled(inner, a + F.get(p, F.lit(2)) * (b - a))


def quadrangulated_disk(eclass: int, vertices: Column, p: Column) -> Column:
    """Quads of a disk around the origin: the distance from the centre is kept, in the norm of the square, and made round."""
    flat = linear(QUAD, vertices, p)
    x, y = F.get(flat, F.lit(0)), F.get(flat, F.lit(1))
    square = F.greatest(F.abs(x), F.abs(y))
    length = F.sqrt(x * x + y * y)
    return F.when(length > 0, vec.ax(flat, square / length)).otherwise(flat)


#: Maps by the name that trees have in their `geometry` column.
GEOMETRIES: dict[str, Callable[[int, Column, Column], Column]] = {
    "linear": linear,
    "axis_aligned": axis_aligned,
    "zero": to_origin,
    "sphere_surface": sphere_surface,
    "spherical_shell": spherical_shell,
    "quadrangulated_disk": quadrangulated_disk,
}


def register(name: str, map_: Callable[[int, Column, Column], Column]) -> None:
    """Add a map of one's own: (class, vertices, reference point) to the point in space."""
    GEOMETRIES[name] = map_


def evaluated(eclass: int, vertices: Column, p: Column, geometry: str = "linear") -> Column:
    return GEOMETRIES[geometry](eclass, vertices, p)


def with_corners(leaves: DataFrame, trees: DataFrame, eclass: int, geometry: str = "linear", name: str = "corners") -> DataFrame:
    """Leaves with their corners in space (an array of points), and `_at`, their place in the tree."""
    met = leaves.join(trees.select("tree_id", F.col("vertices").alias("_vertices")), "tree_id")
    met = met.withColumn("_at", elements.place(eclass, F.col("id"), F.col("level")))
    met = met.withColumn("_ref", elements.corners(eclass, F.col("_at"), F.col("level")))
    return met.withColumn(name, F.transform("_ref", lambda p: evaluated(eclass, F.col("_vertices"), p, geometry))).drop("_ref")


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    u, v = vec.diff(b, a), vec.diff(c, a)
    return 0.5 * F.sqrt(F.greatest(vec.dot(u, u) * vec.dot(v, v) - vec.dot(u, v) * vec.dot(u, v), F.lit(0.0)))


def tet_volume(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.abs(vec.dot(vec.diff(a, d), vec.cross(vec.diff(b, d), vec.diff(c, d)))) / 6


def _by_shape(eclass: int, kind: Column, make: Callable[[int], Column]) -> Column:
    """What the element's own shape asks for: in pyramid trees there are tets too."""
    return F.when(kind < shapes.UP, make(TET)).otherwise(make(PYRAMID)) if eclass == PYRAMID else make(eclass)


def diameter(corners: Column) -> Column:
    mid = elements.mean(corners, 3)
    return 2 * F.aggregate(corners, F.lit(0.0), lambda s, p: s + vec.dist(p, mid)) / F.size(corners)


def volume(eclass: int, kind: Column, corners: Column) -> Column:
    x = lambda *ks: [_corner(corners, k) for k in ks]

    def of(shape: int) -> Column:
        if shape == VERTEX:
            return F.lit(0.0)
        if shape == LINE:
            return diameter(corners)
        if shape == QUAD:
            return 2 * triangle_area(*x(0, 1, 2))
        if shape == TRIANGLE:
            return triangle_area(*x(0, 1, 2))
        if shape == TET:
            return tet_volume(*x(0, 1, 2, 3))
        if shape == HEX:
            a = [vec.diff(p, x(0)[0]) for p in x(1, 2, 4)]
            return vec.parallelepiped(*a)
        if shape == PRISM:
            return tet_volume(*x(0, 1, 2, 4)) + tet_volume(*x(0, 2, 3, 4)) + tet_volume(*x(2, 3, 4, 5))
        return tet_volume(*x(0, 1, 3, 4)) + tet_volume(*x(0, 2, 3, 4))

    return _by_shape(eclass, kind, of)


def measured(leaves: DataFrame, trees: DataFrame, eclass: int, geometry: str = "linear") -> DataFrame:
    """Leaves with `corners`, `volume`, `diameter`, `centroid` (the map of the reference centroid) and `linear_centroid` (the corners' mean)."""
    met = with_corners(leaves, trees, eclass, geometry)
    dim = shapes.DIM[eclass]
    ref = elements.mean(elements.corners(eclass, F.col("_at"), F.col("level")), dim) if dim else F.array(F.lit(0.0))
    out = met.withColumns({"_ref": ref, "volume": volume(eclass, F.col("_at.kind"), F.col("corners")), "diameter": diameter(F.col("corners")), "linear_centroid": elements.mean(F.col("corners"), 3)})
    return out.withColumn("centroid", evaluated(eclass, F.col("_vertices"), F.col("_ref"), geometry)).drop("_at", "_vertices", "_ref")


def with_faces(leaves: DataFrame, trees: DataFrame, eclass: int, geometry: str = "linear") -> DataFrame:
    """Leaves once for each face, with `face`, `face_shape`, `face_area`, `face_centroid` and `face_normal`, the unit vector that points out."""
    met = with_corners(leaves, trees, eclass, geometry)
    met = met.withColumn("face", F.explode(F.sequence(F.lit(0), elements.n_faces(eclass, F.col("_at")) - 1)))
    own = F.transform(elements.face_corners(eclass, F.col("_at"), F.col("face")), lambda k: F.get(F.col("corners"), k))
    met = met.withColumns({"_own": own, "_mid": elements.mean(F.col("corners"), 3)})
    x = [_corner(F.col("_own"), k) for k in range(4)]
    n = F.size("_own")
    area = F.when(n == 1, 0.0).when(n == 2, vec.dist(x[0], x[1])).when(n == 3, triangle_area(*x[:3])).otherwise(triangle_area(*x[:3]) + triangle_area(*x[1:]))
    shape = F.when(n == 1, VERTEX).when(n == 2, LINE).when(n == 3, TRIANGLE).otherwise(QUAD)
    met = met.withColumns({"face_shape": shape, "face_area": area, "face_centroid": elements.mean(F.col("_own"), 3)})
    # At right angles to the face, away from the element's middle.
    to_mid = vec.diff(F.col("_mid"), x[0])
    if shapes.DIM[eclass] == 1:
        raw = vec.ax(to_mid, -1.0)
    elif shapes.DIM[eclass] == 2:
        along = vec.diff(x[1], x[0])
        raw = vec.ax(vec.axpy(along, to_mid, -vec.dot(to_mid, along) / vec.dot(along, along)), -1.0)
    else:
        cross = vec.cross(vec.diff(x[1], x[0]), vec.diff(x[2], x[0]))
        raw = vec.ax(cross, F.when(vec.dot(cross, to_mid) > 0, -1.0).otherwise(1.0))
    return met.withColumn("face_normal", vec.normalised(raw)).drop("_own", "_mid", "_at", "_vertices", "corners")


def point_inside(eclass: int, kind: Column, corners: Column, point: Column, tolerance: float) -> Column:
    """Whether a point in space lies in an element, borders included: by distance for vertices, along the line for lines, in the plane of a
    triangle (a quad is two) with a check of the distance from it, and behind all faces for solids, whose faces count as planes."""
    x = lambda k: _corner(corners, k)

    def on_line() -> Column:
        along, to = vec.diff(x(1), x(0)), vec.diff(point, x(0))
        t = vec.dot(to, along) / vec.dot(along, along)
        return (t >= -tolerance) & (t <= 1 + tolerance) & (vec.norm(vec.axpy(along, to, -t)) <= tolerance)

    def in_triangle(a: int, b: int, c: int) -> Column:
        v, w, to = vec.diff(x(b), x(a)), vec.diff(x(c), x(a)), vec.diff(point, x(a))
        vv, vw, ww, tv, tw = vec.dot(v, v), vec.dot(v, w), vec.dot(w, w), vec.dot(to, v), vec.dot(to, w)
        det = vv * ww - vw * vw
        s, t = (tv * ww - tw * vw) / det, (tw * vv - tv * vw) / det
        off = vec.norm(vec.axpy(w, vec.axpy(v, to, -s), -t))
        return (det > 0) & (s >= -tolerance) & (t >= -tolerance) & (s + t <= 1 + tolerance) & (off <= tolerance)

    def behind(shape: int, faces: list[list[int]]) -> Column:
        mid, ok = elements.mean(corners, 3), F.lit(True)
        for f in faces:
            n = vec.cross(vec.diff(x(f[1]), x(f[0])), vec.diff(x(f[2]), x(f[0])))
            n = vec.ax(n, F.when(vec.dot(n, vec.diff(mid, x(f[0]))) > 0, -1.0).otherwise(1.0))
            ok = ok & (vec.dot(n, vec.diff(point, x(f[0]))) <= 0)
        return ok

    if eclass == VERTEX:
        return vec.dist(x(0), point) <= tolerance
    if eclass == LINE:
        return on_line()
    if eclass == TRIANGLE:
        return in_triangle(0, 1, 2)
    if eclass == QUAD:
        return in_triangle(0, 1, 2) | in_triangle(1, 2, 3)
    if eclass == PYRAMID:
        return F.when(kind < shapes.UP, behind(TET, shapes.FACES[TET])).when(kind == shapes.UP, behind(PYRAMID, shapes.FACES[PYRAMID])).otherwise(behind(PYRAMID, shapes.FACES_DOWN))
    return behind(eclass, shapes.FACES[eclass])
