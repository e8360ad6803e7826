"""Elements of every class as column expressions.

An element is its level and its id: the numbers of the children on the way down from the root, `shapes.BITS` bits each, so that ids of a level
rise along the curve, and parents, children and descendants are shifts, for every class. What is left to work out is where an element lies.
`place` walks down from the root and gives the cell and the type; `at_point` walks down to the element that holds a point.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import shapes
from .eclass import PYRAMID, TET, VERTEX
from .morton import shl, shr

#: Levels whose ids fit a long.
MAX_LEVEL = {c: 62 // max(b, 3) if c != VERTEX else 30 for c, b in shapes.BITS.items()}
XYZ = ("x", "y", "z")


def _list(values: list) -> Column:
    """A literal array, of arrays where the values are lists: written as text and read when the plan is made, which is folded there."""
    depth, one = 1, values
    while isinstance(one[0], (list, tuple)):
        depth, one = depth + 1, one[0]
    flat = json.dumps(values)
    kind = "array<" * depth + ("double" if "." in flat else "int") + ">" * depth
    return F.from_json(F.lit(flat), kind)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


@cache
def _down(eclass: int) -> tuple[list[int], list[int]]:
    """Cell and type of each child, by 16 * parent's type + number."""
    cell, kind = [], []
    for parent in shapes.kinds(eclass):
        row = shapes.children(eclass, parent)
        cell += [row[k][0] if k < len(row) else -1 for k in range(16)]
        kind += [row[k][1] if k < len(row) else -1 for k in range(16)]
    return cell, kind


@cache
def _number(eclass: int) -> list[int]:
    """Number of a child, by 64 * parent's type + 8 * cell + type."""
    known = shapes.child_index(eclass)
    return [known.get((p, c, t), -1) for p in shapes.kinds(eclass) for c in range(8) for t in range(8)]


def _at(values: Column, index: Column) -> Column:
    return F.get(values, index.cast("int"))


def digit(eclass: int, id: Column, level: Column, of: Column) -> Column:
    """Number among its siblings of the ancestor at level `of`, which is 1 at least."""
    bits = shapes.BITS[eclass]
    return shr(id, (level - of) * bits).bitwiseAND(_long((1 << bits) - 1)).cast("int")


def place(eclass: int, id: Column, level: Column) -> Column:
    """struct(x, y, z, kind): the element's cell in the grid of its level, and its type. Coordinates that the class lacks are zero."""
    cells, kinds = (_list(v) for v in _down(eclass))
    start = F.struct(*[_long(0).alias(c) for c in XYZ], F.lit(shapes.ROOT[eclass]).alias("kind"))

    def step(s: Column, of: Column) -> Column:
        entry = s["kind"] * 16 + digit(eclass, id, level, of)
        cell = _at(cells, entry)
        axis = [(s[c] * 2 + shr(cell, a).bitwiseAND(F.lit(1))).cast("long").alias(c) for a, c in enumerate(XYZ)]
        return F.struct(*axis, _at(kinds, entry).alias("kind"))

    # A level without steps has an empty list of them.
    return F.aggregate(F.when(level > 0, F.sequence(F.lit(1), level.cast("int"))).otherwise(F.array().cast("array<int>")), start, step)


def kind_of(eclass: int, parent: Column, u: list[Column]) -> Column:
    """Type of the child that holds the point with shares `u` of a cell inside an element of type `parent`."""
    if len(shapes.kinds(eclass)) == 1:
        return F.lit(0)
    if len(shapes.kinds(eclass)) == 2:
        return F.when(u[0] >= u[1], 0).otherwise(1)
    x, y, z = u
    tet = F.when((x >= z) & (z >= y), 0).when((x >= y) & (y >= z), 1).when((y >= x) & (x >= z), 2).when((y >= z) & (z >= x), 3).when((z >= y) & (y >= x), 4).otherwise(5)
    if eclass == TET:
        return tet
    pyramid = F.when((x >= z) & (y >= z), shapes.UP).when((x < z) & (y < z), shapes.DOWN).when(x >= z, 0).otherwise(3)
    return F.when(parent >= shapes.UP, pyramid).otherwise(tet)


def at_point(eclass: int, p: list[Column], level: Column) -> Column:
    """Id of the element of a level that holds the point of the tree's unit cube; null outside the tree. On a border one of those that meet there."""
    dim, bits = shapes.DIM[eclass], shapes.BITS[eclass]
    numbers = _list(_number(eclass))
    size = shl(F.lit(1), level).cast("double")
    # The far border belongs to the last cells.
    scaled = [F.least(F.greatest(c * size, F.lit(0.0)), size - 1e-9) for c in p[:dim]]
    start = F.struct(_long(0).alias("id"), F.lit(shapes.ROOT[eclass]).alias("kind"))

    def step(s: Column, left: Column) -> Column:
        # `left` levels are still below the child that is sought.
        unit = shl(F.lit(1), left).cast("double")
        whole = [F.floor(c / unit) for c in scaled]
        share = [c / unit - w for c, w in zip(scaled, whole, strict=True)]
        cell = sum((w.bitwiseAND(_long(1)) * (1 << a) for a, w in enumerate(whole)), _long(0))
        kind = kind_of(eclass, s["kind"], share)
        number = _at(numbers, s["kind"] * 64 + cell * 8 + kind)
        return F.struct(F.when(s["id"].isNotNull() & (number >= 0), shl(s["id"], bits) + number).cast("long").alias("id"), kind.alias("kind"))

    lefts = F.when(level > 0, F.sequence((level - 1).cast("int"), F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    found = F.aggregate(lefts, start, step)["id"] if dim else _long(0)
    return F.when(contains(eclass, p), found)


def contains(eclass: int, p: list[Column], slack: float = 1e-9) -> Column:
    """Whether a point of reference space lies in the tree."""
    ok = F.lit(True)
    for f in range(len(shapes.faces(eclass))):
        n = shapes.outward(eclass, shapes.ROOT[eclass], f)
        ok = ok & (sum((c * float(a) for a, c in zip(n, p, strict=False) if a), F.lit(0.0)) <= shapes.level_of(eclass, f) + slack)
    return ok


@cache
def _offsets(eclass: int) -> list[list[list[int]]]:
    return [[list(c) for c in shapes.corners(eclass, k)] for k in shapes.kinds(eclass)]


def corners(eclass: int, at: Column, level: Column) -> Column:
    """Reference coordinates of an element's corners, in their order: an array of arrays of `dim` numbers."""
    dim = shapes.DIM[eclass]
    if not dim:
        return F.array(F.array(F.lit(0.0)))
    size = shl(F.lit(1), level).cast("double")
    own = F.get(_list(_offsets(eclass)), at["kind"])
    return F.transform(own, lambda o: F.array(*[(at[XYZ[a]] + o[a]) / size for a in range(dim)]))


def mean(points: Column, dim: int) -> Column:
    """Coordinates of the mean of an array of points."""

    def total(axis: int) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(axis)))

    return F.array(*[total(a) / F.size(points) for a in range(dim)])


def shape(eclass: int, at: Column) -> Column:
    """Class of the element's own shape."""
    return F.when(at["kind"] < shapes.UP, TET).otherwise(PYRAMID) if eclass == PYRAMID else F.lit(eclass)


def by_kind(eclass: int, make, at: Column) -> Column:
    """A value that `make(type)` gives for each type."""
    return F.get(_list([make(k) for k in shapes.kinds(eclass)]), at["kind"])


def face_corners(eclass: int, at: Column, face: Column) -> Column:
    """Numbers of the corners of a face."""
    return F.get(by_kind(eclass, lambda k: shapes.faces(eclass, k), at), face)


def n_children(eclass: int, at: Column) -> Column:
    return by_kind(eclass, lambda k: len(shapes.children(eclass, k)), at)


def n_faces(eclass: int, at: Column) -> Column:
    return by_kind(eclass, lambda k: len(shapes.faces(eclass, k)), at)


def _padded(eclass: int, make) -> list[list]:
    most = max(len(shapes.faces(eclass, k)) for k in shapes.kinds(eclass))
    return [[make(k, f) if f < len(shapes.faces(eclass, k)) else None for f in range(most)] for k in shapes.kinds(eclass)]


def tree_face(eclass: int, at: Column, level: Column, face: Column) -> Column:
    """The face of the tree that an element's face lies on; null inside the tree."""
    dim = shapes.DIM[eclass]
    rows = _padded(eclass, lambda k, f: shapes.tree_face(eclass, k, f))
    candidate = F.get(F.get(_list([[-1 if x is None else x for x in r] for r in rows]), at["kind"]), face)
    # What the face's vector makes of the element's corner, in the grid of its level.
    normals = _list([list(shapes.outward(eclass, shapes.ROOT[eclass], f)) for f in range(len(shapes.faces(eclass)))])
    heights = _list([shapes.level_of(eclass, f) for f in range(len(shapes.faces(eclass)))])
    corner = F.get(F.get(_list(_offsets(eclass)), at["kind"]), F.get(face_corners(eclass, at, face), F.lit(0)))
    n = F.get(normals, candidate)
    height = sum(((at[XYZ[a]] + corner[a]) * n[a] for a in range(dim)), _long(0))
    return F.when((candidate >= 0) & (height == shl(F.lit(1), level) * F.get(heights, candidate)), candidate)


def step_out(eclass: int, at: Column, face: Column) -> Column:
    """A vector out of the element's face, of about the cell's size."""
    most = max(len(shapes.faces(eclass, k)) for k in shapes.kinds(eclass))
    rows = [[[float(x) for x in shapes.outward(eclass, k, f)] if f < len(shapes.faces(eclass, k)) else [0.0] * shapes.DIM[eclass] for f in range(most)] for k in shapes.kinds(eclass)]
    return F.get(F.get(_list(rows), at["kind"]), face)
