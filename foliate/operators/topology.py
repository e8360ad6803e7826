"""Relations between elements of one class: descendants, and neighbours across faces, inside trees and from tree to tree."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import elements, morton, shapes
from foliate.functions.eclass import HEX, LINE, QUAD
from foliate.functions.morton import shl, shr

BOXES = (LINE, QUAD, HEX)
#: How far outside a face its neighbour is looked for, in cells: little enough for the point to stay in it.
STEP = 1 / 64


def ancestor(eclass: int, id: Column, level: Column, to: Column) -> Column:
    return shr(id, (level - to) * shapes.BITS[eclass])


def first_descendant(eclass: int, id: Column, level: Column, at: Column) -> Column:
    return shl(id, (at - level) * shapes.BITS[eclass])


def last_descendant(eclass: int, id: Column, level: Column, at: Column) -> Column:
    """No id of the level `at` below the element is greater."""
    return shl(id + 1, (at - level) * shapes.BITS[eclass]) - 1


def ancestors(cells: DataFrame, eclass: int, least: int = 0) -> DataFrame:
    """Each cell under itself and each of its ancestors: columns `at_level` and `at_id` besides its own."""
    up = cells.withColumn("at_level", F.explode(F.sequence(F.lit(least), F.col("level"))))
    return up.withColumn("at_id", ancestor(eclass, F.col("id"), F.col("level"), F.col("at_level")))


def nca(eclass: int, a: Column, level_a: Column, b: Column, level_b: Column) -> Column:
    """struct(level, id) of the nearest common ancestor: the deepest level at which both have the same one."""
    low = F.least(level_a, level_b)
    same = lambda at: ancestor(eclass, a, level_a, at) == ancestor(eclass, b, level_b, at)
    level = F.array_max(F.filter(F.sequence(F.lit(0), low.cast("int")), same))
    return F.struct(level.alias("level"), ancestor(eclass, a, level_a, level).alias("id"))


def parent_face(eclass: int, id: Column, level: Column, face: Column) -> Column:
    """Number in the parent of the face that an element's face lies in, or -1 if that is inside the parent; -1 stays -1."""
    up = shr(id, shapes.BITS[eclass])
    parent = elements.place(eclass, up, level - 1)["kind"]
    child = elements.digit(eclass, id, level, level)
    most = max(len(shapes.faces(eclass, k)) for k in shapes.kinds(eclass))

    def table(kind: int) -> list[int]:
        out = [-1] * (16 * most)
        for f in range(len(shapes.faces(eclass, kind))):
            for k, own in shapes.children_at_face(eclass, kind, f):
                out[k * most + own] = f
        return out

    rows = elements._list([table(k) for k in shapes.kinds(eclass)])
    return F.when(face < 0, -1).otherwise(F.get(F.get(rows, parent), child * most + face))


def ancestor_face(eclass: int, id: Column, level: Column, to: Column, face: Column) -> Column:
    """The same for the ancestor at level `to`."""
    if eclass in BOXES:
        # Children keep the numbers of faces; a face is in the parent's where the child's bit of that axis says so, on all levels between.
        axis, dim = F.floor(face / 2).cast("int"), shapes.DIM[eclass]
        side = face % 2
        steps = F.when(level > to, F.sequence(F.lit(0), (level - to - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.when(F.forall(steps, lambda k: shr(id, k * dim + axis).bitwiseAND(F.lit(1).cast("long")) == side), face.cast("int")).otherwise(-1)
    steps = F.when(level > to, F.sequence(level.cast("int"), (to + 1).cast("int"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, face.cast("int"), lambda f, at: parent_face(eclass, ancestor(eclass, id, level, at), at, f))


def _boxes(cells: DataFrame, eclass: int) -> DataFrame:
    """`cells` once for each face, with the element across it where that is inside the tree, by arithmetic on coordinates alone."""
    dim = shapes.DIM[eclass]
    # Coordinates are columns of their own at each step: expressions that name them many times would be copied as often.
    faced = cells.withColumn("face", F.explode(F.array(*[F.lit(f) for f in morton.faces(dim)])))
    at, to = [f"_at{k}" for k in range(dim)], [f"_to{k}" for k in range(dim)]
    faced = faced.withColumns(dict(zip(at, morton.decode(F.col("id"), dim), strict=True)))
    faced = faced.withColumns(dict(zip(to, morton.face_neighbour(list(map(F.col, at)), F.col("face")), strict=True)))
    inside = morton.inside(list(map(F.col, to)), F.col("level"))
    size = shl(F.lit(1), F.col("level"))
    # The middle of the face, for those that go on in another tree.
    middle = [F.when(F.col("face") == 2 * a, F.col(c)).when(F.col("face") == 2 * a + 1, F.col(c) + 1).otherwise(F.col(c) + 0.5) / size for a, c in enumerate(at)]
    out = [F.when(F.col("face") == 2 * a, -1.0).when(F.col("face") == 2 * a + 1, 1.0).otherwise(0.0) for a in range(dim)]
    found = {"_root": F.when(~inside, F.col("face")), "neigh_id": F.when(inside, morton.encode(*[F.pmod(F.col(c).cast("long"), size) for c in to])), "dual": F.when(inside, F.col("face").bitwiseXOR(F.lit(1))), "_mid": F.array(*middle), "_out": F.array(*out)}
    return faced.select(*cells.columns, "face", _kept(found))


def _kept(found: dict[str, Column]) -> Column:
    """Columns worked out once: made into rows of a generator, through which filters on them are not pushed, with copies of what they name."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in found.items()])))


def _shapes(cells: DataFrame, eclass: int) -> DataFrame:
    """The same for every class, by the element that holds a point just outside the face."""
    dim = shapes.DIM[eclass]
    faced = cells.withColumn("_at", elements.place(eclass, F.col("id"), F.col("level")))
    faced = faced.withColumn("face", F.explode(F.sequence(F.lit(0), elements.n_faces(eclass, F.col("_at")) - 1)))
    points = F.transform(elements.face_corners(eclass, F.col("_at"), F.col("face")), lambda c: F.get(F.col("_points"), c))
    faced = faced.withColumn("_points", elements.corners(eclass, F.col("_at"), F.col("level"))).withColumn("_mid", elements.mean(points, dim)).drop("_points")
    faced = faced.select(*cells.columns, "face", "_mid", _kept({"_out": elements.step_out(eclass, F.col("_at"), F.col("face")), "_root": elements.tree_face(eclass, F.col("_at"), F.col("level"), F.col("face"))}))
    there = elements.at_point(eclass, [_beyond(a) for a in range(dim)], F.col("level"))
    faced = faced.select(*cells.columns, "face", "_mid", "_out", "_root", _kept({"neigh_id": F.when(F.col("_root").isNull(), there)}))
    return _with_dual(faced, eclass, "_mid")


def _beyond(axis: int) -> Column:
    return F.get("_mid", F.lit(axis)) + F.get("_out", F.lit(axis)) * STEP / shl(F.lit(1), F.col("level")).cast("double")


def _with_dual(met: DataFrame, eclass: int, mid: str) -> DataFrame:
    """`dual`: the face of `neigh_id` whose middle is nearest to the point `mid`. Its place and corners are columns first, so that each is worked out once."""
    dim = shapes.DIM[eclass]
    met = met.withColumn("_there_at", elements.place(eclass, F.col("neigh_id"), F.col("level")))
    met = met.withColumn("_there_points", elements.corners(eclass, F.col("_there_at"), F.col("level")))

    def away(face: Column) -> Column:
        points = F.transform(elements.face_corners(eclass, F.col("_there_at"), face), lambda c: F.get("_there_points", c))
        gap = F.zip_with(elements.mean(points, dim), F.col(mid), lambda a, b: (a - b) * (a - b))
        return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)

    ranked = F.transform(F.sequence(F.lit(0), elements.n_faces(eclass, F.col("_there_at")) - 1), lambda f: F.struct(away(f).alias("d"), f.alias("f")))
    return met.withColumn("dual", F.when(F.col("neigh_id").isNotNull(), F.array_min(ranked)["f"])).drop("_there_at", "_there_points")


def face_neighbours(cells: DataFrame, eclass: int, tree_faces: DataFrame | None = None) -> DataFrame:
    """Each cell once for each face with the element of the same level across it, as `neigh_tree`, `neigh_id` and `dual`, its face there.

    At a tree's boundary the neighbour lies in the tree that `tree_faces(tree_id, face, neigh_tree, neigh_face, orientation, is_boundary)` joins
    there, turned as the orientation says (without that column: 0); without one it is null. Trees that are joined have one class: an
    orientation or face that can't be raises an error.
    """
    faced = (_boxes if eclass in BOXES else _shapes)(cells, eclass)
    names = [*cells.columns, "face"]
    if tree_faces is None:
        return faced.select(*names, F.when(F.col("neigh_id").isNotNull(), F.col("tree_id")).alias("neigh_tree"), "neigh_id", F.col("dual").cast("int").alias("dual"))
    dim = shapes.DIM[eclass]
    turn = F.col("orientation") if "orientation" in tree_faces.columns else F.lit(0)
    across = tree_faces.where("not is_boundary").select("tree_id", F.col("face").alias("_root"), F.col("neigh_tree").alias("_tree"), F.col("neigh_face").alias("_face"), turn.alias("_turn"))
    inside = faced.where("_root is null").select(*names, F.col("tree_id").alias("neigh_tree"), "neigh_id", F.col("dual").cast("int").alias("dual"))
    met = faced.where("_root is not null").join(across, ["tree_id", "_root"], "left")
    n = len(shapes.faces(eclass))
    maps = [[[None] * 4 for _ in range(n)] for _ in range(n)]
    for _, f, _, g, o in shapes.meetings([eclass]):
        maps[f][g][o] = [list(row) for row in shapes.crossing(eclass, f, eclass, g, o)]
    kind = "array<array<array<array<array<double>>>>>"
    table = F.from_json(F.lit(json.dumps(maps)), kind)
    matrix = F.when(F.col("_tree").isNotNull(), F.coalesce(F.get(F.get(F.get(table, F.col("_root")), F.col("_face")), F.col("_turn")), F.raise_error(F.lit("faces of trees that can't be joined")).cast("array<array<double>>")))
    met = met.withColumn("_map", matrix)
    to = lambda p, r: sum((F.get(F.get("_map", F.lit(r)), F.lit(c)) * p(c) for c in range(dim)), F.get(F.get("_map", F.lit(r)), F.lit(dim)))
    met = met.withColumns({f"_q{r}": to(_beyond, r) for r in range(dim)} | {"_there": F.array(*[to(lambda c: F.get("_mid", F.lit(c)), r) for r in range(dim)])})
    met = met.withColumn("neigh_id", F.when(F.col("_tree").isNotNull(), elements.at_point(eclass, [F.col(f"_q{r}") for r in range(dim)], F.col("level"))))
    met = _with_dual(met, eclass, "_there")
    return inside.unionByName(met.select(*names, F.col("_tree").alias("neigh_tree"), "neigh_id", F.col("dual").cast("int").alias("dual")))


def half_face_neighbours(cells: DataFrame, eclass: int, tree_faces: DataFrame | None = None) -> DataFrame:
    """Each cell once for each face and child of its neighbour there: `neigh_tree`, `sub` (their number at the face), `neigh_id` and `dual` of the child."""
    across = face_neighbours(cells, eclass, tree_faces).where("neigh_id is not null")
    across = across.withColumn("_at", elements.place(eclass, F.col("neigh_id"), F.col("level")))
    most = max(len(shapes.faces(eclass, k)) for k in shapes.kinds(eclass))
    at_face = lambda k: [[list(x) for x in shapes.children_at_face(eclass, k, f)] if f < len(shapes.faces(eclass, k)) else [[-1, -1]] for f in range(most)]
    subs = F.get(elements.by_kind(eclass, at_face, F.col("_at")), F.col("dual"))
    each = across.select("*", F.posexplode(subs).alias("sub", "_child"))
    child = shl(F.col("neigh_id"), shapes.BITS[eclass]) + F.get("_child", F.lit(0))
    return each.withColumns({"neigh_id": child, "dual": F.get("_child", F.lit(1))}).drop("_child", "_at")
