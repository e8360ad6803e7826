import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from foliate.functions import elements, shapes
from foliate.functions.eclass import HEX, LINE, PRISM, PYRAMID, QUAD, TET, TRIANGLE, VERTEX
from foliate.operators import forest as fo
from foliate.operators import geometry, topology
from foliate.plans.tables import written
from foliate.sources import cmesh

SOLID = [LINE, QUAD, TRIANGLE, HEX, TET, PRISM, PYRAMID]
LEVEL = {LINE: 3, QUAD: 2, TRIANGLE: 2, HEX: 2, TET: 2, PRISM: 2, PYRAMID: 2}


def close(a, b):
    return all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))


def test_tables_follow_the_known_counts():
    for c in SOLID:
        kinds, counts = [shapes.ROOT[c]], []
        for _ in range(4):
            counts.append(len(kinds))
            kinds = [k for x in kinds for _, k in shapes.children(c, x)]
        assert counts == [1, 10, 92, 808] if c == PYRAMID else [len(shapes.children(c, 0)) ** n for n in range(4)] == counts
    # A child's cell and type tell its parent's type, but for tets of pyramid trees, which may lie in a pyramid or a tet.
    assert all(len(v) == 1 for c in SOLID if c != PYRAMID for v in shapes.parent_kind(c).values())
    assert [len(shapes.children_at_face(TET, 0, f)) for f in range(4)] == [4] * 4
    assert [[k for k, _ in shapes.children_at_face(PYRAMID, shapes.UP, f)] for f in range(5)] == [[0, 3, 4, 9], [2, 5, 7, 9], [0, 1, 2, 9], [4, 6, 7, 9], [0, 2, 4, 7]]


@pytest.mark.parametrize("c", [TRIANGLE, TET, PYRAMID])
def test_points_are_found_in_their_elements(spark, c):
    f = fo.uniform(cmesh.one(spark, c), c, LEVEL[c], 6)
    at = elements.place(c, F.col("id"), F.col("level"))
    rows = f.leaves.withColumn("mid", elements.mean(elements.corners(c, at, F.col("level")), shapes.DIM[c]))
    found = rows.withColumn("again", elements.at_point(c, [F.get("mid", F.lit(a)) for a in range(shapes.DIM[c])], F.col("level")))
    assert found.where("again is null or again <> id").count() == 0
    assert found.count() == f.leaves.select("id").distinct().count() == (92 if c == PYRAMID else 2 ** (shapes.DIM[c] * LEVEL[c]))


@pytest.mark.parametrize("c", [QUAD, PRISM, PYRAMID])
def test_volumes_add_up(spark, c):
    trees = cmesh.hypercube(spark, c)
    rows = geometry.measured(fo.uniform(trees, c, 2, 4).leaves, trees, c)
    assert abs(rows.agg(F.sum("volume")).first()[0] - 1) < 1e-9
    assert all(close(r.centroid, r.linear_centroid) for r in rows.collect())


def physical_neighbours(spark, trees, c, level):
    """Checks each pair of neighbours by the corners of their faces in space; gives the number of pairs and of sides."""
    faces = cmesh.joined_by_vertices(trees)
    assert cmesh.inconsistent_faces(faces).isEmpty()
    f = fo.uniform(trees, c, level, 5)
    rows = {(r.tree_id, r.id): r for r in geometry.with_corners(f.leaves, trees, c).withColumn("kind", F.col("_at.kind")).select("tree_id", "id", "kind", "corners").collect()}
    sides = fo.face_neighbours(f.leaves.select("tree_id", "level", "id"), c, faces).collect()
    at = lambda t, i, face: sorted(tuple(round(x, 6) + 0.0 for x in rows[t, i].corners[k]) for k in shapes.faces(c, rows[t, i].kind)[face])
    where = {}
    for t, i in rows:
        for face in range(len(shapes.faces(c, rows[t, i].kind))):
            where.setdefault(str(at(t, i, face)), []).append((t, i, face))
    for s in sides:
        mine = where[str(at(s.tree_id, s.id, s.face))]
        want = [x for x in mine if x != (s.tree_id, s.id, s.face)]
        assert want == ([] if s.neigh_id is None else [(s.neigh_tree, s.neigh_id, s.dual)]), (s, want)
    return sum(s.neigh_id is not None for s in sides), len(sides)


@pytest.mark.parametrize("c", [TRIANGLE, PYRAMID])
def test_neighbours_share_their_faces_in_space(spark, c):
    pairs, sides = physical_neighbours(spark, cmesh.hypercube(spark, c), c, 2)
    assert 0 < pairs < sides


def even(p):
    return sum(x > y for k, x in enumerate(p) for y in p[k + 1 :]) % 2 == 0


def numberings(c):
    """Ways to number a tree's corners anew that turn it into itself; solids aren't mirrored."""
    points = shapes.corners(c)
    if c in (LINE, TRIANGLE, TET):
        return [list(p) for p in permutations(range(len(points))) if c != TET or even(p)]
    if c in (QUAD, HEX):
        dim, out = shapes.DIM[c], []
        for axes in permutations(range(dim)):
            for flips in range(1 << dim):
                if dim == 2 or even(axes) == (bin(flips).count("1") % 2 == 0):
                    out.append([points.index(tuple(p[axes[a]] ^ (flips >> a & 1) for a in range(dim))) for p in points])
        return out
    if c == PRISM:
        return [[*p, *(3 + x for x in p)] if even(p) else [*(3 + x for x in p), *p] for p in permutations(range(3))]
    return [[*q, 4] for q in ([0, 1, 2, 3], [1, 3, 0, 2], [3, 2, 1, 0], [2, 0, 3, 1])]


@pytest.mark.parametrize("c", [QUAD, HEX, TET, PRISM])
def test_trees_turned_against_each_other(spark, c):
    rnd = random.Random(c)
    base = cmesh.hypercube(spark, c).collect() if c not in (LINE, QUAD, HEX) else cmesh.brick(spark, *[2] * shapes.DIM[c]).collect()
    ways, rows = numberings(c), []
    for copy in range(3):
        for r in base:
            own = rnd.choice(ways)
            rows.append((len(rows), c, [[x + 10.0 * copy * (a == 0) for a, x in enumerate(r.vertices[k])] for k in own]))
    trees = spark.createDataFrame(rows, "tree_id long, eclass int, vertices array<array<double>>")
    assert physical_neighbours(spark, trees, c, 1)[0] > 0


@pytest.mark.parametrize("c", [TRIANGLE, PYRAMID])
def test_balance_and_ghosts_of_other_classes(spark, c):
    trees = cmesh.hypercube(spark, c)
    faces = cmesh.joined_by_vertices(trees).cache()
    deep = fo.stored(fo.refine_recursive(fo.uniform(trees, c, 0, 3), (F.col("tree_id") == 0) & (F.col("id") == 0)))
    assert not fo.is_balanced(deep, faces)
    out = fo.balance(deep, faces)
    assert fo.is_balanced(out, faces) and fo.overlapping(out).isEmpty()
    assert abs(geometry.measured(out.leaves, trees, c).agg(F.sum("volume")).first()[0] - 1) < 1e-9
    ranked = fo.partition(out, 3).cache()
    ghost = fo.ghosts(out, ranked, faces)
    assert ghost.count() > 0 and ghost.where("rank = owner").isEmpty()


def test_pyramid_families_merge(spark):
    f = fo.uniform(cmesh.one(spark, PYRAMID), PYRAMID, 2, 4)
    assert fo.adapt(f, coarsen=F.lit(True)).leaves.count() == 10
    assert fo.coarsen_recursive(fo.stored(f), F.lit(True)).leaves.count() == 1


def test_impossible_joins_are_refused(spark):
    f = fo.uniform(cmesh.bigmesh(spark, 2, 2), QUAD, 1, 3)
    wrong = spark.createDataFrame([(0, 1, 1, 0, 3, False)], cmesh.FACE_SCHEMA)
    with pytest.raises(Exception, match="can't be joined"):
        fo.face_neighbours(f.leaves, QUAD, wrong).collect()


@pytest.mark.parametrize("c", [TET])
def test_half_neighbours_touch(spark, c):
    trees = cmesh.hypercube(spark, c)
    faces = written(cmesh.joined_by_vertices(trees), "faces")
    cells = fo.uniform(trees, c, 1, 3).leaves.select("tree_id", "level", "id")
    halves = written(topology.half_face_neighbours(cells, c, faces), "halves")
    back = fo.face_neighbours(halves.where("tree_id = 0 and id < 3").select(F.col("neigh_tree").alias("tree_id"), (F.col("level") + 1).alias("level"), F.col("neigh_id").alias("id"), F.col("dual").alias("own"), F.col("tree_id").alias("from_tree"), F.col("id").alias("from_id")).distinct(), c, faces).where("face = own")
    # Across the half neighbour's own face lies a child of the element it was found from.
    assert back.where(~((F.col("neigh_tree") == F.col("from_tree")) & (fo.parent_id(c, F.col("neigh_id")) == F.col("from_id")))).count() == 0
    per_face = halves.groupBy("tree_id", "id", "face").count().select("count").distinct().collect()
    assert {r[0] for r in per_face} == {4}


@pytest.mark.parametrize("c", [QUAD, TET])
def test_points_in_elements(spark, c):
    rnd = random.Random(2)
    trees = cmesh.hypercube(spark, c)
    rows = written(geometry.with_corners(fo.uniform(trees, c, 1, 3).leaves, trees, c).drop("_vertices"), "cells")
    points = spark.createDataFrame([([rnd.random(), rnd.random(), rnd.random() if shapes.DIM[c] == 3 else 0.0],) for _ in range(60)], "p array<double>")
    hit = rows.crossJoin(points).where(geometry.point_inside(c, F.col("_at.kind"), F.col("corners"), F.col("p"), 1e-9))
    assert hit.groupBy("p").count().select("count").distinct().collect() == [(1,)] and hit.select("p").distinct().count() == 60


def test_vertex_class_and_faces(spark):
    assert fo.uniform(cmesh.one(spark, VERTEX), VERTEX, 3, 5).leaves.collect()[0].id == 0
    trees = cmesh.hypercube(spark, HEX)
    faces = geometry.with_faces(fo.uniform(trees, HEX, 1, 2).leaves, trees, HEX)
    total = faces.groupBy("id").agg(*[F.sum(F.col("face_area") * F.get("face_normal", F.lit(a))).alias(f"n{a}") for a in range(3)]).collect()
    assert len(total) == 8 and all(abs(r[k]) < 1e-12 for r in total for k in (1, 2, 3))
