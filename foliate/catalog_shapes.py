"""Registered queries over elements of all classes, meshes and geometry, each beside its SQL.

The SQL finds elements by its own way: a level's elements are all cells and types whose centre lies in an element of the level before, and two
elements are neighbours where the corners of their faces are the same points.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.catalog import DEPTH, ORDERED, RANKED, RANKS, TREE, _BTREE, _PAIRS, _tree, query
from foliate.functions import eclass, elements, morton, shapes, vec
from foliate.functions.eclass import HEX, LINE, PRISM, PYRAMID, QUAD, TET, TRIANGLE
from foliate.operators import forest as fo
from foliate.operators import geometry, topology
from foliate.plans import points as pt
from foliate.sources import cmesh

NAMES = {LINE: "line", QUAD: "quad", TRIANGLE: "triangle", HEX: "hex", TET: "tet", PRISM: "prism", PYRAMID: "pyramid"}
DEEP = {LINE: 5, QUAD: 3, TRIANGLE: 4, HEX: 2, TET: 3, PRISM: 3, PYRAMID: 3}
FLAT = {LINE: 3, QUAD: 2, TRIANGLE: 2, HEX: 1, TET: 1, PRISM: 1, PYRAMID: 1}


def _region(c: int, kind: str, x: str, y: str, z: str) -> str:
    """Whether a point of the unit cell lies in a type."""
    if c in (TRIANGLE, PRISM):
        return f"(({x} < {y})::INT = {kind})"
    if c in (TET, PYRAMID):
        orders = {0: (x, z, y), 1: (x, y, z), 2: (y, x, z), 3: (y, z, x), 4: (z, y, x), 5: (z, x, y)}
        cases = " ".join(f"WHEN {k} THEN {a} > {b} AND {b} > {d}" for k, (a, b, d) in orders.items())
        return f"(CASE {kind} {cases} WHEN 6 THEN {x} > {z} AND {y} > {z} ELSE {x} < {z} AND {y} < {z} END)"
    return "true"


def _corner_rows(c: int) -> str:
    rows = [(k, n, *p, *[0] * (3 - len(p))) for k in shapes.kinds(c) for n, p in enumerate(shapes.corners(c, k))]
    return f"k(kind, corner, dx, dy, dz) AS (VALUES {', '.join(map(str, rows))})"


def _levels(c: int, deepest: int) -> str:
    """CTEs: k, the corners of each type; e, the elements of all levels of one tree, with their cells and types."""
    dim, bits = shapes.DIM[c], shapes.BITS[c]
    held = "true" if c != PYRAMID else "((p.kind >= 6 AND m.kind IN (0, 3, 6, 7)) OR (p.kind < 6 AND m.kind < 6))"
    out = [_corner_rows(c), "m AS (SELECT kind, avg(dx) AS mx, avg(dy) AS my, avg(dz) AS mz FROM k GROUP BY kind)", f"corner_cells AS (SELECT unnest(range(0, {1 << dim})) AS cell)"]
    out.append(f"e0 AS (SELECT 0 AS level, 0::BIGINT AS id, 0::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS z, {shapes.ROOT[c]} AS kind)")
    x, y, z = (f"(((cell >> {a}) & 1) + m.m{n}) / 2" for a, n in enumerate("xyz"))
    for n in range(1, deepest + 1):
        out.append(f"e{n} AS (SELECT {n} AS level, p.id * {1 << bits} + row_number() OVER (PARTITION BY p.id ORDER BY cell, m.kind) - 1 AS id, p.x * 2 + (cell & 1) AS x, p.y * 2 + ((cell >> 1) & 1) AS y, p.z * 2 + ((cell >> 2) & 1) AS z, m.kind FROM e{n - 1} p, corner_cells, m WHERE {held} AND {_region(c, 'p.kind', x, y, z)})")
    out.append("e AS (" + " UNION ALL ".join(f"SELECT * FROM e{n}" for n in range(deepest + 1)) + ")")
    return ", ".join(out)


def _elements(c: int):
    name = f"{NAMES[c]}_elements"

    def run(spark, sf_dir):
        cells = cmesh.one(spark, c).select("tree_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("id"))
        every, now = cells, cells
        for _ in range(DEEP[c]):
            now = fo.children(now, c)
            every = every.unionByName(now)
        at = every.withColumn("at", elements.place(c, F.col("id"), F.col("level")))
        return at.select("level", "id", F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.col("at.z").alias("z"), F.col("at.kind").alias("kind"))

    run.__name__, run.__doc__ = name, f"All elements of a {NAMES[c]} tree down to level {DEEP[c]}, with their cells and types."
    return query(f"WITH {_levels(c, DEEP[c])} SELECT level, id, x, y, z, kind FROM e")(run)


for _c in (TRIANGLE, TET, PRISM, PYRAMID):
    _elements(_c)


def _relations(c: int):
    name, bits, top = f"{NAMES[c]}_relations", shapes.BITS[c], DEEP[c] - 1

    def run(spark, sf_dir):
        f = fo.uniform(cmesh.one(spark, c), c, top, 10)
        level, id = F.col("level"), F.col("id")
        at = f.leaves.withColumn("at", elements.place(c, id, level))
        size = fo.family_size(c, fo.parent_id(c, id), level - 1)
        both = topology.nca(c, id, level, F.lit(0).cast("long"), F.lit(10))
        return at.select(
            "id", fo.parent_id(c, id).alias("parent"), fo.child_number(c, id).cast("int").alias("child_id"), elements.n_children(c, F.col("at")).alias("n_children"), size.alias("n_siblings"), elements.shape(c, F.col("at")).alias("shape"),
            elements.n_faces(c, F.col("at")).alias("n_faces"), topology.first_descendant(c, id, level, F.lit(6)).alias("first6"), both["level"].alias("nca_level"), both["id"].alias("nca_id"),
        )

    run.__name__, run.__doc__ = name, f"Family, shape, descendants and common ancestors of the elements of a {NAMES[c]} level."
    up, common = f"(id >> {bits})", " ".join(f"WHEN id >> {bits * (top - n)} = 0 THEN {n}" for n in range(top, 0, -1))
    shape = f"CASE WHEN kind < 6 THEN {TET} ELSE {PYRAMID} END" if c == PYRAMID else str(c)
    kids = "CASE WHEN kind < 6 THEN 8 ELSE 10 END" if c == PYRAMID else str(len(shapes.children(c, 0)))
    faces = "CASE WHEN kind < 6 THEN 4 ELSE 5 END" if c == PYRAMID else str(len(shapes.FACES[c]))
    sql = f"WITH {_levels(c, top)} SELECT id, {up} AS parent, CAST(id - {up} * {1 << bits} AS INT) AS child_id, {kids} AS n_children, CAST(count(*) OVER (PARTITION BY {up}) AS INT) AS n_siblings, {shape} AS shape, {faces} AS n_faces, id << {bits * (6 - top)} AS first6, CASE {common} ELSE 0 END AS nca_level, 0::BIGINT AS nca_id FROM e{top}"
    return query(sql)(run)


for _c in (TRIANGLE, TET, PRISM, PYRAMID):
    _relations(_c)


def _face_rows(c: int) -> str:
    rows = [(k, f, x) for k in shapes.kinds(c) for f, ids in enumerate(shapes.faces(c, k)) for x in ids]
    return f"fc(kind, face, corner) AS (VALUES {', '.join(map(str, rows))})"


def _blend(c: int, axis: int) -> str:
    """A coordinate in space of the point (u, v, w) of the reference tree, of vertices p0, p1, ... (lists)."""
    n = len(shapes.corners(c))
    if c in (LINE, QUAD, HEX):
        weights = ["*".join(f"({a if p[k] else f'(1 - {a})'})" for k, a in enumerate("uvw"[: shapes.DIM[c]])) for p in shapes.corners(c)]
    elif c == TRIANGLE:
        weights = ["(1 - u)", "(u - v)", "v"]
    elif c == TET:
        weights = ["(1 - u)", "(u - w)", "(w - v)", "v"]
    elif c == PRISM:
        weights = [f"{a} * {b}" for b in ("(1 - w)", "w") for a in ("(1 - u)", "(u - v)", "v")]
    else:
        s, t = "(CASE WHEN w < 1 THEN 1 - (1 - u) / (1 - w) ELSE 0 END)", "(CASE WHEN w < 1 THEN 1 - (1 - v) / (1 - w) ELSE 0 END)"
        weights = [*(f"(1 - w) * {a} * {b}" for b in (f"(1 - {t})", t) for a in (f"(1 - {s})", s)), "w"]
    return " + ".join(f"{weights[k]} * vs[{k + 1}][{axis + 1}]" for k in range(n))


def _mesh(c: int) -> list[list[list[float]]]:
    """Vertices of a mesh for the SQL: the cut cube, or a brick for boxes, stretched and sheared, with turned trees."""
    cube = [[float(k >> a & 1) for a in range(3)] for k in range(8)]
    if c in (LINE, QUAD, HEX):
        sizes = [2 if a < min(shapes.DIM[c], 2) else 1 for a in range(shapes.DIM[c])]
        places = [[k % 2, k // 2 % 2, 0][: shapes.DIM[c]] for k in range(2 ** min(shapes.DIM[c], 2))] if sizes else [[]]
        found = [[[float(at[a] + p[a]) if a < len(at) else 0.0 for a in range(3)] for p in shapes.corners(c)] for at in places]
    else:
        found = [[cube[k] for k in cut] for cut in cmesh.CUBE_TREES[c]]
    turns = {LINE: [1, 0], QUAD: [1, 3, 0, 2], TRIANGLE: [2, 0, 1], HEX: [1, 3, 0, 2, 5, 7, 4, 6], TET: [1, 2, 0, 3], PRISM: [1, 2, 0, 4, 5, 3], PYRAMID: [1, 3, 0, 2, 4]}
    turned = [[v[k] for k in turns[c]] if n % 2 else v for n, v in enumerate(found)]
    return [[[2 * x + y, y + 0.5 * z, 3 * z] for x, y, z in v] for v in turned]


def _mesh_rows(c: int) -> str:
    return "t(tree_id, vs) AS (VALUES " + ", ".join(f"({n}::BIGINT, {v})" for n, v in enumerate(_mesh(c))) + ")"


def _in_space(c: int, level: int) -> str:
    """CTEs up to q: the corners in space of all elements of a level of the mesh, one row each, rounded to a text `s` too."""
    size = f"{1 << level}.0"
    xyz = ", ".join(f"{_blend(c, a)} AS p{a}" for a in range(3))
    text = " || ',' || ".join(f"round(p{a} + 0.0, 6)" for a in range(3))
    return f"{_levels(c, level)}, {_mesh_rows(c)}, r AS (SELECT t.tree_id, t.vs, e{level}.id, e{level}.kind, k.corner, (x + dx) / {size} AS u, (y + dy) / {size} AS v, (z + dz) / {size} AS w FROM e{level} JOIN k USING (kind), t), q0 AS (SELECT tree_id, id, kind, corner, {xyz} FROM r), q AS (SELECT *, {text} AS s FROM q0)"


def _trees(spark, c: int):
    return cmesh._trees(spark, [(c, v) for v in _mesh(c)])


def _neighbours(c: int):
    def run(spark, sf_dir):
        trees = _trees(spark, c)
        f = fo.uniform(trees, c, FLAT[c], 5)
        out = fo.face_neighbours(f.leaves.select("tree_id", "level", "id"), c, cmesh.joined_by_vertices(trees))
        return out.select("tree_id", "id", "face", "neigh_tree", "neigh_id", "dual")

    run.__name__, run.__doc__ = f"{NAMES[c]}_neighbours", f"Neighbours across all faces of a level of {NAMES[c]} trees that are turned against each other."
    sides = f"{_in_space(c, FLAT[c])}, {_face_rows(c)}, sides AS (SELECT tree_id, id, face, string_agg(s, ';' ORDER BY s) AS key FROM q JOIN fc USING (kind, corner) GROUP BY 1, 2, 3)"
    return query(f"WITH {sides} SELECT a.tree_id, a.id, a.face, b.tree_id AS neigh_tree, b.id AS neigh_id, b.face AS dual FROM sides a LEFT JOIN sides b ON a.key = b.key AND (a.tree_id <> b.tree_id OR a.id <> b.id)")(run)


for _c in NAMES:
    _neighbours(_c)


def _minus(a: str, b: str) -> list[str]:
    return [f"({a}[{k}] - {b}[{k}])" for k in (1, 2, 3)]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def _triangle_sql(a: str, b: str, c: str) -> str:
    n = _cross(_minus(b, a), _minus(c, a))
    return f"(sqrt({_dot(n, n)}) / 2)"


def _tet_sql(a: str, b: str, c: str, d: str) -> str:
    return f"(abs({_dot(_minus(a, d), _cross(_minus(b, d), _minus(c, d)))}) / 6)"


def _volume_sql(c: int) -> str:
    x = lambda *ks: [f"ps[{k + 1}]" for k in ks]
    if c == LINE:
        return "diam"
    if c == QUAD:
        return f"2 * {_triangle_sql(*x(0, 1, 2))}"
    if c == TRIANGLE:
        return _triangle_sql(*x(0, 1, 2))
    if c == TET:
        return _tet_sql(*x(0, 1, 2, 3))
    if c == HEX:
        return f"6 * {_tet_sql(*x(1, 2, 4, 0))}"
    if c == PRISM:
        return " + ".join(_tet_sql(*x(*k)) for k in ((0, 1, 2, 4), (0, 2, 3, 4), (2, 3, 4, 5)))
    return f"CASE WHEN kind < 6 THEN {_tet_sql(*x(0, 1, 2, 3))} ELSE {_tet_sql(*x(0, 1, 3, 4))} + {_tet_sql(*x(0, 3, 2, 4))} END"


_POINTS = "l AS (SELECT tree_id, id, kind, list([p0, p1, p2] ORDER BY corner) AS ps, avg(p0) AS c0, avg(p1) AS c1, avg(p2) AS c2 FROM q GROUP BY 1, 2, 3), d AS (SELECT q.tree_id, q.id, 2 * avg(sqrt((p0 - c0) * (p0 - c0) + (p1 - c1) * (p1 - c1) + (p2 - c2) * (p2 - c2))) AS diam FROM q JOIN l USING (tree_id, id) GROUP BY 1, 2), g AS (SELECT * FROM l JOIN d USING (tree_id, id))"


def _measures(c: int):
    def run(spark, sf_dir):
        trees = _trees(spark, c)
        rows = geometry.measured(fo.uniform(trees, c, FLAT[c], 5).leaves, trees, c)
        r = lambda x: F.round(x, 6)
        centre = [r(F.get("linear_centroid", F.lit(a)) + 0.0).alias(f"c{a}") for a in range(3)]
        return rows.select("tree_id", "id", r("volume").alias("volume"), r("diameter").alias("diameter"), *centre)

    run.__name__, run.__doc__ = f"{NAMES[c]}_geometry", f"Volume, diameter and centre of the elements of {NAMES[c]} trees."
    return query(f"WITH {_in_space(c, FLAT[c])}, {_POINTS} SELECT tree_id, id, round({_volume_sql(c)}, 6) AS volume, round(diam, 6) AS diameter, round(c0 + 0.0, 6) AS c0, round(c1 + 0.0, 6) AS c1, round(c2 + 0.0, 6) AS c2 FROM g")(run)


for _c in NAMES:
    _measures(_c)


def _faces(c: int):
    def run(spark, sf_dir):
        trees = _trees(spark, c)
        rows = geometry.with_faces(fo.uniform(trees, c, FLAT[c], 5).leaves, trees, c)
        r = lambda x: F.round(x, 6) + 0.0
        return rows.select("tree_id", "id", "face", r("face_area").alias("area"), *[r(F.get("face_centroid", F.lit(a))).alias(f"c{a}") for a in range(3)], *[r(F.get("face_normal", F.lit(a))).alias(f"n{a}") for a in range(3)])

    run.__name__, run.__doc__ = f"{NAMES[c]}_faces", f"Area, centre and outward normal of the faces of {NAMES[c]} elements."
    fs = [f"f[{k}]" for k in (1, 2, 3, 4)]
    mid = [f"({m} - f[1][{k}])" for k, m in enumerate(("c0", "c1", "c2"), 1)]
    if shapes.DIM[c] == 2:
        area = f"sqrt({_dot(_minus(fs[1], fs[0]), _minus(fs[1], fs[0]))})"
        along = _minus(fs[1], fs[0])
        raw = [f"-({m} - {_dot(mid, along)} / {_dot(along, along)} * {a})" for m, a in zip(mid, along, strict=True)]
    else:
        area = f"CASE WHEN len(f) = 3 THEN {_triangle_sql(*fs[:3])} ELSE {_triangle_sql(*fs[:3])} + {_triangle_sql(*fs[1:])} END"
        n = _cross(_minus(fs[1], fs[0]), _minus(fs[2], fs[0]))
        raw = [f"(CASE WHEN {_dot(n, mid)} > 0 THEN -1 ELSE 1 END * {x})" for x in n]
    return query(f"WITH {_in_space(c, FLAT[c])}, {_face_rows(c)}, {_POINTS}, sides AS (SELECT tree_id, id, face, list([p0, p1, p2] ORDER BY corner) AS f, avg(p0) AS f0, avg(p1) AS f1, avg(p2) AS f2 FROM q JOIN fc USING (kind, corner) GROUP BY 1, 2, 3), n AS (SELECT s.*, {area} AS area, {raw[0]} AS r0, {raw[1]} AS r1, {raw[2]} AS r2 FROM sides s JOIN l USING (tree_id, id)) SELECT tree_id, id, face, round(area, 6) + 0.0 AS area, round(f0, 6) + 0.0 AS c0, round(f1, 6) + 0.0 AS c1, round(f2, 6) + 0.0 AS c2, " + ", ".join(f"round(r{a} / sqrt(r0 * r0 + r1 * r1 + r2 * r2), 6) + 0.0 AS n{a}" for a in range(3)) + " FROM n")(run)


for _c in (QUAD, TRIANGLE, HEX, TET, PRISM, PYRAMID):
    _faces(_c)


@query(f"WITH {_levels(TRIANGLE, 5)}, places AS (SELECT event_id, greatest(least((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // {pt.EVENT_US}, 1023), 0)::BIGINT AS x, greatest(least(CAST(round(value * 100) AS BIGINT) // {pt.EVENT_CENTS}, 1023), 0)::BIGINT AS y FROM events), p AS (SELECT event_id, (x + 0.7) / 1024 * 32 AS x, (y + 0.3) / 1024 * 32 AS y FROM places) SELECT event_id, e5.id FROM p JOIN e5 ON floor(p.x) = e5.x AND floor(p.y) = e5.y AND (p.x - floor(p.x) < p.y - floor(p.y))::INT = e5.kind")
def located_in_triangles(spark, sf_dir):
    """The triangle of level 5 that holds each event's point, as far as the tree reaches."""
    at = pt.events(spark, sf_dir)
    x, y = (F.col("x") + 0.7) / 1024, (F.col("y") + 0.3) / 1024
    return at.select("event_id", elements.at_point(TRIANGLE, [x, y], F.lit(5)).alias("id")).where("id is not null")


_TRI = f"""{_levels(TRIANGLE, 5)}, places AS (SELECT event_id, greatest(least((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // {pt.EVENT_US}, 1023), 0)::BIGINT AS x, greatest(least(CAST(round(value * 100) AS BIGINT) // {pt.EVENT_CENTS}, 1023), 0)::BIGINT AS y FROM events),
p AS (SELECT event_id, (x + 0.7) / 1024 * 32 AS x, (y + 0.3) / 1024 * 32 AS y FROM places), deep AS (SELECT event_id, e5.id FROM p JOIN e5 ON floor(p.x) = e5.x AND floor(p.y) = e5.y AND (p.x - floor(p.x) < p.y - floor(p.y))::INT = e5.kind),
levels AS (SELECT unnest(range(0, 6))::INT AS level), cells AS (SELECT level, id >> (2 * (5 - level)) AS id, count(*) AS n FROM deep, levels GROUP BY 1, 2), split AS (SELECT level, id FROM cells WHERE n > 20 AND level < 5),
kids AS (SELECT level + 1 AS level, id * 4 + c.i AS id FROM split, (SELECT unnest(range(0, 4)) AS i) c UNION ALL SELECT 0, 0), leaves AS (SELECT k.level, k.id, coalesce(c.n, 0)::BIGINT AS n FROM kids k LEFT JOIN cells c USING (level, id) WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.level = k.level AND s.id = k.id))"""


def _triangle_tree(spark, sf_dir) -> fo.Forest:
    rows = located_in_triangles(spark, sf_dir).select(F.lit(0).cast("long").alias("tree_id"), "id")
    return fo.by_count(rows, TRIANGLE, 5, 20)


@query(f"WITH {_TRI} SELECT level, id, n FROM leaves")
def triangles_by_count(spark, sf_dir):
    """A tree of triangles, refined where it holds many events."""
    return _triangle_tree(spark, sf_dir).leaves.select("level", "id", "n")


_TRI_SIDES = f"{_face_rows(TRIANGLE)}, pts AS (SELECT level, id, face, string_agg(((x + dx) * (1 << (5 - level))) || ',' || ((y + dy) * (1 << (5 - level))), ';' ORDER BY (x + dx) * 64 + y + dy) AS key FROM e JOIN k USING (kind) JOIN fc USING (kind, corner) GROUP BY 1, 2, 3), near AS (SELECT a.level, a.id, b.id AS nid FROM pts a JOIN pts b ON a.level = b.level AND a.key = b.key AND a.id <> b.id)"


@query(f"WITH RECURSIVE {_TRI}, {_TRI_SIDES}, closed AS (SELECT level, id FROM split UNION SELECT c.level - 1 AS level, n.nid >> 2 AS id FROM closed c JOIN near n ON n.level = c.level AND n.id = c.id WHERE c.level > 0), bkids AS (SELECT level + 1 AS level, id * 4 + c.i AS id FROM closed, (SELECT unnest(range(0, 4)) AS i) c UNION ALL SELECT 0, 0) SELECT level, id FROM bkids k WHERE NOT EXISTS (SELECT 1 FROM closed s WHERE s.level = k.level AND s.id = k.id)")
def triangles_balanced(spark, sf_dir):
    """The same tree under the 2:1 rule over faces."""
    return fo.balance(_triangle_tree(spark, sf_dir)).leaves.select("level", "id")


@query("WITH c(eclass, trees, corners) AS (VALUES (1, 1, 2), (2, 1, 4), (3, 2, 3), (4, 1, 8), (5, 6, 4), (6, 2, 6), (7, 3, 5)) SELECT eclass, CAST(trees AS BIGINT) AS trees, CAST(trees * corners AS BIGINT) AS corners, CAST(0 AS BIGINT) AS negative, CAST(CASE eclass WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 0 WHEN 5 THEN 12 WHEN 6 THEN 2 ELSE 6 END AS BIGINT) AS inner_faces FROM c")
def hypercube_meshes(spark, sf_dir):
    """The unit cube of each class: trees, corners, trees that turn the wrong way, and faces that are joined."""
    trees = None
    for c in NAMES:
        own = cmesh.hypercube(spark, c).withColumn("tree_id", F.col("tree_id") + 100 * c)
        trees = own if trees is None else trees.unionByName(own)
    # Each class's cube stands apart from the others.
    trees = trees.withColumn("vertices", F.transform("vertices", lambda v: F.transform(v, lambda x, i: F.when(i == 0, x + F.col("eclass") * 5.0).otherwise(x))))
    joined = cmesh.joined_by_vertices(trees).where("not is_boundary").groupBy(F.expr("int(tree_id div 100)").alias("eclass")).agg(F.count("*").alias("j"))
    wrong = cmesh.negative_volumes(trees).groupBy("eclass").agg(F.count("*").alias("w"))
    counts = trees.groupBy("eclass").agg(F.count("*").alias("trees"), F.sum(F.size("vertices")).alias("corners"))
    return counts.join(joined, "eclass", "left").join(wrong, "eclass", "left").select("eclass", "trees", "corners", F.coalesce("w", F.lit(0)).alias("negative"), F.coalesce("j", F.lit(0)).alias("inner_faces"))


@query("SELECT i::BIGINT AS tree_id, (i + 1) % 9 AS next, 1 AS face, 2 AS next_face, 0 AS orientation, round(cos(2 * pi() * i / 9), 6) + 0.0 AS x1, round(sin(2 * pi() * i / 9), 6) + 0.0 AS y1 FROM (SELECT unnest(range(0, 9)) AS i)")
def prism_cake_mesh(spark, sf_dir):
    """Nine prisms around an axis: the connection of each with the next, and the corner that begins it."""
    trees = cmesh.prism_cake(spark, 9)
    joined = cmesh.joined_by_vertices(trees).where("not is_boundary and face = 1")
    first = trees.select("tree_id", (F.round(F.get(F.get("vertices", F.lit(1)), F.lit(0)), 6) + 0.0).alias("x1"), (F.round(F.get(F.get("vertices", F.lit(1)), F.lit(1)), 6) + 0.0).alias("y1"))
    return joined.join(first, "tree_id").select("tree_id", F.col("neigh_tree").alias("next"), "face", F.col("neigh_face").alias("next_face"), "orientation", "x1", "y1")


@query("SELECT i::BIGINT AS tree_id, (i + 1) % 7 AS next, 0 AS face, 1 AS next_face, 0 AS orientation FROM (SELECT unnest(range(0, 7)) AS i)")
def pyramid_cake_mesh(spark, sf_dir):
    """Seven pyramids around an axis: the connection of each with the next."""
    joined = cmesh.joined_by_vertices(cmesh.pyramid_cake(spark, 7)).where("not is_boundary and face = 0")
    return joined.select("tree_id", F.col("neigh_tree").alias("next"), "face", F.col("neigh_face").alias("next_face"), "orientation")


@query("SELECT eclass, trees, volume::DOUBLE AS volume FROM (VALUES (5, 6, 0.125), (6, 6, 0.375), (4, 4, 0.5)) v(eclass, trees, volume)")
def hybrid_cube_mesh(spark, sf_dir):
    """The cube of tets, prisms and hexes: trees and volume of each class."""
    trees = cmesh.hypercube_hybrid(spark)
    out = None
    for c in (TET, PRISM, HEX):
        own = trees.where(F.col("eclass") == c)
        leaves = fo.uniform(own, c, 0, 2).leaves
        part = geometry.measured(leaves, own, c).agg(F.lit(c).alias("eclass"), F.count("*").alias("trees"), F.round(F.sum("volume"), 9).alias("volume"))
        out = part if out is None else out.unionByName(part)
    return out.select("eclass", F.col("trees").cast("int").alias("trees"), "volume")


@query("WITH b AS (SELECT t % 4 AS x, t // 4 AS y FROM (SELECT unnest(range(0, 12)) AS t)), v AS (SELECT x + dx AS px, y + dy AS py, count(*) AS n FROM b, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy) GROUP BY 1, 2) SELECT n AS n_trees, count(*) AS vertices FROM v GROUP BY 1")
def vertex_connectivity(spark, sf_dir):
    """Vertices of a 4 x 3 brick by the number of trees that meet there."""
    return cmesh.vertex_trees(cmesh.with_global_vertices(cmesh.brick(spark, 4, 3))).groupBy("n_trees").agg(F.count("*").alias("vertices"))


@query("SELECT trees, edges::DOUBLE AS edges FROM (VALUES (8, 12), (20, 30), (6, 12)) v(trees, edges)")
def spherical_surfaces(spark, sf_dir):
    """Trees and edges of the spheres from an octahedron, an icosahedron and a cube: closed surfaces, so each side has its partner."""
    out = None
    for shape in ("octahedron", "icosahedron", "cube"):
        trees = cmesh.spherical_surface(spark, shape)
        sides = cmesh.joined_by_vertices(trees).where("not is_boundary").agg((F.count("*") / 2).alias("edges"))
        part = trees.agg(F.count("*").cast("int").alias("trees")).crossJoin(F.broadcast(sides))  # one row
        out = part if out is None else out.unionByName(part)
    return out


# Beside the event quadtree of the other catalog.


@query(f"WITH {TREE}, {ORDERED}, {RANKED}, fam AS (SELECT level, id >> 2 AS p, count(*) AS c, min(rank) AS r FROM ranked WHERE level > 0 GROUP BY 1, 2) SELECT r.level, r.id, elem_id, CAST(CASE WHEN f.c = 4 THEN f.r ELSE r.rank END AS INT) AS rank FROM ranked r LEFT JOIN fam f ON f.level = r.level AND f.p = r.id >> 2 AND r.level > 0")
def partition_for_coarsening(spark, sf_dir):
    """Leaves dealt to ranks so that no family is split."""
    return fo.partition(_tree(spark, sf_dir), RANKS, for_coarsening=True).select("level", "id", "elem_id", "rank")


@query(f"WITH {TREE}, {ORDERED} SELECT level, id, elem_id, CAST((elem_id >= 10) AS INT) + CAST((elem_id >= 10) AS INT) + CAST((elem_id >= 200) AS INT) AS rank FROM ordered")
def partition_by_offsets(spark, sf_dir):
    """Leaves dealt to ranks by given offsets, one rank staying empty."""
    return fo.partition(_tree(spark, sf_dir), 4, offsets=[0, 10, 10, 200]).select("level", "id", "elem_id", "rank")


_OFFSETS = "begins AS (SELECT rank, min(lo) AS lo FROM ranked GROUP BY 1)"


@query(f"WITH {TREE}, {ORDERED}, {RANKED}, {_OFFSETS}, asked AS (SELECT DISTINCT level, id FROM cells) SELECT a.level, a.id, (SELECT max(rank) FROM begins WHERE lo <= a.id << (2 * ({DEPTH} - a.level))) AS first_owner, (SELECT max(rank) FROM begins WHERE lo <= ((a.id + 1) << (2 * ({DEPTH} - a.level))) - 1) AS last_owner FROM asked a")
def element_owners(spark, sf_dir):
    """First and last rank that own a part of each element that holds events."""
    f = fo.stored(_tree(spark, sf_dir))
    deep = pt.events(spark, sf_dir).select("tree_id", morton.ancestor(F.col("id"), pt.DEPTH, DEPTH, 2).alias("id"))
    asked = fo.counted(deep, QUAD, DEPTH).select("tree_id", "level", "id")
    return fo.owners(asked, f, fo.offsets(fo.partition(f, RANKS), RANKS)).select("level", "id", "first_owner", "last_owner")


_AT_FACE = "asked AS (SELECT level, id, f.face FROM (SELECT DISTINCT level, id FROM cells WHERE level = 2) c, (SELECT unnest(range(0, 4))::INT AS face) f), touching AS (SELECT a.level, a.id, a.face, l.level AS leaf_level, l.id AS leaf_id FROM asked a JOIN leaves l ON l.level >= a.level AND l.id >> (2 * (l.level - a.level)) = a.id WHERE {side} = CASE a.face % 2 WHEN 0 THEN 0 ELSE (1 << (l.level - a.level)) - 1 END)"


def _side_sql() -> str:
    """Place of a leaf along the face's axis, counted from the element's low side."""
    from foliate.catalog import unbits_sql

    x, y = unbits_sql("l.id", 2, 0, DEPTH), unbits_sql("l.id", 2, 1, DEPTH)
    return f"(CASE WHEN a.face < 2 THEN {x} ELSE {y} END & ((1 << (l.level - a.level)) - 1))"


@query(f"WITH {TREE}, {_AT_FACE.format(side=_side_sql())} SELECT level, id, face, leaf_level, leaf_id FROM touching")
def leaves_at_faces(spark, sf_dir):
    """Leaves that touch the faces of the level-2 elements that hold events."""
    f = fo.stored(_tree(spark, sf_dir))
    return fo.leaves_at_face(f, _level2(spark, sf_dir)).select("level", "id", "face", "leaf_level", "leaf_id")


def _level2(spark, sf_dir):
    cells = pt.events(spark, sf_dir).select("tree_id", F.lit(2).alias("level"), morton.ancestor(F.col("id"), pt.DEPTH, 2, 2).alias("id")).distinct()
    return cells.withColumn("face", F.explode(F.array(*[F.lit(k) for k in range(4)])))


@query(f"WITH {TREE}, {ORDERED}, {RANKED}, {_AT_FACE.format(side=_side_sql())} SELECT t.level, t.id, t.face, string_agg(DISTINCT r.rank::VARCHAR, ',' ORDER BY r.rank::VARCHAR) AS owners FROM touching t JOIN ranked r ON r.level = t.leaf_level AND r.id = t.leaf_id GROUP BY 1, 2, 3")
def face_owners(spark, sf_dir):
    """The ranks of the leaves at those faces."""
    f = fo.stored(_tree(spark, sf_dir))
    out = fo.owners_at_face(f, fo.partition(f, RANKS), _level2(spark, sf_dir))
    return out.select("level", "id", "face", F.concat_ws(",", F.transform("owners", lambda x: x.cast("string"))).alias("owners"))


_BRANKS = f"bo AS (SELECT *, row_number() OVER (ORDER BY id << (2 * ({DEPTH} - level))) - 1 AS elem_id, count(*) OVER () AS total FROM balanced), br AS (SELECT level, id, CAST(((elem_id + 1) * {RANKS} - 1) // total AS INT) AS rank FROM bo)"


@query(f"{_BTREE}, {_PAIRS}, {_BRANKS} SELECT p.level, p.id, p.face, string_agg(DISTINCT b.rank::VARCHAR, ',' ORDER BY b.rank::VARCHAR) AS owners FROM pairs p JOIN br b ON b.level = p.n_level AND b.id = p.n_id GROUP BY 1, 2, 3")
def owners_across_faces(spark, sf_dir):
    """The ranks on the other side of each leaf's face."""
    f = fo.balance(_tree(spark, sf_dir))
    out = fo.owners_across(f, fo.partition(f, RANKS))
    return out.select("level", "id", "face", F.concat_ws(",", F.transform("owners", lambda x: x.cast("string"))).alias("owners"))


@query(f"{_BTREE}, {_PAIRS}, {_BRANKS} SELECT DISTINCT a.rank, p.n_level AS level, p.n_id AS id, b.rank AS owner, p.n_id * 3 + p.n_level AS v FROM pairs p JOIN br a ON a.level = p.level AND a.id = p.id JOIN br b ON b.level = p.n_level AND b.id = p.n_id WHERE a.rank <> b.rank")
def ghost_values(spark, sf_dir):
    """Values that ranks get for their ghosts from the owners."""
    f = fo.balance(_tree(spark, sf_dir))
    valued = f.leaves.withColumn("v", F.col("id") * 3 + F.col("level"))
    return fo.ghost_data(fo.ghosts(f, fo.partition(f, RANKS)), valued, ["v"]).select("rank", "level", "id", "owner", "v")


@query(f"{_BTREE}, {_PAIRS}, op AS (SELECT count(*) AS n FROM leaves l WHERE EXISTS (SELECT 1 FROM balanced b WHERE b.level > l.level AND b.id >> (2 * (b.level - l.level)) = l.id)) SELECT (SELECT n FROM op) = 0 AS before, (SELECT count(*) FROM pairs WHERE n_level > level + 1) = 0 AS after")
def balance_predicates(spark, sf_dir):
    """Whether the event quadtree is balanced, before and after balancing."""
    old = fo.stored(_tree(spark, sf_dir))
    return spark.createDataFrame([(fo.is_balanced(old), fo.is_balanced(fo.balance(old)))], "before boolean, after boolean")


_BOX = "(x * h < 40 AND (x + 1) * h > 10 AND y * h < 90 AND (y + 1) * h > 30)"


def _box_sql() -> str:
    from foliate.catalog import unbits_sql

    return f"SELECT level, id FROM (SELECT *, {unbits_sql('id', 2, 0, DEPTH)} AS x, {unbits_sql('id', 2, 1, DEPTH)} AS y, 1 << ({DEPTH} - level) AS h FROM leaves) WHERE {_BOX}"


@query(f"WITH {TREE} {_box_sql()}")
def search_with_pruning(spark, sf_dir):
    """Leaves that meet a box, found from the root down without looking into what lies apart from it."""
    def meets(c, id, level):
        x, y = morton.decode(id, 2)
        h = morton.shl(F.lit(1), DEPTH - level)
        return (x * h < 40) & ((x + 1) * h > 10) & (y * h < 90) & ((y + 1) * h > 30)

    roots = cmesh.single(spark, 2).select("tree_id")
    return fo.top_down(_tree(spark, sf_dir), roots, meets).select("level", "id")


@query("WITH n AS (SELECT unnest(range(1, 5))::INT AS level) SELECT level, CAST(pow(3, level) AS BIGINT) AS leaves FROM n")
def sierpinski_triangles(spark, sf_dir):
    """Leaves of a triangle whose third child is removed at every step."""
    rows, f = None, fo.uniform(cmesh.one(spark, TRIANGLE), TRIANGLE, 0, 8)
    for step in range(1, 5):
        kept = fo.adapt(f, refine=F.lit(True)).leaves.where(fo.child_number(TRIANGLE, F.col("id")) != 2)
        f = f.derived(kept)
        part = f.leaves.agg(F.lit(step).alias("level"), F.count("*").alias("leaves"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
