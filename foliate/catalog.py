"""Registered grid queries, each beside the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import eclass, morton, vec
from foliate.operators import forest as fo
from foliate.plans import points as pt
from foliate.sources import cmesh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LIMIT, DEPTH, RANKS = 20, 7, 5


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def bits_sql(*coords: str, bits: int = 10) -> str:
    """Interleaving, bit by bit."""
    return "(" + " + ".join(f"((({c}) >> {b}) & 1) * {1 << (b * len(coords) + k)}" for b in range(bits) for k, c in enumerate(coords)) + ")"


def unbits_sql(id: str, dim: int, k: int, bits: int = 10) -> str:
    return "(" + " + ".join(f"((({id}) >> {b * dim + k}) & 1) * {1 << b}" for b in range(bits)) + ")"


PTS = f"""places AS (SELECT event_id, greatest(least((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // {pt.EVENT_US}, 1023), 0)::BIGINT AS x,
  greatest(least(CAST(round(value * 100) AS BIGINT) // {pt.EVENT_CENTS}, 1023), 0)::BIGINT AS y FROM events),
pts AS (SELECT event_id, x, y, {bits_sql('x', 'y')} AS id FROM places)"""
LEVELS = f"levels AS (SELECT unnest(range(0, {DEPTH} + 1))::INT AS level)"
SPLIT = f"""deep AS (SELECT event_id, id >> {2 * (10 - DEPTH)} AS id FROM pts),
cells AS (SELECT level, id >> (2 * ({DEPTH} - level)) AS id, count(*) AS n FROM deep, levels GROUP BY 1, 2),
split AS (SELECT level, id FROM cells WHERE n > {LIMIT} AND level < {DEPTH})"""
LEAVES = """kids AS (SELECT level + 1 AS level, id * 4 + c.i AS id FROM split, (SELECT unnest(range(0, 4)) AS i) c UNION ALL SELECT 0, 0),
leaves AS (SELECT k.level, k.id, coalesce(c.n, 0) AS n FROM kids k LEFT JOIN cells c USING (level, id) WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.level = k.level AND s.id = k.id))"""
TREE = f"{PTS}, {LEVELS}, {SPLIT}, {LEAVES}"
ORDERED = f"ordered AS (SELECT *, id << (2 * ({DEPTH} - level)) AS lo, row_number() OVER (ORDER BY id << (2 * ({DEPTH} - level))) - 1 AS elem_id, count(*) OVER () AS total, sum(n) OVER (ORDER BY id << (2 * ({DEPTH} - level))) AS running, sum(n) OVER () AS weight FROM leaves)"
RANKED = f"ranked AS (SELECT *, CAST(((elem_id + 1) * {RANKS} - 1) // total AS INT) AS rank FROM ordered)"


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.events(spark, sf_dir).select("event_id", "tree_id", morton.ancestor(F.col("id"), pt.DEPTH, DEPTH, 2).alias("id"))


def _tree(spark: SparkSession, sf_dir: str) -> fo.Forest:
    """The quadtree over events with at most LIMIT of them in a leaf, or depth DEPTH."""
    return fo.by_count(_deep(spark, sf_dir), 2, DEPTH, LIMIT)


@query(f"WITH {PTS} SELECT x >> 5 AS x, y >> 5 AS y, count(*) AS n FROM pts GROUP BY 1, 2")
def cell_counts(spark, sf_dir):
    """Events by cell of the 32 x 32 level."""
    at = pt.events(spark, sf_dir)
    return at.groupBy(morton.shr(F.col("x"), 5).alias("x"), morton.shr(F.col("y"), 5).alias("y")).agg(F.count("*").alias("n"))


@query(f"WITH {PTS} SELECT event_id, id, x, y FROM pts")
def morton_round_trip(spark, sf_dir):
    """Ids of points, and the places decoded from them."""
    x, y = morton.decode(F.col("id"), 2)
    return pt.events(spark, sf_dir).select("event_id", "id", x.alias("x"), y.alias("y"))


@query(f"WITH {PTS} SELECT event_id, id >> 2 AS parent, id & 3 AS child_id, id * 4 + 2 AS child2, (id >> 2) * 4 + 1 AS sibling1, id >> 14 AS ancestor3, id << 10 AS first15, ((id + 1) << 10) - 1 AS last15, id + 1 AS successor FROM pts")
def element_relations(spark, sf_dir):
    """Parent, child, sibling, ancestor, descendants and successor of each point's element."""
    i = F.col("id")
    return pt.events(spark, sf_dir).select(
        "event_id",
        morton.parent(i, 2).alias("parent"),
        morton.child_id(i, 2).alias("child_id"),
        morton.child(i, 2, 2).alias("child2"),
        morton.sibling(i, 1, 2).alias("sibling1"),
        morton.ancestor(i, 10, 3, 2).alias("ancestor3"),
        morton.first_descendant(i, 10, 15, 2).alias("first15"),
        morton.last_descendant(i, 10, 15, 2).alias("last15"),
        (i + 1).alias("successor"),
    )


_NCA = "CASE " + " ".join(f"WHEN a.id >> {2 * (10 - lv)} = b.id >> {2 * (10 - lv)} THEN {lv}" for lv in range(10, -1, -1)) + " END"


@query(f"WITH {PTS} SELECT a.event_id, CAST({_NCA} AS INT) AS nca_level, a.id >> (2 * (10 - ({_NCA}))) AS nca_id FROM pts a JOIN pts b ON b.event_id = a.event_id + 1")
def element_nca(spark, sf_dir):
    """Nearest common ancestor of each event's element and the next event's."""
    a = pt.events(spark, sf_dir).select("event_id", "id")
    b = a.select((F.col("event_id") - 1).alias("event_id"), F.col("id").alias("other"))
    level = morton.nca_level(F.col("id"), F.lit(10), F.col("other"), F.lit(10), 2)
    return a.join(b, "event_id").select("event_id", level.cast("int").alias("nca_level"), morton.shr(F.col("id"), 2 * (10 - level)).alias("nca_id"))


@query(f"WITH {PTS}, c AS (SELECT DISTINCT x >> 4 AS x, y >> 4 AS y FROM pts), f AS (SELECT x, y, f.face, x + CASE face WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS nx, y + CASE face WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS ny FROM c, (SELECT unnest(range(0, 4))::INT AS face) f) SELECT {bits_sql('x', 'y', bits=6)} AS id, face, CASE WHEN nx BETWEEN 0 AND 63 AND ny BETWEEN 0 AND 63 THEN {bits_sql('nx', 'ny', bits=6)} END AS neigh_id, CASE WHEN nx BETWEEN 0 AND 63 AND ny BETWEEN 0 AND 63 THEN CAST(xor(face, 1) AS INT) END AS dual FROM f")
def element_face_neighbours(spark, sf_dir):
    """Elements of level 6 that hold events, and those across their faces inside the tree."""
    cells = pt.events(spark, sf_dir).select("tree_id", F.lit(6).alias("level"), morton.ancestor(F.col("id"), 10, 6, 2).alias("id")).distinct()
    return fo.face_neighbours(cells, 2).select("id", "face", "neigh_id", F.col("dual").cast("int").alias("dual"))


@query(f"WITH {PTS}, levels AS (SELECT unnest(range(0, 11))::INT AS level) SELECT level, id >> (2 * (10 - level)) AS id, count(*) AS n FROM pts, levels GROUP BY 1, 2")
def level_rollup(spark, sf_dir):
    """Events in every element of every level."""
    return fo.counted(pt.events(spark, sf_dir), 2, 10).select("level", "id", "n")


@query("WITH c(eclass, dim, trees) AS (VALUES (0,0,1),(1,1,1),(2,2,1),(3,2,2),(4,3,1),(5,3,6),(6,3,2),(7,3,3)), l AS (SELECT unnest(range(0, 8))::INT AS level) SELECT eclass, level, CAST(trees * CASE WHEN eclass = 7 THEN 2 * pow(8, level) - pow(6, level) ELSE pow(2, dim * level) END AS BIGINT) AS leaves FROM c, l")
def uniform_leaf_counts(spark, sf_dir):
    """Leaves of the uniform unit hypercube of each class and level."""
    levels = eclass.table(spark).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return levels.select("eclass", "level", (F.col("hypercube_trees") * eclass.count_leaves(F.col("eclass"), F.col("dim"), F.col("level"))).alias("leaves"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS tree_id, CAST(256 AS BIGINT) AS leaves, CAST(1.0 AS DOUBLE) AS volume, CAST(0.5 AS DOUBLE) AS cx, CAST(0.5 AS DOUBLE) AS cy FROM region")
def uniform_forest(spark, sf_dir):
    """A uniform quadtree of level 4 for each region: leaves, volume and centroid of each tree."""
    trees = pt.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("tree_id"))
    leaves = fo.volumes(fo.uniform(trees, 2, 4, 10).leaves, 2)
    return leaves.groupBy("tree_id").agg(F.count("*").alias("leaves"), F.round(F.sum("volume"), 9).alias("volume"), F.round(F.avg("cx"), 9).alias("cx"), F.round(F.avg("cy"), 9).alias("cy"))


@query(f"WITH {TREE} SELECT level, id, CAST(n AS BIGINT) AS n FROM leaves")
def refined_by_count(spark, sf_dir):
    """Leaves of the quadtree that is refined where it holds many events."""
    return _tree(spark, sf_dir).leaves.select("level", "id", "n")


@query(f"WITH {TREE} SELECT d.event_id, l.level AS leaf_level, l.id AS leaf_id FROM deep d JOIN leaves l ON d.id >> (2 * ({DEPTH} - l.level)) = l.id")
def search_points(spark, sf_dir):
    """The leaf that holds each event."""
    return fo.search(_deep(spark, sf_dir), _tree(spark, sf_dir)).select("event_id", "leaf_level", "leaf_id")


@query(f"WITH {TREE}, {ORDERED}, {RANKED} SELECT level, id, elem_id, rank FROM ranked")
def partition_equal(spark, sf_dir):
    """Leaves in curve order, dealt to ranks in equal numbers."""
    return fo.partition(_tree(spark, sf_dir), RANKS).select("level", "id", "elem_id", "rank")


@query(f"WITH {TREE}, {ORDERED} SELECT level, id, elem_id, CAST(CASE WHEN running = 0 THEN 0 ELSE (running * {RANKS} + weight - 1) // weight - 1 END AS INT) AS rank FROM ordered")
def partition_weighted(spark, sf_dir):
    """The same, with each leaf weighing its events."""
    return fo.partition(_tree(spark, sf_dir), RANKS, F.col("n")).select("level", "id", "elem_id", "rank")


@query(f"WITH {TREE}, {ORDERED}, {RANKED} SELECT rank, count(*) AS leaves, CAST(sum(n) AS BIGINT) AS points, min(elem_id) AS first_elem, min(lo) AS first_desc FROM ranked GROUP BY rank")
def partition_offsets(spark, sf_dir):
    """First element, first descendant and load of each rank."""
    rows = fo.partition(_tree(spark, sf_dir), RANKS)
    return rows.groupBy("rank").agg(F.count("*").alias("leaves"), F.sum("n").alias("points"), F.min("elem_id").alias("first_elem"), F.min("lo").alias("first_desc"))


_U5 = f"WITH {PTS}, u AS (SELECT 5 AS level, i AS id, i >> 2 AS p FROM (SELECT unnest(range(0, 1024)) AS i)), n AS (SELECT u.level, u.id, u.p, count(pts.id) AS n FROM u LEFT JOIN pts ON pts.id >> 10 = u.id GROUP BY 1, 2, 3)"


def _level5(spark, sf_dir) -> fo.Forest:
    base = fo.uniform(cmesh.single(spark, 2), 2, 5, 10)
    counts = pt.events(spark, sf_dir).groupBy(morton.ancestor(F.col("id"), 10, 5, 2).alias("id")).agg(F.count("*").alias("n"))
    return base.derived(base.leaves.join(counts, "id", "left").select("tree_id", "level", "id", "lo", F.coalesce("n", F.lit(0)).alias("n")))


@query(f"{_U5}, f AS (SELECT p, sum(n) AS s FROM n GROUP BY p) SELECT CASE WHEN s < 40 THEN 4 ELSE 5 END AS level, CASE WHEN s < 40 THEN n.p ELSE n.id END AS id, CAST(CASE WHEN s < 40 THEN min(s) ELSE min(n.n) END AS BIGINT) AS n FROM n JOIN f USING (p) GROUP BY s < 40, CASE WHEN s < 40 THEN 4 ELSE 5 END, CASE WHEN s < 40 THEN n.p ELSE n.id END")
def coarsened(spark, sf_dir):
    """A uniform level with its sparse families merged, counts added up."""
    out = fo.adapt(_level5(spark, sf_dir), coarsen=F.sum("n") < 40, merged={"n": F.sum("n")})
    return out.leaves.select("level", "id", "n")


@query(f"{_U5} SELECT level, id, CAST(n AS BIGINT) AS n FROM n WHERE n BETWEEN 1 AND 30 UNION ALL SELECT 6, id * 4 + c.i, CAST(n AS BIGINT) FROM n, (SELECT unnest(range(0, 4)) AS i) c WHERE n > 30")
def refined_and_removed(spark, sf_dir):
    """A uniform level without its empty elements and with its dense ones refined."""
    return fo.adapt(_level5(spark, sf_dir), refine=F.col("n") > 30, remove=F.col("n") == 0).leaves.select("level", "id", "n")


_LX, _LY = unbits_sql("id", 2, 0), unbits_sql("id", 2, 1)


@query(f"WITH u AS (SELECT unnest(range(0, 256)) AS id), d AS (SELECT id, ({_LX} * 2 + 1 - 16) * ({_LX} * 2 + 1 - 16) + ({_LY} * 2 + 1 - 16) * ({_LY} * 2 + 1 - 16) AS d2 FROM u) SELECT 4 AS level, id FROM d WHERE NOT d2 BETWEEN 49 AND 121 UNION ALL SELECT 5, id * 4 + c.i FROM d, (SELECT unnest(range(0, 4)) AS i) c WHERE d2 BETWEEN 49 AND 121")
def refined_around_circle(spark, sf_dir):
    """A uniform level refined in a band around a circle: a level set tested at element centres, in integers."""
    base = fo.uniform(cmesh.single(spark, 2), 2, 4, 10)
    x, y = (c * 2 + 1 - 16 for c in morton.decode(F.col("id"), 2))
    return fo.adapt(base, refine=(x * x + y * y).between(49, 121)).leaves.select("level", "id")


def _neighbour_parents(source: str) -> str:
    x, y = unbits_sql("id", 2, 0, DEPTH), unbits_sql("id", 2, 1, DEPTH)
    moved = f"SELECT level, {x} + d.dx AS x, {y} + d.dy AS y FROM {source}, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dx, dy) WHERE level > 0"
    return f"SELECT level - 1 AS level, {bits_sql('x', 'y', bits=DEPTH)} >> 2 AS id FROM ({moved}) WHERE x >= 0 AND y >= 0 AND x < (1 << level) AND y < (1 << level)"


BALANCED = f"""closed AS (SELECT level, id FROM split UNION {_neighbour_parents('closed')}),
bkids AS (SELECT level + 1 AS level, id * 4 + c.i AS id FROM closed, (SELECT unnest(range(0, 4)) AS i) c UNION ALL SELECT 0, 0),
balanced AS (SELECT level, id FROM bkids k WHERE NOT EXISTS (SELECT 1 FROM closed s WHERE s.level = k.level AND s.id = k.id))"""
_BTREE = f"WITH RECURSIVE {TREE}, {BALANCED}"


@query(f"{_BTREE} SELECT level, id FROM balanced")
def balanced(spark, sf_dir):
    """The event quadtree under the 2:1 rule over faces."""
    return fo.balance(_tree(spark, sf_dir)).leaves.select("level", "id")


_BX, _BY = unbits_sql("id", 2, 0, DEPTH), unbits_sql("id", 2, 1, DEPTH)
_PAIRS = f"""sides AS (SELECT level, id, f.face, {_BX} + CASE face WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS x, {_BY} + CASE face WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS y FROM balanced, (SELECT unnest(range(0, 4))::INT AS face) f),
across AS (SELECT level, id, face, CASE WHEN x >= 0 AND y >= 0 AND x < (1 << level) AND y < (1 << level) THEN {bits_sql('x', 'y', bits=DEPTH)} END AS nid FROM sides),
met AS (SELECT a.level, a.id, a.face, b.level AS n_level, b.id AS n_id, CAST(xor(a.face, 1) AS INT) AS n_face FROM across a JOIN balanced b ON (b.level = a.level AND b.id = a.nid) OR (b.level = a.level - 1 AND b.id = a.nid >> 2)),
pairs AS (SELECT * FROM met UNION ALL SELECT n_level, n_id, n_face, level, id, face FROM met WHERE n_level < level)"""


@query(f"{_BTREE}, {_PAIRS} SELECT * FROM pairs")
def leaf_face_neighbours(spark, sf_dir):
    """Every pair of leaves of the balanced quadtree across a face."""
    return fo.leaf_neighbours(fo.balance(_tree(spark, sf_dir))).select("level", "id", "face", "n_level", "n_id", F.col("n_face").cast("int").alias("n_face"))


@query(f"{_BTREE}, {_PAIRS}, k AS (SELECT 'boundary' AS kind, level, id, face FROM across WHERE nid IS NULL UNION ALL SELECT 'conformal', level, id, face FROM pairs WHERE level = n_level AND (id < n_id OR (id = n_id AND face < n_face)) UNION ALL SELECT DISTINCT 'mortar', level, id, face FROM pairs WHERE n_level > level) SELECT kind, level, count(*) AS n FROM k GROUP BY 1, 2")
def unique_faces(spark, sf_dir):
    """Faces of the balanced quadtree by kind and level, each counted once."""
    return fo.unique_faces(fo.balance(_tree(spark, sf_dir))).groupBy("kind", "level").agg(F.count("*").alias("n"))


_BRANK = f"bo AS (SELECT *, row_number() OVER (ORDER BY id << (2 * ({DEPTH} - level))) - 1 AS elem_id, count(*) OVER () AS total FROM balanced), br AS (SELECT level, id, CAST(((elem_id + 1) * {RANKS} - 1) // total AS INT) AS rank FROM bo)"


@query(f"{_BTREE}, {_PAIRS}, {_BRANK} SELECT DISTINCT a.rank, p.n_level AS level, p.n_id AS id, b.rank AS owner FROM pairs p JOIN br a ON a.level = p.level AND a.id = p.id JOIN br b ON b.level = p.n_level AND b.id = p.n_id WHERE a.rank <> b.rank")
def ghost_layer(spark, sf_dir):
    """For each rank the leaves of others at its border."""
    f = fo.balance(_tree(spark, sf_dir))
    return fo.ghosts(f, fo.partition(f, RANKS)).select("rank", "level", "id", "owner")


@query(f"{_BTREE} SELECT o.level AS old_level, o.id AS old_id, b.level AS new_level, b.id AS new_id, CAST(sign(b.level - o.level) AS INT) AS change FROM leaves o JOIN balanced b ON b.level >= o.level AND b.id >> (2 * (b.level - o.level)) = o.id")
def replaced_leaves(spark, sf_dir):
    """Old and new leaves of balancing, paired."""
    old = _tree(spark, sf_dir)
    return fo.replaced(old, fo.balance(old)).select("old_level", "old_id", "new_level", "new_id", "change")


@query(f"{_U5}, f AS (SELECT p, sum(n) AS s FROM n GROUP BY p) SELECT CASE WHEN s < 40 THEN 4 ELSE 5 END AS level, CASE WHEN s < 40 THEN n.p ELSE n.id END AS id, round(CAST(avg(n.n) AS DOUBLE), 6) AS v FROM n JOIN f USING (p) GROUP BY s < 40, CASE WHEN s < 40 THEN 4 ELSE 5 END, CASE WHEN s < 40 THEN n.p ELSE n.id END")
def interpolated_values(spark, sf_dir):
    """Values carried to a coarser forest as means of the families."""
    old = _level5(spark, sf_dir)
    old = old.derived(old.leaves.withColumn("v", F.col("n").cast("double")))
    new = fo.adapt(old, coarsen=F.sum("n") < 40)
    return fo.interpolated(old, new, "v").select("level", "id", F.round("v", 6).alias("v"))


_B = "b AS (SELECT t AS tree_id, t % 4 AS x, (t // 4) % 3 AS y FROM (SELECT unnest(range(0, 12)) AS t)), bf AS (SELECT tree_id, f.face, x + CASE face WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS nx, y + CASE face WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS ny FROM b, (SELECT unnest(range(0, 4))::INT AS face) f)"


@query(f"WITH {_B}, m AS (SELECT tree_id, face, (nx + 4) % 4 AS nx, ny, ny < 0 OR ny > 2 AS out FROM bf) SELECT tree_id, face, CASE WHEN out THEN tree_id ELSE ny * 4 + nx END AS neigh_tree, CASE WHEN out THEN face ELSE CAST(xor(face, 1) AS INT) END AS neigh_face, out AS is_boundary FROM m")
def brick_connectivity(spark, sf_dir):
    """A 4 x 3 brick that is periodic in x."""
    return cmesh.brick_faces(spark, 4, 3, periodic=(True, False)).drop("orientation")


@query(f"WITH {_B}, m AS (SELECT *, nx < 0 OR nx > 3 OR ny < 0 OR ny > 2 AS out FROM bf) SELECT tree_id, face, CASE WHEN out THEN tree_id ELSE ny * 4 + nx END AS neigh_tree, CASE WHEN out THEN face ELSE CAST(xor(face, 1) AS INT) END AS neigh_face, CAST(0 AS INT) AS orientation, out AS is_boundary FROM m")
def joined_by_vertices(spark, sf_dir):
    """The connections of a 4 x 3 brick found from its corners alone."""
    return cmesh.joined_by_vertices(cmesh.brick(spark, 4, 3))


@query("SELECT CAST(-1.0 AS DOUBLE) AS min_x, CAST(7.0 AS DOUBLE) AS max_x, CAST(0.5 AS DOUBLE) AS min_y, CAST(6.5 AS DOUBLE) AS max_y, CAST(2.0 AS DOUBLE) AS min_z, CAST(2.0 AS DOUBLE) AS max_z")
def bounding_box(spark, sf_dir):
    """Bounds of a brick, scaled and shifted."""
    return cmesh.bounding_box(cmesh.translated(cmesh.brick(spark, 4, 3), (-1.0, 0.5, 2.0), 2.0))


_E = "e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS p, CAST(embedding[5] AS DOUBLE) AS q, CAST(embedding[6] AS DOUBLE) AS r FROM embeddings)"


@query(f"WITH {_E} SELECT vec_id, round(sqrt(a*a + b*b + c*c), 6) AS norm, round(a*p + b*q + c*r, 6) AS dot, round(b*r - c*q, 6) AS cross_x, round(sqrt((a-p)*(a-p) + (b-q)*(b-q) + (c-r)*(c-r)), 6) AS dist, round(p + 2.0 * a, 6) AS axpy_x FROM e")
def vector_functions(spark, sf_dir):
    """Products and norms of vectors cut from the embeddings."""
    rows = pt.table(spark, sf_dir, "embeddings")
    cut = lambda s: F.transform(F.slice("embedding", s, 3), lambda x: x.cast("double"))
    a, b = F.col("a"), F.col("b")
    r = lambda c: F.round(c, 6)
    return rows.select("vec_id", cut(1).alias("a"), cut(4).alias("b")).select("vec_id", r(vec.norm(a)).alias("norm"), r(vec.dot(a, b)).alias("dot"), r(vec.cross(a, b)[0]).alias("cross_x"), r(vec.dist(a, b)).alias("dist"), r(vec.axpy(a, b, 2.0)[0]).alias("axpy_x"))


_L = f"l AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS tree_id, greatest(least(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 40, 63), 0)::BIGINT AS x, greatest(least(CAST(trunc(l_extendedprice) AS BIGINT) // 1650, 63), 0)::BIGINT AS y, greatest(least(CAST(trunc(l_quantity) AS BIGINT), 63), 0)::BIGINT AS z FROM lineitem), li AS (SELECT CAST(tree_id AS BIGINT) AS tree_id, {bits_sql('x', 'y', 'z', bits=6)} AS id FROM l)"


@query(f"WITH {_L}, levels AS (SELECT unnest(range(0, 5))::INT AS level), cells AS (SELECT tree_id, level, (id >> 6) >> (3 * (4 - level)) AS id, count(*) AS n FROM li, levels GROUP BY 1, 2, 3), split AS (SELECT tree_id, level, id FROM cells WHERE n > 200 AND level < 4), kids AS (SELECT tree_id, level + 1 AS level, id * 8 + c.i AS id FROM split, (SELECT unnest(range(0, 8)) AS i) c UNION ALL SELECT tree_id, level, id FROM cells WHERE level = 0) SELECT k.tree_id, k.level, k.id, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM kids k LEFT JOIN cells c USING (tree_id, level, id) WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.tree_id = k.tree_id AND s.level = k.level AND s.id = k.id)")
def octree_of_lineitems(spark, sf_dir):
    """An octree for each return flag over day, price and quantity."""
    rows = pt.lineitems(spark, sf_dir).select("tree_id", morton.ancestor(F.col("id"), 6, 4, 3).alias("id"))
    return fo.by_count(rows, eclass.HEX, 4, 200).leaves.select("tree_id", "level", "id", "n")


@query(f"{_U5}, c AS (SELECT {_LX} AS x, {_LY} AS y, id, CAST(n AS DOUBLE) AS v FROM n) SELECT a.id, round(a.v - 0.01 * (0.5 * 32 * (a.v - coalesce(w.v, 0)) + CASE WHEN a.x = 31 THEN -0.5 * 32 * a.v ELSE 0 END + 0.25 * 32 * (a.v - coalesce(s.v, 0)) + CASE WHEN a.y = 31 THEN -0.25 * 32 * a.v ELSE 0 END), 6) AS v FROM c a LEFT JOIN c w ON w.x = a.x - 1 AND w.y = a.y LEFT JOIN c s ON s.y = a.y - 1 AND s.x = a.x")
def upwind_step(spark, sf_dir):
    """One upwind step of the event counts in a constant flow, closed at the boundary."""
    f = _level5(spark, sf_dir)
    f = f.derived(f.leaves.withColumn("v", F.col("n").cast("double")))
    return fo.upwind(f, "v", (0.5, 0.25), 0.01).select("id", F.round("v", 6).alias("v"))


@query(f"WITH {TREE} SELECT level, count(*) AS leaves, CAST(sum(n) AS BIGINT) AS points, CAST(max(n) AS BIGINT) AS most, round(sum(pow(0.25, level)), 9) AS volume FROM leaves GROUP BY level")
def forest_profile(spark, sf_dir):
    """Leaves, points and volume of the event quadtree by level."""
    leaves = fo.volumes(_tree(spark, sf_dir).leaves, 2)
    return leaves.groupBy("level").agg(F.count("*").alias("leaves"), F.sum("n").alias("points"), F.max("n").alias("most"), F.round(F.sum("volume"), 9).alias("volume"))


@query(f"WITH {TREE} SELECT d.level, d.id, EXISTS (SELECT 1 FROM leaves l WHERE l.level = d.level AND l.id = d.id) AS is_leaf, EXISTS (SELECT 1 FROM split s WHERE s.level = d.level AND s.id = d.id) AS has_leaf_desc FROM (SELECT level, id FROM cells) d")
def leaf_predicates(spark, sf_dir):
    """Whether elements that hold events are leaves, or have leaves below them."""
    f = fo.stored(_tree(spark, sf_dir))
    asked = fo.counted(_deep(spark, sf_dir), 2, DEPTH).select("level", "id")
    leaves = f.leaves.select("level", "id", F.lit(True).alias("_leaf"))
    above = fo.ancestors(f.leaves.select("level", "id"), 2).where("at_level < level").select(F.col("at_level").alias("level"), F.col("at_id").alias("id"), F.lit(True).alias("_above")).distinct()
    found = asked.join(leaves, ["level", "id"], "left").join(above, ["level", "id"], "left")
    return found.select("level", "id", F.coalesce("_leaf", F.lit(False)).alias("is_leaf"), F.coalesce("_above", F.lit(False)).alias("has_leaf_desc"))


def _crosses_sql(level: str, id: str) -> str:
    """Whether the circle around (32, 32) of radius 20 crosses an element, in units of level 6."""
    x, y, h = unbits_sql(id, 2, 0, 6), unbits_sql(id, 2, 1, 6), f"(1 << (6 - {level}))"
    near = lambda c: f"greatest({c} * {h} - 32, 0, 32 - ({c} + 1) * {h})"
    far = lambda c: f"greatest(abs({c} * {h} - 32), abs(({c} + 1) * {h} - 32))"
    return f"({near(x)} * {near(x)} + {near(y)} * {near(y)} <= 400 AND {far(x)} * {far(x)} + {far(y)} * {far(y)} >= 400)"


@query(f"WITH RECURSIVE s(level, id) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL SELECT s.level + 1, s.id * 4 + c.i FROM s, (SELECT unnest(range(0, 4)) AS i) c WHERE s.level < 6 AND {_crosses_sql('s.level', 's.id')}) SELECT level, id FROM s WHERE level = 6 OR NOT {_crosses_sql('level', 'id')}")
def refined_along_circle(spark, sf_dir):
    """One tree refined recursively where a circle crosses its elements."""
    x, y = morton.decode(F.col("id"), 2)
    h = morton.shl(F.lit(1), 6 - F.col("level"))
    near = lambda c: F.greatest(c * h - 32, F.lit(0).cast("long"), 32 - (c + 1) * h)
    far = lambda c: F.greatest(F.abs(c * h - 32), F.abs((c + 1) * h - 32))
    crosses = (near(x) * near(x) + near(y) * near(y) <= 400) & (far(x) * far(x) + far(y) * far(y) >= 400)
    return fo.refine_recursive(fo.uniform(cmesh.single(spark, 2), 2, 0, 6), crosses).leaves.select("level", "id")


_U5C = f"{_U5}, c5 AS (SELECT id, n, sum(n) OVER (PARTITION BY id >> 2) AS s4, sum(n) OVER (PARTITION BY id >> 4) AS s3, sum(n) OVER (PARTITION BY id >> 6) AS s2, sum(n) OVER (PARTITION BY id >> 8) AS s1, sum(n) OVER () AS s0 FROM n), placed AS (SELECT *, CASE WHEN s4 >= 60 THEN 5 WHEN s3 >= 60 THEN 4 WHEN s2 >= 60 THEN 3 WHEN s1 >= 60 THEN 2 WHEN s0 >= 60 THEN 1 ELSE 0 END AS level FROM c5)"


@query(f"{_U5C} SELECT level, id >> (2 * (5 - level)) AS id, CAST(sum(n) AS BIGINT) AS n FROM placed GROUP BY 1, 2")
def coarsened_recursively(spark, sf_dir):
    """A uniform level merged upwards while families hold few events."""
    return fo.coarsen_recursive(_level5(spark, sf_dir), F.sum("n") < 60, {"n": F.sum("n")}).leaves.select("level", "id", "n")
