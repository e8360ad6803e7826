import duckdb
import pytest
from pyspark.sql import functions as F

from foliate import catalog, catalog_shapes  # noqa: F401
from foliate.functions import eclass, morton, vec
from foliate.operators import forest as fo
from foliate.sources import cmesh, msh, vtk

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "events", "lineitem", "embeddings")
#: The others rest on balancing, or on the same operators as these; bench.py and the driver run them all.
HEAVY = {"leaf_face_neighbours", "unique_faces", "ghost_layer", "replaced_leaves", "owners_across_faces", "ghost_values", "balance_predicates", "triangles_balanced", "line_neighbours", "hex_neighbours", "prism_neighbours", "tet_relations", "prism_relations", "hex_faces", "quad_faces"}
LIGHT = [n for n in catalog.QUERIES if n not in HEAVY]


def _plain(rows):
    def one(x):
        return None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", LIGHT)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got.select(*want.columns).collect()) == _plain(want.fetchall())


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_morton_round_trip(spark, dim):
    cells = spark.range(4000).select((F.pmod(F.xxhash64("id"), F.lit(1 << dim * 20))).alias("id"))
    places = cells.withColumns({f"c{k}": c for k, c in enumerate(morton.decode(F.col("id"), dim))})
    back = places.select("id", morton.encode(*[F.col(f"c{k}") for k in range(dim)]).alias("again"))
    assert back.where("id <> again").count() == 0


def test_leaf_counts(spark):
    rows = eclass.table(spark).where("eclass in (4, 7)").withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(4))))
    got = {(r.eclass, r.l): r.n for r in rows.select("eclass", "l", eclass.count_leaves(F.col("eclass"), F.col("dim"), F.col("l")).alias("n")).collect()}
    assert [got[7, i] for i in range(5)] == [1, 10, 92, 808, 6896] and [got[4, i] for i in range(5)] == [1, 8, 64, 512, 4096]


def test_balance_across_trees(spark):
    faces = cmesh.brick_faces(spark, 2, 2)
    roots = cmesh.brick(spark, 2, 2).select("tree_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("id"))
    # The corner cell at the middle of the brick is refined to level 2 in tree 0.
    cells = fo.children(roots.where("tree_id = 0"), eclass.QUAD)
    cells = cells.where("id <> 3").unionByName(fo.children(cells.where("id = 3"), 2))
    forest = fo.Forest(fo.with_lo(roots.where("tree_id > 0").unionByName(cells), 2, 3), 2, 3)
    out = fo.balance(forest, faces)
    assert [r.m for r in out.leaves.groupBy("tree_id").agg(F.max("level").alias("m")).orderBy("tree_id").collect()] == [2, 1, 1, 0]
    area = out.leaves.groupBy("tree_id").agg(F.sum(F.pow(F.lit(0.25), F.col("level"))).alias("a"))
    assert all(abs(r.a - 1) < 1e-12 for r in area.collect())


@pytest.mark.parametrize("ranks", [1, 3, 7])
def test_partition_closed_form(spark, ranks):
    forest = fo.uniform(cmesh.bigmesh(spark, 2, 3), 2, 2, 5)
    got = sorted((r.elem_id, r.rank) for r in fo.partition(forest, ranks).collect())
    first = [48 * r // ranks for r in range(ranks + 1)]
    assert got == [(i, r) for r in range(ranks) for i in range(first[r], first[r + 1])]
    weighted = sorted((r.elem_id, r.rank) for r in fo.partition(forest, ranks, F.lit(1)).collect())
    assert weighted == got


MESH = """$MeshFormat
4.1 0 8
$EndMeshFormat
$Nodes
2 7 10 16
2 1 0 5
10
11
12
13
14
0 0 1
3 0 1
0 2 1
3 2 1
5 1 1
2 2 0 2
15
16
7 7 7
8 8 8
$EndNodes
$Elements
3 3 20 22
2 1 3 1
21 10 11 13 12
2 2 2 1
20 11 14 13
1 1 1 1
22 10 11
$EndElements
"""


def test_gmsh_files(spark, tmp_path):
    (tmp_path / "a.msh").write_text(MESH)
    nodes, elements = msh.read(spark, str(tmp_path / "a.msh"))
    assert nodes.count() == 7 and elements.count() == 3
    trees = {r.tree_id: r for r in msh.trees(nodes, elements, 2).collect()}
    assert sorted(trees) == [0, 1] and (trees[0].element_id, trees[0].eclass) == (20, eclass.TRIANGLE)
    # The quad's nodes go around it in the file, and along the axes here.
    assert trees[1].vertices == [[0, 0, 1], [3, 0, 1], [0, 2, 1], [3, 2, 1]] and trees[1].global_vertices == [10, 11, 12, 13]
    joined = cmesh.joined_by_vertices(msh.trees(nodes, elements, 2)).where("not is_boundary")
    assert sorted((r.tree_id, r.face, r.neigh_tree, r.neigh_face, r.orientation) for r in joined.collect()) == [(0, 1, 1, 1, 0), (1, 1, 0, 1, 0)]
    assert msh.triangle_neighbours(elements).count() == 0
    for bad in (MESH.replace("4.1 0 8", "2.2 0 8"), MESH.replace("2 2 2 1", "2 2 9 1")):
        with pytest.raises(msh.FormatError):
            msh.parsed(bad)


def test_vtk_files(spark, tmp_path):
    leaves = cmesh.brick(spark, 2, 1).withColumn("v", F.col("tree_id") * 1.5).coalesce(1)
    (only,) = vtk.pieces(leaves, eclass.QUAD, ["v"]).collect()
    assert 'NumberOfPoints="8" NumberOfCells="2"' in only.value and "0.0 1.5" in only.value and "9 9" in only.value
    trees = cmesh.hypercube(spark, eclass.TET).withColumn("v", F.col("tree_id") + 0.5).repartition(3)
    n = vtk.write(trees, f"{tmp_path}/cube", eclass.TET, ["v"])
    assert (tmp_path / "cube.pvtu").read_text().count("<Piece Source") == n and not (tmp_path / "cube.parts").exists()
    back = vtk.read(spark, f"{tmp_path}/cube_*.vtu").select(F.col("fields")["v"].alias("v"), "eclass", "vertices")
    assert sorted((r.v, r.eclass, r.vertices) for r in back.collect()) == sorted((r.v, r.eclass, r.vertices) for r in trees.collect())


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(3.0), F.lit(4.0))
    row = spark.range(1).select(vec.norm(a).alias("n"), vec.cross(a, b).alias("c"), vec.normalised(F.array(*[F.lit(0.0)] * 3)).alias("z"), vec.parallelogram(a, b).alias("p")).first()
    assert row.n == 3 and row.c == [2, -4, 3] and row.z is None and abs(row.p - 29**0.5) < 1e-12
