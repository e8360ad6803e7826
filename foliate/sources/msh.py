"""Gmsh files, ASCII format 4: nodes and elements as DataFrames, and faces joined by their node ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.functions import eclass
from foliate.plans.tables import written

#: Rows of a batch that the parser hands on.
ROWS = 50_000

# Gmsh element type -> (our class, nodes).
TYPES = {15: (eclass.VERTEX, 1), 1: (eclass.LINE, 2), 2: (eclass.TRIANGLE, 3), 3: (eclass.QUAD, 4), 4: (eclass.TET, 4), 5: (eclass.HEX, 8), 6: (eclass.PRISM, 6), 7: (eclass.PYRAMID, 5)}


# Places of our corners among Gmsh's nodes, where they differ; tets turn the other way.
ORDERS = {eclass.QUAD: [0, 1, 3, 2], eclass.HEX: [0, 1, 3, 2, 4, 5, 7, 6], eclass.TET: [0, 2, 1, 3], eclass.PYRAMID: [0, 1, 3, 2, 4]}


class FormatError(ValueError):
    """The file is not what this reader can read."""


def _sections(text: str) -> dict[str, list[str]]:
    out, name = {}, None
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("$End"):
            name = None
        elif line.startswith("$"):
            name = line[1:]
            out[name] = []
        elif name is not None and line:
            out[name].append(line)
    return out


def parsed(text: str) -> tuple[list[tuple], list[tuple]]:
    """Rows (node_id, x, y, z) and (element_id, eclass, dim, nodes)."""
    sections = _sections(text)
    head = (sections.get("MeshFormat") or [""])[0].split()
    if not head or not head[0].startswith("4") or head[1:2] != ["0"]:
        raise FormatError("only ASCII files of format 4 can be read")
    nodes: list[tuple] = []
    lines = iter(sections.get("Nodes", []))
    for _ in range(int(next(lines, "0").split()[0])):
        n = int(next(lines).split()[3])
        ids = [int(next(lines)) for _ in range(n)]
        nodes += [(i, *map(float, next(lines).split()[:3])) for i in ids]
    elements: list[tuple] = []
    lines = iter(sections.get("Elements", []))
    for _ in range(int(next(lines, "0").split()[0])):
        dim, _, kind, n = map(int, next(lines).split())
        for _ in range(n):
            first, *rest = map(int, next(lines).split())
            if kind not in TYPES:
                raise FormatError(f"elements of type {kind} are not known: only linear ones can be read")
            # Points of boxes and pyramids go around a face there, and along the axes here.
            order = ORDERS.get(TYPES[kind][0], range(TYPES[kind][1]))
            elements.append((first, TYPES[kind][0], dim, [rest[i] for i in order]))
    return nodes, elements


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of the files at `path`, each file read once, in one task, by any path that Spark reads."""
    files = spark.read.text(path, wholetext=True)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                nodes, elements = parsed(text)
                for k in range(0, len(nodes), ROWS):
                    part = nodes[k : k + ROWS]
                    yield pd.DataFrame({"id": [n[0] for n in part], "at": [list(n[1:]) for n in part], "eclass": None, "dim": None, "nodes": None})
                for k in range(0, len(elements), ROWS):
                    part = elements[k : k + ROWS]
                    yield pd.DataFrame({"id": [e[0] for e in part], "at": None, "eclass": [e[1] for e in part], "dim": [e[2] for e in part], "nodes": [e[3] for e in part]})

    both = written(files.mapInPandas(rows, "id long, at array<double>, eclass int, dim int, nodes array<long>"), "gmsh")
    nodes = both.where("at is not null").select(F.col("id").alias("node_id"), *[F.get("at", F.lit(k)).alias(a) for k, a in enumerate("xyz")])
    return nodes, both.where("at is null").select(F.col("id").alias("element_id"), "eclass", "dim", "nodes")


def trees(nodes: DataFrame, elements: DataFrame, dim: int) -> DataFrame:
    """Elements of a dimension as trees: (tree_id, element_id, eclass, vertices, global_vertices), tree_id rising from 0 with the elements' ids.

    Numbers are given within ranges of ids and over the ranges' counts, so no task sorts all elements.
    """
    own = elements.where(F.col("dim") == dim).select("element_id", "eclass", "nodes")
    ranged = written(own.repartitionByRange("element_id").sortWithinPartitions("element_id").withColumn("_m", F.monotonically_increasing_id()), "gmsh-trees")
    counts = ranged.groupBy(F.expr("_m >> 33").alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n0"))
    numbered = ranged.withColumn("_part", F.expr("_m >> 33")).join(F.broadcast(starts), "_part")  # a row for each range
    numbered = numbered.withColumn("tree_id", F.col("_n0") + F.expr("_m & ((1L << 33) - 1)")).drop("_m", "_part", "_n0")
    each = numbered.select("tree_id", "element_id", "eclass", F.posexplode("nodes").alias("i", "node_id"))
    points = each.join(nodes, "node_id").groupBy("tree_id", "element_id", "eclass").agg(F.sort_array(F.collect_list(F.struct("i", F.array("x", "y", "z").alias("v"), "node_id"))).alias("p"))
    return points.select("tree_id", "element_id", "eclass", F.col("p.v").alias("vertices"), F.col("p.node_id").alias("global_vertices"))


def triangle_neighbours(elements: DataFrame) -> DataFrame:
    """Pairs of triangles that share an edge, each pair once: (a, b, edge)."""
    edge = lambda i, j: F.sort_array(F.array(F.get("nodes", F.lit(i)), F.get("nodes", F.lit(j))))
    edges = elements.where(F.col("eclass") == eclass.TRIANGLE).select("element_id", F.explode(F.array(edge(1, 2), edge(0, 2), edge(0, 1))).alias("edge"))
    return edges.groupBy("edge").agg(F.sort_array(F.collect_list("element_id")).alias("e")).where(F.size("e") == 2).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"), "edge")
