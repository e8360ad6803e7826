"""Unstructured VTK grids (.vtu, ASCII): one file for each partition and a .pvtu that lists them, as cluster writers do; and reading them."""

from __future__ import annotations

import re
import xml.etree.ElementTree as xml
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions.eclass import HEX, LINE, PRISM, PYRAMID, QUAD, TET, TRIANGLE, VERTEX

# By class, our corner numbers in the order in which VTK wants them, and the cell type.
CORNERS = {VERTEX: ([0], 1), LINE: ([0, 1], 3), QUAD: ([0, 1, 3, 2], 9), TRIANGLE: ([0, 1, 2], 5), HEX: ([0, 1, 3, 2, 4, 5, 7, 6], 12), TET: ([0, 2, 1, 3], 10), PRISM: ([0, 2, 1, 3, 5, 4], 13), PYRAMID: ([0, 1, 3, 2, 4], 14)}
CLASSES = {kind: c for c, (_, kind) in CORNERS.items()}
#: Cells of one file at most, so that a writer holds no more.
CELLS = 100_000


def _array(name: str, kind: str, values: Iterator, extra: str = "") -> str:
    return f'<DataArray type="{kind}" Name="{name}" {extra}format="ascii">{" ".join(map(str, values))}</DataArray>'


def piece(cells: list[tuple[int, list]], fields: dict[str, list[float]]) -> str:
    """One .vtu document of cells (class, corners), whose points are not shared, and a number for each cell and field."""
    points, offsets, kinds = [], [], []
    for c, corners in cells:
        order, kind = CORNERS[c]
        points += [corners[i] for i in order]
        offsets.append(len(points))
        kinds.append(kind)
    data = "".join(_array(n, "Float64", map(repr, map(float, v))) for n, v in fields.items())
    return (
        '<?xml version="1.0"?><VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian"><UnstructuredGrid>'
        f'<Piece NumberOfPoints="{len(points)}" NumberOfCells="{len(cells)}">'
        f"<Points>{_array('Position', 'Float64', (repr(float(c)) for p in points for c in p), 'NumberOfComponents=\"3\" ')}</Points>"
        f"<Cells>{_array('connectivity', 'Int64', range(len(points)))}{_array('offsets', 'Int64', offsets)}{_array('types', 'UInt8', kinds)}</Cells>"
        f"<CellData>{data}</CellData></Piece></UnstructuredGrid></VTKFile>"
    )


def index(names: list[str], fields: list[str]) -> str:
    """The .pvtu document that lists files and fields."""
    data = "".join(f'<PDataArray type="Float64" Name="{f}"/>' for f in fields)
    sources = "".join(f'<Piece Source="{n}"/>' for n in names)
    return (
        '<?xml version="1.0"?><VTKFile type="PUnstructuredGrid" version="0.1" byte_order="LittleEndian"><PUnstructuredGrid GhostLevel="0">'
        '<PPoints><PDataArray type="Float64" Name="Position" NumberOfComponents="3"/></PPoints>'
        f"<PCellData>{data}</PCellData>{sources}</PUnstructuredGrid></VTKFile>"
    )


def pieces(leaves: DataFrame, eclass: int, fields: list[str]) -> DataFrame:
    """(piece, value): .vtu documents of `leaves(vertices or corners, fields...)`, at most CELLS cells in each; pieces are numbered by partition and place."""
    corners = "corners" if "corners" in leaves.columns else "vertices"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), CELLS):
                part = b.iloc[k : k + CELLS]
                yield pd.DataFrame({"value": [piece([(eclass, p) for p in part[corners]], {f: part[f].tolist() for f in fields})]})

    return leaves.select(corners, *fields).mapInPandas(run, "value string").withColumn("piece", F.monotonically_increasing_id())


def write(leaves: DataFrame, path: str, eclass: int, fields: list[str]) -> int:
    """Write `path`.pvtu and the files `path`_N.vtu that it lists, through the file system that holds them; the number of these.

    Executors write documents as rows of a folder; the driver moves one document at a time to its file, as VTK wants plain files.
    """
    spark = leaves.sparkSession
    folder = f"{path}.parts"
    pieces(leaves, eclass, fields).write.parquet(folder)
    stored, names = spark.read.parquet(folder), []
    for n, row in enumerate(stored.select("piece").orderBy("piece").toLocalIterator()):
        name = f"{path}_{n:04}.vtu"
        _put(spark, name, stored.where(F.col("piece") == row.piece).first().value)
        names.append(re.sub(r".*/", "", name))
    _put(spark, f"{path}.pvtu", index(names, fields))
    _at(spark, folder)[0].delete(_at(spark, folder)[1], True)
    return len(names)


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, text: str) -> None:
    system, target = _at(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def parsed(text: str) -> list[tuple[int, list[list[float]], dict[str, float]]]:
    """(class, corners, fields) of the cells of an ASCII .vtu document; cell types that have no class raise an error."""
    out = []
    for p in xml.fromstring(text).iter("Piece"):
        found = {a.get("Name"): (a.text or "").split() for a in p.iter("DataArray") if a.get("format") == "ascii"}
        at = [float(x) for x in (next(iter(p.find("Points"))).text or "").split()]
        points = [at[k : k + 3] for k in range(0, len(at), 3)]
        places, ends, kinds = ([int(x) for x in found[n]] for n in ("connectivity", "offsets", "types"))
        fields = {a.get("Name"): [float(x) for x in (a.text or "").split()] for a in (p.find("CellData") if p.find("CellData") is not None else ())}
        for k, (kind, end) in enumerate(zip(kinds, ends, strict=True)):
            if kind not in CLASSES:
                raise ValueError(f"cells of type {kind} can't be trees")
            own = [points[i] for i in places[ends[k - 1] if k else 0 : end]]
            corners: list = [None] * len(own)
            for theirs, ours in enumerate(CORNERS[CLASSES[kind]][0]):
                corners[ours] = own[theirs]
            out.append((CLASSES[kind], corners, {n: v[k] for n, v in fields.items()}))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell, eclass, vertices, fields) of the .vtu files at `path`, each in one task; `fields` is a map of the cell data."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["value"], strict=True):
                rows = parsed(text)
                yield pd.DataFrame({"file": file, "cell": range(len(rows)), "eclass": [r[0] for r in rows], "vertices": [r[1] for r in rows], "fields": [r[2] for r in rows]})

    return files.mapInPandas(run, "file string, cell long, eclass int, vertices array<array<double>>, fields map<string,double>")
