"""Columns worked out from a text column in Python and put beside all others."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import CHUNK_BYTES, chunks

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def released() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`rows.mapInArrow(run, schema)` in batches of bounded size, whose workers give their memory back when a task ends.

    The bound is a setting of the session, lowered here where it is higher: without it ten thousand long texts are one batch.
    """
    spark = rows.sparkSession
    if int(spark.conf.get(BATCH_SETTING).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return rows.mapInArrow(held, schema)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores behind it as no column in `taken` has (in any case of letters)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def appended(docs: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """`docs` with the columns of `schema` (names and types, comma-separated) after its own.

    `make` is called once in each task and gives the function that turns a chunk of `text` into the new columns. The
    new names must not be among the old ones.
    """
    names = [x.strip().split(" ", 1)[0] for x in schema.split(",")]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in chunks(batches, text, limit):
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(place))], [*batch.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return mapped(docs, run, f"{own}, {schema}")


def row_id(key: str, text: str) -> Column:
    """Tells rows apart by key and text: rows that agree in both are one document, rows that share only the key are not."""
    return F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h"))
