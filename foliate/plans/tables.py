"""Tables written to the cluster's shared folder, to cut the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

SETTING = "spark.checkpoint.dir"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as Parquet in the folder that spark.checkpoint.dir names, read again; a temporary folder is set only where none is named, as in tests."""
    spark = df.sparkSession
    folder = spark.conf.get(SETTING, None)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='foliate-')}"
        spark.conf.set(SETTING, folder)
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
