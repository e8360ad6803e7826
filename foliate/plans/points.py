"""The driver's tables as points of unit trees: integer places from exact arithmetic, so every engine gets the same cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import morton

DEPTH = 10
EVENT_US = 2_531_250_000
EVENT_CENTS = 50
SHIP_DAYS = 4
PRICE = 206


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bounded(x: Column, top: int) -> Column:
    return F.greatest(F.least(x.cast("long"), F.lit(top).cast("long")), F.lit(0).cast("long"))


def event_place() -> tuple[Column, Column]:
    """x: time since 2024 in steps of EVENT_US microseconds; y: value in steps of EVENT_CENTS cents; both under 2^10."""
    x = F.expr(f"(unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))) div {EVENT_US}")
    y = F.expr(f"cast(round(value * 100) as bigint) div {EVENT_CENTS}")
    return _bounded(x, 1023), _bounded(y, 1023)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, tree_id, x, y, id): events in one quadtree of depth 10."""
    x, y = event_place()
    places = table(spark, sf_dir, "events").select("event_id", F.lit(0).cast("long").alias("tree_id"), x.alias("x"), y.alias("y"))
    return places.withColumn("id", morton.encode(F.col("x"), F.col("y")))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_id, x, y, z, id): ship day, price and quantity in one octree of depth 6 for each return flag."""
    rows = table(spark, sf_dir, "lineitem")
    x = F.expr("(unix_date(cast(l_shipdate as date)) - unix_date(date'1995-01-01')) div 40")
    y, z = F.expr("cast(l_extendedprice as bigint) div 1650"), F.expr("cast(l_quantity as bigint)")
    tree = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    places = rows.select(tree.alias("tree_id"), *[_bounded(c, 63).alias(n) for n, c in zip("xyz", (x, y, z), strict=True)])
    return places.withColumn("id", morton.encode(F.col("x"), F.col("y"), F.col("z")))
