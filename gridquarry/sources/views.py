"""Array views over the star-schema tables. Measures are whole numbers, so sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.plans.model import Array, ArrayMeta, Dim

GRID = ArrayMeta("grid", (Dim("x", 0, 999, 10), Dim("y", 0, 82, 6)), ("val",))
UGRIZ = ArrayMeta("ugriz", GRID.dims, ("u", "g", "r", "i", "z"))
WAVE = ArrayMeta("wave", (Dim("record", 0, 1 << 40, 1), Dim("tick", 0, 719, 24)), ("ABP",))
SEQ = ArrayMeta("seq", (Dim("record", 0, 1 << 40, 1), Dim("tick", 0, 63, 16)), ("val",))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month() -> tuple:
    return F.col("l_suppkey").alias("x"), ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long").alias("y")


def grid(spark: SparkSession, sf_dir: str) -> Array:
    """Quantity sold by supplier and month."""
    rows = read(spark, sf_dir, "lineitem").select(*month(), "l_quantity")
    return Array(GRID, rows.groupBy("x", "y").agg(F.sum("l_quantity").alias("val")))


def ugriz(spark: SparkSession, sf_dir: str) -> Array:
    rows = read(spark, sf_dir, "lineitem").select(*month(), "l_quantity", "l_partkey")
    return Array(UGRIZ, rows.groupBy("x", "y").agg(F.sum("l_quantity").alias("u"), F.count(F.lit(1)).alias("g"), F.max("l_quantity").alias("r"), F.min("l_quantity").alias("i"), F.countDistinct("l_partkey").alias("z")))


def wave(spark: SparkSession, sf_dir: str) -> Array:
    """Hourly value of each user's events, in cents; hours without events are empty."""
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 3600).cast("long")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("record"), hour.alias("tick"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return Array(WAVE, rows.groupBy("record", "tick").agg(F.sum("v").alias("ABP")))


def seq(spark: SparkSession, sf_dir: str) -> Array:
    """The components of each embedding as a series, in thousandths."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.posexplode("embedding").alias("tick", "v"))
    return Array(SEQ, rows.select("record", F.col("tick").cast("long").alias("tick"), F.round(F.col("v").cast("double") * 1000).cast("long").alias("val")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as segments (record, segment, Ticks) of a recording."""
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return rows.select(F.col("o_custkey").alias("record"), (F.row_number().over(order) - 1).cast("long").alias("segment"), (F.col("o_orderkey") % 50).alias("Ticks"))
