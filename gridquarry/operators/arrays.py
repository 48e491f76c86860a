"""Array operators: scans, ranges, block aggregates, redimensioning, generation, upserts and the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.plans.model import Array, ArrayMeta, Dim

FOLDS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_samp, "var": F.var_samp}


def between(cells: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Cells inside an inclusive box; the bounds reach the scan."""
    for dim, (lo, hi) in ranges.items():
        cells = cells.where(F.col(dim).between(lo, hi))
    return cells


def depart_box(meta: ArrayMeta, low: Sequence[int], high: Sequence[int]) -> dict[str, tuple[int, int]]:
    """The window clamped to the array and widened to whole tiles; low above high is an error."""
    box = {}
    for d, lo, hi in zip(meta.dims, low, high, strict=True):
        if lo > hi:
            raise ValueError(f"the window of {d.name} is empty: {lo} > {hi}")
        lo, hi = max(lo, d.lo), min(hi, d.hi)
        lo = d.lo + (lo - d.lo) // d.chunk * d.chunk
        hi = min(d.hi, d.lo + ((hi - d.lo) // d.chunk + 1) * d.chunk - 1)
        box[d.name] = (lo, hi)
    return box


def depart(array: Array, low: Sequence[int] | None = None, high: Sequence[int] | None = None, replicate: bool = False) -> Array:
    """The part of an array that a search reads, dealt out by tile, or whole to every executor where it is small enough.

    Replication is a hint that Spark follows only below its broadcast threshold.
    """
    cells = array.cells if low is None else between(array.cells, depart_box(array.meta, low, high))
    if replicate:
        return Array(array.meta, cells)
    tiles = [F.floor((F.col(d.name) - d.lo) / d.chunk) for d in array.meta.dims]
    return Array(array.meta, cells.repartition(*tiles))


def regrid(cells: DataFrame, blocks: dict[str, tuple[int, int]], aggregates: dict[str, Column]) -> DataFrame:
    """Block aggregates: ``blocks`` maps a dimension to (origin, size), the result is indexed by block from 0."""
    keys = [F.floor((F.col(d) - lo) / F.lit(size)).cast("long").alias(d) for d, (lo, size) in blocks.items()]
    return cells.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def redimension(rows: DataFrame, dims: dict[str, Column], attrs: dict[str, Column], collide: str | None = None) -> DataFrame:
    """Attributes become dimensions. Rows that fall on one cell are folded by the named aggregate; without one, the cell takes the smallest row."""
    keyed = rows.select(*[c.cast("long").alias(d) for d, c in dims.items()], *[c.alias(a) for a, c in attrs.items()]).dropna(subset=list(dims))
    if collide:
        return keyed.groupBy(*dims).agg(*[FOLDS[collide](a).alias(a) for a in attrs])
    return keyed.groupBy(*dims).agg(F.min(F.struct(*attrs)).alias("_row")).select(*dims, *[F.col(f"_row.{a}").alias(a) for a in attrs])


def insert(target: DataFrame, rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``target`` with the cells of ``rows`` put in place of its own."""
    return target.join(rows.select(*dims), list(dims), "left_anti").unionByName(rows)


def build(spark: SparkSession, dims: Sequence[Dim], attrs: dict[str, Column]) -> DataFrame:
    """An array from expressions of its dimensions; cells are numbered row-major and made on the executors."""
    sizes = [d.hi - d.lo + 1 for d in dims]
    total = 1
    for s in sizes:
        total *= s
    cells, stride = spark.range(total), total
    for d, size in zip(dims, sizes, strict=True):
        stride //= size
        cells = cells.withColumn(d.name, (F.floor(F.col("id") / stride) % size + d.lo).cast("long"))
    return cells.select(*[d.name for d in dims], *[c.alias(n) for n, c in attrs.items()])


def literal(spark: SparkSession, schema: str, rows: list[tuple | None]) -> DataFrame:
    """A vector from literal cells indexed from 0; None is an empty cell."""
    return spark.createDataFrame([(x, *r) for x, r in enumerate(rows) if r is not None], f"x long, {schema}")


def dimension_mapping(values: DataFrame, label: str) -> DataFrame:
    """Index 0, 1, … of the sorted distinct labels.

    A range partitioning puts the labels in order; only the number of labels in each partition meets in one place.
    """
    labels = values.select(F.col(label).alias("label")).dropna().distinct()
    placed = labels.repartitionByRange("label").withColumn("part", F.spark_partition_id())
    placed = placed.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("label")) - 1)
    counts = placed.groupBy("part").count()
    bases = counts.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("base"))
    return placed.join(bases, "part").select("label", (F.col("k") + F.col("base")).cast("long").alias("index"))


def lookup(cells: DataFrame, points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The cells at given points; points of empty cells have null attributes."""
    return points.join(cells, list(dims), "left")


class Catalogue:
    """Arrays by name, with their dimensions and attributes as tables, and caches that can be dropped."""

    ACTIONS = ("clear_cache", "clear_dep_cache", "clear_syn_cache")

    def __init__(self, spark: SparkSession):
        self.spark, self.arrays, self.cached = spark, {}, {"clear_dep_cache": {}, "clear_syn_cache": {}}

    def register(self, array: Array) -> Array:
        self.arrays[array.meta.name] = array
        array.cells.createOrReplaceTempView(array.meta.name)
        return array

    def remove(self, name: str) -> None:
        self.arrays.pop(name)
        self.spark.catalog.dropTempView(name)

    def persist(self, name: str, df: DataFrame, synopsis: bool = False) -> DataFrame:
        """The cached table of that name, or ``df`` from now on."""
        held = self.cached["clear_syn_cache" if synopsis else "clear_dep_cache"]
        if name not in held:
            held[name] = df.persist()
        return held[name]

    def control(self, action: str) -> int:
        """Drop the caches that an action names; how many tables went."""
        if action not in self.ACTIONS:
            raise ValueError(f"unknown action {action}")
        n = 0
        for kind in self.cached if action == "clear_cache" else [action]:
            for df in self.cached[kind].values():
                df.unpersist()
                n += 1
            self.cached[kind].clear()
        return n

    def list(self) -> DataFrame:
        return self.spark.createDataFrame([(n, len(a.meta.dims), len(a.meta.attrs)) for n, a in sorted(self.arrays.items())], "name string, n_dims int, n_attrs int")

    def dimensions(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(k, d.name, d.lo, d.hi, d.chunk) for k, d in enumerate(self.arrays[name].meta.dims)], "no int, name string, low long, high long, chunk long")

    def attributes(self, name: str) -> DataFrame:
        fields = {f.name: f for f in self.arrays[name].cells.schema.fields}
        return self.spark.createDataFrame([(k, a, fields[a].dataType.simpleString(), fields[a].nullable) for k, a in enumerate(self.arrays[name].meta.attrs)], "no int, name string, type string, nullable boolean")
