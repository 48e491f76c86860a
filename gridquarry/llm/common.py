"""Shared pieces: lineage cuts, row keys, distributed ranks and union-find."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Rows that a window over one rank bucket holds on average; the bucket count follows from the counted rows.
BUCKET_ROWS = 32768
#: Rows that a Python worker gets at a time where they hold whole texts.
BATCH_ROWS = 1024
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: spark.checkpoint.dir. Only a local session may leave it unset; it gets a folder of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='gridquarry-')}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if the session is still there."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone; nothing is left to tidy with
        return


#: While it is on, Spark drops an execution's shuffle files when the execution ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the writes inside go as soon as each is complete: what it wrote replaces them."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/gridquarry/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete what ``cut`` wrote for tables that nothing will read any more."""
    for df in cuts:
        remove(df.sparkSession, df.cut_path)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Python workers of the writes inside get BATCH_ROWS rows at a time: neither they nor the JVM hold the texts of more."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def give_back() -> None:
    """Return what this process has freed to the system: its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; after each task its worker, which waits for others to come, keeps no memory that is free."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null counts as empty."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")).cast("long")


def prefix_sums(df: DataFrame, groups: list[str], order: list[Column], buckets: Column, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same group that come before a row, in the order (``buckets``, ``order``).

    A group of any size is dealt over its buckets, so no task holds a whole group; only the small table
    of bucket totals is summed per group.
    """
    rows = df.withColumn("_bucket", buckets).withColumn("_value", value)
    totals = rows.groupBy(*groups, "_bucket").agg(F.sum("_value").alias("_total"))
    running = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_total").over(running), F.lit(0)).alias("_base"),
    )
    match = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = W.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn(out, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(bases, match, "left")
        .withColumn(out, (F.col(out) + F.coalesce(F.col("_base"), F.lit(0))).cast("long"))
        .drop("_bucket", "_value", "_b", "_base", *[f"_g{i}" for i in range(len(groups))])
    )


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with _rank, the number of rows that come before a row in ``order``, and for each of ``sums`` the sum over them.

    The rows are dealt by ranges of the order, so no task holds them all; one row of totals a range is added up.
    """
    parts = cut(df.withColumns(sums).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = {"_rank": F.lit(1), **{c: F.col(c) for c in sums}}
    totals = parts.groupBy("_part").agg(*[F.sum(v).alias(f"_t{c}") for c, v in own.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_b{c}") for c in own])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumns({f"_s{c}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for c, v in own.items()}).join(bases, "_part")
    return placed.withColumns({c: F.col(f"_s{c}") + F.col(f"_b{c}") for c in own}).drop("_part", *[f"{x}{c}" for c in own for x in ("_s", "_b")])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distributed union-find over (``a``, ``b``): one row (node, root) for each node of an edge, root being the smallest id of its component.

    Each round hooks every node to its smallest neighbour, halves the paths and contracts the edges, until none is
    left. Minima are pre-aggregated before the shuffle, so a node with very many neighbours is safe; a join against
    such a node is an ordinary sort-merge join that adaptive execution splits. Nulls and self links are ignored.
    """
    live = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b"))).distinct()
    live = cut(live, "links")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("up"))
        up = cut(up, "parents")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = cut(up.join(over, "up").select("node", "root"), "roots")
        maps.append(step)
        ra = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(ra, "a").join(rb, "b").where("ra <> rb")
        live = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        out = step.join(later, "root", "left").select("node", F.coalesce("_r", "root").alias("root"))
    return out
