"""Exact dedup by content sort.

Splitters sampled by Spark's range partitioner deal the texts out by content, an external sort puts equal texts next
to each other, and each row is compared in full with its neighbour. Row ids are part of the sort key, so a text that
fills a third of the table is dealt over many partitions; runs that cross a partition border are joined afterwards by
comparing the texts on both sides of the border.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridquarry.llm.common import cut, table

#: Characters of a text in the sort key that the splitters are sampled from; a digest and the id follow, then the text.
KEY_CHARS = 48
_RUNS = "id long, sha string, part int, run long, first_text string, last_text string"


def _runs(batches):
    """Number the runs of equal neighbouring texts; the first and last row of the partition carry their text."""
    part, run, last, held = None, -1, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, text, sha, part = batch["id"], batch["t"], batch["sha"], batch["part"][0].as_py()
        fresh = pa.concat_arrays([pa.array([last is None or text[0].as_py() != last]), pc.not_equal(text[1:], text[:-1])])
        steps = pc.cumulative_sum(fresh.cast(pa.int64()))
        runs = pc.add(steps, run)
        firsts = [text[0].as_py() if held is None else None] + [None] * (batch.num_rows - 1)
        rows = pa.table({"id": ids, "sha": sha, "part": pa.array([part] * batch.num_rows, pa.int32()), "run": runs, "first_text": pa.array(firsts, pa.string()), "last_text": pa.nulls(batch.num_rows, pa.string())})
        last, run = text[-1].as_py(), runs[-1].as_py()
        if held is not None:
            yield from held.to_batches()
        if rows.num_rows > 1:
            yield from rows.slice(0, rows.num_rows - 1).to_batches()
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield from held.set_column(5, "last_text", pa.array([last], pa.string())).to_batches()


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, text_sha256 (of the normalised text).

    ``keep`` names which id of equal texts stays: 'smallest' or 'largest'. Null texts count as empty and so equal the
    empty text. Null ids stay only where a group has no other id. Repeated rows are rows of their own; a repeated id
    inside a group counts each time. An empty table gives an empty result; further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (normalise(text) if normalise else text).alias("t"))
    key = [F.substring("t", 1, KEY_CHARS), F.xxhash64("t")]
    placed = rows.repartitionByRange(*key, F.col("id")).sortWithinPartitions(*key, F.col("t"), F.col("id"))
    runs = cut(placed.select("id", "t", F.sha2("t", 256).alias("sha"), F.spark_partition_id().alias("part")).mapInArrow(_runs, _RUNS), "runs")
    pick = F.max if keep == "largest" else F.min
    sizes = runs.groupBy("part", "run").agg(pick("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    # One row per partition: does its first run carry on the run that ended the partition before?
    ends = runs.groupBy("part").agg(F.max("first_text").alias("first_text"), F.max("last_text").alias("last_text"), F.max("run").alias("last_run"))
    along = W.orderBy("part")
    before = lambda c: F.lag(c).over(along)
    ends = ends.select("part", (before("last_text") == F.col("first_text")).alias("on"), before("part").alias("p"), before("last_run").alias("r"))
    own = F.when(F.coalesce("on", F.lit(False)) & (F.col("r") == 0), F.lit(None)).when(F.col("on"), F.struct(F.col("p").alias("part"), F.col("r").alias("run"))).otherwise(F.struct(F.col("part").alias("part"), F.lit(0).cast("long").alias("run")))
    chains = ends.select("part", F.lit(0).cast("long").alias("run"), F.last(own, ignorenulls=True).over(along).alias("head"))
    linked = sizes.join(chains, ["part", "run"], "left").withColumn("head", F.coalesce("head", F.struct("part", "run")))
    totals = linked.groupBy("head").agg(pick("keep").alias("keep_id"), F.sum("n").alias("group_size"))
    decided = linked.select("part", "run", "head").join(totals, "head").select("part", "run", "keep_id", "group_size")
    return runs.select("id", "sha", "part", "run").join(decided, ["part", "run"]).select("id", "keep_id", "group_size", F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is the one that stays of their text's group; every column is kept.

    An id may stay in one group and go in another. Repeated rows with the id that stays all stay.
    """
    stay = exact_classes(docs, id_col, text_col, keep, normalise).where(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("_stay"), F.col("text_sha256").alias("_sha")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).cast("long").alias("_id"), F.sha2(normalise(text) if normalise else text, 256).alias("_own"))
    return packed.join(stay, F.col("_id").eqNullSafe(F.col("_stay")) & (F.col("_own") == F.col("_sha")), "left_semi").select("_doc.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_classes(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
