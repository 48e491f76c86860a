"""Mixing sources to target weights.

The mix is a sequence of slots of ``block_words`` words each. Slot i gets the van der Corput point of i, which is
mapped through the cumulative block quotas of the sources, so any stretch of the schedule is close to the target
shares. The k-th slot of a source takes the k-th block of the words of its shuffled documents, laid end to end and
repeated up to ``max_epochs`` times; the last block of a source ends at its target.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.common import BUCKET_ROWS, cut, n_words, prefix_sums, running, table

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1024
SHARE = 1.5
MAX_EPOCHS = 2
#: Slots are ranked in ranges of SLOT_RANGE.
SLOT_RANGE = 65536
CELL = 4096


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source (src, source_size, target, no) from rows (src, size).

    Sources in code-point order, null last, get the weights in turn. The whole target is ``share`` times all sizes;
    no source's target exceeds ``max_epochs`` times its size, and the excess goes to the others by weight. Sorted by
    cap per unit of weight, the capped sources are a prefix, so one running sum finds the common level.
    """
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    turned = running(sources, [F.col("src").asc_nulls_last()], {}).withColumnRenamed("_rank", "no")
    capped = turned.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ranked = cut(running(capped.withColumn("at", F.col("cap") / F.col("weight")), [F.col("at"), F.col("no")], {"caps": F.col("cap"), "weights": F.col("weight")}), "levels")
    # One row: all sizes and weights.
    whole = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # The level that would hold if exactly the sources before this one were capped; the first source that fits under it sets the level.
    level = (F.col("all_size") * F.lit(float(share)) - F.col("caps")) / (F.col("all_weight") - F.col("weights"))
    ranked = ranked.join(F.broadcast(whole)).withColumn("level", level)
    first = ranked.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("at", "no", "level"))["level"].alias("final"))
    return ranked.join(F.broadcast(first)).select("src", "no", F.col("source_size").cast("long").alias("source_size"), F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _bit_reversed(i: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a long in reverse order: van der Corput's point of i times 2^bits."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        i = F.shiftrightunsigned(i, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(i.bitwiseAND(F.lit(mask)), shift))
    i = F.shiftrightunsigned(i, 32).bitwiseOR(F.shiftleft(i, 32))
    return F.shiftrightunsigned(i, 64 - bits) if bits else F.lit(0).cast("long")


def schedule(quotas: DataFrame) -> DataFrame:
    """Rows (slot, no, block) from (no, blocks): which source each slot serves and which of its blocks.

    With 2^m >= the number of blocks Q, the point of slot i falls at x = j Q / 2^m for an integer j, so an interval of
    q blocks holds at least q points; slots past a source's quota are left out.
    """
    spark = quotas.sparkSession
    total = quotas.agg(F.sum("blocks")).first()[0] or 0
    bits = max(0, int(total - 1).bit_length()) if total else 0
    lanes = running(quotas.where("blocks > 0"), [F.col("no")], {"lo": F.col("blocks")}).drop("_rank").withColumn("hi", F.col("lo") + F.col("blocks"))
    # Each lane is cut into cells of CELL blocks, so that a point finds its lane by an equi-join.
    cells = F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))
    lanes = lanes.select("no", "blocks", "lo", "hi", F.explode(cells).alias("cell"))
    slots = spark.range(0, (1 << bits) if total else 0).select(F.col("id").alias("slot"))
    point = _bit_reversed(F.col("slot"), bits)
    if bits <= 31:
        x = F.shiftrightunsigned(point * F.lit(int(total)), bits)
    else:  # the product may pass 2^63; whole decimals keep it exact
        x = F.expr(f"cast({int(total)} as decimal(19,0))") * point.cast("decimal(19,0)")
        x = (x - F.pmod(x, F.lit(1 << bits).cast("decimal(19,0)"))) / F.lit(1 << bits).cast("decimal(19,0)")
    placed = slots.withColumn("x", x.cast("long")).withColumn("cell", F.floor(F.col("x") / CELL))
    found = placed.join(lanes, "cell").where("x >= lo and x < hi").select("slot", "no", "blocks")
    ranked = prefix_sums(found, ["no"], [F.col("slot")], F.floor(F.col("slot") / SLOT_RANGE), F.lit(1), "block")
    return ranked.where("block < blocks").select("slot", "no", "block")


def mix_pieces(docs: DataFrame, id_col: str = "doc_id", size: Column | None = None, source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """Rows (id, row, src, size, source_size, target, epoch, slot, piece_words): the mix, piece by piece.

    Every input row has at least one row; slot is null where the mix takes nothing. ``row`` numbers equal ids apart by
    their place among the words of the source. Null sources form a source of their own; empty texts have size 0 and are
    never taken; repeated rows are rows of their own; an empty table gives an empty mix.
    """
    size = n_words(F.col("text")) if size is None else size
    sized = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("src"), size.alias("size")), "sized")
    targets = cut(source_targets(sized, weights, share, max_epochs).withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)), "targets")
    slots = schedule(targets.select("no", F.ceil(F.col("quota") / block_words).alias("blocks")))
    shuffled = F.xxhash64("id", F.lit(seed))
    laid = prefix_sums(sized, ["src"], [shuffled, F.col("id"), F.col("size")], F.pmod(shuffled, F.lit(max(1, sized.count() // BUCKET_ROWS))), F.col("size"), "start")
    laid = laid.join(targets.withColumnRenamed("src", "_src"), F.col("src").eqNullSafe(F.col("_src"))).drop("_src")
    spans = laid.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)]))).withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size"))
    spans = spans.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota")))
    cells = F.when(F.col("hi") > F.col("lo"), F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words)))
    pieces = spans.withColumn("block", F.explode_outer(cells))
    words = F.least("hi", (F.col("block") + 1) * block_words) - F.greatest("lo", F.col("block") * block_words)
    pieces = pieces.withColumn("piece_words", words)
    served = pieces.join(slots, ["no", "block"], "left")
    return served.select("id", F.col("start").alias("row"), "src", "size", "source_size", "target", "epoch", "slot", F.when(F.col("slot").isNotNull(), F.col("piece_words")).otherwise(0).cast("long").alias("piece_words"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word and the white space that follows."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    led = text.rlike(r"\A[\x20\x09-\x0D]").cast("int")
    return F.array_join(F.slice(parts, F.lit(1), (n + led).cast("int")), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix reads them: once for each epoch in which it takes any of their words.

    All columns are kept. Where the mix takes only the first words of a document, the last one of a source, the text ends
    there. Rows with one id and size share the readings of the one that is read most.
    """
    pieces = mix_pieces(docs, id_col, n_words(F.col(text_col)), **how).where("slot is not null")
    read = pieces.groupBy("id", "row", "size", "epoch").agg(F.sum("piece_words").alias("n")).groupBy("id", "size", "epoch").agg(F.max("n").alias("_n"))
    read = read.select(F.col("id").alias("_id"), F.col("size").alias("_size"), "_n")
    text = F.col(f"_doc.`{text_col}`")
    joined = docs.select(F.struct("*").alias("_doc")).join(read, F.col(f"_doc.`{id_col}`").cast("long").eqNullSafe(F.col("_id")) & (n_words(text) == F.col("_size")))
    taken = F.when(F.col("_n") < F.col("_size"), first_words(text, F.col("_n"))).otherwise(text)
    return joined.select(*[taken.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mix_pieces(table(spark, sf_dir, "documents"))
    found = pieces.groupBy("id", "row", "size", "source_size", "target").agg(F.sum("piece_words").alias("taken"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
