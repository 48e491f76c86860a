"""Fuzzy line dedup by MinHash, with DataFrame functions only.

Lines that are equal after trimming are one class. A class's signature holds minwise values of all its 5-character
shingles, the same whose Jaccard similarity decides. Lines that share a band are candidates unless bitmaps of their sets
prove them too different, the similarity is computed exactly, and distributed union-find joins what is linked. Of each component the
first occurrence stays: the smallest document id, then the place in the text.
"""

from __future__ import annotations

import contextlib
import functools
import random
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.common import components, cut, discard, remove, scratch_dir, table, tidy

#: Characters of a shingle; bands and rows of a band. A pair at the threshold shares no band with (1 - 0.8^5)^12, 9 in 1,000.
SHINGLE, BANDS, ROWS = 5, 12, 5
#: Minwise values are taken in ORDERS orders of the hashes of each of BINS bins. Value k is that of bin k % BINS in order k // BINS.
BINS, ORDERS = 16, 4
JACCARD = 0.8
#: Lines of a band with at most this many all meet. In a larger one each line first meets two lines of the band that differ from
#: band to band; then each line that the band's largest component does not hold meets every line of another component.
ALL_PAIRS = 12
#: Lines of a large band meet in blocks of about so many by so many.
BLOCK = 256
_random = random.Random(41)
_MASKS = [_random.getrandbits(64) - (1 << 63) for _ in range(ORDERS)]
#: Order j of the hashes is that of their bits rotated by TURN * j, under mask j.
TURN = 17
#: Words of 64 bits in a line's bitmap: in the coarse one, and in the fine one of lines of large bands, which folds into it.
COARSE, FINE = 16, 64
#: Keeps rounding from ruling out a pair that lies exactly at the threshold.
SLACK = 1e-9
#: Bytes of a character in the fixed-width encoding that shingles are cut out of.
WIDE = 4
#: While shingles are grouped, so many bits of groups of a task lie in the hash map that Spark looks into first. With its usual 16 the map
#: is full after 4,096 lines, and every further shingle is looked up twice.
MAP_BITS = 20
_EDGES = " \t\r\f\u000b "


@contextlib.contextmanager
def _wide_map(spark: SparkSession):
    """The first hash map of the writes inside has MAP_BITS."""
    setting = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before = spark.conf.get(setting, "16")
    spark.conf.set(setting, str(MAP_BITS))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _starts(wide: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(wide) - WIDE * (SHINGLE - 1), F.lit(1)), F.lit(WIDE))


def _name(wide: Column, start: Column) -> Column:
    return F.xxhash64(F.substr(wide, start, F.lit(WIDE * SHINGLE)))


def shingles(wide: Column) -> Column:
    """64-bit names of the runs of SHINGLE characters of a line in UTF-32, repeats included; a shorter line is one shingle.

    The outer function holds the line as a variable: a column would be copied out of its row for every shingle.
    """
    return F.transform(F.array(wide), lambda line: F.transform(_starts(line), lambda k: _name(line, k)))[0]


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, row, pos, line): the lines that are not blank, trimmed; ``row`` is a hash of the document's text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(_EDGES))).where("line <> ''")


def _order(name: str, j: int) -> Column:
    turn = TURN * j % 64
    turned = F.shiftleft(name, turn).bitwiseOR(F.shiftrightunsigned(name, 64 - turn)) if turn else F.col(name)
    return turned.bitwiseXOR(F.lit(_MASKS[j]))


def _named(lines: DataFrame) -> DataFrame:
    """Rows (lid, h): the shingle names of rows (lid, line)."""
    wide = lines.select("lid", F.encode("line", "UTF-32").alias("u"))
    return wide.select("lid", "u", F.explode(_starts(F.col("u"))).alias("k")).select("lid", _name(F.col("u"), F.col("k")).alias("h"))


def _binned(lines: DataFrame) -> DataFrame:
    """Rows (lid, bin, o0, ...): the least hash of each bin in each order. The bin of a hash is its highest bits."""
    bits = BINS.bit_length() - 1
    return _named(lines).groupBy("lid", F.shiftrightunsigned("h", 64 - bits).alias("bin")).agg(*[F.min(_order("h", j)).alias(f"o{j}") for j in range(ORDERS)])


def _bands(digests: list[Column]) -> Column:
    """The bands, each from the exclusive or of the digests (value, bin) of its places: no bin is twice in a band."""
    return F.array(*[F.xxhash64(F.lit(b), digest) for b, digest in enumerate(digests)])


def _quick_signatures(distinct: DataFrame) -> DataFrame:
    """As ``signatures``, at a fraction of the cost, but ``bands`` is null for lines with an empty bin, whose values have to be borrowed."""
    own = _binned(distinct).select("lid", "bin", *[F.xxhash64(f"o{j}", "bin").alias(f"d{j}") for j in range(ORDERS)])

    def digest(b: int) -> Column:
        places = [(j, max(0, b * ROWS - j * BINS), min(BINS, (b + 1) * ROWS - j * BINS)) for j in range(ORDERS)]
        parts = [F.when(F.col("bin").between(lo, hi - 1), F.col(f"d{j}")).otherwise(F.lit(0).cast("long")) for j, lo, hi in places if lo < hi]
        return F.bit_xor(functools.reduce(lambda x, y: x.bitwiseXOR(y), parts))

    whole = own.groupBy("lid").agg(F.count(F.lit(1)).alias("bins"), *[digest(b).alias(f"b{b}") for b in range(BANDS)])
    return whole.select("lid", F.when(F.col("bins") == BINS, _bands([F.col(f"b{b}") for b in range(BANDS)])).alias("bands"))


def signatures(distinct: DataFrame) -> DataFrame:
    """Rows (lid, bands) for rows (lid, line) that lie together by lid: nothing here needs a shuffle.

    A shingle is compared in the orders of its bin alone. A bin without shingles takes the values of the nearest bin by
    exclusive or, which makes value k the minimum of one order of all hashes.
    """
    places = [(b, j) for j in range(ORDERS) for b in range(BINS)][: BANDS * ROWS]
    orders = [f"o{j}" for j in range(ORDERS)]
    held = _binned(distinct).groupBy("lid").agg(F.collect_list(F.struct("bin", *orders)).alias("held"))
    # Lists, as columns for all bins to borrow from would be more code than the JVM compiles. No two bins are equally near to a third.
    far = lambda b: lambda x: F.struct(x["bin"].bitwiseXOR(b).alias("far"), *[x[o].alias(o) for o in orders])
    near = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.array_min(F.transform("held", far(b))))
    near = held.select("lid", near.alias("near"))
    own = near.select("lid", *[F.xxhash64(F.col("near")[b][f"o{j}"], F.lit(b).cast("long")).alias(f"d{k}") for k, (b, j) in enumerate(places)])
    return own.select("lid", _bands([functools.reduce(lambda x, y: x.bitwiseXOR(y), [F.col(f"d{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]).alias("bands"))


def _bit() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(63)).cast("int"))


def _coarse(lines: DataFrame) -> DataFrame:
    """Rows (lid, size, c0, ...) for rows (lid, line): the number of a line's shingles and the words of its coarse bitmap."""
    words = [F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"c{k}") for k in range(COARSE)]
    return _named(lines).select("lid", F.pmod("h", F.lit(COARSE)).cast("int").alias("word"), _bit().alias("bit")).groupBy("lid").agg(F.count(F.lit(1)).alias("size"), *words)


def _only(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose lid ``wanted`` has. Its ids are hashed bucket by bucket, so the texts of all lines are not sorted."""
    return lines.join(wanted.select("lid").distinct().hint("shuffle_hash"), "lid", "left_semi")


def _with_sets(members: DataFrame, lines: DataFrame) -> DataFrame:
    """``members`` with sig: the number of the line's shingles, its bitmaps (c0, ... and ``fine``) and its bands."""
    some = _only(lines, members)
    parts = _named(some).groupBy("lid", F.pmod("h", F.lit(FINE)).cast("int").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.bit_or(_bit()).alias("bits"))
    # A list, as a column for each word would be more code than the JVM compiles.
    whole = parts.groupBy("lid").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    every = F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda k: F.coalesce(F.element_at("words", k), F.lit(0).cast("long")))
    whole = whole.select("lid", "size", every.alias("fine"))
    own = some.select("lid", *[F.col("bands")[k].alias(f"b{k}") for k in range(BANDS)])
    coarse = [functools.reduce(lambda x, y: x.bitwiseOR(y), [F.col("fine")[j] for j in range(k, FINE, COARSE)]).alias(f"c{k}") for k in range(COARSE)]
    with _wide_map(lines.sparkSession):
        sets = cut(whole.join(own, "lid").select("lid", F.struct("size", *coarse, "fine", *[f"b{k}" for k in range(BANDS)]).alias("sig")), "sets")
    out = cut(members.join(sets, "lid"), "bands")
    discard(sets)
    return out


def _open(differ: Column, jaccard: float) -> Column:
    """Whether ``differ`` bits that only one of the bitmaps of gp and gq has leave it open that the sets are alike enough.

    Each such bit stands for at least one shingle that only one line has. Of s shingles in all the lines then share at most
    (s - differ) / 2, so the similarity is at most (s - differ) / (s + differ). No pair at the threshold is lost.
    """
    return F.lit(1 + jaccard) * differ <= F.lit(1 - jaccard + SLACK) * (F.col("gp.size") + F.col("gq.size"))


def _coarse_differ() -> Column:
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"gp.c{k}").bitwiseXOR(F.col(f"gq.c{k}"))) for k in range(COARSE)])


def _fine_differ() -> Column:
    """Said over arrays, which keeps the join out of whole-stage code: in one method all the words are too much for the JVM to compile."""
    return F.aggregate(F.zip_with("gp.fine", "gq.fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def _first_meeting() -> Column:
    """Whether k is the first band that the two lines share: a pair is looked at once."""
    met = F.lit(False)
    for b in range(BANDS - 1):
        met |= (F.lit(b) < F.col("k")) & (F.col(f"gp.b{b}") == F.col(f"gq.b{b}"))
    return ~met


def _meet(one: DataFrame, other: DataFrame, on: list[str], condition: Column, jaccard: float) -> DataFrame:
    """Pairs (a, b), a < b, of lines of one band that meet ``condition`` and whose bitmaps do not rule them out."""
    left = one.withColumnsRenamed({"lid": "p", "sig": "gp"})
    right = other.withColumnsRenamed({"lid": "q", "sig": "gq"})
    met = left.join(right, on).where(condition & _open(_coarse_differ(), jaccard) & _open(_fine_differ(), jaccard))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def _confirmed(pairs: DataFrame, lines: DataFrame, jaccard: float) -> DataFrame:
    """The pairs whose sets of shingles are alike enough; only the texts of pairs that coarse bitmaps leave open are read into a shuffle."""
    lids = lambda df: df.select(F.col("a").alias("lid")).unionAll(df.select(F.col("b").alias("lid")))
    texts = lines.select("lid", "line")
    pairs = cut(pairs.distinct(), "pairs")
    with _wide_map(lines.sparkSession):
        bits = cut(_coarse(_only(texts, lids(pairs))), "bits")
    known = bits.select("lid", F.struct("size", *[f"c{k}" for k in range(COARSE)]).alias("g"))
    met = pairs.join(known.withColumnsRenamed({"lid": "a", "g": "gp"}), "a").join(known.withColumnsRenamed({"lid": "b", "g": "gq"}), "b")
    left = cut(met.where(_open(_coarse_differ(), jaccard)).select("a", "b"), "open")
    discard(pairs, bits)
    texts = cut(_only(texts, lids(left)), "texts")
    wide = texts.select("lid", F.encode("line", "UTF-32").alias("u"))
    both = left.join(wide.withColumnsRenamed({"lid": "a", "u": "ua"}), "a").join(wide.withColumnsRenamed({"lid": "b", "u": "ub"}), "b")
    named = both.select("a", "b", shingles(F.col("ua")).alias("sa"), shingles(F.col("ub")).alias("sb"))
    counted = named.select("a", "b", "sa", "sb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    # Repeats only add to the sizes, so a pair that is alike enough by them needs no union.
    most = F.size("sa") + F.size("sb") - F.col("common")
    whole = F.when(F.col("common") >= F.lit(jaccard) * most, most).otherwise(F.size(F.array_union("sa", "sb")))
    # Written before they are judged: a filter would be moved below and name the shingles again.
    compared = cut(counted.select("a", "b", "common", whole.alias("whole")), "compared")
    found = compared.where(F.col("common") >= F.lit(jaccard) * F.col("whole")).select("a", "b")
    discard(left, texts)
    return found


def _store_lines(placed: DataFrame, name: str) -> DataFrame:
    """The distinct lines (lid, line, bands) as a table bucketed by line: reading them for the exact check then needs no shuffle of their texts.

    All lines are signed the quick way first. Those that it leaves are read from the table and added once more with their bands.
    """
    spark = placed.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def store(lines: DataFrame, signed: DataFrame) -> None:
        rows = lines.join(signed, "lid").select("lid", "line", "bands", F.col("bands").isNotNull().alias("signed"))
        rows.write.format("parquet").mode("append").option("compression", "zstd").option("path", f"{scratch_dir(spark)}/gridquarry/{name}").partitionBy("signed").bucketBy(buckets, "lid").saveAsTable(name)

    distinct = placed.select("lid", "line").groupBy("lid").agg(F.first("line").alias("line"))
    with tidy(spark), _wide_map(spark):
        store(distinct, _quick_signatures(distinct))
        left = spark.table(name).where("not signed").select("lid", "line")
        store(left, signatures(left))
    return spark.table(name).where("signed").select("lid", "line", "bands")


def _shared_bands(lines: DataFrame) -> DataFrame:
    """Rows (lid, band, k, n) of the bands that n > 1 lines have; k is the band's number."""
    banded = lines.select("lid", F.posexplode("bands").alias("k", "band"))
    with _wide_map(lines.sparkSession):
        shared = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    out = cut(banded.join(shared, "band"), "members")
    discard(shared)
    return out


def _blocks(many: DataFrame, linked: DataFrame, jaccard: float) -> DataFrame:
    """Pairs of lines of large bands that no link joins yet: each line outside the band's largest component meets all of other components."""
    roots = cut(components(linked, "a", "b").withColumnRenamed("node", "lid"), "roots")
    rooted = cut(many.join(roots, "lid", "left").select("band", "k", "lid", "n", "sig", F.coalesce("root", "lid").alias("root")), "rooted")
    homes = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(F.max(F.struct("m", "root")).alias("h"))
    rooted = rooted.join(homes, "band").where("n > h.m")
    # At least 1, as filters on the blocks may run before the one above.
    outside = F.greatest(F.ceil((F.col("n") - F.col("h.m")) / BLOCK).cast("int"), F.lit(1))
    whole = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rooted.select("band", "k", "lid", "sig", "root", (F.col("root") == F.col("h.root")).alias("home"), outside.alias("outside"), whole.alias("whole"))
    own = lambda count: F.pmod(F.xxhash64("lid"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    one = dealt.where("not home").select("band", "k", "lid", "sig", "root", own("outside").alias("i"), each("whole").alias("j"))
    other = dealt.select("band", "lid", "sig", F.col("root").alias("_root"), "home", each("outside").alias("i"), own("whole").alias("j"))
    return _meet(one, other, ["band", "i", "j"], (F.col("_root") != F.col("root")) & (F.col("home") | (F.col("p") < F.col("q"))) & _first_meeting(), jaccard)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float = JACCARD) -> DataFrame:
    """Rows (id, row, pos, root): each line that is not blank and its component."""
    spark = docs.sparkSession
    placed = occurrences(docs, id_col, text_col).withColumn("lid", F.xxhash64("line"))
    name = f"gridquarry_lines_{uuid.uuid4().hex}"
    try:
        lines = _store_lines(placed, name)
        members = _shared_bands(lines)
        few = members.where(F.col("n") <= ALL_PAIRS).select("band", F.col("lid").alias("a"))
        pairs = few.join(few.withColumnRenamed("a", "b"), "band").where("a < b").select("a", "b")
        large = members.where(F.col("n") > ALL_PAIRS)
        if large.isEmpty():
            linked = _confirmed(pairs, lines, jaccard)
        else:
            sets = _with_sets(large, lines)
            many = sets.select("band", "lid", "sig")
            turn = F.xxhash64("lid", "band")
            hubs = many.groupBy("band").agg(F.min_by("lid", turn).alias("x"), F.max_by("lid", turn).alias("y"))
            hubs = many.join(hubs.select("band", F.explode(F.array("x", "y")).alias("lid")), ["band", "lid"])
            star = _meet(many, hubs, ["band"], F.col("p") != F.col("q"), jaccard)
            linked = _confirmed(pairs.unionAll(star), lines, jaccard)
            linked = linked.unionAll(_confirmed(_blocks(sets, linked, jaccard), lines, jaccard))
            discard(sets)
        roots = components(linked, "a", "b").withColumnRenamed("node", "lid")
        out = placed.select("id", "row", "pos", "lid").join(roots, "lid", "left").select("id", "row", "pos", F.coalesce("root", "lid").alias("root"))
        out = cut(out, "lines")
        discard(members)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, f"{scratch_dir(spark)}/gridquarry/{name}")
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float = JACCARD) -> DataFrame:
    """Rows (id, row, removed): for each document that loses lines, the places of the lines that go, ascending.

    Of a component the occurrence with the smallest (id, row, place) stays, null ids last. Blank lines belong to no component.
    """
    found = line_classes(docs, id_col, text_col, jaccard)
    place = F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("row"), F.col("pos"))
    first = found.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "first")
    gone = found.join(first, "root").withColumn("here", place).where("here <> first")
    return gone.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float = JACCARD) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text_col``; every row and column stays.

    Null texts stay null. Rows with one id and one text are treated as one document, so they lose the same lines.
    """
    gone = removed_lines(docs, id_col, text_col, jaccard).select(F.col("id").alias("_i"), F.col("row").alias("_r"), F.col("removed").alias("_gone"))
    text = F.col(f"_doc.`{text_col}`").cast("string")
    packed = docs.select(F.struct("*").alias("_doc"))
    joined = packed.join(gone, F.col(f"_doc.`{id_col}`").cast("long").eqNullSafe(F.col("_i")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_r")), "left")
    numbered = F.transform(F.split(text, "\n"), lambda x, k: F.when(F.array_contains("_gone", k), F.lit(None)).otherwise(x))
    kept = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(numbered, "\n"))
    return joined.select(*[kept.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (places of the lines that go, joined by commas)."""
    docs = table(spark, sf_dir, "documents")
    gone = removed_lines(docs).select(F.col("id").alias("_i"), F.col("row").alias("_r"), F.col("removed").alias("gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("row"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    found = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("row") == F.col("_r")), "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


def brute_force(docs: list[tuple[int | None, str | None]], jaccard: float = JACCARD) -> dict[int, list[int]]:
    """Places that go by document position, from comparing all pairs of lines; for tests on small fixtures with distinct ids."""
    places, lines, root = [], [], []
    for k, (i, t) in enumerate(docs):
        for pos, line in enumerate((t or "").split("\n")):
            line = line.strip(_EDGES)
            if line:
                places.append(((i is None, i, pos), k, pos))
                lines.append({line[j : j + SHINGLE] for j in range(max(1, len(line) - SHINGLE + 1))})
                root.append(len(root))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for x, a in enumerate(lines):
        for y in range(x):
            both = len(a & lines[y])
            if both and both >= jaccard * (len(a) + len(lines[y]) - both):
                root[find(x)] = find(y)
    first: dict[int, tuple] = {}
    for x, p in enumerate(places):
        first[find(x)] = min(first.get(find(x), p), p)
    out: dict[int, list[int]] = {}
    for x, p in enumerate(places):
        if first[find(x)] != p:
            out.setdefault(p[1], []).append(p[2])
    return out
