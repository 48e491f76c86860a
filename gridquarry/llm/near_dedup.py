"""MinHash near-dedup by a chosen-path set similarity join.

Documents with one shingle set are one class from the start. In each of ``TREES`` independent trees a class follows the
path of the tokens that its set selects minwise, level by level; classes on one path are a node. Large nodes branch on,
one level at a time; small ones are compared exhaustively by byte sketches. What is alike there is confirmed on the full
sets, in two rounds: first each class with the partner that looks closest, then what is still in different components:
a spanning forest of the pairs of a node that its sets show to be alike, and every pair that sketches leave open.
Nodes that stay large at the last level are dense groups: they are compared in chunks and with a pivot, and classes that
the pivot's component does not hold meet each other and all chunks in blocks, each pair once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.common import components, cut, lean, small_batches, table
from gridquarry.llm.repeats import K1, K3, bitmap, cells_of, filter_bits, finish, may_repeat, pair, slices

TREES, FIRST, LEVELS = 10, 2, 6
#: Rows that are compared exhaustively at a time.
NODE = 256
#: Of TREES * LEVELS sketch bytes, the share that must agree before sets are compared; 4 standard deviations below the threshold.
SLACK = 4.0
#: In the second round a set of at most FULL shingles is there whole, as 32-bit names; a larger one as BINS bytes, the smallest name of each bin.
FULL, BINS = 512, 2048
_SEEDS = finish(np.arange(1, TREES * LEVELS + 1, dtype=np.uint64) * K1)
SHINGLES, PERCENT = 5, 80


def shingle_sets(text: pa.Array, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(names of the distinct shingles, text by text and sorted; where each text's begin and end).

    Shingles are runs of ``k`` words; a text of fewer words, but at least one, is one shingle of all its words.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    at = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(real).dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    words = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
    names = words
    for step in range(1, k):
        names = pair(names[:-1], words[step:]) if len(names) > 1 else names[:0]
    names = finish(names)
    out, ends = [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            mine = np.unique(names[a : b - k + 1])
        elif b > a:
            whole = words[a]
            for w in words[a + 1 : b]:
                whole = pair(np.array([whole]), np.array([w]))[0]
            mine = finish(np.array([whole * K3 + np.uint64(b - a)]))
        else:
            mine = words[:0]
        out.append(mine)
        ends.append(ends[-1] + len(mine))
    return (np.concatenate(out) if out else words[:0]), np.array(ends)


def _signatures(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minwise values of each non-empty set, one for each seed."""
    begins = at[:-1][at[1:] > at[:-1]]
    out = np.empty((len(begins), len(_SEEDS)), np.uint32)
    for k, seed in enumerate(_SEEDS):
        mixed = (names ^ seed) * K3
        out[:, k] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), begins) >> np.uint64(32) if len(begins) else 0
    return out


def _binned(short: np.ndarray) -> np.ndarray:
    """BINS bytes for one set of sorted 32-bit names: of those that share their highest bits the first, 0 where there is none."""
    out, shift = np.zeros(BINS, np.uint8), 32 - (BINS.bit_length() - 1)
    cell, first = np.unique(short >> np.uint32(shift), return_index=True)
    out[cell] = 1 + (short[first] & np.uint32((1 << shift) - 1)) % np.uint32(255)
    return out


_SETS = "id long, row long, n long, c long, c2 long, signature binary"
_PATHS = "path long, level int, tree int, c long, n long, signature binary"


def sets_of(docs: DataFrame, id_col: str, text_col: str, k: int, lower: bool) -> DataFrame:
    """One row per document: size and name of its set, and its minwise signature."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch["t"]):
                names, at = shingle_sets(batch["t"].slice(a, b - a), k, lower)
                n = np.diff(at)
                full = np.flatnonzero(n > 0)
                c1, c2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                if len(full):
                    c1[full] = finish(np.add.reduceat(names, at[:-1][full]) + n[full].astype(np.uint64))
                    c2[full] = np.add.reduceat(finish(names * K3), at[:-1][full])
                signed = np.empty(b - a, object)
                signed[full] = [s.tobytes() for s in _signatures(names, at)]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), batch["row"].slice(a, b - a), pa.array(n), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(signed.tolist(), pa.binary())], names=["id", "row", "n", "c", "c2", "signature"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("t"))
    with small_batches(docs.sparkSession):
        return cut(rows.mapInArrow(lean(run), _SETS), "sets")


def _step(path: np.ndarray, value: np.ndarray) -> np.ndarray:
    return finish(pair(path, value.astype(np.uint64) * K1))


def first_paths(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signed = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            sketch = pa.array([s.tobytes() for s in signed], pa.binary())
            for tree in range(TREES):
                path = np.full(batch.num_rows, tree, np.uint64)
                for level in range(FIRST):
                    path = _step(path, signed[:, tree * LEVELS + level])
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(np.full(batch.num_rows, FIRST, np.int32)), pa.array(np.full(batch.num_rows, tree, np.int32)), batch["c"], batch["n"], sketch], names=["path", "level", "tree", "c", "n", "signature"])

    return classes.select("c", "n", "signature").mapInArrow(lean(run), _PATHS)


def branch(paths: DataFrame) -> DataFrame:
    """The same rows one level further down."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                signed = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                level, tree = batch["level"].to_numpy(), batch["tree"].to_numpy()
                path = _step(batch["path"].to_numpy().view(np.uint64), signed[np.arange(len(signed)), tree * LEVELS + level])
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(level + np.int32(1), pa.int32()), *(batch[k] for k in ("tree", "c", "n", "signature"))], names=["path", "level", "tree", "c", "n", "signature"])

    return paths.mapInArrow(lean(run), _PATHS)


def tree_nodes(classes: DataFrame, node: int) -> DataFrame:
    """Rows (path, chunk, c, n, signature, pivot): nodes of at most about ``node`` rows, or chunks of dense nodes, in which ``pivot`` rows stand in every chunk.

    Rows alone in their node are left out. Frequencies of paths are pre-aggregated and only the large ones go on.
    """
    done, live = [], first_paths(classes)
    for level in range(FIRST, LEVELS + 1):
        live = cut(live, "paths")
        sizes = live.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("least")).where("rows > 1")
        sized = cut(live.join(sizes, "path"), "nodes")
        done.append(sized.where(F.col("rows") <= node).select("path", F.lit(0).alias("chunk"), "c", "n", "signature", F.lit(False).alias("pivot"), F.lit(False).alias("dense")))
        large = sized.where(F.col("rows") > node)
        if level == LEVELS or large.isEmpty():
            break
        live = branch(large.drop("rows", "least"))
    chunks = F.ceil(F.col("rows") / node).cast("int")
    own = F.pmod(F.xxhash64("c", "path"), chunks).cast("int")
    where = F.when(F.col("c") == F.col("least"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))
    dense = large.where(F.lit(level == LEVELS)).select("path", F.explode(where).alias("chunk"), "c", "n", "signature", (F.col("c") == F.col("least")).alias("pivot"), F.lit(True).alias("dense"))
    out = done[0]
    for more in [*done[1:], dense]:
        out = out.unionByName(more)
    return cut(out, "tree")


def _alike(sketch: np.ndarray, n: np.ndarray, a: slice, least: int, percent: int) -> np.ndarray:
    """How many sketch bytes of rows ``a`` agree with each row, 0 where the sets cannot reach the threshold."""
    agree = (sketch[a, None, :] == sketch[None, :, :]).sum(2, dtype=np.int32)
    small, large = np.minimum(n[a, None], n), np.maximum(n[a, None], n)
    return np.where((agree >= least) & (100 * small >= percent * large), agree, 0)


def _close(binned: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the binned sketches leave it open that pairs reach the threshold, SLACK standard deviations down.

    The bins in use are a sample without replacement of the union, so where they hold nearly all of it little is left open.
    """
    p, out = percent / 100, np.zeros(len(i), bool)
    for k in range(0, len(i), 8192):
        x, y = binned[i[k : k + 8192]], binned[j[k : k + 8192]]
        used = ((x != 0) | (y != 0)).sum(1)
        same = ((x == y) & (x != 0)).sum(1)
        union = np.maximum((n[i[k : k + 8192]] + n[j[k : k + 8192]]) / (1 + p), used)
        spread = np.sqrt(p * (1 - p) / np.maximum(used, 1) * (1 - used / (union + 1)))
        out[k : k + 8192] = same >= used * (p - SLACK * spread) - 1
    return out


def _closest_pairs(least: int, percent: int):
    """Each row of a node with its closest partner."""

    def run(table: pa.Table) -> pa.Table:
        c, n = table["c"].to_numpy(), table["n"].to_numpy()
        _, first = np.unique(c, return_index=True)
        c, n = c[first], n[first]
        sketch = np.frombuffer(b"".join(table["signature"].take(pa.array(first)).to_pylist()), np.uint32).reshape(len(c), -1).astype(np.uint8)
        out = []
        for k in range(0, len(c), 64):
            agree = _alike(sketch, n, slice(k, k + 64), least, percent)
            agree[c[k : k + 64, None] == c] = 0
            j = agree.argmax(1)
            i = np.flatnonzero(agree[np.arange(len(j)), j] > 0)
            out.append((c[i + k], c[j[i]], agree[i, j[i]]))
        a, b, agree = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "agree": agree.astype(np.int32)})

    return run


def _shared(short: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many names the sets of each pair share; ``i`` is sorted."""
    out = np.zeros(len(i), np.int64)
    rows, begins = np.unique(i, return_index=True)
    for x, a, b in zip(rows, begins, [*begins, len(i)][1:], strict=True):
        others = [short[y] for y in j[a:b]]
        names = np.concatenate(others)
        at = np.minimum(np.searchsorted(short[x], names), len(short[x]) - 1)
        out[a:b] = np.add.reduceat(short[x][at] == names, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
    return out


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the links (x, y) join what those before them leave apart."""
    up: dict[int, int] = {}

    def find(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = k = up[up[k]]
        return k

    out = np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            up[a], out[k] = b, True
    return out


def _open_pairs(least: int, percent: int, forest: bool):
    """Pairs (a, b, sure) of a block that are in different components and may be alike.

    Sure ones are alike by the names of their whole sets; with ``forest``, of these only a spanning forest is returned.
    Where g and h differ, only pairs of different sides are looked at.
    """

    def run(table: pa.Table) -> pa.Table:
        c, n = table["c"].to_numpy(), table["n"].to_numpy()
        sketch = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(len(c), -1).astype(np.uint8)
        root, side, held = table["root"].to_numpy(), table["side"].to_numpy(), table["held"].to_pylist()
        within, whole = table["g"][0] == table["h"][0], n <= FULL
        found = []
        for k in range(0, len(c), 64):
            a = slice(k, k + 64)
            agree = _alike(sketch, n, a, least, percent)
            agree[root[a, None] == root] = 0
            if within:
                agree[c[a, None] >= c] = 0
            else:
                agree[(side[a, None] != 0) | (side == 0)] = 0
            i, j = np.nonzero(agree)
            found.append((i + k, j))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        exact = whole[i] & whole[j]
        short = [np.frombuffer(x, np.uint32) if w else None for x, w in zip(held, whole, strict=True)]
        both = _shared(short, i[exact], j[exact])
        # A set whose names coincide in 32 bits has fewer of them; a pair that this may hide stays open.
        lost = n - np.array([n[k] if x is None else len(x) for k, x in enumerate(short)])
        total, hidden = n[i[exact]] + n[j[exact]], np.minimum(lost[i[exact]], lost[j[exact]])
        alike = 100 * both >= percent * (total - both)
        unclear = ~alike & (100 * (both + hidden) >= percent * (total - both - hidden))
        si, sj = i[exact][alike], j[exact][alike]
        if forest:
            keep = _forest(root[si], root[sj])
            si, sj = si[keep], sj[keep]
        ui, uj, i, j = i[exact][unclear], j[exact][unclear], i[~exact], j[~exact]
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        binned = np.array([_binned(short[x]) if whole[x] else np.frombuffer(held[x], np.uint8) for x in used], np.uint8).reshape(-1, BINS)
        near = _close(binned, n[used], place[: len(i)], place[len(i) :], percent)
        x, y = c[np.concatenate([si, ui, i[near]])], c[np.concatenate([sj, uj, j[near]])]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "sure": np.arange(len(x)) < len(si)})

    return run


def _blocks(placed: DataFrame, node: int) -> DataFrame:
    """Rows (path, g, h, side, c, n, signature, root) of the blocks in which pairs meet that may still be apart.

    A node that is not dense is one block. In a dense one the rows outside the pivot's component are dealt over
    ``among`` groups, which meet each other and each chunk of the rest: a block has about 2 * ``node`` rows at most
    and each pair one block.
    """
    per = placed.where("pivot").groupBy("path").agg(F.min("root").alias("home"), (F.max("chunk") + 1).alias("chunks"))
    # A pivot stands in every chunk; here it needs one place, and its own pairs are already decided.
    rows = placed.where("not pivot").join(per, "path", "left").withColumn("outside", F.col("dense") & (F.col("root") != F.col("home")))
    few = rows.where("outside").groupBy("path").agg(F.ceil(F.count(F.lit(1)) / node).cast("int").alias("among"))
    rows = rows.join(few, "path", "left").where("not dense or among is not null")
    own = F.pmod(F.xxhash64("path", "c"), F.col("among")).cast("int")
    rows = rows.withColumn("own", F.when(F.col("outside"), own).otherwise(F.col("among") + F.col("chunk")))
    last = F.col("among") - 1 + F.when(F.col("outside"), F.col("chunks")).otherwise(0)
    rows = rows.withColumn("k", F.explode(F.when(F.col("dense"), F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))))
    own = F.when(F.col("dense"), F.col("own")).otherwise(0)
    return rows.select("path", F.least(own, "k").alias("g"), F.greatest(own, "k").alias("h"), (own > F.col("k")).cast("int").alias("side"), "c", "n", "signature", "root")


def _texts_of(docs: DataFrame, one: DataFrame, text_col: str) -> DataFrame:
    """(c, t) for rows (c, row): a Bloom filter of bounded size keeps other documents' texts out of the shuffle."""
    bits = filter_bits(one.count())
    high, low = cells_of(F.col("row"), bits)
    cells = one.select(F.explode(F.array(F.struct(F.lit(0).alias("j"), high.alias("cell")), F.struct(F.lit(1).alias("j"), low.alias("cell")))).alias("x")).select("x.*")
    flags = docs.sparkSession.sparkContext.broadcast(bitmap(cells, bits))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_repeat(flags.value, bits, batch["row"].to_numpy().view(np.uint64))))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.select(F.xxhash64(text).alias("row"), text.alias("t")).mapInArrow(lean(run), "row long, t string")
    return some.join(one, "row").select("c", "t")


def _again(wanted: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str, k: int, lower: bool, held, what: str) -> DataFrame:
    """(c, s) for the classes ``wanted``: their texts are read and shingled again, and ``held`` makes the bytes s of a set's names."""
    one = cut(rows.groupBy("c").agg(F.min("row").alias("row")).join(wanted, "c"), "wanted")
    texts = _texts_of(docs, one, text_col)

    def shingle(batches):
        for batch in batches:
            for a, b in slices(batch["t"]):
                names, at = shingle_sets(batch["t"].slice(a, b - a), k, lower)
                yield pa.RecordBatch.from_arrays([batch["c"].slice(a, b - a), pa.array([held(names[x:y]).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["c", "s"])

    # Copies of a class's text give its set again.
    with small_batches(docs.sparkSession):
        return cut(texts.mapInArrow(lean(shingle), "c long, s binary").dropDuplicates(["c"]), what)


def _held(names: np.ndarray) -> np.ndarray:
    short = np.unique((names >> np.uint64(32)).astype(np.uint32))
    return short if len(names) <= FULL else _binned(short)


def confirm(pairs: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str, k: int, lower: bool, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach ``percent`` percent."""
    pairs = cut(pairs.select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("c")).unionAll(pairs.select(F.col("b").alias("c"))).distinct()
    full = _again(wanted, docs, rows, text_col, k, lower, lambda names: names, "full")
    sides = pairs.join(full.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")

    def compare(batches):
        for batch in batches:
            keep = []
            for sa, sb in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with small_batches(docs.sparkSession):
        return cut(sides.select("a", "b", "sa", "sb").mapInArrow(lean(compare), "a long, b long"), "linked")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLES, percent: int = PERCENT, lower: bool = True, node: int = NODE) -> DataFrame:
    """One row per input row: id, row (a hash of the text), n (size of its set), component_id.

    Documents link where 100 * intersection >= ``percent`` * union of their sets. A null or wordless text has an empty
    set and links with nothing: its component is its own id. Equal sets are linked whatever their ids. component_id is
    the smallest id that a row can reach; null ids count only where there is no other. Repeated rows are rows of their own.
    """
    rows = sets_of(docs, id_col, text_col, shingle, lower)
    full = rows.where("n > 0").withColumn("c", F.xxhash64("c", "c2", "n"))
    classes = full.groupBy("c").agg(F.min("n").alias("n"), F.min("signature").alias("signature"))
    bytes_ = TREES * LEVELS
    p = percent / 100
    least = int(np.floor(bytes_ * p - SLACK * np.sqrt(bytes_ * p * (1 - p))))
    classes = cut(classes, "classes")
    nodes = tree_nodes(classes, node)
    grouped = nodes.groupBy("path", "chunk").applyInArrow(_closest_pairs(least, percent), "a long, b long, agree int")
    closest = grouped.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))
    anchors = nodes.where("pivot").select("path", F.col("c").alias("p")).distinct()
    with_pivot = nodes.where("dense and not pivot").select("path", "c").join(anchors, "path").select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b"))
    linked = confirm(closest.unionByName(with_pivot), docs, full, text_col, shingle, lower, percent)
    roots = cut(components(linked, "a", "b"), "roots")
    # Second round: whatever may be alike and is still apart. Blocks that lie within one component have nothing left to find.
    placed = nodes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    mixed = cut(_blocks(placed, node), "mixed")
    block = ["path", "g", "h"]
    open_ = mixed.groupBy(*block).agg(F.min("root").alias("_x"), F.max("root").alias("_y")).where("_x <> _y").select(*block)
    rest = cut(mixed.join(open_, block), "open")
    sets = _again(rest.select("c").distinct(), docs, full, text_col, shingle, lower, _held, "held")
    blocks = rest.join(sets.withColumnRenamed("s", "held"), "c").groupBy(*block)
    late = cut(blocks.applyInArrow(_open_pairs(least, percent, True), "a long, b long, sure boolean"), "late")
    more = confirm(late, docs, full, text_col, shingle, lower, percent)
    if not late.where("sure").join(more, ["a", "b"], "left_anti").isEmpty():
        # Names of 32 bits misled a forest: every pair that it stood for is confirmed by itself.
        late = blocks.applyInArrow(_open_pairs(least, percent, False), "a long, b long, sure boolean")
        more = confirm(late, docs, full, text_col, shingle, lower, percent)
    roots = components(linked.unionByName(more), "a", "b")
    named = full.select("id", "row", "n", "c").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = cut(named, "named")
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    out = named.join(smallest, "root").select("id", "row", "n", "component_id")
    return out.unionByName(rows.where("n = 0").select("id", "row", "n", F.col("id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, once each; every column is kept."""
    stay = near_classes(docs, id_col, text_col, **how).where("id <=> component_id").select(F.col("id").alias("_id"), F.col("row").alias("_row")).distinct()
    text = F.xxhash64(F.coalesce(F.col(f"_doc.`{text_col}`").cast("string"), F.lit("")))
    packed = docs.select(F.struct("*").alias("_doc"))
    return packed.join(stay, F.col(f"_doc.`{id_col}`").cast("long").eqNullSafe(F.col("_id")) & (text == F.col("_row")), "left_semi").select("_doc.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
pieces AS (
  SELECT DISTINCT r, md5(array_to_string(w[k : k + 2], ' ')) AS s FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS k FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM pieces GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM pieces a JOIN pieces b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT r, r AS z FROM docs UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.z)
SELECT docs.doc_id, coalesce(any_value(sizes.n), 0)::bigint AS n_shingles, min(other.doc_id) AS component_id, docs.doc_id = min(other.doc_id) AS kept
FROM docs JOIN reach ON reach.r = docs.r JOIN docs other ON other.r = reach.z LEFT JOIN sizes ON sizes.r = docs.r
GROUP BY docs.r, docs.doc_id
"""


def brute_force(docs: list[tuple[int | None, str | None]], shingle: int, percent: int) -> list[tuple]:
    """(id, size of the set, component) by comparing all pairs, for tests on small fixtures."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups: dict[int, list] = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(find(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in groups[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(docs)]


