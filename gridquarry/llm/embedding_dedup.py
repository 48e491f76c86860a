"""Embedding near-dedup by product quantisation over coarse inverted lists.

Identical vectors are one class from the start. Each class lies in the list of its nearest coarse centroid, with the
codes of its residual's subspaces and the length of what the codes leave out. A class queries its ``PROBES`` nearest
lists: table lookups give the distance from the query to the coded vector, and the left-out length turns that into a
lower bound, so no link inside a probed list is lost before the exact cosine decides. Lists are cut into blocks; each
block counts its links and reports a spanning forest of them, so a dense group never emits all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.common import components, cut, table

COSINE = 0.95
#: Centroids and codes are fitted on at most this many vectors, those with the smallest hashes.
SAMPLE = 16_384
#: Vectors that a list should hold, the most lists, lists probed for a query, and the rows of a block's two sides.
PER_LIST, MOST_LISTS, PROBES = 200, 1024, 8
LIST_BLOCK, QUERY_BLOCK = 1024, 2048
SUBSPACES, CODES = 8, 256


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is divided by its largest component first, as squares of very small or large ones leave the range of doubles."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Coarse centroids and subspace codebooks, fitted on a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float):
        rng = np.random.default_rng(20)
        self.dim = sample.shape[1]
        # One vector speaks for a dense group, else the group's own neighbourhood would be split among many lists.
        fresh = np.ones(len(sample), bool)
        for a in range(0, len(sample), 1024):
            near = sample[a : a + 1024] @ sample[: a + 1024].T >= cosine
            fresh[a : a + 1024] &= ~np.tril(near, a - 1).any(1)
        spread = sample[fresh]
        self.centres = _means(spread, lists, 8, rng)
        width = -(-self.dim // SUBSPACES)
        self.edges = [(s, min(s + width, self.dim)) for s in range(0, self.dim, width)]
        left = spread - self.centres[_nearest(spread, self.centres)]
        self.books = [_means(left[:, a:b], CODES, 6, rng) for a, b in self.edges]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest lists, codes of the residual in the nearest, length that the codes leave out)."""
        score = x @ self.centres.T - 0.5 * (self.centres * self.centres).sum(1)
        probes = np.argsort(-score, 1, kind="stable")[:, :PROBES]
        left = x - self.centres[probes[:, 0]]
        codes = np.stack([_nearest(left[:, a:b], book) for (a, b), book in zip(self.edges, self.books, strict=True)], 1).astype(np.uint8)
        held = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1)
        return probes, codes, np.sqrt(((left - held) ** 2).sum(1))

    def distances(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Distances from queries to the coded vectors of list ``of``, from a table for each query and subspace."""
        left = queries - self.centres[of]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for k, ((a, b), book) in enumerate(zip(self.edges, self.books, strict=True)):
            part = left[:, a:b]
            lookup = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            total += lookup.astype(np.float32)[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 and links (a, b): the smallest node that each can reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


_MADE = "a long, b long, n long"


def link_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id.

    Vectors of one length link where the cosine in double precision is at least ``cosine``; each length has an index of its
    own. A vector that is null, empty, zero, or holds null or non-finite components links with nothing. Repeated rows and
    ids are vectors of their own; component_id ignores null ids unless there is no other.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("dim", F.when(sound, F.size("e")))
    out = rows.where("dim is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    # The lengths that occur, not the vectors, come to the driver.
    for r in rows.where("dim is not null").select("dim").distinct().orderBy("dim").collect():
        out = out.unionByName(_link_length(rows.where(F.col("dim") == r["dim"]).select("id", "e"), cosine))
    return out.withColumnRenamed("id", "vec_id")


def _link_length(sound_rows: DataFrame, cosine: float) -> DataFrame:
    """Rows (id, n_links, component_id) of sound vectors (id, e) of one length."""
    spark = sound_rows.sparkSession
    classes = cut(sound_rows.groupBy("e").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).withColumn("c", F.xxhash64("e")), "classes")
    total = classes.count()
    # At most SAMPLE vectors come to the driver.
    taken = classes.orderBy(F.xxhash64("c"), "c").limit(SAMPLE).select("e").toArrow()["e"].combine_chunks()
    sample = _unit(taken.flatten().to_numpy().reshape(len(taken), -1))
    lists = int(min(MOST_LISTS, max(1, -(-total // PER_LIST)), max(1, len(sample) // 8)))
    index = spark.sparkContext.broadcast(Index(sample, lists, cosine))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                e = batch["e"]
                x = _unit(e.flatten().to_numpy().reshape(batch.num_rows, -1))
                probes, codes, rest = index.value.encode(x)
                kept = [codes[k].tobytes() for k in range(len(codes))]
                yield pa.RecordBatch.from_arrays([batch["c"], batch["size"], e, pa.array(probes[:, 0].astype(np.int32)), pa.array(probes.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(kept, pa.binary()), pa.array(rest)], names=["c", "size", "e", "list", "probes", "codes", "rest"])

    placed = cut(classes.select("c", "size", "e").mapInArrow(place, "c long, size long, e array<double>, list int, probes array<int>, codes binary, rest double"), "placed")
    # One row per list, at most MOST_LISTS: into how many blocks its vectors and its queries are dealt.
    held = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("xs"))
    asked = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qs"))
    blocks = F.broadcast(held.join(asked, "list"))
    mark = lambda df, query: df.withColumn("query", F.lit(query)).select("list", "x", "q", "query", "c", "size", "e", F.col("own"), "probes", "codes", "rest")
    stored = placed.withColumn("own", F.col("list")).join(blocks, "list").withColumn("x", F.pmod(F.xxhash64("c", F.lit(1)), F.col("xs")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    queries = placed.withColumnRenamed("list", "own").withColumn("list", F.explode("probes")).join(blocks, "list").withColumn("q", F.pmod(F.xxhash64("c", F.lit(2)), F.col("qs")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    queries = queries.withColumn("codes", F.lit(None).cast("binary"))
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-4

    def search(table: pa.Table) -> pa.Table:
        ask = table["query"].to_numpy()
        empty = pa.table({k: pa.array([], pa.int64()) for k in "abn"})
        if ask.all() or not ask.any():
            return empty
        of = int(table["list"][0].as_py())
        c, size, own = table["c"].to_numpy(), table["size"].to_numpy(), table["own"].to_numpy()
        e = table["e"].combine_chunks()
        x = _unit(e.flatten().to_numpy().reshape(len(c), -1))
        probes = table["probes"].combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        theirs, mine = np.flatnonzero(~ask), np.flatnonzero(ask)
        codes = np.frombuffer(b"".join(table["codes"].take(pa.array(theirs)).to_pylist()), np.uint8).reshape(len(theirs), -1)
        reach = (radius + table["rest"].to_numpy()[theirs]).astype(np.float32)
        links_a, links_b = [], []
        for a in range(0, len(mine), 256):
            some = mine[a : a + 256]
            qa, xb = np.nonzero(index.value.distances(x[some], of, codes) <= reach)
            qa, xb = some[qa], theirs[xb]
            # A link that the stored vector's own query finds too counts in the block where the smaller class asks.
            both = (probes[xb] == own[qa][:, None]).any(1)
            once = (c[qa] != c[xb]) & (~both | (c[qa] < c[xb]))
            qa, xb = qa[once], xb[once]
            near = np.concatenate([(x[qa[k : k + 65536]] * x[xb[k : k + 65536]]).sum(1) for k in range(0, len(qa), 65536)]) >= cosine if len(qa) else np.zeros(0, bool)
            links_a.append(qa[near])
            links_b.append(xb[near])
        a, b = np.concatenate(links_a), np.concatenate(links_b)
        if not len(a):
            return empty
        names, node = np.unique(c, return_inverse=True)
        n = np.bincount(node[a], size[b], len(names)) + np.bincount(node[b], size[a], len(names))
        root = _forest(node[a], node[b], len(names))
        told = np.flatnonzero(n > 0)
        return pa.table({"a": names[told], "b": names[root[told]], "n": n[told].astype(np.int64)})

    both = mark(stored, False).unionByName(mark(queries, True))
    made = cut(both.groupBy("list", "x", "q").applyInArrow(search, _MADE), "links")
    counted = made.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "c")
    roots = components(made, "a", "b").select(F.col("node").alias("c"), "root")
    named = classes.select("e", "c", "least", "size").join(counted, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = cut(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "root").select("e", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    return sound_rows.join(of_class, "e").select("id", "n_links", "component_id")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_classes(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
