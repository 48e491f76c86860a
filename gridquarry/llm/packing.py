"""Best-fit packing of token pieces into sequences.

The lengths of the pieces form a histogram of at most ``capacity`` entries, whatever the size of the corpus. On it the
configuration linear program (fewest sequences, each length covered) is solved by multiplicative weights: the weight of
a length falls as it gets covered, and an unbounded knapsack over the weights prices the next configuration, of which a
whole number is taken, until every length is covered. Sequences with room left are packed anew by best fit decreasing; where
best fit alone needs fewer sequences it is taken. The plan then holds (length, rank range) -> sequence rows,
whose number depends on the histogram alone, and each piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.common import BUCKET_ROWS, cut, lean, prefix_sums, small_batches, table

CAPACITY = 2048
#: The share of a length's demand that one round of the multiplicative-weights solver covers at most, or one sequence where that is more.
STEP = 0.25
#: A round takes at most so many configurations, all worth at least this share of the best one.
COLUMNS, WORTH = 32, 0.999
#: Bytes of text that are tokenised at a time, and how many words, of how many bytes in all, a worker remembers. They bound the memory
#: of a worker, which an executor has beside its heap for every core.
SLICE_BYTES = 2 << 20
CACHE_WORDS, CACHE_BYTES = 800_000, 16 << 20
#: New words are encoded so many at a time, with a NUL as a word of its own between them.
JOINED, BETWEEN = 128, "\0"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _slices(text: pa.Array):
    """Ranges of rows with about SLICE_BYTES of text each."""
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space and never joins across it: each distinct word is encoded once.

    The words and their ids are remembered as flat arrays, without an object for each.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.ends = pa.array([], pa.string()), np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each of ``words``; where a NUL is one id that no other word can have, many are encoded as one text."""
        known: dict[str, np.ndarray] = {}
        plain = [w for w in words if BETWEEN not in w] if len(self.between) == 1 else []
        texts = [f" {BETWEEN} ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)]
        for k, e in enumerate(self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.between[0]).tolist(), len(ids)]
            begin = 0
            for w, end in zip(plain[k * JOINED : (k + 1) * JOINED], ends, strict=True):
                known[w] = ids[begin:end]
                begin = end + 1
        for w in words if not plain else [w for w in words if BETWEEN in w]:
            known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4")
        return [known[w] for w in words]

    def _learn(self, words: pa.Array) -> None:
        """Remember ``words``, none of which is known, after those that are."""
        flats, lens = [self.flat], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 4096):
            some = self._encoded(words.slice(k, 4096).to_pylist())
            flats.append(np.concatenate(some))
            lens.append(np.fromiter(map(len, some), np.int64, len(some)))
        self.flat = np.concatenate(flats)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(lens))])
        self.words = pa.concat_arrays([self.words.cast(words.type), words])

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids begin and end."""
        words = pc.ascii_split_whitespace(text)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        size = lambda some: pc.sum(pc.binary_length(some)).as_py() or 0
        place = pc.index_in(distinct, value_set=self.words.cast(distinct.type))
        fresh = distinct.filter(pc.is_null(place))
        if len(self.words) + len(fresh) > CACHE_WORDS or size(self.words) + size(fresh) > CACHE_BYTES:
            self._forget()
            place, fresh = pc.index_in(distinct, value_set=self.words.cast(distinct.type)), distinct
        at = place.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(fresh))
        if len(fresh):
            self._learn(fresh)
        which = at[coded.indices.to_numpy(zero_copy_only=False)]
        each = (self.ends[1:] - self.ends[:-1])[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = self.flat[np.repeat(self.ends[which] - ends[:-1], each) + np.arange(ends[-1])]
        return ids, ends[words.offsets.to_numpy() - words.offsets[0].as_py()]


@functools.cache
def encoder(path: str) -> WordTokens:
    """One for each worker process, so that what it remembers lasts over tasks."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): the ids of each text and then id 0, cut into pieces of ``capacity``.

    A null or empty text is the single id 0. Repeated rows and ids give pieces of their own; null ids stay null.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids, text = batch["i"], batch["t"]
            for a, b in _slices(text):
                flat, at = encode(text.slice(a, b - a))
                out = [[], [], [], [], []]
                for row in range(b - a):
                    tokens = np.append(flat[at[row] : at[row + 1]], np.uint32(0)).astype("<u4")
                    name = ids[a + row].as_py()
                    for k, start in enumerate(range(0, len(tokens), capacity)):
                        piece = tokens[start : start + capacity]
                        for column, value in zip(out, (name, k, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(lean(run), _PIECES)


def price(value: np.ndarray, capacity: int) -> list[list[int]]:
    """The lengths of the configurations of greatest value, the best first: knapsacks of ``capacity`` over lengths with value[length] > 0."""
    best = np.zeros(capacity + 1)
    sums = np.empty(capacity + 1)
    for c in range(capacity):
        if best[c + 1] < best[c]:
            best[c + 1] = best[c]
        part = np.add(value[1 : capacity + 1 - c], best[c], out=sums[: capacity - c])
        np.maximum(best[c + 1 :], part, out=best[c + 1 :])
    # The value of the best configuration with each length.
    lengths = np.flatnonzero(value > 0)
    total = value[lengths] + best[capacity - lengths]
    order = np.argsort(-total, kind="stable")[:COLUMNS]
    made = []
    for k in order[total[order] >= WORTH * total[order[0]]]:
        one = [int(lengths[k])]
        c = capacity - one[0]
        while best[c] > 0:
            part = value[1 : c + 1] + best[c - 1 :: -1][:c] if c else sums[:0]
            part = np.where(value[1 : c + 1] > 0, part, -1)
            length = int(part.argmax()) + 1
            one.append(length)
            c -= length
        made.append(one)
    return made


def fill(made: list[int], left: np.ndarray, capacity: int) -> dict[int, int]:
    """``made`` as far as the demand that is left holds it, and the longest lengths that fit into the rest."""
    out: dict[int, int] = {}
    free = capacity
    for length in made:
        if out.get(length, 0) < left[length]:
            out[length] = out.get(length, 0) + 1
            free -= length
    while free:
        spare = left[: free + 1] > 0
        for length, n in out.items():
            if length <= free and left[length] <= n:
                spare[length] = False
        fits = np.flatnonzero(spare)
        if not len(fits):
            break
        length = int(fits[-1])
        out[length] = out.get(length, 0) + 1
        free -= length
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None, step: float = STEP) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences) that hold the histogram exactly; ``rounds`` ends the program early."""
    demand = np.zeros(capacity + 1)
    for length, n in histogram.items():
        demand[length] = n
    # A piece of full length fills a sequence by itself.
    plan = [([capacity], int(demand[capacity]))] if demand[capacity] else []
    demand[capacity] = 0
    chosen, left = cover(demand, capacity, rounds, step)
    full, again = [], left
    for made, times in chosen.items():
        if sum(k * n for k, n in made) == capacity:
            full.append(([k for k, n in made for _ in range(n)], times))
        else:
            for k, n in made:
                again[k] += n * times
    # Sequences that the program leaves with room are packed anew, and the program has to be as good as best fit alone.
    plans = [full + best_fit(again.astype(np.int64), capacity), best_fit(demand.astype(np.int64), capacity)]
    return plan + min(plans, key=lambda plan: sum(times for _, times in plan))


def cover(demand: np.ndarray, capacity: int, rounds: int | None = None, step: float = STEP) -> tuple[dict[tuple, int], np.ndarray]:
    """Configurations ((length, count), ...) with whole multiples, and the demand that they leave: none unless ``rounds`` ends the program early.

    A length's weight falls as it gets covered and is gone once it is, and each round takes a whole number of the
    configurations that the weights price highest. So each round places pieces, and nothing is left to round.
    """
    left, chosen = demand.copy(), {}
    size = np.arange(capacity + 1) / capacity
    done = 0
    while left.any() and (rounds is None or done < rounds):
        live = left > 0
        weight = np.zeros(capacity + 1)
        weight[live] = size[live] * np.exp(left[live] / demand[live] - 1)
        for column in price(weight, capacity):
            if not left[column[0]]:
                continue
            made = fill(column, left, capacity)
            times = int(max(1, min(min(step * demand[k], left[k]) // n for k, n in made.items())))
            key = tuple(sorted(made.items(), reverse=True))
            chosen[key] = chosen.get(key, 0) + times
            for k, n in made.items():
                left[k] -= n * times
        done += 1
    return chosen, left


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing on counts: sequences that look alike are held as one entry (lengths, count) by free space."""
    room: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            free = min((f for f in room if f >= length), default=None)
            if free is None:
                per = capacity // length
                if n >= per:
                    room.setdefault(capacity - per * length, []).append(([length] * per, n // per))
                    n %= per
                else:
                    room.setdefault(capacity - n * length, []).append(([length] * n, 1))
                    n = 0
                continue
            made, times = room[free].pop()
            if not room[free]:
                del room[free]
            used = min(n, times)
            if times > used:
                room.setdefault(free, []).append((made, times - used))
            room.setdefault(free - length, []).append(([*made, length], used))
            n -= used
    return [x for same in room.values() for x in same]


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset. Needs columns doc_id, piece, length, ids_crc32; lengths are 1 to ``capacity``."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, base, rank = [], 0, dict.fromkeys(histogram, 0)
    for made, times in solve(histogram, capacity, rounds):
        offset = 0
        for length in made:
            slots.append((length, rank[length], rank[length] + times, base - rank[length], offset))
            rank[length] += times
            offset += length
        base += times
    # The number of slots depends on the histogram's entries, not on the pieces.
    plan = spark.createDataFrame(slots, "length long, lo long, hi long, shift long, offset long")
    buckets = max(1, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("start")]
    ranked = prefix_sums(pieces, ["length"], order, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)), F.lit(1), "rank")
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= lo and rank < hi")
    return placed.withColumn("sequence_id", F.col("rank") + F.col("shift")).drop("rank", "lo", "hi", "shift")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece (doc_id, piece, start, length, ids_crc32, sequence_id, offset); an empty table gives no rows."""
    with small_batches(docs.sparkSession):
        pieces = cut(token_pieces(docs, id_col, text_col, capacity, tokenizer), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
