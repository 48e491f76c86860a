"""Windows of symbols that also start in a document with a smaller id, over whole corpora.

Symbols are bytes or words. A window of ``size`` symbols belongs to the block of the smallest name among its grams of
``gram`` symbols, so equal windows fall into blocks of equal name, and a name that occurs once cannot hold a repeated
window. Only blocks whose names may repeat are sent to a shuffle on the name, where windows are compared; blocks with a
name so frequent that one task should not hold them go window by window through a pre-aggregated minimum instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm.common import cut

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
#: Symbols handled at a time, names with more blocks than this are hot, and the most bits of one row of a filter.
SLICE, HOT_BLOCKS, MOST_BITS = 1 << 18, 1 << 16, 29
#: Bits of one row of the filter that marks hot names. A name that is marked without being hot only takes the other way.
HOT_BITS = 22
_CHUNK = 16


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two neighbouring names."""
    b = b * K2
    return a * K1 + ((b << np.uint64(31)) | (b >> np.uint64(33)))


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * K3
    return h ^ (h >> np.uint64(29))


def doubled(names: np.ndarray, length: int) -> np.ndarray:
    """Names of all runs of ``length`` symbols by prefix doubling: names of 2, 4, 8 … symbols from pairs at growing offsets."""
    span = 1
    while span < length:
        step = min(span, length - span)
        if len(names) <= step:
            return names[:0]
        names = pair(names[:-step], names[step:])
        span += step
    return names


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


@dataclass
class Blocks:
    """Runs of windows of one document that share their smallest gram: name, document, first window, windows."""

    name: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray


def blocks(names: np.ndarray, at: np.ndarray, size: int, gram: int) -> Blocks:
    """``at``: where each document's symbols begin and end in ``names``; starts are counted in the concatenation."""
    none = np.zeros(0, np.int64)
    if len(names) < size:
        return Blocks(none.astype(np.uint64), none, none, none)
    least = sliding_min(doubled(names, gram), size - gram + 1)
    lens = np.diff(at)
    rows = np.flatnonzero(lens >= size)
    edge = np.zeros(len(least) + 1, np.int8)
    edge[at[rows]] = 1
    edge[at[rows] + lens[rows] - size + 1] = -1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    head = np.empty(len(least), bool)
    head[0] = True
    head[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    head &= inside
    start = np.flatnonzero(head)
    windows = np.flatnonzero(inside)
    first = np.searchsorted(windows, start)
    count = np.diff(np.append(first, len(windows)))
    return Blocks(finish(least[start]), np.searchsorted(at, start, "right") - 1, start, count)


#: What a kind of symbol needs: names and offsets of a slice of texts, and the bytes from which a block's windows are named again.
Names = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, object]]


def slices(text: pa.Array) -> Iterable[tuple[int, int]]:
    import pyarrow.compute as pc

    part = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)) // (SLICE * 8)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, t): ``row`` tells documents of one id apart by their text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("t"))


def block_names(rows: DataFrame, names: Names, size: int, gram: int) -> DataFrame:
    """One row (h) for each block of the corpus; documents without an id take no part."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch["t"]):
                symbols, at, _ = names(batch["t"].slice(a, b - a))
                found = blocks(symbols, at, size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(found.name.view(np.int64))], names=["h"])

    return rows.where("id is not null").select("t").mapInArrow(run, "h long")


def cells_of(h, bits: int):
    """Two filter cells of a name: its highest and its lowest bits."""
    return F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND(F.lit((1 << bits) - 1))


def bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """Two rows of 2^bits bits from rows (j, cell) to be set; at most 2^(MOST_BITS - 2) bytes come to the driver."""
    chunk = min(_CHUNK, bits)

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << chunk, bool)
        flags[table["cell"].to_numpy() & ((1 << chunk) - 1)] = True
        return pa.table({"j": table["j"].slice(0, 1).cast(pa.int32()), "part": pa.array([int(table["cell"][0].as_py()) >> chunk]), "data": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    packed = cells.distinct().groupBy("j", F.shiftright("cell", chunk).alias("part")).applyInArrow(pack, "j int, part long, data binary")
    out = np.zeros((2, max(1, (1 << bits) // 8)), np.uint8)
    width = max(1, (1 << chunk) // 8)
    for r in packed.collect():
        out[r["j"], r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["data"], np.uint8)
    return out


def may_repeat(filter_bits: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    high, low = h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)
    test = lambda row, c: (row[c >> np.uint64(3)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8))) & 1
    return (test(filter_bits[0], high) & test(filter_bits[1], low)).astype(bool)


_SENT = "hot boolean, h long, w long, id long, row long, start int, n int, data binary"


def repeated_blocks(rows: DataFrame, names: Names, payload, windows, size: int, gram: int, bits: int, set_bits: np.ndarray, hot: np.ndarray) -> DataFrame:
    """The blocks whose names may repeat, with what their windows are named from; hot ones window by window (h, w: the window's two names)."""
    shared = rows.sparkSession.sparkContext.broadcast((set_bits, hot))

    def run(batches):
        flags, frequent = shared.value
        for batch in batches:
            ids, keys = batch["id"].to_numpy(), batch["row"].to_numpy()
            for a, b in slices(batch["t"]):
                symbols, at, raw = names(batch["t"].slice(a, b - a))
                found = blocks(symbols, at, size, gram)
                for pick in np.array_split(np.flatnonzero(may_repeat(flags, bits, found.name)), max(1, len(found.name) // 65536)):
                    if not len(pick):
                        continue
                    name, row, start, count = found.name[pick].view(np.int64), found.row[pick], found.start[pick], found.count[pick]
                    data = payload(raw, symbols, start, count)
                    many = may_repeat(frequent, HOT_BITS, found.name[pick])
                    few = ~many
                    zeros = np.zeros(int(few.sum()), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(zeros.astype(bool)), pa.array(name[few]), pa.array(zeros), pa.array(ids[a + row[few]]), pa.array(keys[a + row[few]]), pa.array((start - at[row])[few].astype(np.int32)), pa.array(count[few].astype(np.int32)), pa.array([data[k] for k in np.flatnonzero(few)], pa.binary())], names=_NAMES)
                    if many.any():
                        w1, w2 = windows([data[k] for k in np.flatnonzero(many)], count[many])
                        each = np.repeat(np.flatnonzero(many), count[many])
                        step = np.arange(len(each)) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
                        r = row[each]
                        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(each), bool)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(ids[a + r]), pa.array(keys[a + r]), pa.array((start[each] - at[r] + step).astype(np.int32)), pa.array(np.ones(len(each), np.int32)), pa.nulls(len(each), pa.binary())], names=_NAMES)

    return rows.where("id is not null").mapInArrow(run, _SENT)


_NAMES = [x.split()[0] for x in _SENT.split(", ")]
_SPANS = "id long, row long, lo int, hi int"


def _spans(ids, rows, starts, size: int) -> pa.RecordBatch:
    """Runs of neighbouring windows of a document as spans of symbols."""
    order = np.lexsort((starts, rows, ids))
    ids, rows, starts = ids[order], rows[order], starts[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + size)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(ids)) - 1
    return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(rows[head]), pa.array(starts[head].astype(np.int32)), pa.array((starts[tail] + size).astype(np.int32))] if len(ids) else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=["id", "row", "lo", "hi"])


def covered_spans(sent: DataFrame, windows, size: int, hot: bool) -> DataFrame:
    """Spans (id, row, lo, hi) of symbols covered by windows that also start in a document with a smaller id.

    Without hot names the blocks are read once, so they go straight into the shuffle.
    """
    if hot:
        sent = cut(sent, "blocks")

    def settle(table: pa.Table):
        count = table["n"].to_numpy()
        w1, w2 = windows(table["data"].to_pylist(), count)
        each = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        ids = table["id"].to_numpy()[each]
        order = np.lexsort((ids, w2, w1))
        w1, w2 = w1[order], w2[order]
        head = np.ones(len(w1), bool)
        head[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        least = ids[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        gone = order[ids[order] > least]
        return _spans(ids[gone], table["row"].to_numpy()[each[gone]], (table["start"].to_numpy()[each] + step)[gone].astype(np.int64), size)

    def run(batches):
        """Whole groups of equal h at a time; the partition is sorted by h."""
        held, held_rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            held_rows += batch.num_rows
            if held_rows >= 20_000:
                table = pa.Table.from_batches(held).combine_chunks()
                h = table["h"].to_numpy()
                whole = int(np.searchsorted(h, h[-1], "left"))
                if whole:
                    yield settle(table.slice(0, whole).combine_chunks())
                    rest = table.slice(whole)
                    held, held_rows = rest.to_batches(), rest.num_rows
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    cold = sent.where("not hot").repartition("h").sortWithinPartitions("h").select("h", "id", "row", "start", "n", "data").mapInArrow(run, _SPANS)
    if not hot:
        return cold
    lone = sent.where("hot").select("h", "w", "id", "row", "start")
    least = lone.groupBy("h", "w").agg(F.min("id").alias("_least"), F.max("id").alias("_most")).where("_least < _most").drop("_most")
    warm = lone.join(least, ["h", "w"]).where("id > _least").select("id", "row", F.col("start").alias("lo"), (F.col("start") + size).alias("hi"))
    return cold.unionByName(warm)


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with los and his, the spans of each document."""
    per = spans.distinct().groupBy("id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).select(F.col("id").alias("_i"), F.col("row").alias("_r"), F.col("spans.lo").alias("los"), F.col("spans.hi").alias("his"))
    # Written before the texts are shuffled, so that the blocks' shuffle files can go first.
    per = cut(per, "spans")
    return rows.join(per, (F.col("id") == F.col("_i")) & (F.col("row") == F.col("_r")), "left").drop("_i", "_r")


def mask(n: int, los: list[int] | None, his: list[int] | None) -> np.ndarray:
    """Which of n symbols the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    if los:
        np.add.at(edge, los, 1)
        np.add.at(edge, his, -1)
    return np.cumsum(edge[:-1]) > 0


def hot_filter(cells: np.ndarray, bits: int) -> np.ndarray:
    """Two rows of 2^HOT_BITS bits from rows (j, cell) of a filter of ``bits`` bits."""
    flags = np.zeros((2, 1 << HOT_BITS), bool)
    j, cell = cells[:, 0], cells[:, 1]
    up = max(0, bits - HOT_BITS)
    flags[0, cell[j == 0] >> up] = True
    flags[1, cell[j == 1] & ((1 << HOT_BITS) - 1)] = True
    return np.packbits(flags, axis=1)


def filter_bits(entries: int) -> int:
    return min(MOST_BITS, max(10, int(8 * entries).bit_length()))


def _two_cells(names: DataFrame, bits: int) -> DataFrame:
    high, low = cells_of(F.col("h"), bits)
    return names.select(F.explode(F.array(F.struct(F.lit(0).alias("j"), high.alias("cell")), F.struct(F.lit(1).alias("j"), low.alias("cell")))).alias("x")).select("x.*")


def exact_filter(found: DataFrame) -> tuple[int, np.ndarray, np.ndarray, bool]:
    """(bits, filter, filter of hot names, whether any is hot) from names that Spark has sorted and counted: those that occur once have dropped out."""
    counts = cut(found.groupBy("h").count().where("count > 1"), "ranks")
    bits = filter_bits(counts.count())
    often = _two_cells(counts.where(F.col("count") > HOT_BLOCKS), HOT_BITS)
    flags = bitmap(_two_cells(counts, bits), bits)
    hot = not often.isEmpty()
    # Either bitmap is of bounded size, however many names there are.
    return bits, flags, bitmap(often, HOT_BITS), hot


def sketch_filter(rows: DataFrame, names: Names, size: int, gram: int) -> tuple[int, np.ndarray, np.ndarray, bool]:
    """The same from a count-min sketch of two rows of counters, without counting any name by itself.

    Each task sketches the windows of its texts, a window in the cells of its smallest gram, and counts a run of windows
    with one such gram once; the tasks' sketches are added up chunk by chunk. A cell that reaches 2 may hold a repeated
    window. Counts are only ever too high, so none is lost.
    """
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(filter_bits(total // 64), _CHUNK)

    def sketched(held: list[np.ndarray]):
        name = np.concatenate(held)
        for j, cell in enumerate((name >> np.uint64(64 - bits), name & np.uint64((1 << bits) - 1))):
            cells, counts = np.unique(cell.astype(np.int64), return_counts=True)
            edges = np.flatnonzero(np.append(True, np.diff(cells >> _CHUNK) > 0))
            parts = list(zip(edges, np.append(edges[1:], len(cells)), strict=True)) if len(cells) else []
            within = (cells & ((1 << _CHUNK) - 1)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(parts), pa.int32()), pa.array([int(cells[a]) >> _CHUNK for a, _ in parts], pa.int64()), pa.array([within[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary())], names=["j", "part", "cells", "counts"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for a, b in slices(batch["t"]):
                symbols, at, _ = names(batch["t"].slice(a, b - a))
                held.append(blocks(symbols, at, size, gram).name)
                n += len(held[-1])
                if n >= 1 << 20:
                    yield from sketched(held)
                    held, n = [], 0
        if n:
            yield from sketched(held)

    def merge(table: pa.Table) -> pa.Table:
        cells = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint16)
        counts = np.bincount(cells, np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32), 1 << _CHUNK)
        often = (np.flatnonzero(counts > HOT_BLOCKS) + (int(table["part"][0].as_py()) << _CHUNK)).tolist()
        return pa.table({"j": table["j"].slice(0, 1), "part": table["part"].slice(0, 1), "data": pa.array([np.packbits(counts > 1).tobytes()], pa.binary()), "hot": pa.array([often], pa.list_(pa.int64()))})

    sketches = cut(rows.where("id is not null").select("t").mapInArrow(run, "j int, part long, cells binary, counts binary"), "sketches")
    merged = sketches.groupBy("j", "part").applyInArrow(merge, "j int, part long, data binary, hot array<long>")
    out, often = np.zeros((2, (1 << bits) // 8), np.uint8), [np.zeros((0, 2), np.int64)]
    width = (1 << _CHUNK) // 8
    for r in merged.collect():
        out[r["j"], r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["data"], np.uint8)
        if r["hot"]:
            often.append(np.array([(r["j"], c) for c in r["hot"]], np.int64))
    cells = np.concatenate(often)
    return bits, out, hot_filter(cells, bits), bool(len(cells))
