"""Suffix-array dedup of byte strings.

Prefix doubling names every run of 2, 4, 8 and 16 bytes from pairs of names at growing offsets. Of the positions, those
whose 16-byte name is the smallest within a 50-byte string stand for it; Spark sorts and counts their names and unique
ones drop out. What may repeat is doubled on, 16 to 32 to 50 bytes, with the blocks of one name side by side, and ranked
again at the threshold. Names of 128 bits stand for the strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.common import table
from gridquarry.llm.repeats import block_names, covered_spans, doubled, exact_filter, finish, mask, repeated_blocks, source, with_spans

LENGTH, GRAM = 50, 16
_FIRST, _SECOND = (np.random.default_rng(seed).integers(1, 1 << 63, 256).astype(np.uint64) for seed in (11, 12))


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = text.cast(pa.large_binary())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return _FIRST[data], at - at[0], data


def _payload(size: int):
    def cut_out(data: np.ndarray, _, start: np.ndarray, count: np.ndarray) -> list[bytes]:
        whole = data.tobytes()
        return [whole[a : a + n + size - 1] for a, n in zip(start.tolist(), count.tolist(), strict=True)]

    return cut_out


def _windows(size: int):
    def named(data: list[bytes], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(data), np.uint8)
        begin = np.cumsum(count + size - 1) - (count + size - 1)
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return finish(doubled(_FIRST[flat], size)[at]), finish(doubled(_SECOND[flat], size)[at])

    return named


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id; strings are
    judged on the input. Null texts are empty. A null id is smaller than none and greater than none, so its document
    stays whole and takes nothing from others; documents that share an id do not take from each other.
    """
    rows = source(docs, id_col, text_col)
    bits, flags, often, hot = exact_filter(block_names(rows, _bytes, length, gram))
    sent = repeated_blocks(rows, _bytes, _payload(length), _windows(length), length, gram, bits, flags, often)
    joined = with_spans(rows, covered_spans(sent, _windows(length), length, hot)).select("id", "t", "los", "his")

    def run(batches):
        for batch in batches:
            out = []
            for text, los, his in zip(batch["t"].cast(pa.large_binary()).to_pylist(), batch["los"].to_pylist(), batch["his"].to_pylist(), strict=True):
                if not los:
                    out.append((len(text), 0, 0, text))
                    continue
                gone = mask(len(text), los, his)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same result from a dictionary of every string, for tests on small fixtures."""
    least: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        if i is not None:
            for k in range(len(b) - length + 1):
                if least[b[k : k + length]] < i:
                    gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out
