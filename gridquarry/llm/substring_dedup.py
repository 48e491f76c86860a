"""Substring dedup of word windows behind a count-min prefilter.

The partitions' sketches count the names under which windows may be found again and are merged; the merged sketch
overestimates. A second pass groups exactly the windows that it estimates to be repeated, so none is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.common import table
from gridquarry.llm.repeats import K3, covered_spans, doubled, finish, mask, repeated_blocks, sketch_filter, source, with_spans

WINDOW, GRAM = 50, 8


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A name for each word of the texts; words are runs without ASCII white space."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    at = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(real).dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    names = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return names[coded.indices.to_numpy(zero_copy_only=False)], at, None


def _payload(size: int):
    """Both names of each window of the blocks: words are longer than names."""

    def cut_out(_, symbols: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[bytes]:
        two = np.stack([finish(doubled(symbols, size)), finish(doubled(finish(symbols * K3), size))], 1)
        return [two[a : a + n].tobytes() for a, n in zip(start.tolist(), count.tolist(), strict=True)]

    return cut_out


def _windows(data: list[bytes], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    two = np.frombuffer(b"".join(data), np.uint64).reshape(-1, 2)
    return two[:, 0].copy(), two[:, 1].copy()


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id; windows are
    judged on the input. Null texts have no words. A document with a null id stays whole and takes nothing from others;
    documents that share an id do not take from each other.
    """
    rows = source(docs, id_col, text_col)
    bits, flags, often, hot = sketch_filter(rows, _words, window, gram)
    sent = repeated_blocks(rows, _words, _payload(window), _windows, window, gram, bits, flags, often)
    joined = with_spans(rows, covered_spans(sent, _windows, window, hot)).select("id", "t", "los", "his")

    def run(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for text, los, his in zip(batch["t"].cast(pa.large_binary()).to_pylist(), batch["los"].to_pylist(), batch["his"].to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                if los:
                    gone = mask(len(words), los, his)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spans AS (
  SELECT r, doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS k FROM docs WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS d FROM spans GROUP BY h HAVING count(*) > 1),
hits AS (SELECT r, k FROM spans JOIN least USING (h) WHERE doc_id > d),
gone AS (SELECT DISTINCT r, k + j AS k FROM hits, generate_series(0, 49) AS s(j)),
words AS (SELECT r, unnest(generate_series(1, len(w))) AS k, unnest(w) AS word FROM docs WHERE len(w) > 0),
kept AS (
  SELECT words.r, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL) AS t
  FROM words LEFT JOIN gone ON words.r = gone.r AND words.k = gone.k GROUP BY words.r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def brute_force(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same result from a dictionary of every window, for tests on small fixtures."""
    data = [(i, (t or "").encode().split()) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, w in data:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in data:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out
