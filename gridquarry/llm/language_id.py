"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are added up as log odds: the likelihood of the text under byte-trigram models, the language that
the markup declares, the address suffix, and a prior for the host. Host priors are counts of what the texts alone say,
from grouped aggregation, smoothed from all rows to the suffix, the registered domain and the host. A class ``und`` of
uniform trigrams stands for text in none of the languages; rows it wins are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.common import cut, discard, lean, small_batches, table

#: The models are fitted on the labelled rows with the smallest hashed ids, at most this many; every label among them is a language.
TRAIN_ROWS = 3000
CELLS = 1 << 16
#: Neighbouring trigrams overlap, so the text's log likelihood is scaled down, and no text speaks louder than this many trigrams.
TEMPER, LOUDEST = 0.25, 2000
#: How far a declaration and an address suffix are trusted, and the weight in rows of each parent prior.
DECLARED_TRUST, SUFFIX_TRUST, PARENT_ROWS = 0.8, 0.6, 20.0
UNDETERMINED, UNDETERMINED_PRIOR = "und", 0.01
#: Address suffixes that stand for a language.
SUFFIX_LANGUAGES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en"}


def _cells(data: np.ndarray) -> np.ndarray:
    """The cell of each byte trigram, ASCII upper case folded."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    return ((low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(16)


def _rows(text: pa.Array):
    """The bytes of each text, without copying."""
    text = text.cast(pa.large_binary())
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    for k in range(len(text)):
        yield data[at[k] : at[k + 1]]


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, table of log likelihoods [cell, language and und]) from a bounded sample of labelled rows."""
    labelled = docs.select(F.col(id_col).alias("i"), F.col(label_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).where("l is not null and t is not null")
    chosen = labelled.select("i").orderBy(F.xxhash64("i"), "i").limit(train_rows).distinct().withColumnRenamed("i", "chosen")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for lang, data in zip(batch["l"].to_pylist(), _rows(batch["t"]), strict=True):
                if len(data) > 2:
                    n = len(data) - 2
                    sums[lang] = sums.get(lang, 0) + np.bincount(_cells(data), minlength=CELLS) * (min(n, LOUDEST) / n)
                    rows[lang] = rows.get(lang, 0) + 1
        for lang, n in sums.items():
            cells = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells)), pa.array(cells), pa.array(n[cells]), pa.array([rows[lang]] + [0] * (len(cells) - 1))], names=["l", "cell", "n", "rows"])

    rows = labelled.join(F.broadcast(chosen), F.col("i").eqNullSafe(F.col("chosen"))).select("l", "t")
    cells = rows.mapInArrow(lean(count), "l string, cell long, n double, rows long").groupBy("l", "cell").agg(F.sum("n").alias("n"))
    # The counts of at most ``train_rows`` rows come to the driver.
    with small_batches(docs.sparkSession):
        found = cells.groupBy("l").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).collect()
    langs = sorted(r["l"] for r in found)
    logs = np.full((CELLS, len(langs) + 1), -np.log(CELLS), np.float32)
    for r in found:
        n = np.bincount([c["cell"] for c in r["cells"]], [c["n"] for c in r["cells"]], CELLS) + 0.02
        logs[:, langs.index(r["l"])] = np.log(n / n.sum())
    return langs, logs


def address_suffix(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_extract(url, r"(?s)\A.*?://([^/?#:]*)", 1), r"\."), -1)


def _address(url_col: str | None, host_col: str | None) -> tuple[Column, Column]:
    """(host, address suffix), null where nothing is known."""
    null = F.lit(None).cast("string")
    other = F.col(host_col).cast("string") if host_col else null
    if not url_col:
        return other, null
    named = lambda c: F.when(c != "", F.lower(c))
    return F.coalesce(named(F.regexp_extract(F.col(url_col), r"(?s)\A.*?://([^/?#:]*)", 1)), other), named(address_suffix(F.col(url_col)))


def markup_language(html: Column) -> Column:
    """The language that the markup's html element declares, without its region; null where there is none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", 1))
    return F.when(found != "", found)


def markup_text(html: Column) -> Column:
    """The text between the tags; scripts and styles are left out."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")


def _log_sum(columns: list[Column]) -> Column:
    top = F.greatest(*columns)
    return top + F.log(sum((F.exp(c - top) for c in columns), F.lit(0.0)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = "lang", declared_col: str | None = None, url_col: str | None = None, host_col: str | None = "source", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: id, row, declared, language, posterior, kept.

    ``label_col`` holds the languages that the text models are fitted on and says nothing else about a row; ``declared_col``
    is evidence. ``url_col`` gives suffix and host; ``host_col`` stands for the host of rows without an address.
    A null or short text, a null declaration, suffix or host adds no evidence, so a row without any falls back on the
    prior of all rows. Rows of class ``und`` are not kept. Without a single labelled row nothing can be told: language
    and posterior are null and every row is kept. Repeated rows are rows of their own.
    """
    null = F.lit(None).cast("string")
    declared = F.col(declared_col).cast("string") if declared_col else null
    host, suffix = _address(url_col, host_col)
    langs, logs = fit(docs, id_col, text_col, label_col, train_rows) if label_col else ([], None)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col), F.col(id_col), declared, suffix, host).alias("row"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    if not langs:
        return rows.select("id", "row", "declared", null.alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(True).alias("kept"))
    models = docs.sparkSession.sparkContext.broadcast(logs)  # CELLS x languages floats
    names = [*langs, UNDETERMINED]
    keep = ["id", "row", "declared", "suffix", "host"]

    def score(batches):
        for batch in batches:
            got = np.zeros((batch.num_rows, len(names)))
            for k, data in enumerate(_rows(batch["t"])):
                if len(data) > 2:
                    n = len(data) - 2
                    got[k] = models.value[_cells(data)].sum(0, dtype=np.float64) * (TEMPER * min(n, LOUDEST) / n)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.FixedSizeListArray.from_arrays(got.ravel(), len(names)).cast(pa.list_(pa.float64()))], names=[*keep, "s"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    with small_batches(docs.sparkSession):
        scored = cut(rows.mapInArrow(lean(score), f"{schema}, s array<double>"), "language")
    parts = F.split("host", r"\.")
    scored = scored.withColumn("domain", F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.least(F.size(parts), F.lit(2))), "."))
    shares = [F.exp(F.col("s")[k] - _log_sum([F.col("s")[j] for j in range(len(langs))])) for k in range(len(langs))]
    said = scored.where(F.col("s")[0] != 0).select("suffix", "domain", "host", *[c.alias(f"c{k}") for k, c in enumerate(shares)])
    counts = cut(said.groupBy("suffix", "domain", "host").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(langs))]), "hosts")
    # One row: the rate of each language over all rows, which every host falls back on.
    all_rows = counts.agg(F.array(*[(F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) + 1) for k in range(len(langs))]).alias("a")).select(F.transform("a", lambda x: x / F.aggregate("a", F.lit(0.0), lambda p, q: p + q)).alias("p0"))
    all_rows = cut(all_rows, "rates")
    prior = counts.join(F.broadcast(all_rows))
    # Without addresses there are no suffixes and domains to smooth by.
    levels = (("suffix", ["suffix"]), ("domain", ["suffix", "domain"]), ("host", ["suffix", "domain", "host"])) if url_col else (("host", ["suffix", "domain", "host"]),)
    for level, keys in levels:
        sums = counts.groupBy(*keys).agg(F.array(*[F.sum(f"c{k}") for k in range(len(langs))]).alias("c"))
        sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("c").alias(f"n_{level}"))
        on = F.lit(True)
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        smoothed = F.zip_with("p0", f"n_{level}", lambda p, n: (p * PARENT_ROWS + n) / (PARENT_ROWS + F.aggregate(F.col(f"n_{level}"), F.lit(0.0), lambda x, y: x + y)))
        prior = prior.join(sums, on).drop(*[f"_{k}" for k in keys]).withColumn("p0", F.when(F.col(level).isNull(), F.col("p0")).otherwise(smoothed)).drop(f"n_{level}")
        prior = cut(prior, "priors")
    prior = prior.select(F.col("suffix").alias("_s"), F.col("domain").alias("_d"), F.col("host").alias("_h"), F.col("p0").alias("prior"))
    joined = scored.join(prior, F.col("suffix").eqNullSafe(F.col("_s")) & F.col("domain").eqNullSafe(F.col("_d")) & F.col("host").eqNullSafe(F.col("_h")), "left").join(F.broadcast(all_rows))
    others = max(1, len(langs) - 1)
    by_suffix = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGES.items() for x in pair])[F.col("suffix")]
    votes = []
    for k, lang in enumerate(langs):
        total = F.col("s")[k] + F.log(F.coalesce(F.col("prior")[k], F.col("p0")[k])) + float(np.log(1 - UNDETERMINED_PRIOR))
        for told, trust in ((F.col("declared"), DECLARED_TRUST), (by_suffix, SUFFIX_TRUST)):
            total += F.when(told.isin(*langs), F.when(told == lang, float(np.log(trust))).otherwise(float(np.log((1 - trust) / others)))).otherwise(float(-np.log(len(langs))))
        votes.append(total)
    votes.append(F.col("s")[len(langs)] + float(np.log(UNDETERMINED_PRIOR) - 2 * np.log(len(langs))))
    voted = joined.withColumn("v", F.array(*votes)).withColumn("best", F.array_max("v"))
    posterior = 1 / F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("best")))
    language = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("v", F.col("best")).cast("int"))
    return voted.select("id", "row", "declared", language.alias("language"), posterior.alias("posterior")).withColumn("kept", F.col("language") != UNDETERMINED)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source and any others) whose language could be told; lang takes the language found.

    Documents have neither markup nor addresses: the text and the prior of the source decide, and lang only labels the
    rows that the text models are fitted on.
    """
    found = identify(docs).select(F.col("id"), F.col("row"), "language", "kept").distinct()
    null = F.lit(None).cast("string")
    row = F.xxhash64(F.col("text"), F.col("doc_id"), null, null, F.col("source").cast("string"))
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), row.alias("_row"))
    kept = packed.join(found, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_row") == F.col("row"))).where("kept")
    return kept.select(*[F.coalesce(F.col("language"), F.col("_doc.lang")).alias("lang") if c == "lang" else F.col("_doc")[c].alias(c) for c in docs.columns])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (id, page, text, label, declared, url, source) of all documents and pages.

    Documents have labels and sources; pages have what their markup declares, an address and the text between their tags.
    """
    null = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(False).alias("page"), "text", F.col("lang").alias("label"), null.alias("declared"), null.alias("url"), "source")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(True).alias("page"), markup_text(F.col("html")).alias("text"), null.alias("label"), markup_language(F.col("html")).alias("declared"), "url", null.alias("source"))
    return docs.unionByName(pages)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and per page: doc_id or page_id, declared, language, posterior, kept."""
    rows = evidence(spark, sf_dir).withColumn("id", F.struct("page", "id"))
    found = identify(rows, "id", declared_col="declared", label_col="label", url_col="url", host_col="source")
    own = lambda page, name: F.when(F.col("id.page") == page, F.col("id.id")).alias(name)
    return found.select(own(False, "doc_id"), own(True, "page_id"), "declared", "language", "posterior", "kept")


def brute_force(rows: list[dict]) -> list[tuple[str, float]]:
    """(language, posterior) of rows with text, label, declared, suffix, domain and host, all of which train: by plain loops, for tests."""
    langs = sorted({r["label"] for r in rows if r["label"] is not None and r["text"] is not None})
    counts = {lang: np.full(CELLS, 0.02) for lang in langs}
    cells = [_cells(np.frombuffer((r["text"] or "").encode(), np.uint8)) if len((r["text"] or "").encode()) > 2 else np.zeros(0, np.int64) for r in rows]
    for r, c in zip(rows, cells, strict=True):
        if r["label"] in counts:
            for cell in c:
                counts[r["label"]][cell] += min(1, LOUDEST / len(c))
    logs = [np.log(counts[lang] / counts[lang].sum()) for lang in langs] + [np.full(CELLS, -np.log(CELLS))]
    score = [[TEMPER * min(1, LOUDEST / max(1, len(c))) * log[c].sum() for log in logs] for c in cells]
    seen: dict[tuple, np.ndarray] = {}
    keys = [[(), ("s", r["suffix"]), ("d", r["suffix"], r["domain"]), ("h", r["suffix"], r["domain"], r["host"])] for r in rows]
    for c, s, own in zip(cells, score, keys, strict=True):
        if len(c):
            share = np.exp(np.array(s[:-1]) - max(s[:-1]))
            for key in own:
                seen[key] = seen.get(key, 0) + share / share.sum()
    out = []
    for r, s, own in zip(rows, score, keys, strict=True):
        prior = (seen.get((), 0) + np.ones(len(langs))) / (seen.get((), 0) + np.ones(len(langs))).sum()
        if own[3] in seen:
            for key in own[1:]:
                if key[-1] is not None:
                    prior = (prior * PARENT_ROWS + seen[key]) / (PARENT_ROWS + seen[key].sum())
        vote = [x + np.log(p) + np.log(1 - UNDETERMINED_PRIOR) for x, p in zip(s[:-1], prior, strict=True)]
        for told, trust in ((r["declared"], DECLARED_TRUST), (SUFFIX_LANGUAGES.get(r["suffix"]), SUFFIX_TRUST)):
            vote = [v + (-np.log(len(langs)) if told not in langs else np.log(trust) if told == lang else np.log((1 - trust) / max(1, len(langs) - 1))) for v, lang in zip(vote, langs, strict=True)]
        vote.append(s[-1] + np.log(UNDETERMINED_PRIOR) - 2 * np.log(len(langs)))
        best = int(np.argmax(vote))
        out.append(([*langs, UNDETERMINED][best], float(1 / np.exp(np.array(vote) - vote[best]).sum())))
    return out
