import hashlib
import random

import pytest

from gridquarry.llm import repeats, substring_dedup, suffix_dedup

DOCS = "doc_id long, text string, h string, row string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "1", "2", "3") for r in rows], DOCS)


def fixture():
    rng = random.Random(5)
    words = ["alpha", "be", "gamma,", "délta", "\tx", " y", "zz\n"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, other = text(120), text(70)
    rows = [(i, text(rng.randrange(0, 150))) for i in range(30)]
    rows += [(40 + i, text(30) + " " + passage + " " + text(rng.randrange(0, 60))) for i in range(25)]
    rows += [(100, passage), (101, passage), (101, passage + " tail"), (5, passage), (None, passage), (102, None), (103, ""), (104, "a" * 400), (105, "b" + "a" * 49 + "c"), (106, "a " * 300), (107, "a " * 49), (108, other + passage), (109, passage + other + text(9000))]
    return rows + [rows[31], rows[31]]


@pytest.mark.parametrize("hot", [4096, 3])
def test_bytes_agree_with_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    rows = fixture()
    got = suffix_dedup.dedup_substrings(docs(spark, rows).repartition(3)).collect()
    mine = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert sorted(mine, key=str) == sorted(suffix_dedup.brute_force(rows), key=str)


@pytest.mark.parametrize("hot", [4096, 3])
def test_words_agree_with_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    rows = fixture()
    got = substring_dedup.dedup_windows(docs(spark, rows).repartition(3)).collect()
    mine = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got]
    assert sorted(mine, key=str) == sorted(substring_dedup.brute_force(rows), key=str)


def test_empty_tables(spark):
    assert suffix_dedup.dedup_substrings(docs(spark, [])).count() == 0
    assert substring_dedup.dedup_windows(docs(spark, [])).count() == 0
    assert substring_dedup.dedup_windows(docs(spark, [(1, None)])).first()["kept"] == ""


def test_bytes_of_a_table_agree_with_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = suffix_dedup.op3_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(suffix_dedup.brute_force(rows))
