import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridquarry.llm.exact_dedup import dedup, exact_classes
from gridquarry.llm.mixing import mix, mix_pieces, op2_mixing, source_targets

DOCS = "doc_id long, text string, source string, id string, t string, size int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 0) for i, t, s in rows], DOCS)


def test_exact_classes_hold_every_row_with_nulls_ties_and_hot_groups(spark):
    rows = [(i, "hot " * 300, "a") for i in range(400)] + [(1000 + i, f"lone {i}", "a") for i in range(50)]
    rows += [(2000, None, None), (2001, "", "b"), (2001, "", "b"), (None, "lone 1", "a"), (3000, "x" * 200_000, "a"), (3001, "x" * 200_000, "a")]
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_classes(docs(spark, rows).repartition(7), keep=keep).collect()
        groups = defaultdict(list)
        for i, t, _ in rows:
            groups[t or ""].append(i)
        want = sorted((str(i), str(pick(x for x in groups[t or ""] if x is not None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
        assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want


def test_exact_classes_of_an_empty_table_and_dedup_keeps_columns(spark):
    assert exact_classes(docs(spark, [])).count() == 0
    out = dedup(docs(spark, [(1, "a", "s"), (2, "a", "s"), (3, None, None)]))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3] and out.columns == ["doc_id", "text", "source", "id", "t", "size"]


def test_an_id_may_stay_with_one_text_and_go_with_another(spark):
    out = dedup(docs(spark, [(1, "a", None), (2, "b", None), (2, "a", None)]))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "a"), (2, "b")]


def water_level(sizes, weights):
    """Targets by resharing the excess until no source is above twice its size."""
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        target = {s: 2.0 * sizes[s] for s in capped} | {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 400), f"s{i % 7}" if i % 3 else "hot") for i in range(300)] + [(900, None, None), (901, "a b c", None), (902, "", "none"), (903, "w " * 40_000, "s1"), (5, "w " * 9, "s1")]
    got = mix_pieces(docs(spark, rows))
    taken = {r["row"]: r for r in []}
    per = got.groupBy("src").agg(F.sum("piece_words").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    for r in per:
        assert r["size"] == sizes[r["src"]] and r["target"] == pytest.approx(want[r["src"]]) and r["taken"] == round(r["target"]), taken
    by_doc = got.groupBy("id", "row", "size", "src").agg(F.sum("piece_words").alias("n")).collect()
    assert len(by_doc) == len(rows) and all(0 <= r["n"] <= 2 * r["size"] for r in by_doc)
    again = mix_pieces(docs(spark, rows).repartition(5)).groupBy("id", "row", "size", "src").agg(F.sum("piece_words").alias("n"))
    assert sorted(map(str, by_doc)) == sorted(map(str, again.collect()))


def test_schedule_spreads_sources_evenly(spark):
    rows = [(i, "w " * 500, f"s{i % 3}") for i in range(600)]
    slots = mix_pieces(docs(spark, rows), block_words=64).where("slot is not null").select("slot", "src", "piece_words").orderBy("slot").collect()
    total, half = defaultdict(int), defaultdict(int)
    top = max(r["slot"] for r in slots)
    for r in slots:
        total[r["src"]] += r["piece_words"]
        half[r["src"]] += r["piece_words"] * (r["slot"] <= top / 2)
    assert all(abs(half[s] / total[s] - 0.5) < 0.02 for s in total)


def test_mix_of_nothing_and_mix_keeps_columns(spark):
    assert mix_pieces(docs(spark, [])).count() == 0
    assert mix_pieces(docs(spark, [(1, None, "a")])).agg(F.sum("piece_words")).first()[0] == 0
    out = mix(docs(spark, [(i, "w " * 50, f"s{i % 2}") for i in range(40)]))
    assert out.columns == ["doc_id", "text", "source", "id", "t", "size"] and 40 <= out.count() <= 80


def test_many_sources_and_words_of_a_cut_document(spark):
    rows = [(i, " \tone two  three\nfour ", f"s{i:03d}") for i in range(300)]
    got = mix_pieces(docs(spark, rows)).groupBy("src").agg(F.sum("piece_words").alias("n"), F.max("target").alias("t")).collect()
    want = water_level({f"s{i:03d}": 4 for i in range(300)}, {f"s{i:03d}": (3, 1, 2)[i % 3] for i in range(300)})
    assert all(r["t"] == pytest.approx(want[r["src"]]) and r["n"] == round(r["t"]) for r in got) and len(got) == 300
    words = defaultdict(int)
    for r in mix(docs(spark, rows)).collect():
        words[r["source"]] += len(r["text"].split())
        assert rows[0][1].startswith(r["text"])
    assert dict(words) == {r["src"]: r["n"] for r in got}


def test_op2_runs_agree(spark):
    a, b = (sorted(map(str, op2_mixing(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert a == b
    assert source_targets(spark.createDataFrame([], "src string, size long")).count() == 0
