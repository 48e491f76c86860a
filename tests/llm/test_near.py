import random

import pytest

from gridquarry.llm.near_dedup import brute_force, keep_one, near_classes

DOCS = "doc_id long, text string, c string, row string, n string, path string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], DOCS)


def fixture(dense=120):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choices(words, k=n)

    def changed(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(words)
        return w

    rows = [(i, " ".join(text(rng.randrange(1, 200)))) for i in range(150)]
    base = text(300)
    rows += [(1000 + i, " ".join(changed(base, rng.randrange(0, 9)))) for i in range(dense)]
    chain = text(200)
    for i in range(12):
        rows.append((2000 + i, " ".join(chain)))
        chain = changed(chain, 2)
    rows += [(3000 + i, "One  two\tTHREE") for i in range(30)] + [(3100, "one two three"), (3101, "one two"), (3102, "one"), (3103, "two"), (3104, None), (3105, ""), (3106, " \n"), (None, "one two three"), (None, None), (3101, "one two"), (3101, rows[0][1]), (3200, " ".join(text(12000)))]
    return rows


@pytest.mark.parametrize(("shingle", "percent", "node"), [(3, 85, 256), (3, 85, 20), (5, 80, 256)])
def test_components_agree_with_brute_force(spark, shingle, percent, node):
    rows = fixture()
    got = [(r["id"], r["n"], r["component_id"]) for r in near_classes(docs(spark, rows).repartition(4), shingle=shingle, percent=percent, node=node).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows, shingle, percent), key=str)


def test_a_dense_template_around_the_threshold(spark):
    """Most texts of the template are just below the threshold: dense nodes of outsiders, whole sets and binned ones."""
    rng = random.Random(4)
    base, long = [f"t{i}" for i in range(150)], [f"u{i}" for i in range(700)]
    rows = []
    for i in range(220):
        w = list(base)
        for k in rng.sample(range(0, 150, 3), rng.randrange(2, 7)):
            w[k] = f"x{i}_{k}" if rng.random() < 0.6 else f"y{k}"
        rows.append((i, " ".join(w)))
    for i in range(30):
        w = list(long)
        for k in rng.sample(range(0, 700, 3), rng.randrange(8, 30)):
            w[k] = f"x{i}_{k}"
        rows.append((5000 + i, " ".join(w)))
    want = sorted(brute_force(rows, 3, 85))
    assert 20 < len({c for _, _, c in want}) < 250
    got = near_classes(docs(spark, rows).repartition(3), shingle=3, percent=85, node=16)
    assert sorted((r["id"], r["n"], r["component_id"]) for r in got.collect()) == want


def test_keep_one_and_empty_tables(spark):
    rows = fixture(20)
    out = keep_one(docs(spark, rows), shingle=3, percent=85)
    want = {(i) for i, _, c in brute_force(rows, 3, 85) if i == c and i is not None}
    assert {r["doc_id"] for r in out.collect()} - {None} == want and out.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert near_classes(docs(spark, [])).count() == 0
    assert [tuple(r)[::3] for r in near_classes(docs(spark, [(4, None)])).collect()] == [(4, 4)]
