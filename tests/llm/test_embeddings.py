import numpy as np
import pandas as pd
import pytest

from gridquarry.llm import embedding_dedup
from gridquarry.llm.embedding_dedup import link_classes


def brute_force(rows, cosine=0.95):
    """Links, components and counts by comparing all pairs; rows of (id, vector or None)."""
    sound = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[k][1] for k in sound], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    label = np.arange(len(sound))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    out = [(i, 0, i) for i, _ in rows]
    for k, s in enumerate(sound):
        members = [rows[sound[j]][0] for j in np.flatnonzero(label == label[k])]
        out[s] = (rows[s][0], int(near[k].sum()) - 1, min((m for m in members if m is not None), default=None))
    return out


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(500)]
    for i in range(200):  # a dense group and chains of neighbours
        rows.append((1000 + i, (np.array(rows[0][1]) + rng.normal(size=16) * 0.1).tolist()))
    step = np.zeros(16)
    step[3] = 0.25
    rows += [(2000 + i, (np.ones(16) / 4 + i * step).tolist()) for i in range(12)]
    rows += [(3000 + i, rows[7][1]) for i in range(40)] + [(7, rows[7][1]), (None, rows[7][1]), (None, [0.5] * 15 + [-9.0])]
    return rows + [(4000, None), (4001, [0.0] * 16), (4002, [None] + [1.0] * 15), (4003, [float("nan")] * 16), (4004, [float("inf")] * 16), (4005, [1.0, 2.0]), (4006, []), (4007, (np.array(rows[9][1]) * 1e-30).tolist())]


@pytest.mark.parametrize("block", [1024, 64])
def test_links_agree_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "LIST_BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "QUERY_BLOCK", block)
    rows = vectors()
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, c int, list int")
    got = sorted((tuple(r) for r in link_classes(table.repartition(4)).collect()), key=str)
    want = sorted(brute_force(rows), key=str)
    assert len(got) == len(want)
    links = sum(x[1] for x in want)
    assert sum(x[1] for x in got) >= 0.99 * links and sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_nothing_to_link(spark):
    schema = "vec_id long, embedding array<float>"
    assert link_classes(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in link_classes(spark.createDataFrame([(1, None)], schema)).collect()] == [(1, 0, 1)]
    assert [tuple(r) for r in link_classes(spark.createDataFrame([(3, [1.0, 0.0])], schema)).collect()] == [(3, 0, 3)]


def test_tiny_and_huge_components_and_two_lengths(spark):
    rng = np.random.default_rng(3)
    base = [rng.normal(size=16) for _ in range(60)]
    rows = [(i, (v + rng.normal(size=16) * 0.02).tolist()) for i, v in enumerate(base + base)]
    rows += [(200, [1e-200] * 16), (201, [1e200] * 16), (202, [5e-324] * 16), (203, [1.7e308] * 16), (204, [-1e-200] * 16)]
    short = rng.normal(size=8)
    rows += [(300, short.tolist()), (301, (short * 1e-9).tolist()), (302, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_classes(table).collect()}
    assert all(got[i] == got[i + 60] == (1, i) for i in range(60))
    assert all(got[i] == (3, 200) for i in range(200, 204)) and got[204] == (0, 204)
    assert got[300] == got[301] == (1, 300) and got[302] == (0, 302)


def test_recall_of_planted_pairs_over_many_lists(spark):
    """20,000 directions with a partner each at cosine 0.95 to 0.97, over 200 lists of which 8 are probed."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.9501, 0.97, (len(x), 1))
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * y])
    pdf = pd.DataFrame({"vec_id": np.arange(len(both)), "embedding": both.tolist()})
    table = spark.createDataFrame(pdf, "vec_id long, embedding array<double>")
    want = 0
    for a in range(0, len(both), 2000):
        want += int((both[a : a + 2000] @ both.T >= 0.95).sum()) - len(both[a : a + 2000])
    got = link_classes(table).agg({"n_links": "sum"}).first()[0]
    print("recall", got / want)
    assert 0.95 * want <= got <= want
