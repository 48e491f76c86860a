"""Region aggregates, intervals, relaxation and contraction against brute force on small arrays."""

import statistics
import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridquarry.operators import regions, relax, synopsis
from gridquarry.plans import tasks
from gridquarry.plans.model import Array, ArrayMeta, Axis, Config, Dim, Domain, Relaxable

META = ArrayMeta("t", (Dim("x", 0, 9, 5), Dim("y", 0, 9, 5)), ("val",))
AXES = (Axis("x", Domain(0, 9, 2), Domain(2, 4, 2), 9), Axis("y", Domain(0, 9), Domain(1, 3), 9))


def half_up(v):
    return int(v + 0.5) if v >= 0 else -int(-v + 0.5)


def cells_of(seed, negative=True):
    rng = random.Random(seed)
    out = {}
    for x, y in itertools.product(range(10), repeat=2):
        kind = rng.random()
        if kind < 0.75:
            out[x, y] = float(rng.randrange(-40 if negative else 0, 60))
        elif kind < 0.85:
            out[x, y] = None
        elif kind < 0.9:
            out[x, y] = float("nan")
    return out


def frame(spark, cells):
    return spark.createDataFrame([(x, y, v) for (x, y), v in cells.items()], "x long, y long, val double")


def values(cells, x, y, lx, ly):
    got = [cells.get((i, j)) for i in range(x, x + lx) for j in range(y, y + ly)]
    return [v for v in got if v is not None and v == v]


def space():
    for x, y, lx, ly in itertools.product(AXES[0].origin.values(), AXES[1].origin.values(), AXES[0].length.values(), AXES[1].length.values()):
        if x + lx <= 10 and y + ly <= 10:
            yield x, y, lx, ly


@pytest.mark.parametrize("seed", range(2))
def test_aggregates(spark, seed):
    cells = cells_of(seed)
    wanted = ["avg", "sum", "min", "max", "count"]
    for found in (
        regions.region_aggregates(frame(spark, cells), AXES, {"v": F.col("val")}, wanted),
        regions.by_equi_join(frame(spark, cells), regions.enumerate_windows(spark, AXES), AXES, {"v": F.col("val")}, wanted).where("v_count > 0"),
    ):
        got = {(r["x"], r["y"], r["lx"], r["ly"]): tuple(r[f"v_{w}"] for w in wanted) for r in found.collect()}
        want = {w: (sum(v) / len(v), sum(v), min(v), max(v), len(v)) for w in space() if (v := values(cells, *w))}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
    sums = regions.by_prefix_sums(frame(spark, cells), AXES, F.col("val"))
    assert {(r["x"], r["y"], r["lx"], r["ly"]): (r["sum"], r["count"]) for r in sums.collect()} == {k: (v[1], v[4]) for k, v in want.items()}
    medians = {(r["x"], r["y"], r["lx"], r["ly"]): r["v_median"] for r in regions.region_aggregates(frame(spark, cells), AXES, {"v": F.col("val")}, ["median"]).collect()}
    assert medians == {w: pytest.approx(statistics.median(v)) for w in space() if (v := values(cells, *w))}
    with pytest.raises(ValueError):
        regions.region_aggregates(frame(spark, cells), AXES, {"v": F.col("val")}, ["no_such_aggregate"])
    with pytest.raises(ValueError):
        regions.region_aggregates(frame(spark, cells), AXES, {"v": F.col("val")}, ["median"], keys=["x"])


@pytest.mark.parametrize("seed", range(3))
def test_intervals_hold_every_exact_value(spark, seed):
    cells = cells_of(seed)
    syn = synopsis.build_synopsis(frame(spark, cells), META, "val", (3, 3))
    windows = regions.enumerate_windows(spark, AXES)
    loose = {(r["x"], r["y"], r["lx"], r["ly"]): r for r in synopsis.intervals(windows, AXES, syn).collect()}
    tight = {(r["x"], r["y"], r["lx"], r["ly"]): r for r in synopsis.tight_intervals(windows, AXES, syn).collect()}
    multi = {(r["x"], r["y"], r["lx"], r["ly"]): r for r in synopsis.multi_resolution(windows, AXES, [syn, synopsis.build_synopsis(frame(spark, cells), META, "val", (2, 2))], 0.5).collect()}
    eps = 1e-9
    for w in space():
        v = values(cells, *w)
        if not v:
            assert w not in loose or loose[w]["state"] == "MAY_NULL"
            continue
        r, t, m = loose[w], tight[w], multi[w]
        assert r["min_lo"] <= min(v) and (r["min_hi"] is None or min(v) <= r["min_hi"])
        assert r["max_hi"] >= max(v) and (r["max_lo"] is None or max(v) >= r["max_lo"])
        assert r["sum_lo"] - eps <= sum(v) <= r["sum_hi"] + eps and m["sum_lo"] - eps <= sum(v) <= m["sum_hi"] + eps
        mean = sum(v) / len(v)
        assert r["avg_lo"] - eps <= t["avg_lo"] - eps <= mean <= t["avg_hi"] + eps <= r["avg_hi"] + 2 * eps and m["avg_lo"] <= mean <= m["avg_hi"]


def config(**more):
    base = {"lx": 0, "ux": 9, "ly": 0, "uy": 9, "avg_l": 5, "avg_u": 20, "size_l": 2, "size_u": 9, "len_lx": 2, "len_ux": 3, "len_ly": 1, "len_uy": 3}
    return Config({"sw": base | more.pop("sw", {}), **more})


def ring_max(cells, x, y, lx, ly, n):
    strips = [(x - n, y, n, ly), (x - n, y - n, lx + 2 * n, n), (x + lx, y, n, ly), (x - n, y + ly, lx + 2 * n, n)]
    tops = [max(values(cells, *s), default=None) for s in strips]
    return None if None in tops else max(tops)


def brute_windows(cells, n, max_diff, min_diff):
    for x, y, lx, ly in itertools.product(range(10), range(10), range(2, 4), range(1, 4)):
        v = values(cells, x, y, lx, ly)
        if x + lx > 10 or y + ly > 10 or not 2 <= lx * ly <= 9 or not v:
            continue
        row = [x, y, lx, ly, half_up(sum(v) / len(v))]
        if n:
            top = ring_max(cells, x, y, lx, ly, n)
            if top is None:
                continue
            row += [half_up(max(v)) - half_up(top)] * bool(max_diff) + [half_up(min(v)) - half_up(top)] * bool(min_diff)
        yield tuple(row)


@pytest.mark.parametrize(("seed", "n", "max_diff", "min_diff"), [(0, 0, 0, 0), (1, 1, -20, 0), (2, 2, -30, -70), (3, 1, 0, -60)])
def test_mean_windows(spark, seed, n, max_diff, min_diff):
    cells = cells_of(seed)
    array = Array(META, frame(spark, cells))
    got = tasks.search(array, "sw:SemWindowsAvg", config(sw={"neighborhood": {"size": n, "max_diff": max_diff, "min_diff": min_diff}}))
    ok = lambda r: 5 <= r[4] <= 20 and all(d > lim for d, lim in zip(r[5:], [m for m in (max_diff, min_diff) if m], strict=True))
    assert sorted(map(tuple, got.collect())) == sorted(r for r in brute_windows(cells, n, max_diff, min_diff) if not n or ok(r)) if n else sorted(r for r in brute_windows(cells, 0, 0, 0) if 5 <= r[4] <= 20)
    for size in ((3, 3), (5, 2)):
        syn = synopsis.build_synopsis(array.cells, META, "val", size)
        assert sorted(map(tuple, tasks.search(array, "sw:SemWindowsAvg", config(sw={"neighborhood": {"size": n, "max_diff": max_diff, "min_diff": min_diff}}), [syn]).collect())) == sorted(map(tuple, got.collect()))


def test_strict_without_relaxation_and_not_with_it(spark):
    cells = {(x, y): 10.0 if 2 <= x <= 3 and y == 3 else 0.0 for x in range(10) for y in range(10)}
    ask = {"len_lx": 2, "len_ux": 2, "len_ly": 1, "len_uy": 1, "avg_l": 10, "avg_u": 10, "neighborhood": {"size": 1, "max_diff": 10}}
    array = Array(META, frame(spark, cells))
    assert tasks.search(array, "sw:SemWindowsAvg", config(sw=ask)).count() == 0
    got = tasks.search(array, "sw:SemWindowsAvg", config(sw=ask, relax={"on": True, "card": 1})).collect()
    assert [tuple(r) for r in got] == [(2, 3, 2, 1, 10, 10, 0.0)]


def test_rounding_is_half_away_from_zero(spark):
    cells = frame(spark, {(0, 0): 2.0, (1, 0): 3.0, (4, 0): -2.0, (5, 0): -3.0})
    got = tasks.search(Array(META, cells), "sw:SemWindowsAvg", config(sw={"len_ux": 2, "len_uy": 1, "avg_l": -3, "avg_u": 3, "step_x": 4}))
    assert sorted((r["x"], r["avg"]) for r in got.collect()) == [(0, 3), (4, -3)]


def test_relaxation_degree_and_limits(spark):
    c = Relaxable("avg", 60, 70, 50, 80)
    other = Relaxable("m", 5, None)
    row = spark.createDataFrame([(75.0, 9.0), (60.0, 9.0), (45.0, 1.0)], "a double, m double")
    got = [r[0] for r in row.select(relax.relaxation_degree([(c, F.col("a")), (other, F.col("m"))])).collect()]
    assert got == [pytest.approx(0.5), 0.0, pytest.approx(0.5 * 1.5 + 0.5)]
    assert Relaxable("a", 10, 20, 15, 12).max_l == 10 and Relaxable("a", 10, 20, 15, 12).max_h == 20
    assert relax.unit_relaxation(1.0, 0.5, 1, 2) == 1.0 and relax.unit_relaxation(0.5, 0.5, 1, 2) == 0.5


def test_top_k_keeps_ties_and_rank_example(spark):
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate([3, 1, 2, 2, 2, 9])], "k int, v double")
    assert sorted(r["k"] for r in relax.top_k(rows, "v", 2, smallest=True).collect()) == [1, 2, 3, 4]
    c = Relaxable("avg", 60, 70, contract=1)
    assert spark.range(1).select(relax.point_rank(c, F.lit(68.0))).first()[0] == pytest.approx(0.8)


def test_skyline(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(12), rng.randrange(12), None if k % 40 == 0 else rng.randrange(12)) for k in range(300)]
    goals = [("a", True), ("b", False), ("c", True)]
    full = [r for r in rows if r[3] is not None]
    better = lambda p, q: p[1] >= q[1] and p[2] <= q[2] and p[3] >= q[3] and p[1:] != q[1:]
    want = sorted(r for r in full if not any(better(p, r) for p in full))
    got = relax.skyline(spark.createDataFrame(rows, "k int, a int, b int, c int").repartition(5), goals)
    assert sorted(map(tuple, got.collect())) == want


def test_step_relax_widens_until_enough(spark):
    rows = spark.range(100)
    for strategy in ("all", "rr", "random"):
        found, params, n = relax.step_relax(lambda p: rows.where(f"id between {p['l']} and {p['u']}"), {"l": 50, "u": 50}, {"l": -3, "u": 3}, 10, strategy)
        assert found.count() > 10 and n > 0 and params["l"] <= 50


def test_unknown_tasks_and_specs(spark):
    with pytest.raises(ValueError):
        tasks.parse_spec("a:b")
    with pytest.raises(ValueError):
        tasks.search(Array(META, spark.range(1)), "no:Such", Config())
