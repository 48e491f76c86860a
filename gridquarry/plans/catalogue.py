"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.functions import expressions
from gridquarry.operators import arrays, regions, relax, sequence, synopsis
from gridquarry.plans import tasks
from gridquarry.plans.model import Axis, Config, Dim, Domain, Relaxable
from gridquarry.sources import files, views
from gridquarry.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Views and search spaces, in SQL and as configuration.
GRID = "grid AS (SELECT l_suppkey AS x, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::bigint AS y, sum(l_quantity) AS val FROM lineitem GROUP BY ALL)"
UGRIZ = "ugriz AS (SELECT l_suppkey AS x, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::bigint AS y, sum(l_quantity) AS u, count(*) AS g, max(l_quantity) AS r, min(l_quantity) AS i, count(DISTINCT l_partkey) AS z FROM lineitem GROUP BY ALL)"
WAVE = "wave AS (SELECT user_id AS record, floor((epoch(ts) - 1704067200) / 3600)::bigint AS tick, sum(round(value * 100)::bigint)::bigint AS ABP FROM events GROUP BY ALL)"
SEQ = "seq AS (SELECT vec_id AS record, (k - 1)::bigint AS tick, round(embedding[k]::double * 1000)::bigint AS val FROM embeddings, generate_series(1, 64) AS s(k))"
SEGMENTS = "seg AS (SELECT o_custkey AS record, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::bigint AS segment, o_orderkey % 50 AS Ticks FROM orders)"
STARTS = SEGMENTS + ", starts AS (SELECT *, coalesce(sum(Ticks) OVER (PARTITION BY record ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS StartTick FROM seg)"

SW = {"lx": 0, "ux": 999, "ly": 0, "uy": 82, "avg_l": 180, "avg_u": 184, "size_l": 9, "size_u": 20, "len_lx": 3, "len_ux": 5, "len_ly": 3, "len_uy": 5, "step_x": 3, "step_y": 3}
STEPS = SW | {"step_x": 5, "step_y": 4, "len_lx": 4, "len_ux": 8, "step_lx": 2, "len_ly": 2, "len_uy": 8, "step_ly": 3, "size_l": 8, "size_u": 48}
ALIGNED = SW | {"lx": 0, "step_x": 5, "step_y": 5, "len_lx": 5, "len_ux": 10, "step_lx": 5, "len_ly": 5, "len_uy": 10, "step_ly": 5, "size_l": 25, "size_u": 100}


def windows_sql(p: dict) -> str:
    s = {"step_x": 1, "step_y": 1, "step_lx": 1, "step_ly": 1} | p
    return (
        f"win AS (SELECT a.v::bigint AS x, b.v::bigint AS y, c.v::bigint AS lx, d.v::bigint AS ly FROM generate_series({s['lx']}, {s['ux']}, {s['step_x']}) AS a(v), generate_series({s['ly']}, {s['uy']}, {s['step_y']}) AS b(v), "
        f"generate_series({s['len_lx']}, {s['len_ux']}, {s['step_lx']}) AS c(v), generate_series({s['len_ly']}, {s['len_uy']}, {s['step_ly']}) AS d(v) "
        f"WHERE a.v + c.v <= {s['ux'] + 1} AND b.v + d.v <= {s['uy'] + 1} AND c.v * d.v BETWEEN {s['size_l']} AND {s['size_u']})"
    )


def values_sql(p: dict) -> str:
    return f"{GRID}, {windows_sql(p)}, agg AS (SELECT w.x, w.y, w.lx, w.ly, avg(val) AS a, sum(val) AS s, min(val) AS lo, max(val) AS hi, count(val) AS n FROM win w JOIN grid g ON g.x BETWEEN w.x AND w.x + w.lx - 1 AND g.y BETWEEN w.y AND w.y + w.ly - 1 GROUP BY ALL)"


def sw(p: dict, **more) -> Config:
    return Config({"sw": p | more.pop("sw", {}), **more})


def axes(p: dict) -> tuple[Axis, Axis]:
    return tasks.window_axes(Config({"sw": p}), "sw")


def all_windows(spark, p: dict) -> DataFrame:
    return regions.enumerate_windows(spark, axes(p), tasks.area(Config({"sw": p}), "sw"))


# Array operators.


@query(f"WITH {GRID} SELECT * FROM grid")
def array_scan(spark, d):
    return views.grid(spark, d).cells


@query(f"WITH {GRID} SELECT * FROM grid WHERE x BETWEEN 5 AND 40 AND y BETWEEN 10 AND 30")
def between(spark, d):
    return arrays.between(views.grid(spark, d).cells, {"x": (5, 40), "y": (10, 30)})


@query(f"WITH {GRID} SELECT (x // 5)::bigint AS x, (y // 5)::bigint AS y, avg(val) AS avg_val, count(*) AS n FROM grid GROUP BY ALL")
def regrid(spark, d):
    return arrays.regrid(views.grid(spark, d).cells, {"x": (0, 5), "y": (0, 5)}, {"avg_val": F.avg("val"), "n": F.count(F.lit(1))})


@query("SELECT l_suppkey AS s, l_linenumber::bigint AS n, sum(l_quantity) AS q, sum(l_orderkey) AS o FROM lineitem GROUP BY ALL")
def redimension(spark, d):
    rows = views.read(spark, d, "lineitem")
    return arrays.redimension(rows, {"s": F.col("l_suppkey"), "n": F.col("l_linenumber")}, {"q": F.col("l_quantity"), "o": F.col("l_orderkey")}, "sum")


@query("SELECT l_suppkey AS s, l_linenumber::bigint AS n, min(l_orderkey) AS o FROM lineitem GROUP BY ALL")
def redimension_first(spark, d):
    return arrays.redimension(views.read(spark, d, "lineitem"), {"s": F.col("l_suppkey"), "n": F.col("l_linenumber")}, {"o": F.col("l_orderkey")})


@query("SELECT x::bigint AS x, y::bigint AS y, (x * y)::bigint AS a FROM generate_series(0, 1000) AS p(x), generate_series(0, 50) AS q(y)")
def build_xy(spark, d):
    return arrays.build(spark, [Dim("x", 0, 1000), Dim("y", 0, 50)], {"a": F.col("x") * F.col("y")})


@query(f"WITH {GRID} SELECT * FROM grid WHERE x BETWEEN 10 AND 29 AND y BETWEEN 6 AND 23")
def depart_window(spark, d):
    return arrays.depart(views.grid(spark, d), (13, 7), (25, 20)).cells


@query("SELECT p_type AS label, (dense_rank() OVER (ORDER BY p_type) - 1)::bigint AS index FROM part GROUP BY p_type")
def dim_mapping(spark, d):
    return arrays.dimension_mapping(views.read(spark, d, "part"), "p_type")


@query(f"WITH {GRID} SELECT * FROM grid WHERE NOT (x <= 3 AND y < 40) UNION ALL SELECT x, y, val * 2 FROM grid WHERE x <= 3 AND y < 40")
def upsert(spark, d):
    cells = views.grid(spark, d).cells
    return arrays.insert(cells, cells.where("x <= 3 and y < 40").withColumn("val", F.col("val") * 2), ["x", "y"])


@query(f"WITH {GRID}, p AS (SELECT (n_nationkey * 7 + 1)::bigint AS x, (n_regionkey * 20)::bigint AS y FROM nation) SELECT p.x, p.y, val FROM p LEFT JOIN grid USING (x, y)")
def point_lookup(spark, d):
    points = views.read(spark, d, "nation").select((F.col("n_nationkey") * 7 + 1).cast("long").alias("x"), (F.col("n_regionkey") * 20).cast("long").alias("y"))
    return arrays.lookup(views.grid(spark, d).cells, points, ["x", "y"])


@query()
def catalog(spark, d):
    found = arrays.Catalogue(spark)
    for make in (views.grid, views.ugriz):
        found.register(make(spark, d))
    return found.attributes("ugriz")


# Exact aggregates and tasks.

_STAT = {"avg": "a", "sum": "s", "min": "lo", "max": "hi", "count": "n"}


def _region_query(stat: str):
    def run(spark, d):
        found = regions.region_aggregates(views.grid(spark, d).cells, axes(SW), {"v": F.col("val")}, [stat], keep=tasks.area(sw(SW), "sw"))
        return found.withColumnRenamed(f"v_{stat}", stat)

    run.__name__ = f"region_{stat}"
    return query(f'WITH {values_sql(SW)} SELECT x, y, lx, ly, {_STAT[stat]} AS "{stat}" FROM agg')(run)


for _stat in _STAT:
    _region_query(_stat)


@query(f"WITH {values_sql(SW)} SELECT x, y, lx, ly, s AS v_sum, n AS v_count FROM agg")
def region_equi_join(spark, d):
    return regions.by_equi_join(views.grid(spark, d).cells, all_windows(spark, SW), axes(SW), {"v": F.col("val")}, ["sum", "count"])


@query(f"WITH {values_sql(STEPS)} SELECT x, y, lx, ly, s AS sum, n AS count FROM agg")
def region_prefix_sums(spark, d):
    return regions.by_prefix_sums(views.grid(spark, d).cells, axes(STEPS), F.col("val"), tasks.area(sw(STEPS), "sw"))


@query(f"WITH {windows_sql(STEPS)} SELECT * FROM win")
def window_space(spark, d):
    return all_windows(spark, STEPS)


@query(f"WITH {values_sql(SW)} SELECT x, y, lx, ly, round(a)::bigint AS avg FROM agg WHERE round(a) BETWEEN 180 AND 184")
def sw_avg(spark, d):
    return tasks.search(views.grid(spark, d), "sw:SemWindowsAvg", sw(SW))


_EXPR = [{"name": "range", "value": "max - min", "l": 40, "h": 120}, {"name": "load", "value": "sum / (lx * ly)", "h": 60, "strict": True}]


@query(f"WITH {values_sql(SW)} SELECT x, y, lx, ly, hi - lo AS range, s / (lx * ly) AS load FROM agg WHERE hi - lo BETWEEN 40 AND 120 AND s / (lx * ly) <= 60 AND (x + y) % 2 = 0")
def expression_windows(spark, d):
    return tasks.search(views.grid(spark, d), "expr:Windows", Config({"expr": SW | {"where": "(x + y) % 2 = 0", "constraints": _EXPR}}))


@query(f"WITH {values_sql(STEPS)}, m AS (SELECT w.x, w.y, w.lx, w.ly, median(val) AS v_median FROM win w JOIN grid g ON g.x BETWEEN w.x AND w.x + w.lx - 1 AND g.y BETWEEN w.y AND w.y + w.ly - 1 GROUP BY ALL) SELECT * FROM m")
def region_median(spark, d):
    return regions.region_aggregates(views.grid(spark, d).cells, axes(STEPS), {"v": F.col("val")}, ["median"], keep=tasks.area(Config({"sw": STEPS}), "sw"))


@query(f"WITH {values_sql(SW)} SELECT x, y, lx, ly, round(a)::bigint AS avg FROM agg WHERE round(a) BETWEEN 180 AND 184")
def sw_sliced(spark, d):
    found = [tasks.search(views.grid(spark, d), "sw:SemWindowsAvg", c) for c in online.slice_configs(sw(SW), "sw", "x", 3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"WITH {values_sql(STEPS)} SELECT x, y, lx, ly, round(a)::bigint AS avg FROM agg WHERE round(a) BETWEEN 180 AND 184")
def sw_avg_steps(spark, d):
    return tasks.search(views.grid(spark, d), "sw:SemWindowsAvg", sw(STEPS))


@query(ORACLES["sw_avg"])
def sw_pruned(spark, d):
    array = views.grid(spark, d)
    blocks = synopsis.build_synopsis(array.cells, array.meta, "val", (10, 10))
    return tasks.search(array, "sw:SemWindowsAvg", sw(SW), [blocks])


_RING = {"neighborhood": {"size": 1, "max_diff": -150, "min_diff": -400}}
_SIDES = """
, around AS (SELECT w.x, w.y, w.lx, w.ly,
  max(val) FILTER (WHERE g.x BETWEEN w.x - 1 AND w.x - 1 AND g.y BETWEEN w.y AND w.y + w.ly - 1) AS l,
  max(val) FILTER (WHERE g.y = w.y - 1) AS t,
  max(val) FILTER (WHERE g.x = w.x + w.lx AND g.y BETWEEN w.y AND w.y + w.ly - 1) AS r,
  max(val) FILTER (WHERE g.y = w.y + w.ly) AS b
  FROM win w JOIN grid g ON g.x BETWEEN w.x - 1 AND w.x + w.lx AND g.y BETWEEN w.y - 1 AND w.y + w.ly GROUP BY ALL),
found AS (SELECT x, y, lx, ly, round(a)::bigint AS avg, (round(hi) - round(greatest(l, t, r, b)))::bigint AS max_diff, (round(lo) - round(greatest(l, t, r, b)))::bigint AS min_diff
  FROM agg JOIN around USING (x, y, lx, ly) WHERE l IS NOT NULL AND t IS NOT NULL AND r IS NOT NULL AND b IS NOT NULL)
"""


@query(f"WITH {values_sql(SW)} {_SIDES} SELECT * FROM found WHERE avg BETWEEN 180 AND 184 AND max_diff > -150 AND min_diff > -400")
def sw_neighborhood(spark, d):
    return tasks.search(views.grid(spark, d), "sw:SemWindowsAvg", sw(SW, sw=_RING))


MIMIC = {"l_id": 0, "u_id": 1 << 40, "l_time": 0, "u_time": 719, "avg_l": 9000, "avg_u": 11000, "len_l": 24, "len_u": 72, "step_len": 24, "step_time": 6, "signal": "ABP"}
_MIMIC = f"""{WAVE}, win AS (SELECT DISTINCT record, t.v::bigint AS time, n.v::bigint AS len FROM wave, generate_series(0, 719, 6) AS t(v), generate_series(24, 72, 24) AS n(v) WHERE t.v + n.v <= 720),
agg AS (SELECT w.record, w.time, w.len, avg(ABP) AS a, max(ABP) AS hi FROM win w JOIN wave g ON g.record = w.record AND g.tick BETWEEN w.time AND w.time + w.len - 1 GROUP BY ALL)"""
_NEAR = """, l AS (SELECT w.record, w.time, w.len, max(ABP) AS hi FROM win w JOIN wave g ON g.record = w.record AND g.tick BETWEEN w.time - 12 AND w.time - 1 GROUP BY ALL),
r AS (SELECT w.record, w.time, w.len, max(ABP) AS hi FROM win w JOIN wave g ON g.record = w.record AND g.tick BETWEEN w.time + w.len AND w.time + w.len + 11 GROUP BY ALL)"""


@query(f"WITH {_MIMIC} SELECT record AS id, time, len, round(a)::bigint AS avg FROM agg WHERE round(a) BETWEEN 9000 AND 11000")
def mimic_avg(spark, d):
    return tasks.search(views.wave(spark, d), "mimic:MimicAvg", Config({"mimic": MIMIC}))


@query(f"""WITH {_MIMIC} {_NEAR} SELECT agg.record AS id, agg.time, agg.len, round(a)::bigint AS avg, (agg.hi - l.hi)::bigint AS left_diff, (agg.hi - r.hi)::bigint AS right_diff
FROM agg JOIN l USING (record, time, len) JOIN r USING (record, time, len) WHERE round(a) BETWEEN 9000 AND 11000 AND time - 12 >= 0 AND time + len + 12 <= 720 AND agg.hi - l.hi > 1000 AND agg.hi - r.hi > 500""")
def mimic_neighborhood(spark, d):
    return tasks.search(views.wave(spark, d), "mimic:MimicAvg", Config({"mimic": MIMIC | {"neighborhood": {"l_size": 12, "r_size": 12, "left_max_diff": 1000, "right_max_diff": 500}}}))


DIST = {"l_id": 0, "u_id": 1 << 40, "l_time": 0, "u_time": 63, "dist": 330, "step_time": 2, "signal": "val"}
Q = [40.0, -60.0, 90.0, 10.0, -30.0, 120.0, 0.0, -80.0]
_QUERY = "q AS (SELECT k - 1 AS k, v FROM (SELECT unnest([" + ", ".join(map(str, Q)) + "]) AS v, unnest(generate_series(1, 8)) AS k))"
_DIST = f"""{SEQ}, {_QUERY}, d AS (SELECT record AS id, (tick - k)::bigint AS time, ceil(sum((val - v) * (val - v)))::bigint AS sqdist FROM seq, q
WHERE tick - k BETWEEN 0 AND 56 AND (tick - k) % 2 = 0 GROUP BY ALL HAVING count(val) = 8)"""


@query(f"WITH {_DIST} SELECT * FROM d WHERE sqdist <= 330 * 330")
def dist_sq(spark, d):
    return tasks.near_subsequences(views.seq(spark, d), Config({"dist": DIST}), query=Q)


@query(f"WITH {_DIST} SELECT * FROM d WHERE sqdist <= 330 * 330")
def dist_pruned(spark, d):
    """The same through piecewise means: only starts whose lower bound is small enough are checked."""
    array = views.seq(spark, d)
    starts = Domain(0, 63, 2)
    points = sequence.paa_features(array.cells, "record", "tick", F.col("val"), 4, 2)
    near = sequence.starts_within(sequence.rectangles(points, "record", 4, 2), "record", 4, Q, 4, 2, 330.0**2, starts, 63)
    ticks = near.select("record", F.explode(F.sequence(F.col("start"), F.col("start") + 7)).alias("tick")).distinct()
    exact = sequence.squared_distances(array.cells.join(ticks, ["record", "tick"], "left_semi"), "record", "tick", F.col("val"), Q, starts, 63)
    found = exact.join(near, ["record", "start"], "left_semi").where(F.ceil("sqdist") <= 330**2)
    return found.select(F.col("record").alias("id"), F.col("start").alias("time"), F.ceil("sqdist").cast("long").alias("sqdist"))


SDSS = {k: v for k, v in SW.items() if not k.startswith("avg")} | {"avg_l": [170, 7, 1, 9, 0], "avg_h": [195, 8, 0, 12, 1000], "min_l": [10, 1, 1, 1, 1], "min_h": [600, 20, 0, 50, 30]}


@query(f"""WITH {UGRIZ}, {windows_sql(SW)}, agg AS (SELECT w.x, w.y, w.lx, w.ly, avg(u) au, min(u) iu, max(u) xu, avg(g) ag, min(g) ig, max(g) xg, avg(i) ai, min(i) ii, max(i) xi, avg(z) az, min(z) iz, max(z) xz
FROM win w JOIN ugriz g ON g.x BETWEEN w.x AND w.x + w.lx - 1 AND g.y BETWEEN w.y AND w.y + w.ly - 1 GROUP BY ALL)
SELECT x, y, lx, ly FROM agg WHERE round(au) BETWEEN 170 AND 195 AND iu >= 10 AND xu <= 600 AND round(ag) BETWEEN 7 AND 8 AND ig >= 1 AND xg <= 20
AND round(ai) BETWEEN 9 AND 12 AND ii >= 1 AND xi <= 50 AND round(az) BETWEEN 0 AND 1000 AND iz >= 1 AND xz <= 30""")
def sdss_ugriz(spark, d):
    return tasks.search(views.ugriz(spark, d), "sdss:SdssUgrizAvg", Config({"sdss": SDSS}))


# Synopses.

_SYN = lambda name, s: f"{name} AS (SELECT (x // {s})::bigint AS x, (y // {s})::bigint AS y, min(val) AS lo, max(val) AS hi, sum(val) AS s, count(val) AS c FROM grid GROUP BY ALL)"


def _parts_sql(name: str, source: str, s: int, window: str = "w.x, w.y, w.lx, w.ly", region: str = "w.x, w.y, w.lx, w.ly") -> str:
    rx, ry, rlx, rly = region.split(", ")
    left = lambda o, d, off: f"greatest({o}, g.{d} * {s} + {off})"
    right = lambda o, n, d, off: f"least({o} + {n} - 1, (g.{d} + 1) * {s} + {off} - 1)"
    return (
        f"{name}0 AS (SELECT {window}, lo, hi, s, c, {left(rx, 'x', 0)} AS px, {right(rx, rlx, 'x', 0)} AS qx, {left(ry, 'y', 0)} AS py, {right(ry, rly, 'y', 0)} AS qy FROM {source} w JOIN syn{s} g "
        f"ON g.x BETWEEN floor({rx} / {s}) AND floor(({rx} + {rlx} - 1) / {s}) AND g.y BETWEEN floor({ry} / {s}) AND floor(({ry} + {rly} - 1) / {s})), "
        f"{name} AS (SELECT *, (qx - px + 1) * (qy - py + 1) AS part, greatest(0, (qx - px + 1) * (qy - py + 1) - ({s * s} - c)) AS m, least(c, (qx - px + 1) * (qy - py + 1)) AS most FROM {name}0)"
    )


_F = "greatest({k} * lo, s - (c - {k}) * hi)"
_G = "least({k} * hi, s - (c - {k}) * lo)"
_BEND_F = "greatest(m, least(most, {r}(CASE WHEN hi > lo THEN (c * hi - s) / (hi - lo) ELSE 0 END)))"
_BEND_G = "greatest(m, least(most, {r}(CASE WHEN hi > lo THEN (s - c * lo) / (hi - lo) ELSE 0 END)))"


def _bounds_sql(cells: int) -> tuple[str, str]:
    low = ", ".join(_F.format(k=k) for k in ("m", "most", _BEND_F.format(r="floor"), _BEND_F.format(r="ceil")))
    high = ", ".join(_G.format(k=k) for k in ("m", "most", _BEND_G.format(r="floor"), _BEND_G.format(r="ceil")))
    return f"CASE WHEN part = {cells} THEN s ELSE least({low}) END", f"CASE WHEN part = {cells} THEN s ELSE greatest({high}) END"


_LOW, _HIGH = _bounds_sql(16)
_INT = f"""{GRID}, {windows_sql(SW)}, {_SYN("syn4", 4)}, {_parts_sql("p", "win", 4)},
iv AS (SELECT x, y, lx, ly, CASE WHEN max(m) > 0 THEN 'NON_NULL' ELSE 'MAY_NULL' END AS state, min(lo) AS min_lo, min(CASE WHEN part = 16 THEN lo WHEN m > 0 THEN hi END) AS min_hi,
max(CASE WHEN part = 16 THEN hi WHEN m > 0 THEN lo END) AS max_lo, max(hi) AS max_hi, sum({_LOW}) AS sum_lo, sum({_HIGH}) AS sum_hi, min(lo) AS avg_lo, max(hi) AS avg_hi, sum(s * part) / sum(c * part) AS avg_val FROM p GROUP BY ALL)"""


def grid_synopsis(spark, d, size: int) -> synopsis.Synopsis:
    array = views.grid(spark, d)
    return synopsis.build_synopsis(array.cells, array.meta, "val", (size, size))


@query(f"WITH {GRID}, {_SYN('syn', 5)} SELECT x, y, lo AS min, hi AS max, s AS sum, c AS count FROM syn")
def synopsis_grid(spark, d):
    return grid_synopsis(spark, d, 5).blocks


def _interval_query(name: str, columns: list[str]):
    def run(spark, d):
        found = synopsis.intervals(all_windows(spark, SW), axes(SW), grid_synopsis(spark, d, 4))
        return found.select("x", "y", "lx", "ly", *columns)

    run.__name__ = name
    return query(f"WITH {_INT} SELECT x, y, lx, ly, {', '.join(columns)} FROM iv")(run)


_interval_query("interval_min", ["min_lo", "min_hi"])
_interval_query("interval_max", ["max_lo", "max_hi"])
_interval_query("interval_sum", ["sum_lo", "sum_hi"])
_interval_query("interval_avg_loose", ["avg_lo", "avg_hi", "avg_val"])
_interval_query("interval_state", ["state"])


@query()
def interval_avg_tight(spark, d):
    return synopsis.tight_intervals(all_windows(spark, SW), axes(SW), grid_synopsis(spark, d, 4))


@query(f"WITH {windows_sql(SW)} SELECT x, y, lx, ly, ((floor((x + lx - 1) / 4) - floor(x / 4) + 1) * (floor((y + ly - 1) / 4) - floor(y / 4) + 1))::bigint AS cost FROM win")
def region_cost(spark, d):
    return all_windows(spark, SW).withColumn("cost", synopsis.region_cost(axes(SW), grid_synopsis(spark, d, 4)).cast("long"))


@query(f"WITH {values_sql(ALIGNED)} SELECT x, y, lx, ly, s AS sum, n AS count, lo AS min, hi AS max FROM agg")
def agg_from_aligned_synopsis(spark, d):
    chosen = synopsis.choose_synopsis(axes(ALIGNED), [grid_synopsis(spark, d, s) for s in (2, 4, 5)])
    return synopsis.from_aligned(axes(ALIGNED), chosen, tasks.area(sw(ALIGNED), "sw"))


_L8, _H8 = _bounds_sql(64)
_L4, _H4 = _bounds_sql(16)


@query(f"""WITH {GRID}, {windows_sql(SW)}, {_SYN("syn8", 8)}, {_SYN("syn4", 4)}, {_parts_sql("a", "win", 8)},
rest AS (SELECT x, y, lx, ly, px AS rx, py AS ry, qx - px + 1 AS rlx, qy - py + 1 AS rly FROM a WHERE part < 16),
{_parts_sql("b", "rest", 4, region="w.rx, w.ry, w.rlx, w.rly")},
both_ AS (SELECT x, y, lx, ly, lo, hi, m, {_L8} AS low, {_H8} AS high FROM a WHERE part >= 16 UNION ALL SELECT x, y, lx, ly, lo, hi, m, {_L4}, {_H4} FROM b)
SELECT x, y, lx, ly, min(lo) AS avg_lo, max(hi) AS avg_hi, sum(low) AS sum_lo, sum(high) AS sum_hi, CASE WHEN max(m) > 0 THEN 'NON_NULL' ELSE 'MAY_NULL' END AS state FROM both_ GROUP BY ALL""")
def synopsis_multires(spark, d):
    return synopsis.multi_resolution(all_windows(spark, SW), axes(SW), [grid_synopsis(spark, d, 4), grid_synopsis(spark, d, 8)], 0.25)


@query(f"""WITH {GRID}, {_SYN("syn5", 5)}, p AS (SELECT x::bigint AS x, (x % 83)::bigint AS y FROM generate_series(1, 300) AS s(x))
SELECT p.x, p.y, lo, hi, s / c AS val, CASE WHEN c IS NULL THEN 'NUL' WHEN c = 25 THEN 'NON_NULL' ELSE 'MAY_NULL' END AS state FROM p LEFT JOIN syn5 g ON g.x = floor(p.x / 5) AND g.y = floor(p.y / 5)""")
def point_estimate(spark, d):
    points = spark.range(1, 301).select(F.col("id").alias("x"), (F.col("id") % 83).alias("y"))
    return synopsis.point_estimates(points, grid_synopsis(spark, d, 5))


# Relaxation and contraction.

_RELAXED = {"avg_l": 300, "avg_u": 320, "avg_relax_l": 200, "avg_relax_u": 420, "neighborhood": {"size": 1, "max_diff": 250, "max_relax_diff": -100}}
_DA = "CASE WHEN avg < 300 THEN (300 - avg) / 100.0::double WHEN avg > 320 THEN (avg - 320) / 100.0::double ELSE 0 END"
_DM = "CASE WHEN max_diff < 250 THEN (250 - max_diff) / 350.0::double ELSE 0 END"
_RD = f"""rds AS (SELECT *, {_DA} AS da, {_DM} AS dm, (CASE WHEN avg BETWEEN 300 AND 320 THEN 0 ELSE 1 END + CASE WHEN max_diff >= 250 THEN 0 ELSE 1 END) AS nv FROM found WHERE avg BETWEEN 200 AND 420 AND max_diff >= -100),
rd AS (SELECT *, CASE WHEN nv = 0 THEN 0.0 ELSE 0.5::double * greatest(da, dm) + 0.5::double * nv / 2 END AS rd FROM rds)"""


@query(f"WITH {values_sql(SW)} {_SIDES}, {_RD} SELECT x, y, lx, ly, avg, max_diff, rd FROM rd QUALIFY rank() OVER (ORDER BY rd) <= 10")
def sw_relax_topk(spark, d):
    return tasks.search(views.grid(spark, d), "sw:SemWindowsAvg", sw(SW, sw=_RELAXED, relax={"on": True, "card": 10, "dist_w": 0.5}))


@query(f"""WITH {_MIMIC}, v AS (SELECT record AS id, time, len, round(a)::bigint AS avg FROM agg), r AS (SELECT *, CASE WHEN avg BETWEEN 39000 AND 40000 THEN 0.0 ELSE 0.5::double * (CASE WHEN avg < 39000 THEN (39000 - avg) / 34000.0::double ELSE (avg - 40000) / 20000.0::double END) + 0.5::double END AS rd
FROM v WHERE avg BETWEEN 5000 AND 60000) SELECT * FROM r QUALIFY rank() OVER (ORDER BY rd) <= 7""")
def mimic_relax_topk(spark, d):
    config = {"mimic": MIMIC | {"avg_l": 39000, "avg_u": 40000, "avg_relax_l": 5000, "avg_relax_u": 60000}, "relax": {"on": True, "card": 7}}
    return tasks.search(views.wave(spark, d), "mimic:MimicAvg", Config(config))


@query(f"WITH {_DIST}, r AS (SELECT *, CASE WHEN sqdist <= 40000 THEN 0.0 ELSE 0.5::double * ((sqdist - 40000) / 300000.0::double) + 0.5::double END AS rd FROM d WHERE sqdist <= 340000) SELECT * FROM r QUALIFY rank() OVER (ORDER BY rd) <= 12")
def dist_relax_topk(spark, d):
    return tasks.near_subsequences(views.seq(spark, d), Config({"dist": DIST | {"dist": 200, "dist_relax": 300000}, "relax": {"on": True, "card": 12}}), query=Q)


_CONTRACT = {"avg_l": 170, "avg_u": 200, "avg_contr": 1, "neighborhood": {"size": 1, "max_diff": -200, "max_diff_contr": 1, "min_diff": -600, "min_diff_contr": 2}}
_MET = f"{values_sql(SW)} {_SIDES}, met AS (SELECT * FROM found WHERE avg BETWEEN 170 AND 200 AND max_diff >= -200 AND min_diff >= -600)"


@query(f"""WITH {_MET}, r AS (SELECT *, 0.0::double AS rd, ((1 - (200 - avg) / 30.0::double) + (1 - (800 - least(max_diff, 800)) / 1000.0::double) + (1 - (least(min_diff, 400) + 600) / 1000.0::double)) / 3 AS rank FROM met)
SELECT * FROM r QUALIFY rank() OVER (ORDER BY rank DESC) <= 9""")
def contract_rank(spark, d):
    return tasks.search(views.grid(spark, d), "sw:SemWindowsAvg", sw(SW, sw=_CONTRACT, relax={"on": True, "card": 9, "contr_type": 1}))


@query(f"""WITH {_MET} SELECT a.*, 0.0::double AS rd FROM met a WHERE NOT EXISTS (SELECT 1 FROM met b WHERE b.avg >= a.avg AND b.max_diff >= a.max_diff AND b.min_diff <= a.min_diff
AND (b.avg > a.avg OR b.max_diff > a.max_diff OR b.min_diff < a.min_diff))""")
def contract_skyline(spark, d):
    return tasks.search(views.grid(spark, d), "sw:SemWindowsAvg", sw(SW, sw=_CONTRACT, relax={"on": True, "contr_type": 2}))


@query(f"""WITH {values_sql(SW)} {_SIDES} SELECT CASE WHEN avg BETWEEN 300 AND 320 THEN 0 ELSE 1 END AS avg_violated, CASE WHEN max_diff >= 250 THEN 0 ELSE 1 END AS max_diff_violated, count(*) AS n FROM found GROUP BY ALL""")
def violation_report(spark, d):
    loose = sw(SW, sw={"avg_l": -(10**9), "avg_u": 10**9, "neighborhood": {"size": 1, "max_diff": -(10**9)}})
    found = tasks.search(views.grid(spark, d), "sw:SemWindowsAvg", loose)
    mean, gap = Relaxable("avg", 300, 320), Relaxable("max_diff", 250, None)
    return found.groupBy((~mean.holds(F.col("avg"))).cast("int").alias("avg_violated"), (~gap.holds(F.col("max_diff"))).cast("int").alias("max_diff_violated")).agg(F.count(F.lit(1)).alias("n"))


@query()
def step_relax(spark, d):
    array = views.grid(spark, d)
    run = lambda p: tasks.search(array, "sw:SemWindowsAvg", sw(SW, sw=p))
    return relax.step_relax(run, {"avg_l": 300, "avg_u": 305}, {"avg_l": -20, "avg_u": 20}, target=5, strategy="rr")[0]


# Sequences.

_PAA = f"{SEQ}, f AS (SELECT a.record, a.tick AS start, [avg(b.val) FILTER (WHERE b.tick < a.tick + 2), avg(b.val) FILTER (WHERE b.tick >= a.tick + 2)] AS f FROM seq a JOIN seq b ON a.record = b.record AND b.tick BETWEEN a.tick AND a.tick + 3 GROUP BY ALL HAVING count(b.val) = 4)"


@query(f"WITH {_PAA} SELECT record, start, f[1] AS f0, f[2] AS f1 FROM f")
def paa_features(spark, d):
    points = sequence.paa_features(views.seq(spark, d).cells, "record", "tick", F.col("val"), 4, 2)
    return points.select("record", "start", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1"))


_BOX = f"{_PAA}, box AS (SELECT record, (start // 4)::bigint AS mbr, min(f[1]) AS l0, min(f[2]) AS l1, max(f[1]) AS h0, max(f[2]) AS h1 FROM f GROUP BY ALL)"


def _boxes(spark, d):
    points = sequence.paa_features(views.seq(spark, d).cells, "record", "tick", F.col("val"), 4, 2)
    return sequence.rectangles(points, "record", 4, 2)


@query(f"WITH {_BOX} SELECT * FROM box")
def paa_mbr(spark, d):
    return _boxes(spark, d).select("record", "mbr", *[F.col(s)[k].alias(f"{s[0]}{k}") for s in ("low", "high") for k in (0, 1)])


@query(f"WITH {_BOX} SELECT record, mbr, 2.0::double * (pow(greatest(l0 - 40, 40 - h0, 0), 2) + pow(greatest(l1 + 60, -60 - h1, 0), 2)) AS d FROM box WHERE d <= 20000")
def mindist_filter(spark, d):
    return _boxes(spark, d).select("record", "mbr", sequence.mindist("low", "high", [40.0, -60.0], 2.0).alias("d")).where("d <= 20000")


@query()
def dft_mbr(spark, d):
    points = sequence.dft_features(views.seq(spark, d).cells, "record", "tick", "val", 16, 4)
    return sequence.rectangles(points, "record", 8, 4)


# Services.


@query(f"""WITH {WAVE}, r AS (SELECT min(record) AS record FROM wave), s AS (SELECT tick, ABP FROM wave WHERE record = (SELECT record FROM r) AND tick BETWEEN 100 AND 299)
SELECT t.v::bigint AS tick, coalesce(ABP, 0)::bigint AS ABP FROM generate_series(100, 299) AS t(v) LEFT JOIN s ON s.tick = t.v WHERE t.v <= (SELECT max(tick) FROM s)""")
def waveform_gapfill(spark, d):
    cells = views.wave(spark, d).cells
    first = cells.agg(F.min("record")).first()[0]
    return files.waveform(cells, first, 100, 200, "ABP").withColumn("ABP", F.col("ABP").cast("long"))


@query(f"WITH {STARTS} SELECT record, segment, Ticks, StartTick FROM starts")
def segment_starts(spark, d):
    return files.segment_starts(views.segments(spark, d))


@query(f"WITH {STARTS}, t AS (SELECT c_custkey AS record, (c_custkey * 13 % 200)::bigint AS tick FROM customer) SELECT t.record, t.tick, segment, Ticks, StartTick, tick - StartTick AS \"offset\" FROM t JOIN starts ON t.record = starts.record AND tick >= StartTick AND tick < StartTick + Ticks")
def tick_to_segment(spark, d):
    ticks = views.read(spark, d, "customer").select(F.col("c_custkey").alias("record"), (F.col("c_custkey") * 13 % 200).alias("tick"))
    return files.tick_to_segment(ticks, files.segment_starts(views.segments(spark, d)), 64)


@query("SELECT o_orderkey AS k, epoch_us(o_orderdate) + (o_orderkey % 1000) * 8000 AS at_us FROM orders")
def tick_to_time(spark, d):
    at = expressions.tick_to_time(F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 1000)
    return views.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.unix_micros(at).alias("at_us"))


@query(f"WITH {values_sql(SW)} SELECT concat('x=', x, ', y=', y, ', lx=', lx, ', ly=', ly, ', avg=', round(a)::bigint) AS assignment FROM agg WHERE round(a) BETWEEN 180 AND 184")
def result_string(spark, d):
    return tasks.result_strings(sw_avg(spark, d))


@query(f"WITH {values_sql(SW)} SELECT x, avg FROM (SELECT x, round(a)::bigint AS avg FROM agg WHERE round(a) BETWEEN 180 AND 184)")
def result_parse(spark, d):
    return tasks.parse_results(result_string(spark, d), ["x", "avg"])


@query()
def online_slices(spark, d):
    array = views.grid(spark, d)
    run = lambda part: tasks.search(array, "sw:SemWindowsAvg", sw(SW)).where(F.col("x").between(part.lo, part.hi))
    rows = list(online.OnlineSearch(spark, run, Domain(0, 999, 3), slices=4, limit=20))
    return spark.createDataFrame(rows, "x long, y long, lx long, ly long, avg long")


@query()
def random_probe(spark, d):
    return online.random_probe(all_windows(spark, SW), 100, seed=3)


@query(f"WITH {values_sql(SW)} SELECT (x // 40)::bigint AS slice, count(*) AS tries, count(*) FILTER (WHERE round(a) BETWEEN 180 AND 184) AS hits, avg(CASE WHEN round(a) BETWEEN 180 AND 184 THEN 1.0 ELSE 0.0 END) AS ratio FROM agg GROUP BY ALL")
def slice_impact(spark, d):
    values = region_avg_values(spark, d)
    return online.slice_impact(values, F.round("avg").between(180, 184), "x", 40)


def region_avg_values(spark, d):
    return QUERIES["region_avg"](spark, d)



@query("SELECT trunc(c_acctbal * 100)::bigint AS ra, trunc(c_nationkey * 100.0::double)::bigint + 250574 AS dec, c_custkey AS id FROM customer")
def sky_grid(spark, d):
    rows = views.read(spark, d, "customer").select(F.col("c_acctbal").alias("ra"), F.col("c_nationkey").alias("dec"), F.col("c_custkey").alias("id"))
    return expressions.to_grid(rows, {"ra": 100, "dec": 100}, {"dec": 250574})


@query("""WITH g AS (SELECT o_custkey AS run, epoch(o_orderdate) AS t FROM orders), l AS (SELECT run, t, t - lag(t) OVER (PARTITION BY run ORDER BY t) AS gap FROM g)
SELECT run, count(*) AS results, max(t) - min(t) AS total, min(gap) FILTER (WHERE gap > 0) AS min_delay, max(gap) FILTER (WHERE gap > 0) AS max_delay, avg(gap) FILTER (WHERE gap > 0) AS avg_delay FROM l GROUP BY run""")
def delay_statistics(spark, d):
    log = views.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("at"))
    return online.delay_statistics(log)
