import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.functions import expressions
from gridquarry.operators import arrays, sequence, synopsis
from gridquarry.plans import tasks
from gridquarry.plans.model import Array, ArrayMeta, Axis, Config, Dim, Domain
from gridquarry.sources import files
from gridquarry.streaming.online import OnlineSearch

META = ArrayMeta("t", (Dim("x", 0, 19, 5),), ("val",))


def test_build_checksum(spark):
    cells = arrays.build(spark, [Dim("x", 0, 1000), Dim("y", 0, 50)], {"a": F.col("x") * F.col("y")})
    assert cells.agg(F.sum("a")).first()[0] == 638137500


def test_literal_cells(spark):
    got = arrays.literal(spark, "a int, b string", [(1, "p"), None, (4, "q"), (6, None)])
    assert [tuple(r) for r in got.orderBy("x").collect()] == [(0, 1, "p"), (2, 4, "q"), (3, 6, None)]


def test_depart_box():
    meta = ArrayMeta("a", (Dim("x", 0, 49, 10), Dim("y", 5, 33, 10)), ("v",))
    assert arrays.depart_box(meta, (13, -9), (25, 20)) == {"x": (10, 29), "y": (5, 24)}
    assert arrays.depart_box(meta, (49, 30), (99, 99)) == {"x": (40, 49), "y": (25, 33)}
    with pytest.raises(ValueError):
        arrays.depart_box(meta, (3, 5), (2, 5))


def test_catalogue(spark):
    found = arrays.Catalogue(spark)
    found.register(Array(META, spark.range(5).select(F.col("id").alias("x"), F.lit(1.0).alias("val"))))
    assert found.list().count() == 1 and found.dimensions("t").first()["chunk"] == 5 and spark.table("t").count() == 5
    one = found.persist("p", spark.range(3))
    assert found.persist("p", spark.range(9)) is one
    found.persist("s", spark.range(3), synopsis=True)
    assert found.control("clear_syn_cache") == 1 and found.control("clear_cache") == 1
    with pytest.raises(ValueError):
        found.control("clear")
    found.remove("t")


def test_dimension_mapping(spark):
    rows = spark.createDataFrame([("ccc",), ("aaa",), ("bbb",), ("aaa",), (None,)], "a string")
    assert sorted(map(tuple, arrays.dimension_mapping(rows, "a").collect())) == [("aaa", 0), ("bbb", 1), ("ccc", 2)]


def test_synopsis_names_and_grid(spark):
    assert synopsis.parse_synopsis_name("wave_ABP_1x100") == {"kind": "aggregate", "array": "wave", "attr": "ABP", "sizes": (1, 100)}
    assert synopsis.parse_synopsis_name("paa_128_wave_ABP_1x200")["window"] == 128
    with pytest.raises(ValueError):
        synopsis.parse_synopsis_name("nothing")
    with pytest.raises(ValueError):
        synopsis.build_synopsis(spark.range(1), META, "val", (4,), {"x": (2, 9)})
    axis = [Axis("x", Domain(0, 19, 4), Domain(4, 8, 4), 19)]
    syn = [synopsis.Synopsis("s", None, ("x",), (0,), (s,)) for s in (2, 4, 3)]
    assert synopsis.choose_synopsis(axis, syn).sizes == (4,)


def test_load_blocks_leaves_out_empty_ones(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 2), (1, float("nan"), 2.0, 3.0, 2), (2, 1.0, 1.0, 0.0, 0), (3, None, 1.0, 1.0, 1)], "x int, min double, max double, sum double, count long")
    assert [r["x"] for r in synopsis.load_blocks(rows).collect()] == [0]


def test_mandatory_values_count_first():
    # One block of five 5 and 0s, another with a certain 2: skipping an optional 0 too early would miss the mean of 7/3.
    assert synopsis.tight_average([(0.0, 5.0, 10.0, 3, 2, 3), (2.0, 2.0, 2.0, 1, 0, 1)], False) <= 7 / 3 + 1e-9


def test_distances_reject_gaps(spark):
    series = spark.createDataFrame([(1, t, None if t == 6 else float(t % 3)) for t in range(12) if t != 2], "record int, tick long, v double")
    got = sequence.squared_distances(series, "record", "tick", F.col("v"), [1.0, 1.0], Domain(0, 11), 11)
    want = {t: sum((v - 1) ** 2 for v in ((t % 3), ((t + 1) % 3))) for t in range(11) if not {t, t + 1} & {2, 6}}
    assert {r["start"]: r["sqdist"] for r in got.collect()} == want


def test_paa_and_dft():
    assert sequence.paa([1, 3, 5, 7, 9], 4, 2) == [[2.0, 6.0]]
    f = sequence.dft([1.0, 2.0, 3.0, 4.0], 4, 3)[0]
    assert f == pytest.approx([5.0, 0.0, -1.0])


def test_features_over_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=200)
    series = spark.createDataFrame([(7, t, float(x)) for t, x in enumerate(v) if t not in (50, 51)], "record int, tick long, v double")
    monkeypatch.setattr(sequence, "TILE", 32)
    got = {r["start"]: r["f"] for r in sequence.dft_features(series, "record", "tick", "v", 8, 4).collect()}
    starts = [t for t in range(193) if not {50, 51} & set(range(t, t + 8))]
    assert sorted(got) == starts
    for t in starts:
        assert got[t] == pytest.approx(sequence.dft(v[t : t + 8], 8, 4)[0])
    rows = series.select("record", "tick", F.col("v").alias("_v"))
    wide = sequence.sliding(rows, "record", "tick", 8, lambda w: [F.sum("_v").over(w.rangeBetween(0, 7)).alias("s")], tile=32)
    sums = {r["tick"]: r["s"] for r in wide.collect()}
    assert len(sums) == 198 and all(sums[t] == pytest.approx(sum(v[t : t + 8])) for t in starts)


def test_lower_bounds_lose_nothing(spark):
    rng = np.random.default_rng(3)
    series = spark.createDataFrame([(r, t, float(x)) for r in range(4) for t, x in enumerate(np.cumsum(rng.normal(size=60)))], "record int, tick long, v double")
    query = [float(x) for x in np.cumsum(rng.normal(size=16))]
    exact = sequence.squared_distances(series, "record", "tick", F.col("v"), query, Domain(0, 59), 59)
    boxes = sequence.rectangles(sequence.paa_features(series, "record", "tick", F.col("v"), 8, 4), "record", 5, 4)
    near = sequence.starts_within(boxes, "record", 5, query, 8, 4, 150.0, Domain(0, 59), 59)
    bound = {(r["record"], r["start"]): r["bound"] for r in near.collect()}
    for r in exact.where("sqdist <= 150").collect():
        assert bound[r["record"], r["start"]] <= r["sqdist"] + 1e-9


def test_files(spark, tmp_path):
    files.write_sequence(f"{tmp_path}/q", [10.0, 10.5])
    assert files.read_sequence(f"{tmp_path}/q") == [10.0, 10.5]
    (tmp_path / "short").write_text("3 1 2")
    with pytest.raises(ValueError):
        files.read_sequence(f"{tmp_path}/short")
    types = ["int64", "double null", "string", "string null", "uint64"]
    rows = [(1, 2.5, "ab", None, 2**63), (-1, None, "", "é", 0)]
    data = b"".join(files.pack_row(types, r) for r in rows)
    assert list(files.unpack_rows(types, data)) == rows
    with pytest.raises(ValueError):
        files.pack_row(["string"], (None,))
    packed = files.binary_rows(spark.createDataFrame([(3, None)], "a long, b double"), ["int64", "double null"])
    assert packed.first()["row"] == files.pack_row(["int64", "double null"], (3, None))
    (tmp_path / "p.csv").write_text("1,2.5\n2,x\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_points(spark, f"{tmp_path}/p.csv").collect()
    files.write_limited(spark.range(10).coalesce(1), f"{tmp_path}/lim", 4)
    assert len(list((tmp_path / "lim").glob("part-*.csv"))) == 3
    assert 200 < files.synthetic_grid(spark, 20, 4, 50, 5, 0.8, 1).count() < 400


def test_waveform_fills_inner_gaps_only(spark):
    series = spark.createDataFrame([(1, 3, 5), (1, 6, None), (1, 8, 7), (2, 4, 9)], "record int, tick long, v int")
    got = files.waveform(series, 1, 2, 10, "v").orderBy("tick").collect()
    assert [tuple(r) for r in got] == [(2, 0), (3, 5), (4, 0), (5, 0), (6, 0), (7, 0), (8, 7)]
    assert files.waveform(series, 5, 0, 10, "v").count() == 0


def test_segments(spark):
    seg = files.segment_starts(spark.createDataFrame([(1, 0, 10), (1, 1, 0), (1, 2, 5), (1, 3, None)], "record int, segment int, Ticks long"))
    assert [r["StartTick"] for r in seg.orderBy("segment").collect()] == [0, 10, 10, 15]
    ticks = spark.createDataFrame([(1, t) for t in (0, 9, 10, 14, 15)], "record int, tick long")
    got = files.tick_to_segment(ticks, seg, 4).orderBy("tick").collect()
    assert [(r["tick"], r["segment"], r["offset"]) for r in got] == [(0, 0, 0), (9, 0, 9), (10, 2, 0), (14, 2, 4)]


def test_times_and_registries(spark):
    row = spark.range(1).select(expressions.ticks_to_interval(F.lit(126)).alias("d"), *[F.unix_seconds(expressions.parse_header_time(F.lit(t))) for t in ("10:00:00.500 01/02/2020", "10:00:00 01/02/2020", "01/02/2020 10:00:00")], expressions.parse_header_time(F.lit("?")).alias("n")).first()
    assert row["d"].total_seconds() == pytest.approx(1.008) and row[1] == row[2] == row[3] and row["n"] is None
    expressions.register_aggregate("spread", lambda c: F.max(c) - F.min(c))
    got = spark.range(5).agg(expressions.aggregate("spread", F.col("id")), expressions.aggregate("median", F.col("id"))).first()
    assert tuple(got) == (4, 2.0)
    assert spark.range(1).select(expressions.pairwise_max(F.lit(1), F.lit(None).cast("int"))).first()[0] is None
    assert expressions.tokens("a_b__c") == ["a", "b", "c"]


def test_results_as_text(spark):
    rows = spark.createDataFrame([(0, 1, 0.0, 0.87654), (2, 3, 0.5, 0.1)], "id long, time long, rd double, rank double")
    text = tasks.result_strings(rows)
    assert [r[0] for r in text.collect()] == ["id=0, time=1, rd=0.0, rank=0.876", "id=2, time=3, rd=0.5"]
    assert [tuple(r) for r in tasks.parse_results(text, ["id", "time", "rd"]).collect()] == [(0, 1, 0.0), (2, 3, 0.5)]


def test_online(spark):
    make = lambda part: spark.range(part.lo, part.hi + 1)
    assert [r["id"] for r in OnlineSearch(spark, make, Domain(0, 99), slices=7)] == list(range(100))
    some = OnlineSearch(spark, make, Domain(0, 99), slices=4, limit=5)
    assert len(list(some)) == 5 and some.statistics()["results"] == 5
    stopped = OnlineSearch(spark, make, Domain(0, 99))
    for row in stopped:
        if row["id"] == 3:
            stopped.cancel()
    assert stopped.sent == 4
    assert len(list(OnlineSearch(spark, make, Domain(0, 99), deadline_s=0.0))) == 0


def test_config():
    c = Config({"a": {"b": "5", "c": True}})
    assert c.num("a.b") == 5 and c.flag("a.c") and c.get("a.x", 7) == 7 and c.set("q.r", 1).get("q.r") == 1
    with pytest.raises(ValueError):
        c.need("z")
    assert [(d.lo, d.hi) for d in Domain(0, 9, 2).slices(2)] == [(0, 4), (6, 8)] and math.prod((Domain(0, 9, 2).last, 1)) == 8
