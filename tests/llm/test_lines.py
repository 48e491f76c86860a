import random

from pyspark.sql import functions as F

from gridquarry.llm import line_dedup
from gridquarry.llm.line_dedup import _open, _quick_signatures, brute_force, dedup_lines, op1_line_dedup, removed_lines, signatures

DOCS = "doc_id long, text string, id string, row string, pos string, removed string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], DOCS)


def fixture():
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "zu") for b in ("ran", "tel", "pos") for c in ("", "ing", "ed")]
    line = lambda n: " ".join(rng.choices(words, k=n))
    common = line(14)

    def near(text):
        w = text.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    rows = [(i, "\n".join([line(rng.randrange(3, 20)) for _ in range(4)] + [near(common) if i % 3 else common, "", "  "])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "ab\nab\nabc\n  ab\t"), (103, "-----\n-----\n=====" ), (104, "字" * 60 + "\n" + "字" * 60 + "x"), (105, line(6000)), (None, rows[0][1].split("\n")[0] + "\nonly here " + line(9)), (106, "\n\n")]
    return rows


def test_lines_agree_with_brute_force(spark):
    rows = fixture()
    got = {(r["id"]): r["removed"] for r in removed_lines(docs(spark, rows).repartition(3)).collect()}
    want = {rows[k][0]: v for k, v in brute_force(rows).items()}
    wrong = [i for i in {*got, *want} if got.get(i) != want.get(i)]
    assert not wrong, [(i, got.get(i), want.get(i)) for i in wrong]


def test_dedup_lines_keeps_rows_and_columns(spark):
    rows = [*fixture(), (102, "ab\nab\nabc\n  ab\t")]
    out = dedup_lines(docs(spark, rows))
    assert out.columns == [x.split()[0] for x in DOCS.split(", ")] and out.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    gone = brute_force(rows[:-1])
    for k, (i, t) in enumerate(rows[:-1]):
        assert texts[i] == (t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(k, [])))
    assert dedup_lines(docs(spark, [])).count() == 0 and removed_lines(docs(spark, [(1, None)])).count() == 0


def test_op1_on_a_table_finds_what_brute_force_finds(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = brute_force([(r["doc_id"], r["text"]) for r in table])
    got = {r["doc_id"]: [int(x) for x in r["removed"].split(",") if x] for r in op1_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(table)
    found = sum(len(v) for v in got.values())
    assert found >= 0.99 * sum(map(len, want.values())) and all(set(v) <= set(want.get(i, [])) for i, v in got.items())


def found_and_wanted(spark, lines):
    rows = [(k, line) for k, line in enumerate(lines)]
    got = {r["id"] for r in removed_lines(docs(spark, rows).repartition(3)).collect()}
    return got, set(brute_force(rows))


def test_lines_without_spaces_are_candidates_by_all_their_shingles(spark):
    rng = random.Random(6)
    some = lambda n, of="abcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choices(of, k=n))
    lines = []
    for _ in range(40):
        url, code, row = "http://" + some(90), some(100), [some(11) for _ in range(9)]
        lines += [url, "https" + url[4:], code, "#" + code[1:-1] + "#", "\t".join(["2024-01-05", *row, "17"]), "\t".join(["2024-01-06", *row, "18"])]
    got, want = found_and_wanted(spark, lines)
    assert len(want) >= 110 and len(got & want) >= 0.98 * len(want) and got <= want


def test_near_copies_in_a_template_with_many_variants_meet(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    template = [some(7) for _ in range(14)]
    lines = []
    for _ in range(500):
        own = " ".join([*template, *(some(7) for _ in range(5))])
        lines += [own, own[:-9] + some(9)]
    got, want = found_and_wanted(spark, lines)
    assert len(want) >= 400 and len(got & want) >= 0.99 * len(want) and got <= want


def test_quick_signatures_are_those_with_borrowed_values_and_leave_lines_with_empty_bins(spark):
    rng = random.Random(10)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    texts = [some(n) for n in (1, 4, 9, 20, 60) for _ in range(8)] + [some(600) for _ in range(60)] + ["-" * 900]
    lines = spark.createDataFrame(list(enumerate(texts)), "lid long, line string").repartition(3, "lid")
    quick, full = ({r["lid"]: r["bands"] for r in of(lines).collect()} for of in (_quick_signatures, signatures))
    assert len(quick) == len(full) == len(texts) and all(full.values())
    assert all(quick[k] is None for k, t in enumerate(texts) if len(t) < 20) and quick[len(texts) - 1] is None
    signed = [k for k, v in quick.items() if v is not None]
    assert len(signed) >= 60 and all(quick[k] == full[k] for k in signed)


def test_pairs_of_small_bands_are_found_without_fine_bitmaps(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("no band here is large")

    monkeypatch.setattr(line_dedup, "_with_sets", unwanted)
    rng = random.Random(12)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    lines = [x for k in range(60) for own in [some(120)] for x in (own, own[: 119 - k % 40] + "#" + own[120 - k % 40 :], own[:60] + some(60))]
    got, want = found_and_wanted(spark, lines)
    assert len(want) >= 60 and got == want


def test_bitmaps_rule_out_only_what_cannot_reach_the_threshold(spark):
    cases = [(9, 9, 2), (9, 9, 3), (10, 8, 2), (45, 45, 10), (45, 45, 11), (40, 50, 10), (7, 7, 0), (90_000_000, 90_000_000, 20_000_000)]
    rows = spark.createDataFrame([((p,), (q,), d) for p, q, d in cases], "gp struct<size: long>, gq struct<size: long>, d long")
    got = [r[0] for r in rows.select(_open(F.col("d"), 0.8)).collect()]
    assert got == [5 * (p + q - d) >= 4 * (p + q + d) for p, q, d in cases]
