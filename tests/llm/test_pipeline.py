import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gridquarry.llm import line_dedup, near_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCAB = {"en": "the house and river were with this that from over under water light".split(), "de": "das haus und der fluss waren mit nicht durch über wasser licht".split()}


def fixture():
    rng = random.Random(8)
    line = lambda lang, n: " ".join(rng.choice(VOCAB[lang]) + rng.choice("abcdefgh") + rng.choice("ijklm") for _ in range(n))
    rows = []
    for i in range(90):
        lang = "de" if i % 4 == 0 else "en"
        rows.append((i, "\n".join(line(lang, rng.randrange(8, 30)) for _ in range(rng.randrange(1, 6))), lang, f"s{i % 3}"))
    rows += [(100 + i, rows[i][1], rows[i][2], "copies") for i in range(5)]
    rows += [(200, rows[1][1] + "\n" + line("en", 20), "en", "s1"), (201, None, "en", "s0"), (202, "", None, None), (203, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(900)), None, "s2")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_each_stage_agrees_with_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == COLUMNS
    texts = lambda name: {r["doc_id"]: r["text"] for r in seen[name]}
    assert texts("language_id") == {r[0]: r[1] for r in rows if r[0] != 203}
    given = sorted(texts("language_id").items())
    gone = line_dedup.brute_force(given)
    want = {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(k, [])) for k, (i, t) in enumerate(given)}
    assert texts("line_dedup") == want
    kept = {i for i, _, c in near_dedup.brute_force(sorted(want.items()), 5, 80) if i == c}
    assert texts("near_dedup") == {i: t for i, t in want.items() if i in kept}
    often = Counter(r["doc_id"] for r in seen["mixing"])
    assert set(often) <= kept and max(often.values()) <= 2 and all((want[r["doc_id"]] or "").startswith(r["text"] or "") and r["n_chars"] == len(r["text"] or "") for r in seen["mixing"])
    words = defaultdict(int)
    for r in seen["mixing"]:
        words[r["source"]] += len((r["text"] or "").split())
    assert abs(sum(words.values()) - 1.5 * sum(len((want[i] or "").split()) for i in kept)) <= len(words)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for r in seen["mixing"]:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for start in range(0, len(ids), 2048):
            pieces[(r["doc_id"], start, zlib.crc32(ids[start : start + 2048].tobytes()))] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in seen["packing"]) == pieces
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])
