import os

from gridquarry.llm import common, language_id, near_dedup, packing


def test_workers_get_few_whole_texts_at_a_time(spark, monkeypatch):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(setting), {}

    def cut(df, what):
        seen[what] = int(spark.conf.get(setting))
        return common.cut(df, what)

    for module in (language_id, near_dedup, packing):
        monkeypatch.setattr(module, "cut", cut)
    docs = spark.createDataFrame([(k, f"some words of text {k} to tell apart", "en" if k % 2 else "de", "a") for k in range(8)], "doc_id long, text string, lang string, source string")
    assert language_id.identify(docs).count() == near_dedup.sets_of(docs, "doc_id", "text", 5, True).count() == packing.pack_documents(docs).count() == 8
    assert all(seen[what] <= common.BATCH_ROWS for what in ("language", "sets", "pieces")) and spark.conf.get(setting) == before


def test_a_worker_gives_back_what_it_has_freed(monkeypatch):
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20  # noqa: E731, SIM115

    def run(batches):
        for batch in batches:
            blocks = [bytes(4000) for _ in range(40_000)]
            last.append(blocks[-1])  # what lies at the end keeps the rest from being returned
            del blocks
            yield batch

    last: list[bytes] = []
    assert list(run([1])) == [1]
    full = held()
    assert list(common.lean(run)([1, 2])) == [1, 2]
    assert held() < full - 60
