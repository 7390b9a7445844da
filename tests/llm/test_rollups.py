from collections import Counter

from judge_jobs.llm import rollups
from judge_jobs.llm.common import shared_dir

SCHEMA = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int"


def state(totals):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in totals.read().collect()}


def test_batches_commit_once(spark):
    totals = rollups.Totals(spark, shared_dir(spark, "totals"))
    assert state(totals) == {} and totals.batches().count() == 0
    df = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    assert totals.commit("a", df((1, "s", "en", "w@1", 5, 1), (2, "s", "en", "w@1", 7, None), (3, None, "de", "w@1", None, 1)))
    first = {("s", "en", "w@1"): (2, 12), (None, "de", "w@1"): (1, 0)}
    assert state(totals) == first
    assert not totals.commit("a", df((1, "s", "en", "w@1", 5, 1)))
    assert state(totals) == first
    assert totals.commit("b", df((1, "s", "en", "w@1", 5, -1), (1, "s", "en", "w@2", 6, 1), (3, None, "de", "w@1", 0, -1)))
    assert state(totals) == {("s", "en", "w@1"): (1, 7), ("s", "en", "w@2"): (1, 6)}
    assert {r.batch_id for r in totals.batches().collect()} == {"a", "b"}
    assert totals.commit("c", df())


def test_two_writers_take_different_versions(spark):
    path = shared_dir(spark, "totals")
    a, b = rollups.Totals(spark, path), rollups.Totals(spark, path)
    assert a._mark(1, "v1-x") and not b._mark(1, "v1-y")


def test_half_written_version_is_not_seen(spark):
    path = shared_dir(spark, "totals")
    totals = rollups.Totals(spark, path)
    totals.commit("a", spark.createDataFrame([(1, "s", "en", "w@1", 5, 1)], SCHEMA))
    spark.range(3).write.parquet(f"{path}/v000000002-dead/totals")  # a writer that died before its marker
    assert state(totals) == {("s", "en", "w@1"): (1, 5)}
    assert totals.commit("b", spark.createDataFrame([(2, "s", "en", "w@1", 5, 1)], SCHEMA))
    assert state(totals) == {("s", "en", "w@1"): (2, 10)}


def test_changes_turn_old_into_new(spark):
    columns = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    old = spark.createDataFrame([(1, "s", "en", "w", 5), (2, "s", "en", "w", 6), (3, "s", None, "w", 7)], columns)
    new = spark.createDataFrame([(2, "s", "en", "w", 9), (3, "s", None, "w", 7), (4, "t", "en", "w", 1)], columns)
    got = {(r.doc_id, r.n_tokens, r.sign) for r in rollups.changes(old, new).collect()}
    assert got == {(1, 5, -1), (2, 6, -1), (2, 9, 1), (4, 1, 1)}


def test_changes_of_repeated_rows_and_nulls(spark):
    columns = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    row = (1, "s", "en", "w", 5)
    old = spark.createDataFrame([row, row, (None, None, None, "w", None)], columns)
    new = spark.createDataFrame([row, (2, "s", "en", "w", 6), (2, "s", "en", "w", 6)], columns)
    got = {(r.doc_id, r.n_tokens, r.sign) for r in rollups.changes(old, new).collect()}
    assert got == {(1, 5, -1), (None, None, -1), (2, 6, 2)}
    totals = rollups.Totals(spark, shared_dir(spark, "totals"))
    totals.commit("a", rollups.changes(old.limit(0), old))
    totals.commit("b", rollups.changes(old, new))
    assert state(totals) == {("s", "en", "w"): (3, 17)}
    assert rollups.changes(old, old).count() == 0


def test_history_over_a_corpus(spark, docs, texts, odd, empty):
    import re

    want_docs, want = Counter(), Counter()
    meta = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    for i, t in texts:
        if i % 10 != 3:
            for name, pattern in rollups.PATTERNS.items():
                want_docs[(*meta[i], name)] += 1
                want[(*meta[i], name)] += len(re.findall(pattern, t or "")) + (i % 7 == 1)
    got = rollups.maintained(docs, shared_dir(spark, "totals")).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == {k: (want_docs[k], want[k]) for k in want}
    assert rollups.maintained(empty, shared_dir(spark, "totals")).count() == 0
    found = rollups.maintained(odd, shared_dir(spark, "totals")).collect()
    assert sum(r.n_docs for r in found if r.tokenizer == "words@1") == odd.where("doc_id is null or doc_id % 10 <> 3").count()


