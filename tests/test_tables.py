import hashlib

import pytest
from judge_jobs import schemas
from judge_jobs.operators import effects, reshape, sampling, validation
from judge_jobs.sources import tables
from pyspark.sql import functions as F

DIMS = ("coherence", "consistency", "fluency", "relevance")


def raw(spark, docs=3, models=4, short=False):
    rows = [(f"d{k}", f"article {k}", [f"s{m}" for m in range(models)], ["h"] * 11, [3.0] * models, [4.0] * models, [5.0] * (models - short), [2.5] * (models + 2)) for k in range(docs)]
    return spark.createDataFrame(rows, schemas.RAW)


def test_to_long(spark):
    long = reshape.to_long(raw(spark))
    rows = long.collect()
    assert len(rows) == 12 and long.columns == schemas.SCORED.fieldNames()
    r = next(r for r in rows if r.doc_id == "d1" and r.model_index == 2)
    assert (r.article, r.summary, r.coherence, r.relevance) == ("article 1", "s2", 3.0, 2.5)
    with pytest.raises(Exception, match="fewer scores than summaries in d0"):
        reshape.to_long(raw(spark, 1, short=True)).collect()


def test_report(spark):
    long = reshape.to_long(raw(spark))
    good = validation.report(long, docs=3, models=4).first()
    assert good.passed and good.errors == [] and (good.n_rows, good.n_unique_docs) == (12, 3)
    assert validation.require(long, docs=3, models=4) is long
    bad = long.withColumns({"coherence": F.when(F.col("doc_id") == "d0", 7.0).otherwise(F.col("coherence")), "summary": F.when(F.col("model_index") == 1, " \u2003").otherwise(F.col("summary")), "article": F.when(F.col("doc_id") == "d1", None).otherwise(F.col("article"))})
    found = validation.report(bad.where("doc_id <> 'd2' or model_index > 0"), docs=100, models=4).first()
    assert found.errors == ["null values found in columns: ['article']", "expected 100 unique docs, found 3", "docs with != 4 models: {d2: 3}", "4 rows with coherence outside [1.0,5.0]", "3 rows with empty summary text"]
    assert not found.passed and found.n_bad_docs == 1
    assert validation.report(long.drop("fluency")).first().errors == ["missing columns: ['fluency']"]
    with pytest.raises(RuntimeError, match="expected 5 unique docs"):
        validation.require(long, docs=5, models=4)


def test_contract(spark):
    long = reshape.to_long(raw(spark, 1)).withColumn("fluency", F.when(F.col("model_index") == 1, 9.0).when(F.col("model_index") == 2, float("nan")).otherwise(F.col("fluency")))
    valid, bad = reshape.split_valid(long, models=3)
    assert valid.count() == 1
    assert {r.model_index: r.violations for r in bad.collect()} == {1: ["fluency out of range"], 2: ["fluency out of range"], 3: ["model_index out of range"]}


def test_keys_spread_missing(spark):
    df = spark.createDataFrame([("a::b", 3)], "d string, m int").select(reshape.item_key(F.col("d"), F.col("m")).alias("k"))
    doc, model = reshape.split_key(F.col("k"))
    assert tuple(df.select(doc, model).first()) == ("a::b", 3)
    scores = spark.createDataFrame([(1.0, 2.0, float("nan"), 5.0)], ", ".join(f"{d} double" for d in DIMS))
    assert reshape.spread(scores).first().spread == 4.0
    pairs = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (float("nan"), 1.0)], "judge_score double, human_score double")
    assert reshape.complete(pairs).count() == 1


def test_csv_round_trip(spark, tmp_path):
    rows = [("d1", 0, "fluency", 3.5, 'He said "4",\nmaybe', 4, True, "note, with comma"), ("d2", 1, "fluency", 2.0, "none", None, False, "no number found in response")]
    tables.write_csv(spark.createDataFrame(rows, schemas.JUDGE_RESULTS), str(tmp_path / "r"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "r"), schemas.JUDGE_RESULTS).collect())) == rows


def test_telemetry_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert tables.read_telemetry(spark, path).count() == 0
    event = ("i", "fluency", "pointwise", "mock", "m", 1000.0, 250.0, False, False, 2, "timeout", {"prompt_tokens": "512"})
    for _ in range(2):
        tables.append_telemetry(spark.createDataFrame([event], schemas.TELEMETRY), path)
    (tmp_path / "log" / "part-blank.txt").write_text("\n  \n")
    assert [tuple(r) for r in tables.read_telemetry(spark, path).collect()] == [event, event]
    (tmp_path / "log" / "part-bad.txt").write_text("{not json\n")
    with pytest.raises(Exception):
        tables.read_telemetry(spark, path).collect()


def test_summary_glob(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_summaries(spark, str(tmp_path / "*.csv"))
    tables.write_csv(spark.createDataFrame([], schemas.SENSITIVITY), str(tmp_path / "a.csv"))
    assert tables.read_summaries(spark, str(tmp_path / "*.csv")).columns == schemas.SENSITIVITY.fieldNames()


def test_quarantine(spark, tmp_path):
    """Records that don't fit go aside whole, whatever columns are asked for."""
    (tmp_path / "r.csv").write_text("dimension,n,pearson_r\nfluency,5,0.5\ncoherence,many,0.25\n\"a,b\",,\n")
    schema = "dimension string, n long, pearson_r double"
    good, bad = tables.read_quarantined(spark, str(tmp_path / "r.csv"), spark.createDataFrame([], schema).schema)
    assert sorted(map(tuple, good.collect()), key=str) == [("a,b", None, None), ("fluency", 5, 0.5)]
    assert good.count() == 2 and good.select("dimension").count() == 2
    assert [r._corrupt_record for r in bad.collect()] == ["coherence,many,0.25"] and bad.count() == 1
    (tmp_path / "r.json").write_text('{"dimension": "fluency", "n": 5}\n{broken\n')
    good, bad = tables.read_quarantined(spark, str(tmp_path / "r.json"), good.schema, "json")
    assert [tuple(r) for r in good.collect()] == [("fluency", 5, None)] and [r._corrupt_record for r in bad.collect()] == ["{broken"]


def test_drifted_headers(spark, tmp_path):
    (tmp_path / "a_s.csv").write_text("model_pair,metric,sample_size\nm1,fluency,25\n")
    (tmp_path / "b_s.csv").write_text("sample_size,extra,metric\n50,x,coherence\n")
    (tmp_path / "c_s.csv").write_text("model_pair,metric,sample_size\nm2,fluency,100\n")
    found = tables.read_summaries(spark, str(tmp_path / "*_s.csv"))
    assert found.columns == schemas.SENSITIVITY.fieldNames()
    assert sorted((str(r.model_pair), r.metric, r.sample_size) for r in found.collect()) == [("None", "coherence", 50), ("m1", "fluency", 25), ("m2", "fluency", 100)]


def test_checked_in_one_pass(spark, tmp_path):
    """Good and bad rows are written at once, with a report of the same pass; every bad document is in the table."""
    long = reshape.to_long(raw(spark, 40))
    bad = long.withColumns({"coherence": F.when(F.col("doc_id") == "d0", 7.0).otherwise(F.col("coherence")), "summary": F.when((F.col("model_index") == 1) & (F.col("doc_id") == "d1"), " ").otherwise(F.col("summary"))})
    bad = bad.where("not (doc_id in ('d2', 'd3') and model_index = 0)").unionByName(long.where("doc_id = 'd4'").withColumn("doc_id", F.lit(None).cast("string")))
    path = str(tmp_path / "checked")
    found = validation.write_checked(bad, path, docs=40, models=4).first()
    assert (found.n_rows, found.n_unique_docs, found.n_bad_docs, found.passed) == (162, 40, 2, False)
    assert found.faults == {"null_doc_id": 4, "out_coherence": 4, "blank": 1, "models": 6} and found.n_bad_rows == 15
    held = spark.read.parquet(path)
    assert {r.doc_id for r in held.where(F.array_contains("faults", "models")).collect()} == {"d2", "d3"}
    assert held.where("good = 'true'").count() == 147 and held.where("good = 'true' and size(faults) > 0").count() == 0
    assert validation.write_checked(long, path, docs=40, models=4).first().passed
    with pytest.raises(ValueError, match="missing columns"):
        validation.checked(long.drop("fluency"))
    plan = validation.checked(bad)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0
    empty = validation.write_checked(long.limit(0), path, docs=0, models=4).first()
    assert (empty.n_rows, empty.passed) == (0, True)


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_samples_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("model_index")).repartition(partitions)
    rows = [tuple(r) for r in sampling.rows(df, 10, 42, "doc_id", "model_index").collect()]
    docs = [r.doc_id for r in sampling.documents(df, 5, 42).collect()]
    pairs = {r.doc_id: (r.model_a_idx, r.model_b_idx) for r in sampling.two_models(df, 42).collect()}
    assert rows == [tuple(r) for r in sampling.rows(df.coalesce(1), 10, 42, "doc_id", "model_index").collect()]
    assert len(set(rows)) == 10 and len(set(docs)) == 5 and len(pairs) == 200 and all(a != b for a, b in pairs.values())
    assert sampling.rows(df, 9999, 1, "doc_id", "model_index").count() == 800
    picked = sampling.subsamples(spark.range(30).withColumnRenamed("id", "doc_id").repartition(partitions), 7, 3, 1).collect()
    assert len(picked) == 21 and len({(r.trial, r.doc_id) for r in picked}) == 21


def test_effects(spark):
    rows = [(d, m, "x", float(s)) for d, scores in enumerate([(1, 2, 5), (3, 4, 5), (5, 9, 5)]) for m, s in enumerate(scores)]
    long = spark.createDataFrame(rows, "doc_id int, model_index int, metric string, score double")
    found = {(r.model_a, r.model_b): r for r in effects.effect_sizes(long).collect()}
    assert len(found) == 3 and found[0, 1].mean_diff == pytest.approx(-2)
    assert found[0, 1].cohens_d == pytest.approx(-2 / ((8 / 3 + 26 / 3) / 2) ** 0.5)
    assert effects.span(effects.effect_sizes(long)).first().n_pairs == 3
    flat = long.withColumn("score", F.lit(2.0))
    assert {r.cohens_d for r in effects.effect_sizes(flat).collect()} == {0.0}
    assert effects.unmatched(long.where("not (doc_id = 0 and model_index = 1)"), 0, 1).first().asDict() == {"metric": "x", "n_both": 2, "only_a": 1, "only_b": 0}


def test_samples_are_cut_before_they_move(spark):
    """Hashes that can't be among a sample's smallest are dropped before the sort and the shuffle."""
    df = spark.range(1000).withColumnRenamed("id", "doc_id").repartition(3)
    found = sampling.subsamples(df, 7, 3, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the plan is printed from its end to its start: what is cut is kept, and only then moved
    moved, held, made = (plan.index(x) for x in ("Exchange hashpartitioning(trial", "InMemoryRelation", "Generate explode"))
    assert moved < held < made and "Filter" in plan[held:made] and "Exchange" not in plan[held:made]
    assert found.count() == 21


def test_subsamples_by_group_are_the_smallest_hashes(spark):
    """A group smaller than its sample, a null group, and a key with most rows, which the first cut may leave out; against brute force."""
    rows = [("large", k) for k in range(3000)] + [("small", k) for k in range(5)] + [(None, k) for k in range(40)]
    rows += [("hot", 1)] * 2000 + [("hot", k) for k in range(2, 12)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "g string, doc_id long, row long")
    found = {}
    for r in sampling.subsamples(df, 20, 6, 3, by=("g",)).collect():
        found.setdefault((r.g, r.trial), []).append(r.doc_id)
    hashed = lambda t, k: hashlib.md5(f"3:{t}:{k}".encode()).hexdigest()
    want = {(g, t): sorted((k for x, k in rows if x == g), key=lambda k: hashed(t, k))[:20] for g in ("large", "small", "hot", None) for t in range(6)}
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert sampling.subsamples(df.where("false"), 20, 6, 3).count() == 0 and sampling.subsamples(df.where("false"), 20, 6, 3, by=("g",)).count() == 0


def test_checks_sort_once(spark, tmp_path):
    """Rows are sorted for the document's figures once, and not again by the folder they are written to."""
    long = reshape.to_long(raw(spark, 5))
    plan = validation.checked(long)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 1
    before = spark.conf.get(validation.OPEN_FILES)
    with validation._open_files(spark, 2):
        assert spark.conf.get(validation.OPEN_FILES) == "2"
    validation.write_checked(long, str(tmp_path / "checked"), docs=5)
    assert spark.conf.get(validation.OPEN_FILES) == before
