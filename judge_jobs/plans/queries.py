"""Registered queries: each operation of the inventory over whole test tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..fixed import DIMENSIONS
from ..functions import padding, parsing, prompts
from ..operators import calibration as cal
from ..operators import effects, exact_draws, judging, pairwise, resampling, reshape, sampling, telemetry, validation, verbosity
from ..sources import tables
from .views import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> dict[str, Column]:
    """Doubles rounded to six places, NaN as null."""
    return {c: F.round(F.when(~F.isnan(c), F.col(c)), 6) for c in names}


def longs(*names: str) -> dict[str, Column]:
    return {c: F.col(c).cast("long") for c in names}


def long_panel(spark, d) -> DataFrame:
    """metric, score: one row for each article, model and metric."""
    return view(spark, d, "panel").unpivot(["doc_id", "model_index"], list(DIMENSIONS), "metric", "score")


def judged(spark, d) -> DataFrame:
    results = view(spark, d, "judge_results")
    return results.withColumn("p", parsing.score(F.col("raw_response"))).select("doc_id", "model_index", "dimension", "human_score", "raw_response", F.col("p.score").alias("judge_score"), "p.parse_ok", "p.parse_note")


def both_orders(spark, d, name="pair_calls") -> DataFrame:
    return pairwise.both_orders(pairwise.winners(view(spark, d, name), "pairwise_cot"))


def debiased(spark, d) -> DataFrame:
    """Third calls answer as the order they repeat did."""
    calls = pairwise.winners(view(spark, d, "pair_calls"), "pairwise_cot")
    both = pairwise.both_orders(calls)
    third = pairwise.second_round(both, 7).join(calls.select("doc_id", "dimension", "ord", "winner"), ["doc_id", "dimension", "ord"])
    return pairwise.debias(both, third)


def padded_scores(spark, d) -> DataFrame:
    """Scores of the original and the padded summary of each document, by dimension."""
    texts = view(spark, d, "summaries").select("doc_id", F.col("summary").alias("original_text"), padding.verbose(F.col("summary"), F.col("seed")).alias("verbose_text"))
    h = lambda p: F.conv(F.substring(F.md5(F.concat(F.lit(f"{p}:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("dimension"))), 1, 8), 16, 10).cast("long") % 5 + 1
    each = texts.withColumn("dimension", F.explode(F.array(*map(F.lit, DIMENSIONS))))
    return verbosity.compare(each.withColumns({"original_score": h("o").cast("int"), "verbose_score": h("w").cast("int")}))


def pair57(spark, d) -> DataFrame:
    """Scores of models 1 and 2 on the same articles."""
    return effects.paired_dimensions(view(spark, d, "panel"), 1, 2, DIMENSIONS).withColumn("model_pair", F.lit("m1v2"))


# ---- sources and sinks ----


@query
def s1_read_raw(spark, d):
    """The wide table written as JSON lines, read with its schema, and long again."""
    from uuid import uuid4

    path, wide = _scratch(spark, f"raw-{uuid4().hex}"), view(spark, d, "wide").withColumns({"text": F.lit(""), "machine_summaries": F.transform("coherence", lambda x: F.lit(""))})
    wide.write.json(path)
    long = reshape.to_long(tables.read_raw(spark, path, "json"))
    return long.groupBy("model_index").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 6).alias(c) for c in DIMENSIONS]).withColumns(longs("model_index"))


@query
def s2_read_csv(spark, d):
    """Judge results written as CSV with quotes and line feeds in the answers, and read again; records that don't fit go to quarantine."""
    from uuid import uuid4

    path = _scratch(spark, f"results-{uuid4().hex}")
    odd = F.concat(F.lit('said "'), F.col("raw_response"), F.lit('",\nthen more'))
    results = judged(spark, d).withColumns({"raw_response": F.when(F.col("model_index") % 2 == 0, odd).otherwise(F.col("raw_response")), "doc_id": F.col("doc_id").cast("string")})
    kept = results.select(schemas.JUDGE_RESULTS.fieldNames())
    tables.write_csv(kept.withColumn("model_index", F.when(F.col("model_index") == 3, "three").otherwise(F.col("model_index").cast("string"))), path)
    good, bad = tables.read_quarantined(spark, path, schemas.JUDGE_RESULTS)
    rows = good.groupBy("dimension").agg(F.count("*").alias("n"), F.sum(F.length("raw_response")).alias("n_chars"), F.count("judge_score").alias("n_scored"))
    return rows.unionByName(bad.agg(F.lit("quarantine").alias("dimension"), F.count("*").alias("n"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("long").alias("n_scored")))


@query
def s3_read_summaries(spark, d):
    """Two studies' summaries in files of different column order and number, read by a pattern."""
    from uuid import uuid4

    path = _scratch(spark, f"studies-{uuid4().hex}")
    full = long_panel(spark, d).groupBy("metric").agg(F.count("*").alias("n_trials"), F.avg("score").alias("full_sample_estimate")).withColumns({"model_pair": F.lit("m1"), "sample_size": F.lit(25)})
    tables.write_csv(full.where("metric < 'f'").select("model_pair", "metric", "sample_size", "n_trials", "full_sample_estimate"), f"{path}/a_summary.csv")
    tables.write_csv(full.where("metric >= 'f'").select("full_sample_estimate", "metric", "sample_size", "model_pair"), f"{path}/b_summary.csv")
    return tables.read_summaries(spark, f"{path}/*_summary.csv").select("model_pair", "metric", F.col("sample_size").cast("long").alias("sample_size"), "n_trials", F.round("full_sample_estimate", 6).alias("full_sample_estimate"))


@query
def s4_s6_telemetry_roundtrip(spark, d):
    """The log written as JSON lines and read again."""
    from uuid import uuid4

    path = _scratch(spark, f"log-{uuid4().hex}")
    tables.append_telemetry(view(spark, d, "telemetry"), path)
    return telemetry.by_dimension(tables.read_telemetry(spark, path)).withColumns(r6("ok_share", "escalated_share", "mean_latency_ms"))


@query
def s5_committed_append(spark, d):
    """The log appended by two runs, each delivered twice, merged into few files, and read again."""
    from uuid import uuid4

    path, log = _scratch(spark, f"log-{uuid4().hex}"), view(spark, d, "telemetry")
    for run, part in (("even", "started_at % 2 < 1"), ("odd", "started_at % 2 >= 1"), ("even", "true"), ("odd", "true")):
        tables.append_telemetry_once(log.where(part), path, run)
    tables.CommittedTable(spark, path, "value string", "text").compact()
    return telemetry.by_dimension(tables.read_committed_telemetry(spark, path)).withColumns(r6("ok_share", "escalated_share", "mean_latency_ms"))


@query
def s7_partitioned_results(spark, d):
    """Trials written by pair and metric, one metric read back."""
    from uuid import uuid4

    path = _scratch(spark, f"pairs-{uuid4().hex}")
    tables.write_results(pair57(spark, d), path)
    return spark.read.parquet(path).where("metric = 'fluency'").groupBy("model_pair", "metric").agg(F.count("*").alias("n"), F.round(F.sum("score_a"), 6).alias("sum_a"), F.round(F.sum("score_b"), 6).alias("sum_b"))


@query
def s8_resumed_append(spark, d):
    """Judge results appended by two runs, of which the second skips what the first has; both are then repeated, which adds nothing."""
    from uuid import uuid4

    path, results = _scratch(spark, f"results-{uuid4().hex}"), judged(spark, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    keys, found = ("doc_id", "model_index", "dimension"), tables.judge_results_table(spark, path)
    for _ in range(2):
        tables.append_judge_results_once(results.where("dimension = 'fluency' or dimension = 'coherence'"), path, "first")
        tables.append_judge_results_once(telemetry.pending(results, found.read(), keys), path, "second")
    return found.read().groupBy("dimension").agg(F.count("*").alias("n"), F.count("judge_score").alias("n_scored"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A path in the folder all executors share. Only a single machine may go without such a folder."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='spark-shared-')).rstrip('/')}/{name}"


# ---- reshapes, keys, filters ----


@query
def p1_wide_to_long(spark, d):
    wide = view(spark, d, "wide").withColumns({"text": F.lit(""), "machine_summaries": F.transform("coherence", lambda x: F.lit(""))})
    return reshape.to_long(wide).select("doc_id", F.col("model_index").cast("long").alias("model_index"), *DIMENSIONS).withColumns(r6(*DIMENSIONS))


@query
def p2_by_dimension(spark, d):
    return reshape.by_dimension(view(spark, d, "panel"), ["doc_id", "model_index"]).withColumns({**r6("human_score"), **longs("model_index")})


@query
def p3_item_keys(spark, d):
    items = view(spark, d, "panel").select(reshape.item_key(F.col("doc_id"), F.col("model_index")).alias("item_id"))
    doc, model = reshape.split_key(F.col("item_id"))
    return items.select("item_id", doc.alias("doc"), model.cast("long").alias("model"))


@query
def p4_parsed_only(spark, d):
    results = judged(spark, d)
    return reshape.parsed_only(results).groupBy("dimension").agg(F.count("*").alias("n"), F.sum("judge_score").alias("total")).crossJoin(reshape.excluded(results))


@query
def p5_complete_pairs(spark, d):
    scored = judged(spark, d).withColumns({"judge_score": F.when(F.col("judge_score") == 3, F.lit(float("nan"))).otherwise(F.col("judge_score").cast("double"))})
    return reshape.complete(scored).groupBy("dimension").agg(F.count("*").alias("n"), F.round(F.sum("judge_score"), 6).alias("total"))


@query
def p6_one_model(spark, d):
    return long_panel(spark, d).where("model_index = 3 and metric = 'relevance'").select("doc_id", F.round("score", 6).alias("score"))


@query
def p7_point_lookup(spark, d):
    return view(spark, d, "panel").where("doc_id = 7 and model_index = 0").select("doc_id", *DIMENSIONS).withColumns(r6(*DIMENSIONS)).limit(1)


@query
def p8_flagged_documents(spark, d):
    flagged = view(spark, d, "panel").groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 7")
    return reshape.of_documents(view(spark, d, "panel"), flagged).groupBy("model_index").agg(F.count("*").alias("n"), F.round(F.sum("fluency"), 6).alias("total")).withColumns(longs("model_index"))


@query
def p9_spread(spark, d):
    return reshape.spread(view(spark, d, "panel")).select("doc_id", F.col("model_index").cast("long").alias("model_index"), F.round("spread", 6).alias("spread"))


@query
def p10_contract(spark, d):
    """Rows with and without faults (models 5 and up break the contract of five models here)."""
    valid, bad = reshape.split_valid(view(spark, d, "panel").withColumn("fluency", F.when(F.col("doc_id") % 50 == 0, 7.0).otherwise(F.col("fluency"))), models=5)
    broken = bad.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    return broken.unionByName(valid.agg(F.lit("none").alias("rule"), F.count("*").alias("n")))


# ---- validation ----


@query
def v1_report(spark, d):
    found = validation.report(view(spark, d, "panel"), docs=100, models=4, required=("doc_id", "model_index", *DIMENSIONS))
    return found.select("n_rows", "n_unique_docs", "n_bad_docs", "passed", F.size("errors").cast("long").alias("n_errors"), F.element_at("errors", 1).alias("first_error"))


@query
def v2_models_per_doc(spark, d):
    return validation.models_per_doc(view(spark, d, "panel"))


@query
def v3_checked(spark, d):
    """The panel with some scores moved out of range or left out, written in one pass as good and quarantined rows, and read back."""
    from uuid import uuid4

    path, odd = _scratch(spark, f"checked-{uuid4().hex}"), F.col("doc_id") % 10
    panel = view(spark, d, "panel").withColumns({"fluency": F.when(odd == 1, F.col("fluency") + 5).otherwise(F.col("fluency")), "relevance": F.when(odd != 2, F.col("relevance"))})
    validation.write_checked(panel, path, models=4, required=("doc_id", "model_index", *DIMENSIONS))
    return spark.read.parquet(path).groupBy(F.array_join("faults", ",").alias("faults"), (F.col("good") == "true").alias("good")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query
def v3_report(spark, d):
    """The report that the same pass counts."""
    from uuid import uuid4

    found = validation.write_checked(view(spark, d, "panel"), _scratch(spark, f"checked-{uuid4().hex}"), docs=100, models=4, required=("doc_id", "model_index", *DIMENSIONS))
    return found.select("n_rows", "n_unique_docs", "n_bad_docs", "n_bad_rows", "passed", F.element_at("faults", "models").alias("n_models_fault"))


@query
def u4_missing_columns(spark, d):
    """The panel without a dimension and the texts, against all that are required, beside the rows it has."""
    panel = view(spark, d, "panel").drop("relevance")
    found = validation.report(panel).select("n_rows", "passed", F.element_at("errors", 1).alias("error"))
    return panel.agg(F.count("*").alias("n_panel")).crossJoin(found)  # one row each


@query
def v4_profile(spark, d):
    return validation.profile(view(spark, d, "panel")).withColumns(r6("mean", "std", "min", "q25", "q50", "q75", "max"))


@query
def v5_coverage(spark, d):
    return validation.coverage(judged(spark, d))


# ---- joins ----


@query
def j1_paired_scores(spark, d):
    return effects.paired(long_panel(spark, d), 1, 2).withColumns(r6("score_a", "score_b"))


@query
def j1_unmatched(spark, d):
    return effects.unmatched(long_panel(spark, d), 1, 5)


@query
def j3_judge_with_human(spark, d):
    results = judged(spark, d)
    human = view(spark, d, "judge_results").select("doc_id", "model_index", "dimension", F.col("human_score").alias("human"))
    return results.drop("human_score").join(human, ["doc_id", "model_index", "dimension"]).select("doc_id", "dimension", F.col("judge_score").cast("long").alias("judge_score"), F.round("human", 6).alias("human_score"))


@query
def j5_resume(spark, d):
    """Jobs of every user and dimension that the log has not seen."""
    log = view(spark, d, "telemetry")
    jobs = log.select("item_id").distinct().crossJoin(spark.createDataFrame([(x,) for x in DIMENSIONS], "dimension string")).withColumn("judge_type", F.lit("pairwise"))
    return telemetry.pending(jobs, log)


@query
def j5_partly_done(spark, d):
    """Jobs of every item in the log by dimension and type, against the part of the log whose latency is over 50 ms."""
    log = view(spark, d, "telemetry")
    types = spark.createDataFrame([(x, t) for x in DIMENSIONS for t in ("pointwise", "pairwise")], "dimension string, judge_type string")
    jobs = log.select("item_id").distinct().crossJoin(F.broadcast(types))  # eight rows
    return telemetry.pending(jobs, log.where("latency_ms > 50"))


@query
def j6_both_orders(spark, d):
    return both_orders(spark, d).drop("flip_slot")


@query
def j7_compare_studies(spark, d):
    return pairwise.compare_studies(both_orders(spark, d), both_orders(spark, d, "pair_calls_b")).withColumns(r6("rate_a", "rate_b", "change_points"))


# ---- sampling ----


@query
def a1_sample_rows(spark, d):
    return sampling.rows(view(spark, d, "panel"), 100, 42, "doc_id", "model_index").select("doc_id", F.col("model_index").cast("long").alias("model_index"))


@query
def a2_sample_documents(spark, d):
    return sampling.documents(view(spark, d, "panel"), 15, 42)


@query
def a3_two_models(spark, d):
    return sampling.two_models(view(spark, d, "panel"), 42).withColumns(longs("model_a_idx", "model_b_idx"))


@query
def a4_subsamples(spark, d):
    found = sampling.subsamples(pair57(spark, d), 25, 4, 42, by=("metric",))
    return found.select("metric", F.col("trial").cast("long").alias("trial"), "doc_id", F.round(F.col("score_a") - F.col("score_b"), 6).alias("diff"))


# ---- aggregations ----


@query
def g1_g2_calibration(spark, d):
    return cal.by_dimension(judged(spark, d), p_values=False).withColumns(r6("pearson_r", "spearman_r", "mean_absolute_error", "mean_signed_error"))


@query
def g3_calibration_p(spark, d):
    """With p-values."""
    return cal.by_dimension(judged(spark, d)).withColumns(r6("pearson_r", "pearson_p", "spearman_r", "spearman_p", "mean_absolute_error", "mean_signed_error"))


@query
def g4_judge_histogram(spark, d):
    return cal.histogram(judged(spark, d), F.col("judge_score").cast("long"))


@query
def g5_human_histogram(spark, d):
    return cal.histogram(view(spark, d, "judge_results"), cal.rounded(F.col("human_score")).cast("long"))


@query
def g6_bias_summary(spark, d):
    return pairwise.bias_summary(both_orders(spark, d)).withColumns(r6("inconsistency_rate"))


@query
def g7_overall_bias(spark, d):
    return pairwise.overall_bias(both_orders(spark, d)).withColumns(r6("inconsistency_rate"))


@query
def g8_flip_slots(spark, d):
    return pairwise.flips(both_orders(spark, d))


@query
def g9_tie_break_slots(spark, d):
    return pairwise.tie_break_slots(debiased(spark, d))


@query
def g10_debias_rollup(spark, d):
    return pairwise.debias_rollup(debiased(spark, d)).withColumns(r6("tie_break_share", "agreement_share"))


@query
def g11_verbosity(spark, d):
    return verbosity.summary(padded_scores(spark, d)).withColumns(r6("mean_delta", "lower", "higher", "same", "mean_length_ratio"))


@query
def g12_escalation(spark, d):
    """Which answers go to people when correlations of 0.3 and more are trusted."""
    return cal.escalation_rate(cal.annotate(judged(spark, d), _policy(spark, d))).withColumns(r6("escalation_rate"))


def _policy(spark, d) -> DataFrame:
    return cal.policy(cal.by_dimension(judged(spark, d)))


@query
def g15_effect_sizes(spark, d):
    return effects.effect_sizes(long_panel(spark, d)).withColumns({**r6("mean_diff", "cohens_d"), **longs("model_a", "model_b")})


@query
def g16_effect_span(spark, d):
    return effects.span(effects.effect_sizes(long_panel(spark, d))).withColumns(r6("smallest_d", "largest_d"))


@query
def g17_kpis(spark, d):
    return telemetry.kpis(view(spark, d, "telemetry")).withColumns(r6("duration_s", "per_second", "ok_share", "retried_share", "escalated_share"))


@query
def g18_by_dimension(spark, d):
    return telemetry.by_dimension(view(spark, d, "telemetry")).withColumns(r6("ok_share", "escalated_share", "mean_latency_ms"))


@query
def g19_latency_percentiles(spark, d):
    return telemetry.latency_percentiles(view(spark, d, "telemetry")).withColumns({**r6("latency_ms"), **longs("pct")})


@query
def g20_throughput(spark, d):
    return telemetry.throughput(view(spark, d, "telemetry")).withColumn("starts_at", F.round("starts_at", 3))


@query
def g21_job_mix(spark, d):
    return telemetry.job_mix(view(spark, d, "telemetry"))


@query
def g22_projection(spark, d):
    return telemetry.projection(view(spark, d, "telemetry"), {"full set": 6_400, "ten times": 64_000, "a million items": 4_000_000}).select("workload", "n_jobs", F.round("seconds", 3).alias("seconds"))


# ---- windows, sorts, sets ----


@query
def w1_top_spread(spark, d):
    return reshape.spread(view(spark, d, "panel")).withColumn("spread", F.round("spread", 6)).orderBy(F.desc("spread"), "doc_id", "model_index").limit(5).select("doc_id", F.col("model_index").cast("long").alias("model_index"), "spread")


@query
def w2_strongest_pairs(spark, d):
    return effects.strongest(effects.effect_sizes(long_panel(spark, d))).withColumns({**r6("mean_diff", "cohens_d"), **longs("model_a", "model_b", "rank")})


@query
def w3_median_pairs(spark, d):
    return effects.around_median(effects.effect_sizes(long_panel(spark, d))).withColumns({**r6("mean_diff", "cohens_d"), **longs("model_a", "model_b", "rank")})


@query
def w4_best_row(spark, d):
    return effects.best_rows(view(spark, d, "panel"), DIMENSIONS).withColumn("model_index", F.col("model_index").cast("long"))


@query
def w6_average_ranks(spark, d):
    return cal.average_ranks(judged(spark, d).where("judge_score is not null"), "judge_score").withColumns(longs("judge_score"))


@query
def w7_latest_event(spark, d):
    return telemetry.latest(view(spark, d, "telemetry")).select("item_id", "dimension", "judge_type", F.round("started_at", 3).alias("started_at"), F.round("latency_ms", 6).alias("latency_ms"))


@query
def w8_troubled_calls(spark, d):
    return telemetry.troubled(view(spark, d, "telemetry")).select("item_id", "dimension", "judge_type", F.round("started_at", 3).alias("started_at"), F.col("retry_count").cast("long").alias("retry_count"), "error")


@query
def u1_concat_studies(spark, d):
    a, b = both_orders(spark, d), both_orders(spark, d, "pair_calls_b")
    both = a.withColumn("study", F.lit("a")).unionByName(b.withColumn("study", F.lit("b")))
    return both.groupBy("study").agg(F.count("*").alias("n"), F.count_if("consistent").alias("n_consistent"))


@query
def u2_distinct_keys(spark, d):
    return view(spark, d, "telemetry").select(*telemetry.KEYS).distinct()


# ---- text ----


@query
def x1_pointwise_prompt(spark, d):
    text = view(spark, d, "summaries").withColumn("dimension", F.explode(F.array(*map(F.lit, DIMENSIONS))))
    return text.select("doc_id", "dimension", F.md5(prompts.pointwise(F.col("summary"), F.col("summary"), F.col("dimension"))).alias("prompt_md5"))


@query
def x2_pairwise_prompt(spark, d):
    text = view(spark, d, "summaries").withColumn("dimension", F.lit("relevance"))
    return text.select("doc_id", F.md5(prompts.pairwise(F.col("summary"), F.lit("first"), F.lit("second"), F.col("dimension"))).alias("prompt_md5"))


@query
def x3_reasoned_prompt(spark, d):
    text = view(spark, d, "summaries").withColumn("dimension", F.lit("fluency"))
    return text.select("doc_id", F.md5(prompts.reasoned(F.col("summary"), F.lit("first"), F.lit("second"), F.col("dimension"))).alias("prompt_md5"))


@query
def x4_parse_score(spark, d):
    return judged(spark, d).select("doc_id", "dimension", F.col("judge_score").cast("long").alias("score"), "parse_ok", "parse_note")


@query
def x5_parse_verdict(spark, d):
    return view(spark, d, "pair_calls").withColumn("v", parsing.verdict(F.col("raw_response"))).select("doc_id", "dimension", "ord", "v.winner", "v.parse_ok", "v.parse_note")


@query
def x6_parse_reasoned_verdict(spark, d):
    return view(spark, d, "pair_calls").withColumn("v", parsing.reasoned_verdict(F.col("raw_response"))).select("doc_id", "dimension", "ord", "v.winner", "v.parse_ok", "v.parse_note")


@query
def x7_fillers(spark, d):
    return view(spark, d, "summaries").select("doc_id", padding.with_fillers(F.col("summary"), 2, F.col("seed")).alias("padded"))


@query
def x8_restatement(spark, d):
    return view(spark, d, "summaries").select("doc_id", padding.with_restatement(F.col("summary"), F.col("seed")).alias("padded"))


@query
def x9_verbose_variant(spark, d):
    return view(spark, d, "summaries").select("doc_id", padding.verbose(F.col("summary"), F.col("seed")).alias("padded"))


@query
def x10_compare_scores(spark, d):
    return padded_scores(spark, d).select("doc_id", "dimension", F.col("score_delta").cast("long").alias("score_delta"), "length_ratio")


# ---- pairwise verdicts ----


@query
def k1_identities(spark, d):
    return pairwise.winners(view(spark, d, "pair_calls"), "pairwise_cot").groupBy("dimension", "ord", "winner").agg(F.count("*").alias("n"))


@query
def k2_order_jobs(spark, d):
    """Prompts of both orders for each document's two halves."""
    half = F.floor(F.length("summary") / 2).cast("int")
    pairs = view(spark, d, "summaries").select("doc_id", F.col("summary").alias("article"), F.substr("summary", F.lit(1), half).alias("summary_1"), F.substr("summary", half + 1).alias("summary_2"))
    return pairwise.order_jobs(pairs).select("doc_id", "dimension", "ord", F.md5("prompt").alias("prompt_md5"))


@query
def k3_k5_debiased(spark, d):
    return debiased(spark, d).withColumns(longs("n_calls"))


@query
def k3_without_tie_break(spark, d):
    return pairwise.debias(both_orders(spark, d), None).withColumns(longs("n_calls")).select("doc_id", "dimension", "winner", "agreement", "n_calls")


# ---- policy ----


@query
def e1_policy(spark, d):
    """Trust and reasons."""
    return _policy(spark, d).withColumns(r6("pearson_r", "pearson_p"))


@query
def e2_annotated(spark, d):
    return cal.annotate(judged(spark, d), _policy(spark, d)).select("doc_id", "dimension", "escalate_to_human")


@query
def e3_escalated_calls(spark, d):
    return cal.escalate_calls(judged(spark, d), _policy(spark, d)).groupBy("dimension").agg(F.count_if("escalated").alias("n_escalated"), F.count("*").alias("n"))


# ---- resampling ----


@query
def r1_bootstrap(spark, d):
    return exact_draws.bootstrap_exact(pair57(spark, d), "doc_id")


@query
def r1_bootstrap_hashed(spark, d):
    return resampling.bootstrap_large(pair57(spark, d), "doc_id", 50).withColumns(r6("point_estimate", "ci_lower", "ci_upper"))


@query
def r2_cluster_bootstrap(spark, d):
    """Whole articles are drawn: rows are all models up to 3 against the article's model 0."""
    rows = effects.paired_dimensions(view(spark, d, "panel"), F.col("model_index").between(1, 3), 0, DIMENSIONS).withColumn("model_pair", F.lit("later v 0"))
    return exact_draws.bootstrap_exact(rows, "doc_id", cluster=True)


@query
def r3_permutation(spark, d):
    return exact_draws.permutation_exact(pair57(spark, d), "doc_id")


@query
def r3_permutation_hashed(spark, d):
    return resampling.permutation_large(pair57(spark, d), "doc_id", 50).withColumns(r6("observed_statistic", "p_value", "null_distribution_std"))


@query
def r4_sensitivity(spark, d):
    """Coverage by sample size, with its band."""
    pairs = pair57(spark, d)
    trials = resampling.sensitivity(pairs, [25, 50, 100])
    full = pairs.groupBy("model_pair", "metric").agg((F.avg("score_a") - F.avg("score_b")).alias("full_sample_estimate"))
    return resampling.coverage_band(resampling.sensitivity_summary(trials, full))


@query
def r5_median_bootstrap(spark, d):
    return exact_draws.median_bootstrap(pair57(spark, d), "doc_id")


@query
def r5_median_permutation(spark, d):
    return exact_draws.median_permutation(pair57(spark, d))


# ---- judge calls and streams ----


@query
def y1_judge_calls(spark, d):
    """Each document's prompt answered by a fixed rule (its length), parsed, rolled up."""
    text = view(spark, d, "summaries").withColumns({"dimension": F.lit("fluency"), "judge_type": F.lit("pointwise"), "item_id": F.col("doc_id").cast("string")})
    jobs = text.withColumn("prompt", prompts.pointwise(F.lit("none"), F.col("summary"), F.col("dimension")))
    called = judging.parsed(judging.call(jobs, lambda prompt, model: f"{len(prompt) % 5 + 1} out of 5", "rule"))
    return called.groupBy("score", "parse_ok", "retry_count").agg(F.count("*").alias("n")).withColumns(longs("score", "retry_count"))


@query
def y1_durable_run(spark, d):
    """The same calls as one durable run over a growing list: half of the jobs, then all, then all again, which asks nothing."""
    from uuid import uuid4

    text = view(spark, d, "summaries").withColumns({"dimension": F.lit("fluency"), "judge_type": F.lit("pointwise"), "item_id": F.col("doc_id").cast("string")})
    jobs = text.withColumn("prompt", prompts.pointwise(F.lit("none"), F.col("summary"), F.col("dimension")))
    path = _scratch(spark, f"judge-run-{uuid4().hex}")
    for some in (jobs.where("doc_id % 2 = 0"), jobs, jobs):
        log = judging.judge_durably(some, lambda prompt, model: f"{len(prompt) % 5 + 1} out of 5", "rule", path, chunks=8, max_in_flight=64)
    return log.groupBy("score", "parse_ok", "retry_count").agg(F.count("*").alias("n")).withColumns(longs("score", "retry_count"))


@query
def m1_live_rollup(spark, d):
    """The log as a stream of files that come in two parts, with a restart between: every event by hour, open hours too."""
    from uuid import uuid4

    from ..streaming import live

    base, log = _scratch(spark, f"stream-{uuid4().hex}"), view(spark, d, "telemetry")
    rollup = live.LiveRollup(spark, f"{base}/rollup", "1 hour")
    for part in ("item_id < 'u5'", "item_id >= 'u5' or item_id is null"):
        tables.append_telemetry(log.where(part), f"{base}/log")
        rollup.drain(live.read(spark, f"{base}/log"), f"{base}/state")
    found = rollup.read()
    return found.select(F.unix_seconds("starts_at").alias("starts_at"), "dimension", "n", *[F.round(c, 6).alias(c) for c in ("ok_share", "escalated_share", "mean_latency_ms")])


@query
def m2_each_job_once(spark, d):
    """The log as a stream in two parts, then all of it once more: one event for each job key, whatever its time."""
    from uuid import uuid4

    from ..streaming import live

    base, log = _scratch(spark, f"stream-{uuid4().hex}"), view(spark, d, "telemetry")
    before = {k: spark.conf.get(k, None) for k in live.STATE}
    try:
        for k, v in live.STATE.items():
            spark.conf.set(k, v)
        for part in ("item_id < 'u5'", "item_id >= 'u5' or item_id is null", "true"):
            tables.append_telemetry(log.where(part), f"{base}/log")
            live.drain(live.first_of_each_job(live.read(spark, f"{base}/log")).select("item_id", "dimension", "judge_type"), f"{base}/out", f"{base}/state")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.parquet(f"{base}/out")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which dimensions may be trusted, why, and what share of their judgements goes to people."""
    policy = _policy(spark, d)
    rates = cal.escalation_rate(cal.annotate(judged(spark, d), policy)).where("not is_total")
    return policy.join(rates.select("dimension", "n_escalated", "escalation_rate"), "dimension").orderBy("dimension")
