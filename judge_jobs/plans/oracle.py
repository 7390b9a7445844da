"""DuckDB SQL of the registered queries, over the same bindings. Views come in as common table expressions."""

import re

from ..fixed import CLOSING_HEDGES, DEFINITIONS, OPENING_FILLERS, PAIRWISE_PROMPT, POINTWISE_PROMPT, REASONED_PROMPT, RESTATEMENT_LEAD
from ..operators.resampling import POISSON
from . import views

SQL: dict[str, str] = {}

_DIMS = "(VALUES ('coherence'),('consistency'),('fluency'),('relevance')) AS d(dimension)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt(template: str, **values: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    definition = "CASE dimension " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in DEFINITIONS.items()) + " END"
    values = {"dimension": "dimension", "definition": definition, **values}
    return " || ".join(values[p] if k % 2 else _q(p) for k, p in enumerate(parts) if p)


def _pick(values: tuple[str, ...], k: str) -> str:
    return f"list_extract([{', '.join(map(_q, values))}], CAST(({k}) % {len(values)} AS INT) + 1)"


_SHARED = {name: views.sql(name, "duckdb") for name in views.NAMES} | {
    "long": "SELECT doc_id, model_index, metric, score FROM panel UNPIVOT (score FOR metric IN (coherence, consistency, fluency, relevance))",
    "stripped": r"SELECT *, regexp_replace(raw_response, '^\s+|\s+$', '', 'g') AS s FROM judge_results",
    "found": r"""SELECT *, regexp_extract(s, '(?i)\b([1-5])\s*(?:out of|/)\s*5\b', 1) AS o5, regexp_extract_all(s, '\b[1-5]\b') AS ns, regexp_extract_all(s, '\d+') AS ds FROM stripped""",
    "judged": r"""SELECT doc_id, model_index, dimension, human_score, raw_response, CAST(v AS BIGINT) AS judge_score, v IS NOT NULL AS parse_ok,
        CASE WHEN regexp_full_match(s, '[1-5]') THEN 'bare integer' WHEN o5 <> '' THEN 'extracted from ''X out of 5'' / ''X/5'' pattern'
          WHEN len(ns) = 1 THEN 'single valid number embedded in text'
          WHEN len(ns) > 1 THEN 'ambiguous: found ' || len(ns) || ' candidate numbers [''' || array_to_string(ns, ''', ''') || ''']'
          WHEN len(ds) > 0 THEN 'found number(s) [''' || array_to_string(ds, ''', ''') || '''] but none in valid range [1,5]'
          ELSE 'no number found in response' END AS parse_note
        FROM (SELECT *, CASE WHEN regexp_full_match(s, '[1-5]') THEN s WHEN o5 <> '' THEN o5 WHEN len(ns) = 1 THEN ns[1] END AS v FROM found)""",
    **{
        f"verdicts{b}": rf"""SELECT *, CASE WHEN marker IS NOT NULL THEN (CASE WHEN lower(marker)='tie' THEN 'tie' ELSE upper(marker) END) ELSE plain END AS reasoned,
            CASE WHEN marker IS NOT NULL THEN 'found ''VERDICT:'' marker' ELSE 'no VERDICT marker found; fallback parse: ' || plain_note END AS reasoned_note
          FROM (SELECT *, CASE WHEN bare <> '' THEN (CASE WHEN lower(bare)='tie' THEN 'tie' ELSE upper(bare) END) WHEN tie THEN 'tie' WHEN lead <> '' THEN upper(lead) WHEN ma AND NOT mb THEN 'A' WHEN mb AND NOT ma THEN 'B' END AS plain,
              CASE WHEN bare <> '' THEN 'bare token' WHEN tie THEN '''tie'' keyword found' WHEN lead <> '' THEN 'leading letter token' WHEN ma AND NOT mb THEN 'only Summary A mentioned' WHEN mb AND NOT ma THEN 'only Summary B mentioned' ELSE 'could not determine winner from response' END AS plain_note
            FROM (SELECT *, regexp_extract(raw_response, '(?i)^[\s.]*([AB]|Tie)[\s.]*$', 1) AS bare, regexp_matches(raw_response, '(?i)\btie\b') AS tie, regexp_extract(raw_response, '(?i)^\W*([AB])\b', 1) AS lead,
                regexp_matches(raw_response, '(?i)\bsummary\s+a\b') AS ma, regexp_matches(raw_response, '(?i)\bsummary\s+b\b') AS mb,
                list_extract(regexp_extract_all(raw_response, '(?i)verdict:\s*(a|b|tie)\b', 1), -1) AS marker FROM pair_calls{b}))"""
        for b in ("", "_b")
    },
    **{
        f"won{b}": f"""SELECT doc_id, dimension, ord, CASE WHEN reasoned='tie' THEN 'tie' WHEN (reasoned='A')=(ord='original') THEN 'summary_1' WHEN reasoned IS NOT NULL THEN 'summary_2' END AS winner FROM verdicts{b}"""
        for b in ("", "_b")
    },
    **{
        f"both{b}": f"""SELECT *, w1 = w2 AS consistent FROM (SELECT doc_id, dimension, max(CASE WHEN ord='original' THEN winner END) AS w1, max(CASE WHEN ord='swapped' THEN winner END) AS w2 FROM won{b} GROUP BY ALL)"""
        for b in ("", "_b")
    },
    "third": f"""SELECT b.doc_id, b.dimension, b.w1, b.w2, o.ord, w.winner AS w3 FROM both_ b
        JOIN (SELECT doc_id, dimension, CASE WHEN {views.hashed("concat('7:', doc_id, ':', dimension)", "duckdb")} % 2 = 0 THEN 'original' ELSE 'swapped' END AS ord FROM both_) o USING (doc_id, dimension)
        JOIN won w ON w.doc_id = b.doc_id AND w.dimension = b.dimension AND w.ord = o.ord WHERE b.w1 <> b.w2""",
    "debiased": """SELECT doc_id, dimension, CASE WHEN ord IS NOT NULL THEN f WHEN w1 = w2 THEN w1 END AS winner, coalesce(w1 = w2, false) AS agreement, CAST(CASE WHEN ord IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n_calls,
        CASE WHEN ord IS NOT NULL THEN 'orders disagreed (' || w1 || ' vs ' || w2 || '); random tie-break (' || CASE WHEN ord='original' THEN 'orig' ELSE 'swapped' END || ' order): ''' || f || ''''
          WHEN w1 = w2 THEN 'orders agreed on ''' || w1 || '''' ELSE 'one or both verdicts failed to parse; inconclusive' END AS note, ord
        FROM (SELECT b.doc_id, b.dimension, b.w1, b.w2, t.ord, CASE WHEN t.w3 = b.w1 THEN b.w1 WHEN t.w3 = b.w2 THEN b.w2 ELSE 'tie' END AS f FROM both_ b LEFT JOIN third t ON t.doc_id = b.doc_id AND t.dimension = b.dimension)""",
    "sentences": r"""SELECT *, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM (SELECT *, regexp_replace(summary, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') AS t FROM summaries)""",
    "filled": f"""SELECT *, CASE WHEN t = '' THEN summary ELSE array_to_string(list_transform(ss, lambda s, i: CASE WHEN (i-1) % step = 0 AND (i-1) // step < n AND s <> '' THEN {_pick(OPENING_FILLERS, "seed + (i-1) // step")} || ' ' || lower(s[1]) || s[2:] ELSE s END), ' ') END AS filled
        FROM (SELECT *, greatest(1, len(ss) // greatest(n, 1)) AS step FROM (SELECT *, least(2, len(ss)) AS n FROM sentences))""",
    "padded": rf"""SELECT doc_id, summary, filled, CASE WHEN ft = '' OR first = '' THEN filled ELSE ft || {_q(" " + RESTATEMENT_LEAD + " ")} || lower(first[1]) || first[2:] || '. ' || {_pick(CLOSING_HEDGES, "seed")} END AS wordy
        FROM (SELECT *, regexp_replace(string_split(regexp_replace(ft, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1], '[.!?]+$', '') AS first FROM (SELECT *, regexp_replace(filled, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') AS ft FROM filled))""",
    "compared": f"""SELECT doc_id, dimension, {views.hashed("concat('w:', doc_id, ':', dimension)", "duckdb")} % 5 - {views.hashed("concat('o:', doc_id, ':', dimension)", "duckdb")} % 5 AS delta,
        CASE WHEN length(summary) = 0 THEN NULL ELSE round_even(length(wordy) / CAST(length(summary) AS DOUBLE), 2) END AS ratio FROM padded CROSS JOIN {_DIMS}""",
    "pair": "SELECT 'm1v2' AS model_pair, doc_id, metric, a.score AS score_a, b.score AS score_b FROM (FROM long WHERE model_index = 1) a JOIN (FROM long WHERE model_index = 2) b USING (doc_id, metric)",
    "moments": "SELECT metric, model_index, avg(score) AS m, var_pop(score) AS v FROM long GROUP BY ALL",
    "effects": """SELECT metric, a.model_index AS model_a, b.model_index AS model_b, a.m - b.m AS mean_diff, CASE WHEN a.v + b.v > 0 THEN (a.m - b.m) / sqrt((a.v + b.v) / 2) ELSE 0 END AS cohens_d
        FROM moments a JOIN moments b USING (metric) WHERE a.model_index < b.model_index""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(round(cohens_d, 9)) DESC, model_a, model_b) AS rank, count(*) OVER (PARTITION BY metric) AS n_pairs FROM effects",
    "spreads": "SELECT *, greatest(coherence, consistency, fluency, relevance) - least(coherence, consistency, fluency, relevance) AS spread FROM panel",
    "scored": "FROM judged WHERE judge_score IS NOT NULL",
    "agreement": """SELECT dimension, count(*) AS n, corr(judge_score, human_score) AS pearson_r, corr(rj, rh) AS spearman_r, avg(abs(judge_score - human_score)) AS mae, avg(judge_score - human_score) AS mse
        FROM (SELECT *, rank() OVER (PARTITION BY dimension ORDER BY judge_score) + (count(*) OVER (PARTITION BY dimension, judge_score) - 1) / 2.0 AS rj,
            rank() OVER (PARTITION BY dimension ORDER BY human_score) + (count(*) OVER (PARTITION BY dimension, human_score) - 1) / 2.0 AS rh FROM scored) GROUP BY ALL HAVING count(*) >= 2""",
    # the tail of the density of r by Simpson's rule, over 20,000 parts of what lies within forty standard deviations
    "tails": f"""SELECT dimension, {', '.join(f"""CASE WHEN n = 2 THEN 1.0 WHEN abs({r}) >= 1 THEN 0.0 ELSE 2 * exp(lgamma(n / 2 - 0.5) - lgamma(n / 2 - 1) - 0.5 * ln(pi())) * sum(w * pow(1 - pow(least(abs({r}) + i * (top_{r} - abs({r})) / 20000, 1.0), 2), n / 2 - 2)) * any_value(top_{r} - abs({r})) / 60000 END AS {p}""" for r, p in (("pearson_r", "pearson_p"), ("spearman_r", "spearman_p")))}
        FROM (SELECT *, least(1.0, abs(pearson_r) + 40 / sqrt(n)) AS top_pearson_r, least(1.0, abs(spearman_r) + 40 / sqrt(n)) AS top_spearman_r FROM agreement),
            (SELECT i, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 20001) AS t(i)) GROUP BY dimension, n, pearson_r, spearman_r""",
    "calibrated": "SELECT * FROM agreement JOIN tails USING (dimension)",
    "trusted": "SELECT dimension, abs(pearson_r) >= 0.3 AND pearson_p < 0.05 AS trusted FROM calibrated",
    "ends": "SELECT min(started_at) AS t0, max(started_at) AS t1, greatest(max(started_at) - min(started_at), 1e-6) / 20 AS width FROM telemetry",
}


def _alias(name: str) -> str:
    return {"both": "both_"}.get(name, name)


def _with(body: str) -> str:
    """Prefix the shared expressions that the text needs, and those that these need, in their order."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in _SHARED:
            if name not in need and re.search(rf"\b{_alias(name)}\b", text):
                need.add(name)
                todo.append(_SHARED[name])
    parts = [f"{_alias(n)} AS ({t})" for n, t in _SHARED.items() if n in need]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def put(name: str, body: str) -> None:
    SQL[name] = _with(body)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_FOUR = "coherence, consistency, fluency, relevance"
_SHARES = "avg(CAST(parse_ok AS INT)) AS ok_share, avg(CAST(escalated AS INT)) AS escalated_share, avg(latency_ms) AS mean_latency_ms"

put("s4_s6_telemetry_roundtrip", f"SELECT dimension, n, {_r('ok_share', 'escalated_share', 'mean_latency_ms')} FROM (SELECT dimension, count(*) AS n, {_SHARES} FROM telemetry GROUP BY ALL)")
SQL["s5_committed_append"] = SQL["s4_s6_telemetry_roundtrip"]
SQL["g18_by_dimension"] = SQL["s4_s6_telemetry_roundtrip"]
put("s7_partitioned_results", "SELECT model_pair, metric, count(*) AS n, round(sum(score_a), 6) AS sum_a, round(sum(score_b), 6) AS sum_b FROM pair WHERE metric = 'fluency' GROUP BY ALL")
put("s8_resumed_append", "SELECT dimension, count(*) AS n, count(judge_score) AS n_scored FROM judged GROUP BY ALL")
put("p1_wide_to_long", f"SELECT id AS doc_id, CAST(i AS BIGINT) AS model_index, {', '.join(f'round({d}[i+1], 6) AS {d}' for d in DEFINITIONS)} FROM wide CROSS JOIN range(16) AS t(i)")
put("p2_by_dimension", "SELECT doc_id, CAST(model_index AS BIGINT) AS model_index, metric AS dimension, round(score, 6) AS human_score FROM long")
put("p3_item_keys", "SELECT doc_id || '::' || model_index AS item_id, CAST(doc_id AS VARCHAR) AS doc, CAST(model_index AS BIGINT) AS model FROM panel")
put("p4_parsed_only", "SELECT * FROM (SELECT dimension, count(*) AS n, CAST(sum(judge_score) AS DOUBLE) AS total FROM scored GROUP BY ALL) CROSS JOIN (SELECT count(*) AS n_rows, count(*) FILTER (NOT parse_ok) AS n_excluded FROM judged)")
put("p5_complete_pairs", "SELECT dimension, count(*) AS n, round(CAST(sum(judge_score) AS DOUBLE), 6) AS total FROM scored WHERE judge_score <> 3 GROUP BY ALL")
put("p6_one_model", "SELECT doc_id, round(score, 6) AS score FROM long WHERE model_index = 3 AND metric = 'relevance'")
put("p7_point_lookup", f"SELECT doc_id, {_r(*DEFINITIONS)} FROM panel WHERE doc_id = 7 AND model_index = 0")
put("p8_flagged_documents", "SELECT CAST(model_index AS BIGINT) AS model_index, count(*) AS n, round(sum(fluency), 6) AS total FROM panel WHERE doc_id IN (SELECT doc_id FROM panel GROUP BY doc_id HAVING count(*) >= 7) GROUP BY 1")
put("p9_spread", "SELECT doc_id, CAST(model_index AS BIGINT) AS model_index, round(spread, 6) AS spread FROM spreads")
put(
    "p10_contract",
    """SELECT rule, count(*) AS n FROM (SELECT unnest(CASE WHEN model_index > 4 AND doc_id % 50 = 0 THEN ['model_index out of range', 'fluency out of range']
    WHEN model_index > 4 THEN ['model_index out of range'] WHEN doc_id % 50 = 0 THEN ['fluency out of range'] ELSE ['none'] END) AS rule FROM panel) GROUP BY ALL""",
)
put(
    "v1_report",
    """SELECT n_rows, n_unique_docs, n_bad_docs, false AS passed, CAST(CASE WHEN n_unique_docs <> 100 THEN 1 ELSE 0 END + CASE WHEN n_bad_docs > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
    'expected 100 unique docs, found ' || n_unique_docs AS first_error FROM (SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_unique_docs FROM panel)
    CROSS JOIN (SELECT count(*) AS n_bad_docs FROM (SELECT doc_id FROM panel GROUP BY doc_id HAVING count(DISTINCT model_index) <> 4))""",
)
put("v2_models_per_doc", "SELECT doc_id, count(DISTINCT model_index) AS n_models FROM panel GROUP BY ALL")
put("v4_profile", """SELECT metric AS dimension, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.75), 6) AS q75, round(max(score), 6) AS max FROM long GROUP BY ALL""")
put("v5_coverage", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(DISTINCT model_index) AS n_models, count(DISTINCT dimension) AS n_dimensions FROM judged")
put("j1_paired_scores", "SELECT doc_id, metric, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b FROM pair")
put("j1_unmatched", """SELECT metric, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS n_both, count(*) FILTER (b.doc_id IS NULL) AS only_a, count(*) FILTER (a.doc_id IS NULL) AS only_b
    FROM (FROM long WHERE model_index = 1) a FULL JOIN (FROM long WHERE model_index = 5) b USING (doc_id, metric) GROUP BY metric""")
put("j3_judge_with_human", "SELECT doc_id, dimension, judge_score, round(human_score, 6) AS human_score FROM judged")
put("j5_partly_done", f"SELECT item_id, dimension, judge_type FROM (SELECT DISTINCT item_id FROM telemetry) CROSS JOIN {_DIMS} CROSS JOIN (VALUES ('pointwise'), ('pairwise')) AS t(judge_type) ANTI JOIN (SELECT item_id, dimension, judge_type FROM telemetry WHERE latency_ms > 50) USING (item_id, dimension, judge_type)")
put("j5_resume", f"SELECT item_id, dimension, 'pairwise' AS judge_type FROM (SELECT DISTINCT item_id FROM telemetry) CROSS JOIN {_DIMS} WHERE (item_id, dimension) NOT IN (SELECT (item_id, dimension) FROM telemetry WHERE judge_type = 'pairwise')")
put(
    "j6_both_orders",
    """SELECT doc_id, dimension, w1 AS winner_original_order, w2 AS winner_swapped_order, consistent, CASE WHEN w1 IS NULL OR w2 IS NULL THEN 'one or both verdicts failed to parse; cannot assess consistency'
    WHEN w1 = w2 THEN 'consistent: preferred ''' || w1 || ''' regardless of position' ELSE 'POSITION BIAS DETECTED: preferred ''' || w1 || ''' when shown first, ''' || w2 || ''' when shown second' END AS note FROM both_""",
)
put(
    "j7_compare_studies",
    """SELECT dimension, is_total, n, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(100 * (rb - ra), 6) AS change_points FROM (SELECT dimension, grouping(dimension) = 1 AS is_total, count(*) AS n,
    avg(CASE WHEN a.consistent = false THEN 1.0 ELSE 0 END) AS ra, avg(CASE WHEN b.consistent = false THEN 1.0 ELSE 0 END) AS rb FROM both_ a JOIN both_b b USING (doc_id, dimension) GROUP BY ROLLUP (dimension))""",
)
put("a1_sample_rows", "SELECT doc_id, CAST(model_index AS BIGINT) AS model_index FROM panel ORDER BY md5(concat('42:', doc_id, ':', model_index)), doc_id, model_index LIMIT 100")
put("a2_sample_documents", "SELECT doc_id FROM (SELECT DISTINCT doc_id FROM panel) ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 15")
put("a3_two_models", """SELECT doc_id, CAST(max(CASE WHEN r = 1 THEN model_index END) AS BIGINT) AS model_a_idx, CAST(max(CASE WHEN r = 2 THEN model_index END) AS BIGINT) AS model_b_idx
    FROM (SELECT doc_id, model_index, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat('42:', doc_id, ':', model_index)), model_index) AS r FROM panel) WHERE r <= 2 GROUP BY doc_id HAVING count(*) = 2""")
put("a4_subsamples", """SELECT metric, CAST(trial AS BIGINT) AS trial, doc_id, round(score_a - score_b, 6) AS diff FROM (SELECT *, row_number() OVER (PARTITION BY metric, trial ORDER BY md5(concat('42:', trial, ':', doc_id)), doc_id) AS r
    FROM pair CROSS JOIN range(4) AS t(trial)) WHERE r <= 25""")
put("g1_g2_calibration", "SELECT dimension, n, round(pearson_r, 6) AS pearson_r, round(spearman_r, 6) AS spearman_r, round(mae, 6) AS mean_absolute_error, round(mse, 6) AS mean_signed_error FROM agreement")
put("g4_judge_histogram", "SELECT judge_score AS score, count(*) AS count FROM scored GROUP BY ALL")
put("g5_human_histogram", "SELECT CAST(round_even(human_score, 0) AS BIGINT) AS score, count(*) AS count FROM judge_results GROUP BY 1")
_PCT = "(CASE WHEN round_even(100 * rate, 1) = floor(round_even(100 * rate, 1)) THEN CAST(CAST(round_even(100 * rate, 1) AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(round_even(100 * rate, 1) AS VARCHAR) END) || '%'"
put(
    "g6_bias_summary",
    f"""SELECT dimension, n_comparisons, n_inconsistent, n_unparsed, round(rate, 6) AS inconsistency_rate, rate > 0.2 AS escalate, 'position-inconsistency ' || {_PCT} || CASE WHEN rate > 0.2
    THEN ' exceeds threshold 20%; pairwise verdicts on this dimension are not reliable without order-debiasing (e.g. majority vote across both orders)' ELSE ' is within threshold 20%; pairwise verdicts are usable as-is' END AS reason
    FROM (SELECT dimension, count(*) AS n_comparisons, count(*) FILTER (consistent = false) AS n_inconsistent, count(*) FILTER (consistent IS NULL) AS n_unparsed, count(*) FILTER (consistent = false) / count(*) AS rate FROM both_ GROUP BY dimension)""",
)
put("g7_overall_bias", "SELECT dimension, grouping(dimension) = 1 AS is_total, count(*) AS n_comparisons, round(avg(CASE WHEN consistent = false THEN 1.0 ELSE 0 END), 6) AS inconsistency_rate FROM both_ GROUP BY ROLLUP (dimension)")
put("g8_flip_slots", """SELECT dimension, slot, count(*) AS n_flips, CAST(grouping(dimension, slot) AS BIGINT) AS level FROM (SELECT dimension, CASE WHEN w1 = 'summary_1' AND w2 = 'summary_2' THEN 'A' WHEN w1 = 'summary_2' AND w2 = 'summary_1' THEN 'B' ELSE 'tie' END AS slot FROM both_ WHERE consistent = false) GROUP BY CUBE (dimension, slot)""")
put("g9_tie_break_slots", "SELECT count(*) FILTER (n_calls = 3) AS n_tie_breaks, count(*) FILTER (n_calls = 3 AND winner = CASE WHEN ord = 'original' THEN 'summary_1' ELSE 'summary_2' END) AS n_shown_first, count(*) FILTER (n_calls = 3 AND agreement) AS n_unanimous FROM debiased")
put("g10_debias_rollup", """SELECT dimension, count(*) AS n, CAST(sum(n_calls) AS BIGINT) AS n_calls, round(avg(CASE WHEN n_calls = 3 THEN 1.0 ELSE 0 END), 6) AS tie_break_share, round(avg(CASE WHEN agreement THEN 1.0 ELSE 0 END), 6) AS agreement_share,
    count(*) FILTER (winner = 'summary_1') AS n_summary_1, count(*) FILTER (winner = 'summary_2') AS n_summary_2, count(*) FILTER (winner = 'tie') AS n_tie, count(*) FILTER (winner IS NULL) AS n_none FROM debiased GROUP BY ALL""")
put("g11_verbosity", """SELECT dimension, grouping(dimension) = 1 AS is_total, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0 END), 6) AS lower, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END), 6) AS higher,
    round(avg(CASE WHEN delta = 0 THEN 1.0 ELSE 0 END), 6) AS same, round(avg(ratio), 6) AS mean_length_ratio FROM compared GROUP BY ROLLUP (dimension)""")
put("g12_escalation", """SELECT dimension, grouping(dimension) = 1 AS is_total, count(*) AS n, count(*) FILTER (NOT trusted) AS n_escalated, round(avg(CASE WHEN trusted THEN 0.0 ELSE 1 END), 6) AS escalation_rate FROM judged JOIN trusted USING (dimension) GROUP BY ROLLUP (dimension)""")
put("g15_effect_sizes", "SELECT metric, CAST(model_a AS BIGINT) AS model_a, CAST(model_b AS BIGINT) AS model_b, round(mean_diff, 6) AS mean_diff, round(cohens_d, 6) AS cohens_d FROM effects")
put("g16_effect_span", "SELECT metric, max(n_pairs) AS n_pairs, round(arg_max(cohens_d, rank), 6) AS smallest_d, round((SELECT arg_max(cohens_d, (abs(round(cohens_d, 9)), model_a, model_b)) FROM effects e WHERE e.metric = r.metric), 6) AS largest_d FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(round(cohens_d, 9)) DESC, model_a DESC, model_b DESC) AS rank, count(*) OVER (PARTITION BY metric) AS n_pairs FROM effects) r GROUP BY metric")
put("g17_kpis", """SELECT n, n_ok, n_retried, n_errors, n_escalated, round(dur, 6) AS duration_s, round(n / dur, 6) AS per_second, round(n_ok / n, 6) AS ok_share, round(n_retried / n, 6) AS retried_share, round(n_escalated / n, 6) AS escalated_share
    FROM (SELECT count(*) AS n, count(*) FILTER (parse_ok) AS n_ok, count(*) FILTER (retry_count > 0) AS n_retried, count(*) FILTER (error IS NOT NULL) AS n_errors, count(*) FILTER (escalated) AS n_escalated, greatest(max(started_at) - min(started_at), 1e-6) AS dur FROM telemetry)""")
put("g19_latency_percentiles", "SELECT CAST(pct AS BIGINT) AS pct, round(latency_ms, 6) AS latency_ms FROM (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM telemetry) JOIN (VALUES (50), (90), (95), (99)) AS p(pct) ON i = round_even(pct / 100 * (n - 1), 0)")
put("g20_throughput", "SELECT b AS bucket, round(t0 + b * width, 3) AS starts_at, coalesce(n, 0) AS n FROM range(20) AS r(b) CROSS JOIN ends LEFT JOIN (SELECT least(CAST(floor((started_at - t0) / width) AS BIGINT), 19) AS k, count(*) AS n FROM telemetry CROSS JOIN ends GROUP BY 1) ON k = b")
put("g21_job_mix", "SELECT backend, model, judge_type, dimension, count(*) AS n, CAST(grouping(backend, model, judge_type, dimension) AS BIGINT) AS level FROM telemetry GROUP BY CUBE (backend, model, judge_type, dimension)")
put("g22_projection", "SELECT workload, CAST(n_jobs AS BIGINT) AS n_jobs, round(n_jobs / per, 3) AS seconds FROM (VALUES ('full set', 6400), ('ten times', 64000), ('a million items', 4000000)) AS w(workload, n_jobs) CROSS JOIN (SELECT count(*) / greatest(max(started_at) - min(started_at), 1e-6) AS per FROM telemetry)")
put("w1_top_spread", "SELECT doc_id, CAST(model_index AS BIGINT) AS model_index, round(spread, 6) AS spread FROM spreads ORDER BY round(spread, 6) DESC, doc_id, model_index LIMIT 5")
_RANKED = "SELECT metric, CAST(model_a AS BIGINT) AS model_a, CAST(model_b AS BIGINT) AS model_b, round(mean_diff, 6) AS mean_diff, round(cohens_d, 6) AS cohens_d, rank, n_pairs FROM ranked"
put("w2_strongest_pairs", f"{_RANKED} WHERE rank <= 5")
put("w3_median_pairs", f"{_RANKED} WHERE rank - 1 BETWEEN n_pairs // 2 - 2 AND n_pairs // 2 + 2")
put("w4_best_row", "SELECT metric, doc_id, CAST(model_index AS BIGINT) AS model_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(score, 6) DESC, doc_id, model_index) AS r FROM long) WHERE r = 1")
put("w6_average_ranks", "SELECT dimension, judge_score, CAST(avg(r) AS DOUBLE) AS rank FROM (SELECT dimension, judge_score, row_number() OVER (PARTITION BY dimension ORDER BY judge_score) AS r FROM scored) GROUP BY ALL")
put("w7_latest_event", "SELECT item_id, dimension, judge_type, round(started_at, 3) AS started_at, round(latency_ms, 6) AS latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY item_id, dimension, judge_type ORDER BY started_at DESC, latency_ms DESC, retry_count DESC, parse_ok DESC) AS r FROM telemetry) WHERE r = 1")
put("w8_troubled_calls", "SELECT item_id, dimension, judge_type, round(started_at, 3) AS started_at, CAST(retry_count AS BIGINT) AS retry_count, error FROM telemetry WHERE error IS NOT NULL OR retry_count > 0")
put("u1_concat_studies", "SELECT study, count(*) AS n, count(*) FILTER (consistent) AS n_consistent FROM (SELECT 'a' AS study, consistent FROM both_ UNION ALL SELECT 'b', consistent FROM both_b) GROUP BY ALL")
put("u2_distinct_keys", "SELECT DISTINCT item_id, dimension, judge_type FROM telemetry")
put("x1_pointwise_prompt", f"SELECT doc_id, dimension, md5({_prompt(POINTWISE_PROMPT, article='summary', summary='summary')}) AS prompt_md5 FROM summaries CROSS JOIN {_DIMS}")
put("x2_pairwise_prompt", f"SELECT doc_id, md5({_prompt(PAIRWISE_PROMPT, article='summary', summary_a=_q('first'), summary_b=_q('second'))}) AS prompt_md5 FROM (SELECT *, 'relevance' AS dimension FROM summaries)")
put("x3_reasoned_prompt", f"SELECT doc_id, md5({_prompt(REASONED_PROMPT, article='summary', summary_a=_q('first'), summary_b=_q('second'))}) AS prompt_md5 FROM (SELECT *, 'fluency' AS dimension FROM summaries)")
put("x4_parse_score", "SELECT doc_id, dimension, judge_score AS score, parse_ok, parse_note FROM judged")
put("x5_parse_verdict", "SELECT doc_id, dimension, ord, plain AS winner, plain IS NOT NULL AS parse_ok, plain_note AS parse_note FROM verdicts")
put("x6_parse_reasoned_verdict", "SELECT doc_id, dimension, ord, reasoned AS winner, reasoned IS NOT NULL AS parse_ok, reasoned_note AS parse_note FROM verdicts")
put("x7_fillers", "SELECT doc_id, filled AS padded FROM filled")
put("x8_restatement", rf"""SELECT doc_id, CASE WHEN t = '' OR first = '' THEN summary ELSE t || {_q(" " + RESTATEMENT_LEAD + " ")} || lower(first[1]) || first[2:] || '. ' || {_pick(CLOSING_HEDGES, "seed")} END AS padded FROM (SELECT *, regexp_replace(ss[1], '[.!?]+$', '') AS first FROM sentences)""")
put("x9_verbose_variant", "SELECT doc_id, wordy AS padded FROM padded")
put("x10_compare_scores", "SELECT doc_id, dimension, delta AS score_delta, ratio AS length_ratio FROM compared")
put("k1_identities", "SELECT dimension, ord, winner, count(*) AS n FROM won GROUP BY ALL")
put(
    "k2_order_jobs",
    f"""SELECT doc_id, dimension, ord, md5({_prompt(PAIRWISE_PROMPT, article='summary', summary_a='a', summary_b='b')}) AS prompt_md5 FROM (SELECT doc_id, dimension, ord, summary, CASE WHEN ord = 'original' THEN s1 ELSE s2 END AS a, CASE WHEN ord = 'original' THEN s2 ELSE s1 END AS b
    FROM (SELECT *, substr(summary, 1, length(summary) // 2) AS s1, substr(summary, length(summary) // 2 + 1) AS s2 FROM summaries) CROSS JOIN {_DIMS} CROSS JOIN (VALUES ('original'), ('swapped')) AS o(ord))""",
)
put("k3_k5_debiased", "SELECT doc_id, dimension, winner, agreement AND ord IS NULL AS agreement, n_calls, note FROM debiased")
put("k3_without_tie_break", "SELECT doc_id, dimension, CASE WHEN w1 IS NULL OR w2 IS NULL THEN NULL WHEN w1 = w2 THEN w1 ELSE 'tie' END AS winner, coalesce(w1 = w2, false) AS agreement, CAST(2 AS BIGINT) AS n_calls FROM both_")
put("e2_annotated", "SELECT doc_id, dimension, NOT trusted AS escalate_to_human FROM judged JOIN trusted USING (dimension)")
put("e3_escalated_calls", "SELECT dimension, count(*) FILTER (NOT parse_ok OR NOT trusted) AS n_escalated, count(*) AS n FROM judged JOIN trusted USING (dimension) GROUP BY ALL")
_U = f"{views.hashed("concat('42:', doc_id, ':', draw)", 'duckdb')} / CAST(4294967296 AS DOUBLE)"
_W = " + ".join(f"CASE WHEN u >= {p} THEN 1 ELSE 0 END" for p in POISSON)
put(
    "r1_bootstrap_hashed",
    f"""SELECT model_pair, metric, round(any_value(p), 6) AS point_estimate, round(quantile_cont(stat, 0.025), 6) AS ci_lower, round(quantile_cont(stat, 0.975), 6) AS ci_upper, count(*) AS n_resamples, any_value(n) AS n_units_resampled, 'poisson' AS method
    FROM (SELECT model_pair, metric, draw, sum(w * (score_a - score_b)) / sum(w) AS stat FROM (SELECT *, {_W} AS w FROM (SELECT *, {_U} AS u FROM pair CROSS JOIN range(50) AS t(draw))) GROUP BY ALL)
    JOIN (SELECT model_pair, metric, avg(score_a) - avg(score_b) AS p, count(*) AS n FROM pair GROUP BY ALL) USING (model_pair, metric) GROUP BY model_pair, metric""",
)
put(
    "r3_permutation_hashed",
    f"""SELECT model_pair, metric, round(any_value(o), 6) AS observed_statistic, round(avg(CASE WHEN abs(stat) >= abs(o) - 1e-12 * greatest(1.0, abs(o)) THEN 1.0 ELSE 0 END), 6) AS p_value, count(*) AS n_permutations, round(stddev_pop(stat), 6) AS null_distribution_std
    FROM (SELECT model_pair, metric, draw, avg((score_a - score_b) * CASE WHEN {_U} < 0.5 THEN -1.0 ELSE 1.0 END) AS stat FROM pair CROSS JOIN range(50) AS t(draw) GROUP BY ALL)
    JOIN (SELECT model_pair, metric, avg(score_a - score_b) AS o FROM pair GROUP BY ALL) USING (model_pair, metric) GROUP BY model_pair, metric""",
)
put(
    "y1_judge_calls",
    f"SELECT CAST(length(prompt) % 5 + 1 AS BIGINT) AS score, true AS parse_ok, CAST(0 AS BIGINT) AS retry_count, count(*) AS n FROM (SELECT {_prompt(POINTWISE_PROMPT, article=_q('none'), summary='summary')} AS prompt FROM (SELECT *, 'fluency' AS dimension FROM summaries)) GROUP BY 1",
)
put(
    "y1_durable_run",
    f"SELECT CAST(length(prompt) % 5 + 1 AS BIGINT) AS score, true AS parse_ok, CAST(0 AS BIGINT) AS retry_count, count(*) AS n FROM (SELECT {_prompt(POINTWISE_PROMPT, article=_q('none'), summary='summary')} AS prompt FROM (SELECT *, 'fluency' AS dimension FROM summaries)) GROUP BY 1",
)
put(
    "m1_live_rollup",
    """SELECT CAST(floor(started_at / 3600) * 3600 AS BIGINT) AS starts_at, dimension, count(*) AS n, round(avg(CAST(parse_ok AS DOUBLE)), 6) AS ok_share, round(avg(CAST(escalated AS DOUBLE)), 6) AS escalated_share, round(avg(latency_ms), 6) AS mean_latency_ms
    FROM telemetry WHERE started_at IS NOT NULL GROUP BY 1, 2""",
)
put("m2_each_job_once", "SELECT DISTINCT item_id, dimension, judge_type FROM telemetry")
_SCORES = ("coherence", "consistency", "fluency", "relevance")
put("s1_read_raw", f"SELECT CAST(i - 1 AS BIGINT) AS model_index, count(*) AS n, {', '.join(f'round(sum({c}[i]), 6) AS {c}' for c in _SCORES)} FROM wide, range(1, 17) AS t(i) GROUP BY i")
put(
    "s2_read_csv",
    """SELECT dimension, count(*) AS n, CAST(sum(length(raw_response) + CASE WHEN model_index % 2 = 0 THEN 18 ELSE 0 END) AS BIGINT) AS n_chars, count(judge_score) AS n_scored FROM judged WHERE model_index <> 3 GROUP BY dimension
    UNION ALL SELECT 'quarantine', count(*), NULL, NULL FROM judged WHERE model_index = 3""",
)
put("s3_read_summaries", "SELECT 'm1' AS model_pair, metric, CAST(25 AS BIGINT) AS sample_size, CASE WHEN metric < 'f' THEN count(*) END AS n_trials, round(avg(score), 6) AS full_sample_estimate FROM long GROUP BY metric")
_MODELS = "(SELECT doc_id, count(DISTINCT model_index) AS m FROM panel GROUP BY doc_id)"
put(
    "v3_checked",
    f"""SELECT faults, faults = '' AS good, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
        SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 10 = 2 THEN 'null_relevance' END, CASE WHEN doc_id % 10 = 1 AND fluency + 5 > 5 THEN 'out_fluency' END, CASE WHEN m <> 4 THEN 'models' END) AS faults
        FROM panel JOIN {_MODELS} USING (doc_id)) GROUP BY faults""",
)
put(
    "v3_report",
    f"SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_unique_docs, count(DISTINCT CASE WHEN m <> 4 THEN doc_id END) AS n_bad_docs, count(*) FILTER (m <> 4) AS n_bad_rows, false AS passed, count(*) FILTER (m <> 4) AS n_models_fault FROM panel JOIN {_MODELS} USING (doc_id)",
)
put("u4_missing_columns", "SELECT count(*) AS n_panel, CAST(0 AS BIGINT) AS n_rows, false AS passed, 'missing columns: [''article'', ''summary'', ''relevance'']' AS error FROM panel")
put("g3_calibration_p", "SELECT dimension, n, round(pearson_r, 6) AS pearson_r, round(pearson_p, 6) AS pearson_p, round(spearman_r, 6) AS spearman_r, round(spearman_p, 6) AS spearman_p, round(mae, 6) AS mean_absolute_error, round(mse, 6) AS mean_signed_error FROM calibrated")
put(
    "e1_policy",
    """SELECT dimension, round(pearson_r, 6) AS pearson_r, round(pearson_p, 6) AS pearson_p, n, trusted,
        CASE WHEN pearson_p >= 0.05 THEN printf('not statistically significant (p=%.4f >= 0.05)', pearson_p) WHEN abs(pearson_r) < 0.3 THEN printf('correlation too weak (|r|=%.3f < 0.3)', abs(pearson_r))
          ELSE printf('significant (p=%.4f) and sufficiently strong (r=%.3f)', pearson_p, pearson_r) END AS reason
    FROM calibrated JOIN trusted USING (dimension)""",
)
