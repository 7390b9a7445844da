"""Explicit schemas of the tables that jobs read and write."""

from pyspark.sql import types as T

from .fixed import DIMENSIONS

_S, _D, _I, _B, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.LongType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RAW = _of(id=_S, text=_S, machine_summaries=T.ArrayType(_S), human_summaries=T.ArrayType(_S), **{d: T.ArrayType(_D) for d in DIMENSIONS})
SCORED = _of(doc_id=_S, model_index=_I, article=_S, summary=_S, **{d: _D for d in DIMENSIONS})
JUDGE_RESULTS = _of(doc_id=_S, model_index=_I, dimension=_S, human_score=_D, raw_response=_S, judge_score=_I, parse_ok=_B, parse_note=_S)
POSITION_BIAS = _of(doc_id=_S, dimension=_S, model_a_idx=_I, model_b_idx=_I, winner_original_order=_S, winner_swapped_order=_S, consistent=_B, note=_S)
DEBIASED = _of(doc_id=_S, dimension=_S, model_a_idx=_I, model_b_idx=_I, winner=_S, agreement=_B, n_calls=_I, note=_S)
VERBOSITY = _of(doc_id=_S, model_idx=_I, dimension=_S, original_score=_I, verbose_score=_I, score_delta=_I, length_ratio=_D)
CALIBRATION = _of(dimension=_S, n=_L, pearson_r=_D, pearson_p=_D, spearman_r=_D, spearman_p=_D, mean_absolute_error=_D, mean_signed_error=_D)
SENSITIVITY = _of(
    model_pair=_S, metric=_S, sample_size=_I, n_trials=_L, mean_ci_width=_D, std_ci_width=_D, empirical_coverage=_D, mean_point_estimate=_D,
    std_point_estimate=_D, fraction_significant=_D, median_p_value=_D, coverage_se=_D, nominal_ci_level=_D, full_sample_estimate=_D,
)
TELEMETRY = _of(
    item_id=_S, dimension=_S, judge_type=_S, backend=_S, model=_S, started_at=_D, latency_ms=_D, parse_ok=_B, escalated=_B, retry_count=_I, error=_S,
    extra=T.MapType(_S, _S),
)
JOBS = _of(item_id=_S, dimension=_S, judge_type=_S, prompt=_S)
