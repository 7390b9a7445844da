import subprocess
import sys

import __spark_entry__ as entry
import pytest


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r.dimension for r in rows] == ["coherence", "consistency", "fluency", "relevance"]
    assert [r.trusted for r in rows] == [True, True, False, True]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


CHECKED = ("g1_g2_calibration", "j6_both_orders", "k3_k5_debiased", "x4_parse_score", "x9_verbose_variant", "g19_latency_percentiles", "p10_contract")
CHECKED += ("s1_read_raw", "s2_read_csv", "s3_read_summaries", "s5_committed_append", "s8_resumed_append", "u4_missing_columns", "v3_checked", "v3_report", "v4_profile", "w6_average_ranks", "j5_partly_done", "m1_live_rollup", "m2_each_job_once", "y1_durable_run", "x6_parse_reasoned_verdict", "g3_calibration_p", "e1_policy", "e2_annotated", "g12_escalation")


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "events", "documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(want.columns)
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())


def test_works_without_the_corpus_part(tmp_path):
    """A copy without that subpackage and pipeline still imports and lists the other queries."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
