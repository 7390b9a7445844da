import json
import os

import pytest
from judge_jobs.sources import tables
from judge_jobs.sources.commits import CommittedTable
from pyspark.sql import functions as F


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def held(table):
    return sorted(r.n for r in table.read().collect())


@pytest.mark.parametrize("form", ["parquet", "json", "csv"])
def test_a_run_counts_once(spark, tmp_path, form):
    table = CommittedTable(spark, str(tmp_path / "t"), "n long", form)
    assert held(table) == [] and not table.holds("a")
    assert table.append("a", numbers(spark, 1, 2))
    assert not table.append("a", numbers(spark, 1, 2)) and held(table) == [1, 2]
    assert table.append("b", numbers(spark)) and table.append("c", numbers(spark, 3))
    assert held(table) == [1, 2, 3] and table.holds("b")
    again = CommittedTable(spark, str(tmp_path / "t"), "n long", form)
    assert not again.append("c", numbers(spark, 3)) and held(again) == [1, 2, 3]


def test_a_killed_append_leaves_nothing_and_is_repeated(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "n long")
    table.append("a", numbers(spark, 1))
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="lost"):
        table.append("b", bad)
    numbers(spark, 7).write.parquet(str(tmp_path / "t/data/written-but-never-committed"))
    (tmp_path / "t/drafts").mkdir(exist_ok=True)
    (tmp_path / "t/drafts/left").write_text(json.dumps({"folders": ["written-but-never-committed"], "runs": ["a", "b"]}))
    assert held(table) == [1]
    assert table.append("b", numbers(spark, 2)) and held(table) == [1, 2]


def test_two_writers(spark, tmp_path, monkeypatch):
    """The one that comes second for a version starts over on what the first left; the same run counts for one of them."""
    a, b = (CommittedTable(spark, str(tmp_path / "t"), "n long") for _ in range(2))
    take, done = CommittedTable._take, []

    def slow(self, number, folders, runs):
        if self is a and not done:
            done.append(b.append("b", numbers(spark, 2)))
        return take(self, number, folders, runs)

    monkeypatch.setattr(CommittedTable, "_take", slow)
    assert a.append("a", numbers(spark, 1)) and done == [True] and held(a) == [1, 2]
    done.clear()

    def same(self, number, folders, runs):
        if self is a and not done:
            done.append(b.append("c", numbers(spark, 3)))
        return take(self, number, folders, runs)

    monkeypatch.setattr(CommittedTable, "_take", same)
    assert not a.append("c", numbers(spark, 3)) and done == [True] and held(a) == [1, 2, 3]


def test_small_files_are_merged(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "n long")
    for k in range(6):
        table.append(str(k), numbers(spark, k, k))
    assert table.compact(files=1) and held(table) == sorted([*range(6)] * 2)
    assert len(table.version()[1]) == 1 and not table.append("3", numbers(spark, 3)) and not table.compact()
    assert len(os.listdir(tmp_path / "t/data")) == 7
    assert table.vacuum(keep=1) == 6 and held(table) == sorted([*range(6)] * 2) and table.version()[0] == 7
    assert table.append("6", numbers(spark, 9)) and held(table)[-1] == 9


def test_appends_merge_by_themselves(spark, tmp_path, monkeypatch):
    from judge_jobs.sources import commits

    monkeypatch.setattr(commits, "FOLDERS", 3)
    table = CommittedTable(spark, str(tmp_path / "t"), "n long")
    for k in range(7):
        table.append(str(k), numbers(spark, k))
        assert len(table.version()[1]) < 3 and held(table) == [*range(k + 1)]


def test_telemetry_and_results(spark, tmp_path):
    from test_telemetry_and_judging import run

    log = str(tmp_path / "log")
    assert tables.read_committed_telemetry(spark, log).count() == 0
    assert tables.append_telemetry_once(run(spark), log, "one") and not tables.append_telemetry_once(run(spark), log, "one")
    assert sorted(map(str, tables.read_committed_telemetry(spark, log).collect())) == sorted(map(str, run(spark).collect()))
    results = spark.createDataFrame([("d", 1, "fluency", 2.0, "4", 4, True, "bare integer", "more")], "doc_id string, model_index int, dimension string, human_score double, raw_response string, judge_score int, parse_ok boolean, parse_note string, extra string")
    assert tables.append_judge_results_once(results, str(tmp_path / "r"), "one") and not tables.append_judge_results_once(results, str(tmp_path / "r"), "one")
    assert tables.judge_results_table(spark, str(tmp_path / "r")).read().first().raw_response == "4"
