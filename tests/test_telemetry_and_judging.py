import os

import pytest
from judge_jobs import schemas
from judge_jobs.operators import judging, telemetry
from judge_jobs.sources import tables
from judge_jobs.streaming import live
from pyspark.sql import functions as F


def events(spark, *rows):
    """(item, dimension, started_at, latency, ok, escalated, retries, error)"""
    return spark.createDataFrame([(i, d, "pointwise", "mock", "m", t, ms, ok, e, n, x, {}) for i, d, t, ms, ok, e, n, x in rows], schemas.TELEMETRY)


def run(spark):
    rows = [(f"i{k}", "fluency" if k % 2 else "coherence", 1000.0 + k, 10.0 * (k + 1), k != 3, k < 50, 2 if k == 5 else 0, "rate limited" if k == 5 else None) for k in range(100)]
    return events(spark, *rows)


def test_kpis(spark):
    r = telemetry.kpis(run(spark)).first()
    assert (r.n, r.n_ok, r.n_retried, r.n_errors, r.n_escalated) == (100, 99, 1, 1, 50)
    assert r.duration_s == 99 and r.per_second == pytest.approx(100 / 99)
    empty = telemetry.kpis(events(spark)).first()
    assert empty.n == 0 and empty.ok_share == 0


def test_nearest_rank_percentiles(spark):
    found = {r.pct: r.latency_ms for r in telemetry.latency_percentiles(run(spark)).collect()}
    assert found == {p: 10.0 * (round(p / 100 * 99) + 1) for p in (50, 90, 95, 99)}
    assert {r.latency_ms for r in telemetry.latency_percentiles(events(spark)).collect()} == {0.0}
    few = {r.pct: r.latency_ms for r in telemetry.latency_percentiles(run(spark), parts=3).collect()}
    assert few == found
    same = events(spark, *[("i", "d", 5.0, 7.0, True, False, 0, None)] * 3)
    assert {r.latency_ms for r in telemetry.latency_percentiles(same).collect()} == {7.0}


def test_throughput_has_every_bucket(spark):
    df = events(spark, *[("i", "d", t, 1.0, True, False, 0, None) for t in (0.0, 0.1, 19.0, 20.0)])
    found = [r.n for r in telemetry.throughput(df).orderBy("bucket").collect()]
    assert found == [2] + [0] * 18 + [2]
    same = events(spark, *[("i", "d", 5.0, 1.0, True, False, 0, None)] * 3)
    assert [r.n for r in telemetry.throughput(same).orderBy("bucket").collect()] == [3] + [0] * 19


def test_breakdown_mix_projection(spark):
    d = {r.dimension: r for r in telemetry.by_dimension(run(spark)).collect()}
    assert d["coherence"].n == 50 and d["fluency"].ok_share == 0.98
    assert telemetry.troubled(run(spark)).count() == 1
    assert telemetry.job_mix(run(spark)).where("level = 15").first().n == 100
    p = {r.workload: r.duration for r in telemetry.projection(run(spark), {"small": 10, "mid": 1000, "big": 400000}).collect()}
    assert p == {"small": "9.9 s", "mid": "16.5 min", "big": "110.0 h"}


def jobs(spark, n, start=0):
    return spark.createDataFrame([(f"doc-{k}", "fluency", "pointwise", f"prompt {k}") for k in range(start, n)], schemas.JOBS)


def test_calls_retry_and_parse(spark, tmp_path):
    flaky = str(tmp_path)

    def responder(prompt, model):
        import os

        n = int(prompt.split()[1])
        if n == 2:
            raise RuntimeError("always down")
        mark = f"{flaky}/{n}"
        tries = len(open(mark).read()) if os.path.exists(mark) else 0
        open(mark, "a").write("x")
        if n == 1 and tries < 2:
            raise RuntimeError("busy")
        return "no number" if n == 3 else f"{n % 5 + 1}/5"

    called = judging.call(jobs(spark, 6), responder, "m", max_retries=2, threads=2, wait_s=0.01)
    called.write.parquet(f"{flaky}/out")  # calls are made once
    found = {r.item_id: r for r in judging.parsed(spark.read.parquet(f"{flaky}/out")).collect()}
    assert (found["doc-1"].retry_count, found["doc-1"].error, found["doc-1"].score) == (2, None, 2)
    assert (found["doc-2"].retry_count, found["doc-2"].error, found["doc-2"].parse_ok, found["doc-2"].score) == (2, "always down", False, None)
    assert not found["doc-3"].parse_ok and found["doc-3"].error is None
    assert found["doc-4"].parse_ok and found["doc-4"].winner is None

    log = f"{flaky}/log"
    tables.append_telemetry(judging.events(judging.parsed(spark.read.parquet(f"{flaky}/out")).withColumn("escalated", ~F.col("parse_ok"))), log)
    done = tables.read_telemetry(spark, log)
    assert done.count() == 6
    assert {r.item_id for r in telemetry.pending(jobs(spark, 9), done).collect()} == {"doc-6", "doc-7", "doc-8"}
    assert telemetry.pending(jobs(spark, 9), done, resume=False).count() == 9
    assert telemetry.latest(done.union(done.withColumn("started_at", F.col("started_at") + 1))).count() == 6


def test_a_lost_run_goes_on_where_it_was(spark, tmp_path):
    """The first run breaks off half-way; the second repeats no chunk that was whole, and ends with every job answered once."""
    asked, path, down = str(tmp_path / "asked"), str(tmp_path / "run"), str(tmp_path / "down")
    os.makedirs(asked)
    open(down, "w").close()

    def responder(prompt, model):
        import os
        import uuid

        class Lost(BaseException):
            pass

        if os.path.exists(down) and len(os.listdir(asked)) >= 12:
            raise Lost
        open(f"{asked}/{prompt.split()[1]}-{uuid.uuid4().hex}", "w").close()
        if prompt.endswith(" 5"):
            raise RuntimeError("never")
        return "4"

    twice = jobs(spark, 24).union(jobs(spark, 1))
    options = {"chunks": 6, "max_retries": 1, "wait_s": 0.001, "threads": 1, "partitions": 1}
    policy = spark.createDataFrame([("fluency", False)], "dimension string, trusted boolean")
    with pytest.raises(Exception):
        judging.judge_durably(twice, responder, "m", path, policy, **options)
    before = {r.item_id for r in judging.durable_log(spark, path).collect()}
    assert 0 < len(before) < 24
    tried = set(os.listdir(asked))
    os.remove(down)
    log = judging.judge_durably(twice, responder, "m", path, policy, **options)
    again = {f"doc-{f.split('-')[0]}" for f in set(os.listdir(asked)) - tried}
    assert not again & before
    rows = {r.item_id: r for r in log.collect()}
    assert log.count() == len(rows) == 24 and all(r.escalated for r in rows.values())
    assert (rows["doc-5"].error, rows["doc-5"].retry_count, rows["doc-5"].score) == ("never", 1, None) and rows["doc-6"].score == 4
    count = len(os.listdir(asked))
    assert judging.judge_durably(twice, responder, "m", path, policy, **options).count() == 24 and len(os.listdir(asked)) == count
    assert judging.judge_durably(jobs(spark, 0), responder, "m", str(tmp_path / "none"), **options).count() == 0


def counting(folder):
    """A responder that leaves a file for each call."""

    def responder(prompt, model):
        import uuid

        open(f"{folder}/{prompt.split()[1]}-{uuid.uuid4().hex}", "w").close()
        return "3"

    return responder


def test_later_jobs_under_the_same_path(spark, tmp_path):
    """Finished jobs are never asked again, new ones are, and resume=False asks all."""
    asked, path = str(tmp_path / "asked"), str(tmp_path / "run")
    os.makedirs(asked)
    options = {"chunks": 4, "threads": 2, "max_in_flight": 2}
    calls = lambda: len(os.listdir(asked))
    assert judging.judge_durably(jobs(spark, 2), counting(asked), "m", path, **options).count() == 2 and calls() == 2
    assert judging.judge_durably(jobs(spark, 5), counting(asked), "m", path, **options).count() == 5 and calls() == 5
    assert judging.judge_durably(jobs(spark, 5), counting(asked), "m", path, **options).count() == 5 and calls() == 5
    assert judging.judge_durably(jobs(spark, 8, start=5), counting(asked), "m", path, **options).count() == 8 and calls() == 8
    assert judging.judge_durably(jobs(spark, 3), counting(asked), "m", path, resume=False, **options).count() == 11 and calls() == 11
    other = jobs(spark, 2).withColumn("judge_type", F.lit("pairwise"))  # the type is part of the key
    assert judging.judge_durably(other, counting(asked), "m", path, **options).count() == 13 and calls() == 13
    nulls = jobs(spark, 1).withColumn("item_id", F.lit(None).cast("string"))
    for _ in range(2):
        assert judging.judge_durably(nulls.union(nulls), counting(asked), "m", path, **options).count() == 14 and calls() == 14


def test_other_chunks_and_half_written_ones(spark, tmp_path):
    """A later start may deal to another number of chunks; what a lost writer left without its mark is not read."""
    asked, path = str(tmp_path / "asked"), str(tmp_path / "run")
    os.makedirs(asked)
    judging.judge_durably(jobs(spark, 6), counting(asked), "m", path, chunks=3)
    spark.range(3).write.parquet(f"{path}/rounds/000001/log/chunk=0")
    os.remove(f"{path}/rounds/000001/log/chunk=0/_SUCCESS")
    log = judging.judge_durably(jobs(spark, 20), counting(asked), "m", path, chunks=7)
    assert log.count() == 20 and log.select("item_id").distinct().count() == 20 and len(os.listdir(asked)) == 20


@pytest.mark.parametrize("bound, threads, partitions", [(1, 8, None), (3, 2, None), (4, 8, None), (6, 2, 1)])
def test_calls_in_flight_have_one_bound(spark, tmp_path, bound, threads, partitions):
    """Files stand for calls that run; no call ever sees more of them than the bound."""
    going, most = str(tmp_path / "going"), str(tmp_path / "most")
    os.makedirs(going)
    os.makedirs(most)

    def responder(prompt, model):
        import os
        import time
        import uuid

        name = uuid.uuid4().hex
        open(f"{going}/{name}", "w").close()
        time.sleep(0.02)
        open(f"{most}/{len(os.listdir(going))}", "w").close()
        os.remove(f"{going}/{name}")
        return "1"

    called = judging.call(jobs(spark, 40).repartition(8), responder, "m", threads=threads, partitions=partitions, max_in_flight=bound)
    called.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    assert 1 <= max(map(int, os.listdir(most))) <= bound
    with pytest.raises(ValueError):
        judging.call(jobs(spark, 1), responder, "m", max_in_flight=0)


def test_live_rollup(spark, tmp_path):
    """Every event counts, in open windows too; late ones are listed; restarts and replayed batches change nothing."""
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    rollup = live.LiveRollup(spark, str(tmp_path / "rollup"), "1 minute", late="2 minutes")
    assert rollup.read().count() == 0
    add = lambda *rows: tables.append_telemetry(events(spark, *rows).coalesce(1), log)
    drain = lambda: rollup.drain(live.read(spark, log), state)
    found = lambda: {(r.starts_at.timestamp(), r.dimension): (r.n, r.ok_share, r.mean_latency_ms) for r in rollup.read().collect()}
    add(("i1", "fluency", 0.0, 10.0, True, False, 0, None), ("i2", "fluency", 30.0, 30.0, False, True, 0, None), ("i3", "fluency", 60.0, 50.0, True, False, 0, None))
    drain()
    assert found() == {(0.0, "fluency"): (2, 0.5, 20.0), (60.0, "fluency"): (1, 1.0, 50.0)}
    add(("i4", "fluency", 1000.0, 1.0, True, False, 0, None))
    drain()
    drain()
    add(("i5", "fluency", 5.0, 20.0, True, False, 0, None), ("i6", None, 2000.0, None, None, None, 0, None))
    drain()
    assert found() == {(0.0, "fluency"): (3, 2 / 3, 20.0), (60.0, "fluency"): (1, 1.0, 50.0), (960.0, "fluency"): (1, 1.0, 1.0), (1980.0, None): (1, None, None)}
    assert [r.item_id for r in rollup.late_events().collect()] == ["i5"]
    batch = live.read(spark, log)  # a batch that comes again, as after a crash before the checkpoint was written
    stream = live._stream_id(spark, state)
    seen = spark.read.schema(schemas.TELEMETRY).json(log).withColumn("ts", F.col("started_at").cast("timestamp"))
    before = found()
    assert not rollup.add(stream, seen, 0) and found() == before and batch.isStreaming
    with pytest.raises(ValueError):
        rollup.add("another", seen, 0)


def test_live_rollup_equals_the_batch(spark, tmp_path):
    """Sliding windows and many small batches against one pass over all."""
    rows = [(f"i{k}", "fluency" if k % 3 else "coherence", 7.0 * k, 1.0 * k, k % 4 > 0, k % 5 == 0, 0, None) for k in range(200)]
    log = str(tmp_path / "log")
    rollup = live.LiveRollup(spark, str(tmp_path / "rollup"), "2 minutes", "1 minute")
    tables.append_telemetry(events(spark, *rows).repartition(6), log)
    rollup.drain(live.read(spark, log, files_per_batch=2), str(tmp_path / "state"))
    assert len(rollup.parts.version()[2]) == 3
    want = live.shares(live.sums(events(spark, *rows).withColumn("ts", F.col("started_at").cast("timestamp")), "2 minutes", "1 minute"))
    key = lambda r: (r.starts_at, r.dimension)
    for a, b in zip(sorted(rollup.read().collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert tuple(a)[:4] == tuple(b)[:4] and tuple(a)[4:] == pytest.approx(tuple(b)[4:])


def test_each_job_once(spark, tmp_path):
    """Repeats are dropped within a batch, after restarts, and long after the first event."""
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    drain = lambda: live.drain(live.first_of_each_job(live.read(spark, log)).drop("ts"), out, state)
    tables.append_telemetry(events(spark, *[("i1", "fluency", 1.0 * k, 1.0, True, False, 0, None) for k in range(3)], ("i2", "fluency", 1.0, 1.0, True, False, 0, None)), log)
    drain()
    tables.append_telemetry(events(spark, ("i1", "fluency", 1e6, 1.0, True, False, 0, None), ("i3", "fluency", 2e6, 1.0, True, False, 0, None)), log)
    drain()
    tables.append_telemetry(events(spark, ("i3", "fluency", 5.0, 1.0, True, False, 0, None), ("i2", "fluency", 9e6, 1.0, True, False, 0, None)), log)
    drain()
    assert sorted(r.item_id for r in spark.read.parquet(out).collect()) == ["i1", "i2", "i3"]
    limited, out2 = live.first_of_each_job(live.read(spark, log), "10 minutes").drop("ts"), str(tmp_path / "out2")
    live.drain(limited, out2, str(tmp_path / "state2"))
    assert {r.item_id for r in spark.read.parquet(out2).collect()} == {"i1", "i2", "i3"}
