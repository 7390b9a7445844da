import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from judge_jobs.llm import idfiles
from judge_jobs.llm.common import shared_dir


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), dtype="<i8").view("<u8")
    assert sorted(idfiles.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError):
        idfiles.PerfectHash.build(np.array([1, 1], "<u8"))


def test_absent_keys_are_refused():
    keys = list(range(0, 4000, 2))
    stream = io.BytesIO()
    writer = idfiles.ShardWriter(stream, 2)
    for part in (keys[:700], keys[700:]):
        writer.add(part, np.ones(len(part), np.int64), np.array(part, "<u4"))
    writer.close()
    shard = idfiles.Shard(stream.getvalue())
    assert (shard.find(np.arange(1, 4000, 2)) == -1).all()
    assert shard.find(np.array(keys)).tolist() == list(range(2000))


def test_round_trip(spark, docs, texts, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    path = shared_dir(spark, "ids")
    assert idfiles.write(docs, path, vocabulary, partitions=3).count() == 3
    got = {r.doc_id: r for r in idfiles.read(spark, path, with_ids=True).collect()}
    at = 0
    for doc, t in sorted(texts):
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert list(got[doc].ids) == want
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    wanted = spark.createDataFrame([(texts[0][0],), (texts[5][0],), (10**12,), (4,)], "doc_id long")
    found = {r.doc_id: r for r in idfiles.lookup(wanted, path).collect()}
    for doc in (texts[0][0], texts[5][0]):
        assert (found[doc].start, found[doc].ids_crc32) == (got[doc].start, got[doc].ids_crc32)
    assert found[10**12].start is None and found[4].start is None


def test_edges(empty, odd, vocabulary):
    assert idfiles.write_and_read(empty, vocabulary).count() == 0
    rows = idfiles.write_and_read(odd, vocabulary, partitions=2).collect()
    assert len(rows) == odd.count()
    assert sorted(r.start for r in rows) == sorted({r.start for r in rows})  # each record once
    assert {r.n_tokens for r in rows if r.doc_id == 4} == {1}


def test_a_hot_key_runs_over_files(spark, vocabulary):
    """A key, and one row, with most of all rows, null keys, and a text of some MB: files stay small, and every row is stored."""
    long = "word " * 600_000
    rows = [(5, f"text {k % 3}") for k in range(900)] + [(None, "x")] * 200 + [(k, f"other {k}") for k in range(10, 60)] + [(7, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    path = shared_dir(spark, "ids")
    files = idfiles.write(docs, path, vocabulary, partitions=4, file_ids=200).collect()
    assert max(f.n_docs for f in files) < 200 and sum(f.n_docs for f in files) == len(rows)
    got = sorted(idfiles.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    (hot,) = idfiles.lookup(spark.createDataFrame([(5,)], "doc_id long"), path).collect()
    assert hot.start == min(r.start for r in got if r.doc_id == 5)
    (huge,) = [r for r in got if r.doc_id == 7]
    assert huge.n_tokens > 600_000
