"""Lines are filed by all their blocks, in shares, and meet once for each run of words in common."""

import random

import pyarrow as pa
from judge_jobs.llm import lines
from judge_jobs.llm.common import table


def one_block_in_common(seed, n=200):
    """Two lines of edit similarity above 0.9 that have four words in a row in common at one place only: of the others each fourth one has another letter."""
    rng = random.Random(seed)
    first = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(6, 9))) for _ in range(n)]
    second, kept = list(first), 4 * rng.randrange(n // 4 - 1)
    for k in range(0, n, 4):
        if k != kept:
            second[k] = second[k][:2] + "z" + second[k][3:]
    return " ".join(first), " ".join(second)


def test_one_block_in_common_is_enough(spark):
    pairs = [one_block_in_common(k) for k in range(30)]
    for a, b in pairs:
        assert lines.similar(a, b, 0.9)
        rows, keys = lines.meeting_keys(pa.array([a.encode(), b.encode()], pa.binary()))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(x for p in pairs[:8] for x in p)], "doc_id long, text string")
    assert {r.doc_id for r in lines.dedupe_lines(docs).collect() if r.n_removed} == set(range(1, 16, 2))


def met(spark, texts):
    classes = table(spark.createDataFrame([(k, bytearray(x.encode())) for k, x in enumerate(texts)], "id long, norm binary"), "classes")
    return [r for share in range(lines.PASSES) for r in lines._met(classes, share).collect()]


def test_words_in_common_are_met_once(spark):
    """Two lines meet where what they have in common begins: not under each of its blocks, and also at their beginnings."""
    run = " ".join(f"common{k}" for k in range(40))
    rows = met(spark, [f"one two three four five {run} six", f"{run} seven eight", f"other words {run}", "nothing of all this is in any other line of these at all as far as one sees"])
    assert sorted(r.id for r in rows) == [0, 1, 2] and len({r.k for r in rows}) == 1 and {r.met for r in rows} == {3}


def test_a_key_goes_on_in_the_next_batch(spark):
    texts = [f"word{k} in front of some few words that all lines have and then some more of them {k}" for k in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = met(spark, texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.id for r in rows) == list(range(50)) and {r.met for r in rows} == {50}


def test_pairs_meet_their_texts_in_shares(spark):
    classes = table(spark.createDataFrame([(k, bytearray(f"a line of some words {k // 2}".encode())) for k in range(40)], "id long, norm binary"), "classes")
    pairs = table(spark.createDataFrame([(k, k + 1) for k in range(0, 40, 2)], "id long, id_b long"), "pairs")
    shares = lines._verified(pairs, classes, 5)
    assert len(shares) == 4
    assert sorted(tuple(r) for s in shares for r in s.collect()) == [(k, k + 1) for k in range(0, 40, 2)]
