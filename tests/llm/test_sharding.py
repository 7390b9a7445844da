import itertools
import random
import zlib

import pytest
from judge_jobs.llm import sharding
from judge_jobs.llm.common import shared_dir, table
from pyspark.sql import functions as F


def cheapest(sizes, capacities, cost):
    """Brute force over all integer flows of tiny instances."""
    best = None

    def go(i, room, total):
        nonlocal best
        if best is not None and total >= best:
            return
        if i == len(sizes):
            best = total
            return
        for split in itertools.product(range(sizes[i] + 1), repeat=len(room)):
            if sum(split) == sizes[i] and all(a <= b for a, b in zip(split, room)):
                go(i + 1, [b - a for a, b in zip(split, room)], total + sum(a * cost(i, j) for j, a in enumerate(split)))

    go(0, list(capacities), 0)
    return best


def test_transfers_cost_least():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(0, 4) for _ in range(3)]
        capacities = [rng.randint(0, 4) for _ in range(3)]
        capacities[rng.randrange(3)] += max(0, sum(sizes) - sum(capacities))
        prices = [[rng.randint(0, 5) for _ in range(3)] for _ in range(3)]
        cost = lambda i, j, prices=prices: prices[i][j]
        flow = sharding.transfers(sizes, capacities, cost)
        assert [sum(f) for f in flow] == sizes
        assert all(sum(f[j] for f in flow) <= capacities[j] for j in range(3))
        assert sum(flow[i][j] * cost(i, j) for i in range(3) for j in range(3)) == cheapest(sizes, capacities, cost)


def test_too_little_room():
    with pytest.raises(ValueError):
        sharding.transfers([5], [4])


def test_default_cost_keeps_all_it_can():
    sizes, capacities = [900, 100, 500, 0], [375] * 4
    flow = sharding.transfers(sizes, capacities)
    assert sum(flow[k][k] for k in range(4)) == sum(min(a, b) for a, b in zip(sizes, capacities))


def test_reshard(docs, texts, spark):
    old = F.floor(3 * F.sqrt(F.col("block") / sharding.BLOCKS))
    plan = sharding.reshard(docs, old, shards=4)
    rows = plan.collect()
    text = dict(texts)
    assert len(rows) == len(texts)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    shard = {}
    for r in rows:
        shard.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in shard.values())  # equal texts stay together
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    moved = sum(r.size for r in rows if r.moved)
    sizes = [sum(r.size for r in rows if r.old_shard == k) for k in range(3)]
    total = sum(sizes)
    assert moved >= total - sum(min(s, -(-total // 4)) for s in sizes) - max(r.size for r in rows)


def test_sizes_even_out(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, "x" * rng.randint(1, 60) + str(k)) for k in range(3000)], "doc_id long, text string")
    rows = sharding.reshard(df, F.floor(F.col("block") / 1000), shards=8).collect()
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 60


def test_hot_text_stays_whole(spark):
    df = spark.createDataFrame([(k, "hot text") for k in range(500)] + [(1000 + k, f"t{k}") for k in range(300)], "doc_id long, text string")
    rows = sharding.reshard(df, F.lit(0), shards=4).collect()
    assert len({r.shard for r in rows if r.doc_id < 500}) == 1
    rest = [sum(r.size for r in rows if r.shard == k and r.doc_id >= 1000) for k in range(4)]
    assert sorted(rest)[0] == 0 and sorted(rest)[3] - sorted(rest)[1] < 30


def test_rewrite_touches_affected_shards(spark, docs):
    old = F.pmod(F.col("block"), F.lit(4))
    plan, path = table(sharding.reshard(docs, old, shards=4, capacities=[10**9] * 4), "plan"), shared_dir(spark, "shards")
    assert plan.where("moved").count() == 0
    assert sharding.rewrite_in_order(docs, plan, path).count() == docs.count()
    assert spark.read.schema("doc_id long").parquet(path).count() == 0


@pytest.mark.parametrize("blocks", [1, 16, 500])
def test_any_number_of_blocks(spark, docs, blocks):
    plan, path = table(sharding.reshard(docs, F.lit(0), shards=2, blocks=blocks), "plan"), shared_dir(spark, "shards")
    got = {(r.doc_id, r.shard, r.slot) for r in sharding.rewrite_in_order(docs, plan, path).collect()}
    assert got == {(r.doc_id, r.shard, r.slot) for r in plan.collect()} and len(got) == docs.count()
    if blocks == 1:  # the one block stays where it is
        return
    other = plan.withMetadata("block", {"blocks": 4096})
    with pytest.raises(ValueError, match="planned"):
        sharding.rewrite_in_order(docs, other, shared_dir(spark, "shards"))
    with pytest.raises(ValueError, match="planned"):
        sharding.rewrite_in_order(docs.where("doc_id > 100"), plan, shared_dir(spark, "shards"))


def test_edges(empty, odd):
    assert sharding.reshard(empty, F.lit(0)).count() == 0
    rows = sharding.reshard(odd, F.lit(0), shards=3).collect()
    assert len(rows) == odd.count()
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 3} == {(1, 0)}
    for k in range(3):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
