import zlib
from pathlib import Path

from judge_jobs.llm import sharding
from judge_jobs.llm.common import shared_dir, table
from judge_jobs.llm.queries import op7_flow_resharding
from pyspark.sql import functions as F


def test_files_hold_the_planned_rows(spark, docs, odd):
    for rows, old in ((docs, F.floor(3 * F.sqrt(F.col("block") / sharding.BLOCKS))), (odd, F.lit(0))):
        plan, path = table(sharding.reshard(rows, old, shards=3), "plan"), shared_dir(spark, "shards")
        places = sharding.rewrite_in_order(rows, plan, path)
        want = sorted((r.shard, r.slot, str(r.doc_id), r.size, r.text_crc32) for r in plan.collect())
        assert sorted((r.shard, r.slot, str(r.doc_id), r.size, r.text_crc32) for r in places.collect()) == want
        held = spark.read.parquet(path).collect()
        assert held and {(r.shard, r.slot, str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in held} <= set(want)
        assert sorted(str(r.text) for r in held) == sorted(str(r.text) for r in rows.collect())  # all shards are affected here
        for f in Path(path.removeprefix("file:")).rglob("*.parquet"):
            slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
            assert slots == sorted(slots)


def test_the_query_writes_shards(spark, docs):
    folder = shared_dir(spark, "corpus")
    docs.write.parquet(f"{folder}/documents.parquet")
    assert op7_flow_resharding(spark, folder).count() == docs.count()
    base = Path(folder.removeprefix("file:")).parent
    assert any(base.glob("shards-*/shard=*/*.parquet"))
