import inspect

import corpus_pipeline
from judge_jobs.llm import quality_rules
from judge_jobs.llm.common import shared_dir, table
from judge_jobs.llm.tokens import TextEncoder
from test_decontamination import brute as leaks
from test_lines import brute as deduped
from test_simhash import first_of_groups


def test_against_brute_force(spark, docs, vocabulary):
    """Each stage by hand on what the stage before kept."""
    folder = shared_dir(spark, "corpus")
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    item = next(r.text for r in rows.values() if r.text and len(r.text.split()) > 60)
    items = [(1, " ".join(item.split()[2:40])), (2, "nothing like this is in any of the texts of ours")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        before, now = {r.doc_id: r.text for r in now.collect()}, table(stage(spark, now, folder), name)
        if name == "pack":
            break
        assert now.columns == docs.columns
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "quality":
            want = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
            assert set(after) == want and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            assert after == deduped(list(before.items()))[0]
        elif name == "near_dedup":
            assert set(after) == first_of_groups(before)
        elif name == "decontaminate":
            assert set(after) == set(before) - {d for d, _ in leaks(list(before.items()), items)}
            seen.append(len(before) - len(after))
    assert seen[0] >= 1
    encoder = TextEncoder.of(vocabulary)
    got = {}
    for r in now.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(encoder.encode(t)) // 4 + 1 for i, t in before.items()}
    assert sorted(now.collect()) == sorted(corpus_pipeline.run(spark, folder).collect())
