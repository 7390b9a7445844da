import random

from judge_jobs.llm import decontamination as dec
from judge_jobs.llm.lines import normalise


def shingles(text):
    words = normalise((text or "").encode()).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(texts, items):
    out = {}
    for doc, t in texts:
        own = shingles(t)
        for item, x in items:
            want = shingles(x)
            shared = len(own & want)
            if want and shared >= 0.8 * len(want):
                out[doc, item] = (shared, len(want))
    return out


def corpus():
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, prose(rng.choice([1, 3, 5, 6, 9, 14, 25, 40, 90]))) for k in range(60)] + [(60, ""), (61, None)]
    items.append((62, items[20][1]))
    texts = []
    for k in range(80):
        x = items[k % 60][1].split()
        if k % 3 == 1:
            x = [w.upper() + "," for w in x]
        if k % 3 == 2 and len(x) > 10:
            x[len(x) // 2] = "other"
        texts.append((k, " ".join([prose(rng.randint(0, 2000)), *x, prose(rng.randint(0, 300))])))
    return texts + [(90, None), (91, "")], items


def frames(spark):
    texts, items = corpus()
    return texts, items, spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    texts, items, docs, bench = frames(spark)
    want = brute(texts, items)
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in dec.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 60


def test_blocks_of_items(spark):
    texts, items, docs, bench = frames(spark)
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(docs, bench, block_items=20).collect()}
    assert got == set(brute(texts, items))


def test_clean(spark, docs, odd, empty):
    texts, items, some, bench = frames(spark)
    dirty = {d for d, _ in brute(texts, items)}
    assert {r.doc_id for r in dec.clean(some, bench).collect()} == {d for d, _ in texts} - dirty
    item = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(10, 40)))], "item_id long, text string")
    kept = dec.clean(odd, item)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {None, 3, 4}
    assert dec.clean(empty, item).count() == 0
    assert dec.contaminated(docs, item.limit(0)).count() == 0
