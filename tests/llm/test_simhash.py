import random

import numpy as np
from judge_jobs.llm import simhash
from judge_jobs.llm.graph import components
from xxhash import xxh64_intdigest


def union(n, pairs):
    to = list(range(n))

    def find(a):
        while to[a] != a:
            to[a] = to[to[a]]
            a = to[a]
        return a

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        to[b] = a
    return [find(a) for a in range(n)]


def test_golay_decodes_three_errors():
    rng = random.Random(1)
    codewords = []
    for data in rng.sample(range(4096), 64):
        word = data << 11
        word |= int(simhash._syndrome(np.array([word], dtype=np.int64))[0])
        assert simhash._syndrome(np.array([word], dtype=np.int64))[0] == 0
        for _ in range(10):
            errors = sum(1 << b for b in rng.sample(range(23), rng.randint(0, 3)))
            assert simhash.decode([word ^ errors])[0] == data
        codewords.append(word)
    assert min(bin(a ^ b).count("1") for a in codewords for b in codewords if a != b) >= 7


def test_keys_meet_within_three_bits():
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        one = lambda v, near: set(simhash.keys(np.array([v], dtype=np.uint64), near)[1].tolist())
        assert one(x, True) & one(y, False)
        assert one(y, True) & one(x, False)


def test_fingerprint_bits():
    for text in (b"", b"One two", b"a b c d e a b c d e F g", b" ".join(b"w%d" % (k % 50) for k in range(40000))):
        words = text.lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) == want


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {0} | {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long").repartition(3)).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want and len(want) > 100


def test_components(spark):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    want = union(300, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {k: want[k] for k in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(docs, texts):
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in texts}
    ids = sorted(prints)
    pairs = [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if bin(prints[ids[a]] ^ prints[ids[b]]).count("1") <= 3]
    want = union(len(ids), pairs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", ids[want[k]]) for k, i in enumerate(ids)}
    assert len({c for _, c in got.values()}) < len(ids)


def first_of_groups(texts):
    """Ids that stay when groups are chains of Jaccard similarity 0.8 over five-word shingles, by comparing all pairs."""
    ids = sorted(texts, key=lambda i: (i is not None, i))
    words = [(texts[i] or "").encode().lower().split() for i in ids]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return {ids[k] for k in set(union(len(ids), pairs))}


def test_keep_first(docs, texts):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    found = [r.doc_id for r in kept.collect()]
    assert len(found) == len(set(found)) and set(found) == first_of_groups(dict(texts))


def test_keep_first_recall_and_precision(spark):
    """Near copies at and above the limit of 0.8, and pairs below it that must stay."""
    rng = random.Random(6)
    texts = {}
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        texts[2 * k] = " ".join(words)
        share = rng.uniform(0.002, 0.05)
        texts[2 * k + 1] = " ".join("new" + w if rng.random() < share else w for w in words)
    want = first_of_groups(texts)
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert want <= got
    assert len(texts) - len(got) >= 0.9 * (len(texts) - len(want)) > 30


def test_edges(empty, odd):
    assert simhash.near_duplicates(empty).count() == 0
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (3, 4)} == {3}  # no words: linked at zero
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())[0][0] in (True, False)
    assert simhash.keep_first(empty).count() == 0
