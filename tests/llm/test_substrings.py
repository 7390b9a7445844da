import hashlib

import numpy as np
from judge_jobs.llm import substrings


def brute(texts):
    """(doc_id, n_words, n_removed, sha of what is kept) by comparing every window."""
    first, out = {}, {}
    for doc, t in sorted(texts):
        words = (t or "").encode().split()
        gone, new = set(), []
        for p in range(len(words) - 49):
            window = tuple(words[p : p + 50])
            if first.get(window, doc) < doc:
                gone.update(range(p, p + 50))
            else:
                new.append(window)
        for window in new:
            first.setdefault(window, doc)
        out[doc] = (len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())
    return out


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_window_hashes_depend_on_the_window_alone():
    x = np.arange(1000, dtype=np.uint64) % np.uint64(37)
    for size in (20, 50, 31):
        h = substrings.windows(x, size)
        assert len(h) == 1000 - size + 1
        assert len(set(h.tolist())) == 37
        assert h[0] == h[37]


def test_against_brute_force(docs, texts):
    want = brute(texts)
    rows = substrings.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want
    assert len(rows) == len(texts)
    assert any(0 < r.n_removed < r.n_words for r in rows) and any(r.n_removed == r.n_words > 0 for r in rows)
    for r in rows:
        assert r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_all_alignments(spark):
    """A shared run of exactly 50 words, at every pair of residues that matters."""
    run = [f"r{k}" for k in range(50)]
    rows = [(k, " ".join([f"a{k}x{j}" for j in range(k)] + run + [f"z{k}"])) for k in range(40)]
    found = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: 50 if k else 0 for k in range(40)}


def test_edges(empty, odd):
    assert substrings.remove_repeats(empty).count() == 0
    rows = substrings.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    by = lambda i: sorted(r.n_removed for r in rows if r.doc_id == i)
    assert by(1) == [0, 0, 0]  # rows of one id don't remove from each other
    assert by(2) == [70] and by(3) == [0] and by(4) == [0]
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
