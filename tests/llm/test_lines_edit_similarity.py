"""Edit similarity alone decides which lines are linked."""

import random

import numpy as np
import pyarrow as pa
import pytest
from judge_jobs.llm import lines
from test_simhash import union


def corpus(seed=4):
    """Lines of 5 to 50 words, each with near copies, one line a document."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    out = []
    for n in (5, 7, 10, 15, 20, 30, 50):
        for _ in range(6):
            first = [word() for _ in range(n)]
            k = rng.randrange(n)
            out += [first, [*first[:k], word(), *first[k + 1 :]], [*first[:k], first[k] + "q", *first[k + 1 :]], [*first, "end"]]
    return [" ".join(x) for x in out]


def by_similarity(found):
    """Which lines stay, comparing all pairs of lines."""
    pairs = [(a, b) for a in range(len(found)) for b in range(a) if lines.similar(found[a], found[b])]
    group, first = union(len(found), pairs), {}
    for k in range(len(found)):
        first.setdefault(group[k], k)
    return set(first.values()), pairs


def test_all_similar_lines_are_linked(spark):
    found = corpus()
    want, pairs = by_similarity(found)
    assert len(pairs) > 150
    got = lines.dedupe_lines(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == want


def test_short_lines_and_lines_without_spaces(spark):
    """Exact repeats go however few words they have; signs alone are compared as they stand; blank lines stay."""
    chinese = "這一行沒有空格但是很長而且在兩個文件裡都出現過所以只留一次"
    texts = ["Contents\n---\n\nwell then\n" + chinese, "Contents\n***\n\nwell then\n" + chinese.replace("很長", "很短"), "---\n \nanything"]
    got = lines.dedupe_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == {0: (texts[0], 0), 1: ("***\n", 3), 2: (" \nanything", 1)}


def changed(rng, words, kind):
    """Words with one letter replaced, one word replaced or added, a fifth of the words replaced, or a twentieth or a twelfth of the letters."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    out, n = list(words), len(words)
    if kind == "added":
        out.insert(rng.randrange(n + 1), word())
    elif kind in ("letters", "noise"):
        text = list(" ".join(out))
        for k in rng.sample(range(len(text)), max(1, len(text) // (20 if kind == "letters" else 12))):
            text[k] = rng.choice("abcdefghijklmnop")
        return "".join(text).split()
    else:
        for k in rng.sample(range(n), max(1, n // 5) if kind == "fifth" else 1):
            at = rng.randrange(len(out[k]))
            out[k] = out[k][:at] + "q" + out[k][at + 1 :] if kind == "letter" else word()
    return out


@pytest.mark.parametrize("n", [5, 8, 12, 20, 35, 50])
@pytest.mark.parametrize("kind", ["letter", "word", "added", "fifth", "letters", "noise"])
def test_recall(n, kind):
    """Of pairs with edit similarity 0.8 or more at least 0.9 meet and look alike; with a twelfth of all letters changed half of them meet, and 0.9 of these look alike."""
    rng, found, met = random.Random(n), [], 0
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    while len(found) < 150:
        a = [rng.choice(vocabulary) for _ in range(n)]
        b = changed(rng, a, kind)
        x, y = " ".join(a), " ".join(b)
        if not lines.similar(x, y):
            if kind == "fifth" and n == 5 and rng.random() < 0.02:
                break
            continue
        both = pa.array([x.encode(), y.encode()], pa.binary())
        rows, keys = lines.meeting_keys(both)
        prints = lines.simhashes(both)
        alike = min(len(x), len(y)) < lines.FEW_CHARACTERS or int(np.bitwise_count((prints[0] ^ prints[1]).view(np.uint64)).sum()) <= lines.ERRORS
        shared = bool(set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist()))
        met += shared
        found.append(alike and shared)
    assert sum(found) >= 0.9 * met and met >= (0.5 if kind == "noise" else 0.9) * len(found)
    assert kind == "noise" or sum(found) >= 0.9 * len(found)


def test_similar_tiny_lines_share_a_key():
    rng = random.Random(8)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(4, lines.TINY)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        if 4 <= len(b) <= lines.TINY and lines.similar(a, b):
            assert lines.short_keys(a.encode()) & lines.short_keys(b.encode())
