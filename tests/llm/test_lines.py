import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from judge_jobs.llm import lines
from judge_jobs.llm.common import table
from judge_jobs.llm.graph import components
from test_simhash import union


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=12), st.text("abcé", max_size=12), st.integers(0, 12))
def test_distance(a, b, most):
    assert lines.distance(a, b, most) == min(levenshtein(a, b), most + 1)


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=30), st.text("abc ", min_size=1, max_size=30))
def test_lines_apart_are_not_similar(a, b):
    assert not (lines.apart(a.encode(), b.encode()) and lines.similar(a, b))


def brute(texts):
    """Lines kept by each document, by comparing all pairs of classes."""
    places = {}
    for doc, t in sorted(texts, key=lambda x: x[0]):
        for k, line in enumerate((t or "").encode().split(b"\n")):
            norm = b" ".join(lines.parts(line))
            if norm:
                places.setdefault(norm, []).append((doc, k))
    found = list(places)
    pairs = [(a, b) for a in range(len(found)) for b in range(a) if lines.similar(found[a].decode(), found[b].decode())]
    group = union(len(found), pairs)
    members = {}
    for k, norm in enumerate(found):
        members.setdefault(group[k], []).extend(places[norm])
    drop = {x for m in members.values() for x in sorted(m)[1:]}
    return {doc: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (doc, k) not in drop) for doc, t in texts}, len(pairs)


def test_buckets_link_what_all_pairs_link(spark):
    """Small buckets, hubs and the rest together link what all fitting pairs of a bucket link, with fewer pairs."""
    rng = np.random.default_rng(1)
    near = lambda b, n: int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, n, replace=False)))
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    rows = []
    for k in range(400):
        b = 0 if k < 250 else int(rng.integers(0, 30))
        one = base[int(rng.integers(0, 3)) if b == 0 else b]  # the first bucket holds three kinds, which do not look alike
        rows.append((int(b), k, 1 + k % 3, int(rng.integers(80, 110)), near(one, rng.integers(0, 36)), near(base[0], rng.integers(0, 5)), one))
    size = {b: sum(r[0] == b for r in rows) for b in range(30)}
    buckets = spark.createDataFrame([(*r, size[r[0]]) for r in rows], "k long, id long, n long, size int, s1 long, s2 long, s3 long, met long")
    pairs = lambda df: [tuple(r) for r in df.collect()]
    first = pairs(lines.first_pairs(buckets))
    groups = components(spark.createDataFrame(first, "a long, b long"))
    rest = pairs(lines.remaining_pairs(buckets, groups))
    fits = lambda x, y: 5 * abs(x[3] - y[3]) <= max(x[3], y[3]) and sum(bin((x[c] ^ y[c]) & (2**64 - 1)).count("1") for c in (4, 5, 6)) <= lines.ERRORS
    want = [(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and fits(x, y)]
    assert set(first + rest) <= set(want) and first and rest
    assert union(len(rows), first + rest) == union(len(rows), want)
    assert len(set(first + rest)) < len(want)
    steps = [pairs(lines.remaining_pairs(buckets, groups, errors, above)) for above, errors in zip((None, *lines.STEPS), lines.STEPS)]
    assert sorted(x for step in steps for x in step) == sorted(rest)  # each pair is compared in one step


def test_against_brute_force(docs, texts, spark):
    long = " ".join(f"word{k}" for k in range(120))
    more = [(1000 + k, long.replace("word60", f"word{60 + k}")) for k in range(4)]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], docs.schema))
    want, fuzzy = brute(texts + more)
    got = lines.dedupe_lines(rows)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert fuzzy and {r.doc_id: r.text for r in got.collect()} == want


def test_edges(empty, odd):
    assert lines.dedupe_lines(empty).count() == 0
    got = lines.dedupe_lines(odd)
    assert got.columns[: len(odd.columns)] == odd.columns
    rows = got.collect()
    assert len(rows) == odd.count()
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    assert [r.text for r in rows if r.doc_id == 2] == [""]


def test_clashing_names(spark):
    """Counts replace the input's columns of their names; without counts these stay."""
    docs = spark.createDataFrame([(1, "a line of some words", "x", 9), (2, "a line of some words", "y", 9)], "doc_id long, text string, n_lines string, n_removed int")
    assert lines.dedupe_lines(docs).columns == docs.columns
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in lines.dedupe_lines(docs).collect()) == [(1, 1, 0), (2, 1, 1)]
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in lines.dedupe_lines(docs, counts=False).collect()) == [(1, "x", 9), (2, "y", 9)]


def test_very_long_texts_and_lines(spark):
    """A text of some MB with many lines, and a line of 200 kB that differs in one word from another."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 7))
    many = "\n".join(f"{word()} {word()} {word()} {word()}" for _ in range(40_000))
    words = [word() for _ in range(25_000)]
    other = " ".join([*words[:99], "changed", *words[100:]])
    docs = spark.createDataFrame([(1, many), (2, "head\n" + many + "\ntail"), (3, " ".join(words)), (4, other)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedupe_lines(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].text) == (0, 40_000, "head\ntail")
    assert (got[3].n_removed, got[4].n_removed) == (0, 1)


def test_pairs_compared_together_as_one_by_one():
    """Chunks of pairs of all lengths and alphabets, with lines too long for them, give what single comparisons give."""
    import random

    rng, pairs = random.Random(6), []
    for letters in ("ab", "abcdefgh ", "aé中😀b"):
        for n in (1, 2, 3, 8, 21, 40, 90, 300):
            for _ in range(40):
                a = [rng.choice(letters) for _ in range(n)]
                b = list(a)
                for _ in range(rng.randint(0, 1 + n // 3)):
                    k = rng.randrange(len(b) + 1)
                    b[k : k + rng.randint(0, 1)] = rng.choice(["", *letters])
                pairs.append(("".join(a), "".join(b) or "a"))
    long = "".join(rng.choice("abcdefgh ") for _ in range(lines.LONG_LINE + 500))
    pairs += [(long, "x" + long[1:-1] + "y"), (long, long[::-1])]
    want = [lines.similar(a, b) for a, b in pairs]
    assert 0.2 < sum(want) / len(want) < 0.9
    assert lines.similar_pairs([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs]).tolist() == want


def test_merged_components_are_those_of_all_edges(spark):
    from judge_jobs.llm.graph import merged

    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (230, 2))]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    of = lambda df: sorted(tuple(r) for r in df.select("node", "component").collect())
    assert of(merged(components(frame(edges[:120])), frame(edges[120:]))) == of(components(frame([e for e in edges if e[0] != e[1]])))


def test_a_text_is_split_once(spark):
    """And not again for each line that it keeps."""
    docs = spark.createDataFrame([(1, "\n".join(f"line number {k} of many" for k in range(50)) + "\nagain and again\nagain and again")], "doc_id long, text string")
    got = lines.dedupe_lines(docs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert got.first().text.endswith("\nagain and again")
