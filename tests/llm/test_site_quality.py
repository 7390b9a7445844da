import math
import random

import numpy as np
from judge_jobs.llm import site_quality as sq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=400, seed=1):
    """Good and junk prose on good and bad sites. Rows and the truth by id."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        site = i % 8
        good = rng.random() < (0.9 if site < 6 else 0.2)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(15, 80))]
        if not good:
            words = [w.upper() + "!!" if rng.random() < 0.8 else w for w in words]
        rows.append((i, " ".join(words), f"p{i % 3}", f"h{site}", 0))
        truth[i] = int(good)
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, q) for i, q in truth.items() if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in sq.judge(docs, labels).collect()}
    held = [i for i in truth if i % 2 == 0]
    assert sum(got[i].kept == bool(truth[i]) for i in held) / len(held) > 0.97
    good = [got[i].host_posterior for i in held if i % 8 < 6]
    bad = [got[i].host_posterior for i in held if i % 8 >= 6]
    assert min(good) > max(bad)


def test_fit_is_bounded(spark):
    rows, truth = corpus(300)
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    few, again = sq.train(docs.select("doc_id", "text"), labels, rows=50), sq.train(docs.repartition(5).select("doc_id", "text"), labels, rows=50)
    assert np.allclose(few[0], again[0]) and np.isclose(few[1], again[1])
    assert not np.allclose(few[0], sq.train(docs.select("doc_id", "text"), labels)[0])


def test_posteriors_against_plain_formulas(spark):
    rng = random.Random(2)
    rows = [(k, rng.uniform(-3, 3) + (2 if k % 4 else -2), f"h{k % 4}", f"p{k % 3}") for k in range(60)] + [(60, 0.0, "lone", "x"), (61, 1.0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, evidence double, host string, path string")
    from judge_jobs.llm.common import table

    got = {r.doc_id: r for r in sq.posteriors(table(df, "t")).collect()}
    p = {k: 1 / (1 + math.exp(-e)) for k, e, _, _ in rows}
    host, path = {}, {}
    for k, _, h, q in rows:
        host.setdefault(h, []).append(k)
        path.setdefault((h, q), []).append(k)
    prior = (sum(p.values()) + 0.5) / (len(p) + 1)
    # strengths implied by the results themselves, then every formula again
    k0 = got[0]
    s, n = sum(p[k] for k in host["h0"]), len(host["h0"])
    strength = (s - n * k0.host_posterior) / (k0.host_posterior - prior)
    assert strength > 0
    for k, _, h, q in rows:
        s, n = sum(p[x] for x in host[h]), len(host[h])
        assert abs(got[k].host_posterior - (s + strength * prior) / (n + strength)) < 1e-9
    # the lone site is shrunk towards the prior and does not count itself
    assert abs(got[60].posterior - 1 / (1 + math.exp(-0.0))) < 1e-6
    assert abs(got[61].posterior - 1 / (1 + math.exp(-1.0))) < 1e-6


def test_the_samples_prior_is_taken_off(spark):
    """The sample's log-odds come from its labels alone, and shift every posterior's log-odds by just that."""
    rows, truth = corpus(600)
    docs = spark.createDataFrame(rows, SCHEMA)
    even = [(i, q) for i, q in truth.items()]
    skewed = [(i, q) for i, q in truth.items() if not q or i % 5 == 0]
    bases = [sq.train(docs.select("doc_id", "text"), spark.createDataFrame(x, "doc_id long, quality int"))[2] for x in (even, skewed)]
    for base, x in zip(bases, (even, skewed)):
        good = sum(q for _, q in x)
        assert abs(base - math.log((good + 0.5) / (len(x) - good + 0.5))) < 1e-9
    scored = [(k, 0.3 * (k % 7) - 1 + bases[0], f"h{k % 4}", "p") for k in range(80)]
    from judge_jobs.llm.common import table

    df = table(spark.createDataFrame(scored, "doc_id long, evidence double, host string, path string"), "t")
    odds = lambda p: math.log(p / (1 - p))
    a, b = ({r.doc_id: r.posterior for r in sq.posteriors(df, base).collect()} for base in bases)
    assert all(abs(odds(b[k]) - odds(a[k]) - (bases[0] - bases[1])) < 1e-6 for k in a)


def test_sites_of_addresses(spark):
    rows = [("https://user@WWW.Example.org:8080/blog/2020/a.html?q=1#x", "example.org", "blog"), ("http://a.b.net", "a.b.net", None), ("http://a.b.net/", "a.b.net", None),
            ("https://c.net//deep/er", "c.net", "deep"), ("not an address", None, None), ("http://bad host/x", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(u, 7) for u, _, _ in rows], "url string, host int")
    got = {r.url: (r.host, r.path) for r in sq.sites(df).collect()}
    assert got == {u: (h, p) for u, h, p in rows}
    assert sq.sites(df.limit(0)).count() == 0
    docs = sq.sites(spark.createDataFrame([(k, f"some words of text {k}", f"https://h{k % 3}.net/p{k % 2}/x") for k in range(30)], "doc_id long, text string, url string"))
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(30)], "doc_id long, quality int")
    found = {r.doc_id: r for r in sq.judge(docs, labels, host_col="host", path_col="path").collect()}
    assert len(found) == 30 and len({round(r.host_posterior, 6) for r in found.values()}) <= 3


def test_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sq.judge(empty, none).count() == 0
    rows = sq.judge(odd, none).collect()
    assert len(rows) == odd.count() and {r.evidence for r in rows} == {0.0}
    one = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert all(r.kept for r in sq.judge(odd, one).collect())
