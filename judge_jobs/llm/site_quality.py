"""Quality by hierarchical empirical Bayes: a text classifier's evidence and its site's record.

A logistic classifier on word shapes gives each document its evidence. Sites are a hierarchy: hosts,
and paths within hosts. A host's share of good documents is shrunk towards the global share, a path's
towards its host's; how strongly is estimated from the data (method of moments for the beta-binomial),
so sites with few documents say little. A document's posterior adds its own log-odds to its path's, with
the document itself left out of the record of its site. The prior that the classifier's log-odds hold, the
share of good documents in its labelled sample, is taken off first.

Grouped sums carry the hierarchy: one row for each path and host. Only the classifier's training sample,
which is bounded, and a few global sums reach the driver.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Labelled documents that the classifier is fitted on, at most: those with the smallest hashes of their id.
TRAIN_ROWS = 10_000
SHAPES = 512
MEMO_WORDS = 400_000
#: Words of average evidence that each document has besides its own, so that a few words don't condemn it.
PRIOR_WORDS = 10
#: Evidence is held within these log-odds.
MOST_EVIDENCE = 8.0

_LETTER = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))


class _Shapes(dict):
    """Hashed shapes of words: letters as a or A, digits as 0, runs as one sign. Starts afresh when full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO_WORDS:
            self.clear()
        sign = word.translate(_LETTER)
        shape = bytes(b for k, b in enumerate(sign) if not k or b != sign[k - 1])
        out = self[word] = xxh64_intdigest(shape, 3) % (SHAPES - 2)
        return out


_shapes = _Shapes()


def features(text: bytes):
    """Frequencies of word shapes (hashed), and of words that repeat the one before; sum to 1 with a constant."""
    import numpy as np

    words = text.split()
    x = np.zeros(SHAPES)
    x[-1] = 1.0
    if words:
        x[: SHAPES - 2] = np.bincount(np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words)), minlength=SHAPES - 2) / len(words)
        x[-2] = sum(map(bytes.__eq__, words[1:], words[:-1])) / len(words)
    return x


def fit(x, y, ridge: float = 1e-4, steps: int = 25):
    """Ridge logistic regression by Newton steps. With one class or none: its smoothed log-odds alone."""
    import numpy as np

    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if 0 < y.sum() < len(y):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - y) / len(y) + ridge * w * (np.arange(len(w)) < len(w) - 1)
            bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
            step = np.linalg.solve(bend, slope)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """Weights, the average evidence, and the sample's prior log-odds, from at most ``rows`` labelled ids (columns doc_id, text; doc_id, quality). An id counts once, with the mean features of its rows."""
    import numpy as np

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = [features(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
            at = [np.flatnonzero(v) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([v[a] for v, a in zip(x, at)], pa.list_(pa.float64()))], names=["doc_id", "quality", "at", "x"])

    # one row for each labelled id, the mean of its rows' features: as many as the sample has, however often an id is repeated
    each = labelled.mapInArrow(run, "doc_id long, quality int, at array<int>, x array<double>").select("doc_id", "quality", F.explode(F.arrays_zip("at", "x")).alias("f"))
    sums = each.groupBy("doc_id", "quality", F.col("f.at").alias("at")).agg(F.sum("f.x").alias("x"))
    # the constant is 1 in each row, so its sum counts the rows
    grouped = sums.groupBy("doc_id", "quality").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("f"))
    found = grouped.orderBy("doc_id").collect()
    x = np.zeros((len(found), SHAPES))
    for k, row in enumerate(found):
        x[k, [f.at for f in row.f]] = [round(f.x / row.f[-1].x, 12) for f in row.f]
    good = np.array([r.quality for r in found], dtype=float)
    weights = fit(x, good)
    base = math.log((good.sum() + 0.5) / (len(good) - good.sum() + 0.5))
    return weights, float((x @ weights).mean()) if len(x) else 0.0, base


def evidence(docs: DataFrame, weights, middle: float, text_col: str = "text") -> DataFrame:
    """The rows' other columns and ``evidence``: the classifier's log-odds, drawn to ``middle`` for short texts. Null text: no words, so just that."""
    columns = [c for c in docs.columns if c != text_col]
    schema = docs.select(*columns).schema.add("evidence", "double")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for t in batch.column(len(columns)).cast(pa.binary()):
                text = t.as_py() or b""
                n = len(text.split())
                own = (n * float(features(text) @ weights) + PRIOR_WORDS * middle) / (n + PRIOR_WORDS)
                found.append(min(MOST_EVIDENCE, max(-MOST_EVIDENCE, own)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(columns))], pa.array(found, pa.float64())], names=[*columns, "evidence"])

    return docs.select(*columns, text_col).mapInArrow(run, schema)


def _strength(groups: DataFrame) -> float:
    """Beta prior strength from groups with columns n, s (sum of probabilities) and mean (of their parent)."""
    between = F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("mean")) ** 2)
    noise = F.sum(F.col("mean") * (1 - F.col("mean")))
    total, spread, within, size = groups.agg(F.count("*"), between, noise, F.sum("n") - F.sum(F.col("n") ** 2) / F.sum("n")).first()
    if not total or not size or total < 2:
        return 10.0
    variance = (spread - within) / size  # of the groups' true shares
    middle = within / total
    return float(min(1e6, max(1.0, middle / variance - 1))) if variance > 1e-9 else 1e6


def sites(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` and ``path`` (the first folder or page name, if any) of an address; both null if there is no host.

    Hosts are lower-cased, without user, port and a leading ``www.``. Columns of these names are replaced. An address of any
    length is read whole; null, empty and malformed ones have no site; repeated rows stay, an empty table gives no rows.
    """
    url = F.col(f"`{url_col}`")
    host = F.nullif(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.(?=.)", ""), F.lit(""))
    first = F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/*([^/]+)", 1), F.lit(""))
    return pages.withColumns({"host": host, "path": F.when(host.isNotNull(), first)})


def posteriors(scored: DataFrame, base: float | None = None) -> DataFrame:
    """For a stored table with evidence, host and path: add host_posterior, path_posterior and posterior.

    ``base`` is the prior that the evidence holds, as log-odds (see :func:`train`); without it, that of the rows' own mean.

    A null host or path is a site of its own. The site figures given are those of the whole site; the
    document's posterior uses them without the document itself.
    """
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    rows = scored.withColumns({"_host": mark("host"), "_path": mark("path"), "_p": p})
    paths = table(rows.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), F.sum("_p").alias("s")), "paths")
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    prior = min(max((s + 0.5) / (n + 1), 1e-4), 1 - 1e-4) if n else 0.5
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k_host = _strength(hosts.withColumn("mean", F.lit(prior)))
    share = lambda s, n, k, m: (s + k * m) / (n + k)
    hosts = table(hosts.select("_host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), share(F.col("s"), F.col("n"), k_host, F.lit(prior)).alias("host_posterior")), "hosts")
    within = table(paths.join(hosts, "_host"), "sites")
    k_path = _strength(within.withColumn("mean", F.col("host_posterior")))
    sites = table(within.select("_host", "_path", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s", "host_posterior", share(F.col("s"), F.col("n"), k_path, F.col("host_posterior")).alias("path_posterior")), "sites")
    joined = rows.join(sites, ["_host", "_path"])
    other_host = share(F.col("host_s") - F.col("_p"), F.col("host_n") - 1, k_host, F.lit(prior))
    other = share(F.col("path_s") - F.col("_p"), F.col("path_n") - 1, k_path, other_host)
    odds = F.col("evidence") + F.ln(other / (1 - other)) - (math.log(prior / (1 - prior)) if base is None else base)
    return joined.withColumn("posterior", 1 / (1 + F.exp(-odds))).select(*scored.columns, "host_posterior", "path_posterior", "posterior")


def judge(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, posterior and kept (posterior of at least ``least``).

    ``labels`` has doc_id and quality (1 good, 0 not); several labels of a document are averaged, nulls
    ignored. Without labels every document's evidence is 0. Null text has no words; null ids are scored
    like others. Repeated rows count each. A text of any length is read whole, in one task. Other columns are not read. An empty table gives no rows.
    """
    named = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{host_col}`"].cast("string").alias("host"), docs[f"`{path_col}`"].cast("string").alias("path"), docs[f"`{text_col}`"].alias("text"))
    weights, middle, base = train(named, labels.select(F.col("doc_id").cast("long"), "quality"))
    scored = table(evidence(named, weights, middle), "evidence")
    found = posteriors(scored, base)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "host_posterior", "path_posterior", "posterior")], (F.col("posterior") >= least).alias("kept"))
