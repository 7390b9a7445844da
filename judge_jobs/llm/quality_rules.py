"""Quality rules: text statistics, base rules, and robust multivariate outliers. DataFrame functions only.

The verdict comes from minimum-covariance-determinant estimates for each (language, source) group
(Rousseeuw & Van Driessen 1999). They start deterministically (as in Hubert, Rousseeuw & Verdonck 2012)
at medians and MADs, at the medians with the scatter of spatial signs, and, for each axis, at the mean and
scatter of the rows within a MAD of its median. Each start takes ``TRIALS`` concentration steps, the one of least determinant goes on, and further steps are taken
as long as the determinant of any group falls. A step is one grouped aggregation over the narrow
statistics table. Statistics are transformed to shrunken log or square-root rates, so that the
noise of short texts doesn't count against them. The scatter gets a floor on each axis (regularised
MCD), since most clean groups have no symbols or repeats at all; steps lower its determinant all the same
(Boudt et al. 2020). A document is rejected if its squared Mahalanobis distance exceeds ``CUTOFF``.

Quantiles are taken over values rounded to a fixed grid, so a task holds a bounded histogram however
large a group is. Nothing but one row for each group moves between steps.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, bounded, drop_table, table, text_or_empty

#: Words of prior weight in the rates.
PRIOR_WORDS = 20
#: Share of a group that the estimate covers.
SHARE = 0.75
#: Concentration steps of each start, and of the best one at most, should its determinant fall for so long.
TRIALS, MOST_STEPS = 2, 20
#: Groups with fewer documents are judged with the other small ones of their language, or with all that is left; the floors hold where that is little, too.
LEAST_GROUP = 200
#: Up to so many groups the estimates (about 200 bytes each) are broadcast; beyond, they are joined.
BROADCAST_GROUPS = 10_000
#: Up to so many rejected rows (16 bytes each) are broadcast to take them out; beyond, they are joined.
BROADCAST_REJECTED = 500_000
#: Chi-square quantile (4 degrees of freedom) at 1 - 1e-9.
CUTOFF = 49.2

#: Transformed statistics, SQL that Spark and DuckDB both read; ``word_size`` is the group's median of characters a word.
FEATURES = {
    "x1": f"ln((word_chars + {PRIOR_WORDS} * word_size) / (n_words + {PRIOR_WORDS}))",
    "x2": f"sqrt(n_symbols / (n_words + {PRIOR_WORDS}))",
    "x3": f"sqrt(n_dup_lines / (n_words + {PRIOR_WORDS}))",
    "x4": f"sqrt(n_repeat_words / (n_words + {PRIOR_WORDS}))",
}
#: Least standard deviation of each.
FLOOR = {"x1": 0.08, "x2": 0.06, "x3": 0.06, "x4": 0.08}
AXES = list(FEATURES)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) to the rows.

    Null text counts as empty: all are zero. Works within each row: nothing is exploded or shuffled.
    Windows of five words are compared by 64-bit hashes of their words' 64-bit hashes.
    """
    text = text_or_empty(text_col)
    words = docs.withColumn("_words", F.array_remove(F.split(text, WS), ""))
    hashed = words.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words")
    last = F.size("_hashes") - 5
    windows = hashed.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("_lines", "_hashes")
    # only texts with a window that comes again need places
    found = windows.withColumn("_found", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    here = lambda k: F.get("_found", k)["h"]
    places = found.withColumn("_at", F.sort_array(F.array_compact(F.transform("_found", lambda x, k: F.when((x["h"] == here(k - 1)) | (x["h"] == here(k + 1)), x["i"]))))).drop("_found")
    steps = F.transform("_at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_at", k + 1) - p, F.lit(5))))
    return places.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_at")


def base_failed():
    """Fewer than ten words, or over a fifth of the words in repeated five-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def consistency(share: float = SHARE) -> float:
    """Factor that makes the covariance of the inner ``share`` of 4 normal axes consistent."""
    low, high = 0.0, 100.0
    inner = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)  # noqa: E731  chi-square, 4 degrees of freedom
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if inner(mid) < share else (low, mid)
    return share / (1 - math.exp(-low / 2) * (1 + low / 2 + low**2 / 8))


def moments(where: str = "") -> dict[str, str]:
    """SQL aggregates of one concentration step: means and the regularised covariance (lower triangle), of the rows with ``where``."""
    avg = lambda e: f"avg({e})" + (f" FILTER (WHERE {where})" if where else "")
    out = {f"m{a}": avg(x) for a, x in enumerate(AXES)}
    for a, x in enumerate(AXES):
        for b, y in enumerate(AXES[: a + 1]):
            out[f"s{a}{b}"] = f"{consistency():.12f} * ({avg(f'{x} * {y}')} - {avg(x)} * {avg(y)})" + (f" + {FLOOR[x] ** 2:.6f}" if a == b else "")
    return out


def cholesky() -> list[dict[str, str]]:
    """SQL for the Cholesky factor l of s, column by column; each dict needs those before it."""
    n, out = len(AXES), []
    for b in range(n):
        out.append({f"l{b}{b}": f"sqrt(s{b}{b}" + "".join(f" - l{b}{k} * l{b}{k}" for k in range(b)) + ")"})
        if b + 1 < n:
            out.append({f"l{a}{b}": f"(s{a}{b}" + "".join(f" - l{a}{k} * l{b}{k}" for k in range(b)) + f") / l{b}{b}" for a in range(b + 1, n)})
    return out


def starts() -> list[dict[str, str]]:
    """SQL aggregates for means and scatter of each start, over x1.. and their group's medians c0.. and MADs d0.. (group keys)."""
    n = range(len(AXES))
    z = [f"(({x} - c{a}) / d{a})" for a, x in enumerate(AXES)]
    norm = "greatest(" + " + ".join(f"{v} * {v}" for v in z) + ", 0.000001)"
    middle = {f"m{a}": f"c{a}" for a in n}
    mads, signs = {}, {}
    for a in n:
        for b in range(a + 1):
            mads[f"s{a}{b}"] = f"d{a} * d{b}" if a == b else "0.0"
            # the ridge keeps it positive where all rows lie on a line
            signs[f"s{a}{b}"] = f"d{a} * d{b} * ({len(AXES)} * avg({z[a]} * {z[b]} / {norm})" + (" + 0.1)" if a == b else ")")
    return [middle | mads, middle | signs, *[moments(f"abs({v}) <= 0.6745") for v in z]]


#: Log of the square root of the scatter's determinant; on a grid, so that engines agree on what is less.
DETERMINANT = "round(" + " + ".join(f"ln(l{a}{a})" for a in range(len(AXES))) + ", 6)"


def whitened() -> list[dict[str, str]]:
    """SQL for z = inverse(l) (x - m), axis by axis; the squared distance is their sum of squares."""
    return [{f"z{a}": f"({x} - m{a}" + "".join(f" - l{a}{k} * z{k}" for k in range(a)) + f") / l{a}{a}"} for a, x in enumerate(AXES)]


#: On a grid and bounded, so that its histogram is.
DISTANCE = "round(least(" + " + ".join(f"z{a} * z{a}" for a in range(len(AXES))) + ", 10000), 2)"


def _with(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df


M = [f"m{a}" for a in range(len(AXES))]
L = [f"l{a}{b}" for a in range(len(AXES)) for b in range(a + 1)]


def _started(passed: DataFrame, hint) -> DataFrame:
    """A row for each _group and start: m0.., and the factor l00.. of its scatter."""
    median = lambda e: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {e})")
    axes = list(enumerate(AXES))
    centres, scales = [f"c{a}" for a, _ in axes], [f"d{a}" for a, _ in axes]
    medians = table(passed.groupBy("_group").agg(*[median(x).alias(f"c{a}") for a, x in axes]), "medians")
    spread = passed.join(hint(medians), "_group").groupBy("_group", *centres).agg(*[median(f"round(abs({x} - c{a}), 4)").alias(f"d{a}") for a, x in axes])
    mads = table(spread.select("_group", *centres, *[F.expr(f"greatest(1.4826 * d{a}, {FLOOR[x]})").alias(f"d{a}") for a, x in axes]), "mads")
    rows = passed.join(hint(mads), "_group").groupBy("_group", *centres, *scales)
    each = [F.struct(F.lit(k).alias("_start"), *[F.expr(e).cast("double").alias(c) for c, e in found.items()]).alias(f"start{k}") for k, found in enumerate(starts())]
    found = table(rows.agg(*each).select("_group", F.inline(F.array(*[f"start{k}" for k in range(len(each))]))), "starts")
    drop_table(medians, mads)
    return _with(found, cholesky()).select("_group", "_start", *M, *L)


def _concentrated(passed: DataFrame, estimate: DataFrame, by: list[str], hint) -> DataFrame:
    """One concentration step: m, l and det from the ``SHARE`` of rows nearest to the estimate of each ``by``."""
    placed = _with(passed.join(hint(estimate), "_group"), whitened()).select(*by, *AXES, F.expr(DISTANCE).alias("d"))
    reach = placed.groupBy(*by).agg(F.expr(f"percentile_disc({SHARE}) WITHIN GROUP (ORDER BY d)").alias("reach"))
    spread = placed.join(hint(reach), by).where("d <= reach").groupBy(*by).agg(*[F.expr(e).alias(k) for k, e in moments().items()])
    return _with(spread, cholesky()).select(*by, *M, *L, F.expr(DETERMINANT).alias("det"))


def estimates(passed: DataFrame, hint=lambda x: x) -> DataFrame:
    """For rows of _group and x1.. to x4 (no nulls): _group, means m0.., the scatter's Cholesky factor l00.., det.

    ``hint`` is put on the small sides of joins (six rows for each group). Of starts with equal
    determinants the first goes on, and a step counts only if it lowers the determinant, so the result is
    the same on any partitioning. No rows give no estimates; one row gives itself and the floors.
    """
    estimate = _started(passed, hint)
    for _ in range(TRIALS):
        estimate = table(_concentrated(passed, estimate, ["_group", "_start"], hint), "trial")
    best = F.min_by(F.struct(*M, *L, "det"), F.struct("det", "_start")).alias("e")
    estimate = table(estimate.groupBy("_group").agg(best).select("_group", "e.*"), "estimate")
    for _ in range(MOST_STEPS):
        step = _concentrated(passed, estimate, ["_group"], hint).select("_group", F.struct(*M, *L, "det").alias("new"))
        lower = F.col("new.det") < F.col("det")
        both = estimate.join(hint(step), "_group").select("_group", lower.alias("fell"), *[F.when(lower, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in (*M, *L, "det")])
        found = table(both, "estimate")
        drop_table(estimate)
        estimate = found
        if not estimate.where("fell").limit(1).count():
            break
    return estimate.drop("fell")


def verdicts(stats: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Add base_failed, distance (null if base_failed) and kept.

    ``stats`` should be a stored table: each step reads its few numeric columns once. A null language
    or source is a group of its own. Groups are those of documents that pass the base rules; for their
    estimates see :func:`estimates`.
    """
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`")), F.lit("-"))
    key = F.concat_ws("\x01", mark(lang_col), mark(source_col))
    rows = stats.withColumns({"base_failed": base_failed(), "_own": key, "_lang": mark(lang_col)})
    passed = rows.where(~F.col("base_failed"))
    own = passed.groupBy("_own", "_lang").count()
    few = own.where(F.col("count") < LEAST_GROUP).groupBy("_lang").agg(F.sum("count").alias("_few"))
    size = lambda c: F.coalesce(F.col(c), F.lit(0))
    names = own.join(few, "_lang", "left").select(
        "_own", F.when(F.col("count") >= LEAST_GROUP, F.col("_own")).when(size("_few") >= LEAST_GROUP, F.col("_lang")).otherwise("*").alias("_group")
    )
    names = table(names, "groups")
    hint = F.broadcast if names.count() <= BROADCAST_GROUPS else lambda x: x
    rows = rows.join(hint(names), "_own", "left")
    passed = rows.where(~F.col("base_failed"))
    sizes = passed.groupBy("_group").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY round(word_chars / n_words, 2))").alias("word_size"))
    featured = rows.join(hint(sizes), "_group", "left").withColumns({x: F.expr(f"CASE WHEN base_failed THEN NULL ELSE round({e}, 4) END") for x, e in FEATURES.items()})
    featured = featured.drop("word_size")
    # narrow, and read by each step
    passed = table(featured.where(~F.col("base_failed")).select("_group", *AXES), "features")
    estimate = estimates(passed, hint)
    drop_table(passed)
    judged = _with(featured.join(hint(estimate), "_group", "left"), whitened())
    distance = F.when(~F.col("base_failed"), F.expr(DISTANCE))
    return judged.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)).select(*stats.columns, "base_failed", "distance", "kept")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Statistics and verdict of each document: doc_id, the five counts, base_failed, distance, kept.

    The texts are read once; everything after works on the stored narrow table. Other columns of
    ``docs`` are not read and may have any name. Null text: no words, so base_failed. A text of any length is
    counted whole, in one task. An empty table gives no rows. Repeated rows are judged each; equal rows get equal verdicts.
    """
    named = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in ((id_col, "doc_id"), (text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    stats = statistics(named).select("doc_id", "lang", "source", *COUNTS)
    return verdicts(table(stats, "statistics")).drop("lang", "source")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that :func:`judge` keeps: the input's rows and columns. Rows are told apart by id, text, language and source.

    Null and empty texts go (they fail the base rules), repeated rows stay or go together, null ids, languages and sources are values
    like others. Clashing names do no harm, since a row travels as one value. An empty table gives no rows.
    """
    mark = F.xxhash64(*[docs[f"`{c}`"] for c in (text_col, lang_col, source_col)])
    named = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"), docs[f"`{lang_col}`"].alias("lang"), docs[f"`{source_col}`"].alias("source"), mark.alias("mark"))
    stats = table(statistics(named).select("doc_id", "mark", "lang", "source", *COUNTS), "statistics")
    rejected = table(verdicts(stats).where(~F.col("kept")).select("doc_id", "mark").distinct(), "rejected")
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("d"), mark.alias("m"))
    kept = marked.join(bounded(rejected, BROADCAST_REJECTED), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
