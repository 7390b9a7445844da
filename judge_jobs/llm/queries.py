"""The registered queries of this subpackage and their SQL."""

from pyspark.sql import functions as F

from .common import shared_dir, table
from . import decontamination, idfiles, lines, packing, pieces, prefix_tree, quality_rules, rollups, sharding, simhash, site_quality, substrings, turn_repair


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op1_vector_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op10_token_id_files(spark, sf_dir):
    return idfiles.write_and_read(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_site_bayes(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return site_quality.judge(documents(spark, sf_dir), labels)


def op9_mcd_outliers(spark, sf_dir):
    return quality_rules.judge(documents(spark, sf_dir)).drop("distance")


def op2_difference_cover(spark, sf_dir):
    return substrings.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_fuzzy_lines(spark, sf_dir):
    found = lines.dedupe_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_delta_rollup(spark, sf_dir):
    return rollups.maintained(documents(spark, sf_dir), shared_dir(spark, "totals"))


def op5_golay_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_ensemble_containment(spark, sf_dir):
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_flow_resharding(spark, sf_dir):
    """The old layout: six shards over the blocks, growing in size from the first to the last."""
    old = F.floor(6 * F.sqrt(F.col("block") / sharding.BLOCKS))
    docs = documents(spark, sf_dir)
    plan = table(sharding.reshard(docs, old), "plan")
    files = sharding.rewrite_in_order(docs, plan, shared_dir(spark, "shards"))
    shards = plan.select("shard", "slot", "old_shard", "moved")
    return files.join(shards, ["shard", "slot"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op11_turn_repair(spark, sf_dir):
    rows = turn_repair.clean(conversations(spark, sf_dir))
    return turn_repair.report(rows, turn_repair.damaged(rows))


def op12_prefix_tree(spark, sf_dir):
    own = prefix_tree.sequences(conversations(spark, sf_dir))
    return prefix_tree.trie(prefix_tree.with_borrowed_heads(own))


def op13_prefix_table_pieces(spark, sf_dir):
    model = vocabulary("piece_bpe_32k.model")
    encoded = pieces.encode(documents(spark, sf_dir), model).withColumn("ids_sha256", F.sha2("ids", 256))
    return pieces.decode(encoded, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_vector_packing, op2_difference_cover, op3_fuzzy_lines, op4_delta_rollup, op5_golay_simhash, op6_ensemble_containment, op7_flow_resharding, op8_site_bayes, op9_mcd_outliers, op10_token_id_files, op11_turn_repair, op12_prefix_tree, op13_prefix_table_pieces)}
_ROLLUP = """
WITH counted AS (
    SELECT doc_id, source, lang, 'words@1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents
    UNION ALL
    SELECT doc_id, source, lang, 'pieces@2', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]')) FROM documents
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n + CASE WHEN doc_id % 7 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_tokens
FROM counted WHERE doc_id IS NULL OR doc_id % 10 <> 3 GROUP BY ALL
"""

_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
gone AS (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM windows JOIN (SELECT k, min(doc_id) AS low FROM windows GROUP BY k) USING (k) WHERE low < doc_id),
places AS (SELECT DISTINCT doc_id, i FROM gone),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN places USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id) USING (doc_id)
"""

_CONTAINMENT = r"""
WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
normal AS (SELECT side, id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM texts WHERE text IS NOT NULL),
shingles AS (SELECT DISTINCT side, id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM normal WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM (FROM shingles WHERE side = 0) d JOIN (FROM shingles WHERE side = 1) i USING (s) JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n_item)
"""


def _outliers() -> str:
    """The estimate of quality_rules as one statement: each concentration step is a few expressions, and one that lowers no determinant changes nothing."""
    from .quality_rules import AXES, CUTOFF, DETERMINANT, DISTANCE, FEATURES, FLOOR, LEAST_GROUP, MOST_STEPS, SHARE, TRIALS, cholesky, moments, starts, whitened

    n = range(len(AXES))
    m, lower = [f"m{a}" for a in n], [f"l{a}{b}" for a in n for b in range(a + 1)]
    nest = lambda source, steps: source if not steps else f"(SELECT *, {', '.join(f'{e} AS {k}' for k, e in steps[-1].items())} FROM {nest(source, steps[:-1])})"
    axes, scales = list(enumerate(AXES)), ", ".join(f"{c}{a}" for c in "cd" for a in n)
    each = " UNION ALL ".join(f"SELECT g, {k} AS start, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in found.items())} FROM x JOIN mads USING (g) GROUP BY g, {scales}" for k, found in enumerate(starts()))

    def step(k: int, estimate: str, by: str) -> list[str]:
        """Expressions p, i and c: c has the means, factor and determinant of the rows nearest to the estimate."""
        spread = f"(SELECT {by}, {', '.join(f'{e} AS {c}' for c, e in moments().items())} FROM i{k} GROUP BY {by})"
        return [
            f"p{k} AS MATERIALIZED (SELECT {by}, {', '.join(AXES)}, {DISTANCE} AS d FROM {nest(f'(SELECT * FROM x JOIN {estimate} USING (g))', whitened())})",
            f"i{k} AS (SELECT {by}, {', '.join(AXES)} FROM p{k} JOIN (SELECT {by}, quantile_disc(d, {SHARE}) AS reach FROM p{k} GROUP BY {by}) USING ({by}) WHERE d <= reach)",
            f"c{k} AS MATERIALIZED (SELECT {by}, {', '.join(m + lower)}, {DETERMINANT} AS det FROM {nest(spread, cholesky())})",
        ]

    parts = [
        r"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)",
        "spans AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d))",
        "again AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS i FROM spans JOIN (SELECT r, k FROM spans GROUP BY r, k HAVING count(*) > 1) USING (r, k)) GROUP BY r)",
        r"""counted AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d) LEFT JOIN again USING (r))""",
        "judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)",
        "own AS (SELECT lang, source, count(*) AS n FROM judged WHERE NOT base_failed GROUP BY ALL)",
        f"names AS (SELECT lang, source, CASE WHEN n >= {LEAST_GROUP} THEN lang || chr(1) || source WHEN coalesce(few, 0) >= {LEAST_GROUP} THEN lang ELSE '*' END AS g FROM own LEFT JOIN (SELECT lang, sum(n) AS few FROM own WHERE n < {LEAST_GROUP} GROUP BY lang) USING (lang))",
        "passed AS (SELECT r, g, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words FROM judged JOIN names USING (lang, source) WHERE NOT base_failed)",
        "sizes AS (SELECT g, quantile_disc(round(word_chars / n_words, 2), 0.5) AS word_size, count(*) AS n FROM passed GROUP BY g)",
        f"x AS (SELECT r, g, n, {', '.join(f'round({e}, 4) AS {x}' for x, e in FEATURES.items())} FROM passed JOIN sizes USING (g))",
        f"medians AS (SELECT g, {', '.join(f'quantile_disc({x}, 0.5) AS c{a}' for a, x in axes)} FROM x GROUP BY g)",
        f"mads AS MATERIALIZED (SELECT g, {', '.join(f'any_value(c{a}) AS c{a}' for a in n)}, {', '.join(f'greatest(1.4826 * quantile_disc(round(abs({x} - c{a}), 4), 0.5), {FLOOR[x]}) AS d{a}' for a, x in axes)} FROM x JOIN medians USING (g) GROUP BY g)",
        f"c0 AS MATERIALIZED (SELECT g, start, {', '.join(m + lower)} FROM {nest(f'({each})', cholesky())})",
    ]
    for k in range(TRIALS):
        parts += step(k + 1, f"c{k}", "g, start")
    parts.append(f"e{TRIALS} AS MATERIALIZED (SELECT g, {', '.join(m + lower)}, det FROM c{TRIALS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start) = 1)")
    last = TRIALS + MOST_STEPS
    for k in range(TRIALS, last):
        better = ", ".join(f"CASE WHEN c.det < e.det THEN c.{c} ELSE e.{c} END AS {c}" for c in (*m, *lower, "det"))
        parts += [*step(k + 1, f"e{k}", "g"), f"e{k + 1} AS MATERIALIZED (SELECT e.g, {better} FROM e{k} e JOIN c{k + 1} c ON e.g = c.g)"]
    parts.append(f"far AS (SELECT r, {DISTANCE} AS d FROM {nest(f'(SELECT * FROM x JOIN e{last} USING (g))', whitened())})")
    return f"WITH {', '.join(parts)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(d > {CUTOFF}, false) AS kept FROM judged LEFT JOIN far USING (r)"


SQL: dict[str, str] = {"op2_difference_cover": _SUBSTRINGS, "op4_delta_rollup": _ROLLUP, "op6_ensemble_containment": _CONTAINMENT, "op9_mcd_outliers": _outliers()}
