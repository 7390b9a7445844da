"""Bindings of the test tables to the study tables, in one SQL text for Spark and for DuckDB."""

from pyspark.sql import DataFrame, SparkSession

_DIMS = "(VALUES ('coherence'),('consistency'),('fluency'),('relevance')) AS d(dimension)"
_SLICE = {
    "spark": "transform(slice(embedding, {i}, 16), x -> 1+4*(abs(CAST(x AS DOUBLE))-floor(abs(CAST(x AS DOUBLE)))))",
    "duckdb": "list_transform(embedding[{i}:{i}+15], lambda x: 1+4*(abs(CAST(x AS DOUBLE))-floor(abs(CAST(x AS DOUBLE)))))",
}
_EPOCH = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))/CAST(1000000 AS DOUBLE)", "duckdb": "epoch_us(ts)/CAST(1000000 AS DOUBLE)"}
_K = {"spark": "CAST(get_json_object(props,'$.k') AS INT)", "duckdb": "CAST(json_extract_string(props,'$.k') AS INT)"}


def hashed(expr: str, engine: str) -> str:
    """0 to 2^32 - 1 from the md5 of a text."""
    return f"CAST(conv(substr(md5({expr}),1,8),16,10) AS BIGINT)" if engine == "spark" else f"(('0x'||substr(md5({expr}),1,8))::BIGINT)"


def sql(name: str, engine: str, table=lambda t: t) -> str:
    """The view's SQL; ``table`` names a test table."""
    h = lambda e: hashed(e, engine)
    if name == "panel":
        return f"""SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber-1 AS INT) AS model_index,
            1+(min(l_quantity)-1)*4/49 AS coherence, 1+min(l_discount)*40 AS consistency, 1+min(l_tax)*50 AS fluency,
            1+(CAST(floor(min(l_extendedprice)) AS BIGINT)%401)/CAST(100 AS DOUBLE) AS relevance
            FROM {table('lineitem')} GROUP BY l_orderkey, l_linenumber"""
    if name == "wide":
        arrays = ", ".join(f"{_SLICE[engine].format(i=1 + 16 * k)} AS {d}" for k, d in enumerate(("coherence", "consistency", "fluency", "relevance")))
        return f"SELECT vec_id AS id, {arrays} FROM {table('embeddings')}"
    if name == "judge_results":
        return f"""SELECT doc_id, CAST({h("concat('m:',doc_id)")}%16 AS INT) AS model_index, dimension, human_score,
            CASE WHEN k<10 THEN CAST(j AS STRING) WHEN k<12 THEN concat('  ',j,' ')
              WHEN k<14 THEN concat('I would rate this a ',j,' out of 5.')
              WHEN k=14 THEN concat('Score: ',j,'/5') WHEN k=15 THEN concat('I''d say ',j,' overall')
              WHEN k=16 THEN 'I''d give this a 7.' WHEN k=17 THEN 'Coherence is 2 but fluency might be closer to 4.'
              WHEN k=18 THEN 'Quite good overall.' ELSE '10/5' END AS raw_response
            FROM (SELECT *, CASE WHEN dimension='fluency' THEN noise
                ELSE greatest(1, least(5, CAST(floor(human_score) AS BIGINT)+noise-3)) END AS j
              FROM (SELECT l.doc_id, d.dimension,
                  1+3*CAST(l.quality AS DOUBLE)+({h("concat('h:',l.doc_id,':',d.dimension)")}%4)/CAST(3 AS DOUBLE) AS human_score,
                  {h("concat('r:',l.doc_id,':',d.dimension)")}%20 AS k,
                  {h("concat('j:',l.doc_id,':',d.dimension)")}%5+1 AS noise
                FROM {table('labels')} l CROSS JOIN {_DIMS}) g) s"""
    if name in ("pair_calls", "pair_calls_b"):
        p = "p" if name == "pair_calls" else "q"  # the same pairs under a second prompt
        return f"""SELECT doc_id, dimension, ord, CASE WHEN k<10 THEN v WHEN k<12 THEN concat(v,'.')
              WHEN k<14 THEN concat(v,', because it is concise.')
              WHEN k<17 THEN concat('Summary A is short. Summary B is long. VERDICT: A ... VERDICT: ',v)
              WHEN k=17 THEN 'Summary B is more coherent overall.' WHEN k=18 THEN 'It''s a tie.'
              ELSE 'This is a difficult comparison to make.' END AS raw_response
            FROM (SELECT *, CASE WHEN c<5 THEN 'A' WHEN c<7 THEN (CASE WHEN ord='original' THEN 'A' ELSE 'B' END)
                WHEN c<9 THEN (CASE WHEN ord='original' THEN 'B' ELSE 'A' END) ELSE 'Tie' END AS v
              FROM (SELECT l.doc_id, d.dimension, o.ord, {h(f"concat('{p}:',l.doc_id,':',d.dimension)")}%10 AS c,
                  {h("concat('v:',l.doc_id,':',d.dimension,':',o.ord)")}%20 AS k
                FROM {table('labels')} l CROSS JOIN {_DIMS} CROSS JOIN (VALUES ('original'),('swapped')) AS o(ord)) g) w"""
    if name == "telemetry":
        k = _K[engine]
        return f"""SELECT concat('u',user_id) AS item_id,
            CASE event_type WHEN 'click' THEN 'coherence' WHEN 'view' THEN 'consistency'
              WHEN 'purchase' THEN 'fluency' ELSE 'relevance' END AS dimension,
            CASE WHEN {k}%2=0 THEN 'pointwise' ELSE 'pairwise' END AS judge_type, 'mock' AS backend, 'm1' AS model,
            {_EPOCH[engine]} AS started_at, value AS latency_ms, event_type<>'error' AS parse_ok, user_id%4=0 AS escalated,
            CAST(CASE WHEN {k}>=97 THEN {k}-96 ELSE 0 END AS INT) AS retry_count,
            CASE WHEN event_type='error' AND {k}>=97 THEN 'transient' END AS error
            FROM {table('events')}"""
    if name == "summaries":
        return f"SELECT doc_id, CAST(doc_id%7 AS INT) AS seed, text AS summary FROM {table('documents')}"
    raise KeyError(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(sql(name, "spark", lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


NAMES = ("panel", "wide", "judge_results", "pair_calls", "pair_calls_b", "telemetry", "summaries")
