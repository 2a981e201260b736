"""Registration of queries with their SQL, table access, and SQL fragments that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH, UNION, checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with DuckDB SQL for the same rows if there is some."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set(*UNION)
    spark.conf.set(*BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: one a document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", "lang", F.col("source"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tok(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def count_tokens(c: str) -> str:
    return f"(CAST(floor(len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')) * CAST(1.3 AS DOUBLE)) AS INTEGER) + 1)"


def sentences(c: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def content(c: str, stop: list[str]) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"list_filter(list_distinct({tok(c)}), lambda x: length(x) > 2 AND NOT list_contains([{words}], x))"


#: CTEs for terms of queries q(query_id, text) and of documents, and their sparse scores.
TERMS = f"""
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({tok("text")}) AS token FROM q) GROUP BY ALL),
dt AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({tok("text")}) AS token FROM documents) GROUP BY ALL),
ls AS (SELECT query_id, doc_id AS chunk_id, round(sum((1 + ln(qtf)) * (1 + ln(tf))), 6) AS sparse, CAST(sum(least(qtf, tf)) AS BIGINT) AS overlap FROM qt JOIN dt USING (token) GROUP BY ALL),
st AS (SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, sparse AS score, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, chunk_id) - 1 AS rank FROM ls WHERE sparse > 0) WHERE rank < 40)
"""

#: CTEs for the hashed dense leg: vectors as (id, dimension, value) rows of unit length.
_HASH = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


def _dense(name: str, source: str, key: str) -> str:
    sign = f"CASE WHEN {_HASH.format("token || '#'")} % 2 = 0 THEN 1.0 ELSE -1.0 END"
    return f"""
{name}0 AS (SELECT {key} AS id, {_HASH.format("token")} % 256 AS dim, sum(({sign}) * (1 + ln(CAST(n AS DOUBLE)))) AS v FROM {source} GROUP BY ALL),
{name} AS (SELECT id, dim, v / coalesce(nullif(sqrt(sum(v * v) OVER (PARTITION BY id)), 0), 1) AS v FROM {name}0)"""


DENSE = f"""
qn AS (SELECT query_id, token, qtf AS n FROM qt), dn AS (SELECT doc_id, token, tf AS n FROM dt),{_dense("qv", "qn", "query_id")},{_dense("dv", "dn", "doc_id")},
qall AS (SELECT DISTINCT query_id FROM q), dall AS (SELECT DISTINCT doc_id FROM documents),
dp AS (SELECT a.id AS query_id, b.id AS chunk_id, sum(a.v * b.v) AS s FROM qv a JOIN dv b USING (dim) GROUP BY ALL),
ds AS (SELECT query_id, doc_id AS chunk_id, round(coalesce(s, 0.0), 6) + 0.0 AS score FROM qall CROSS JOIN dall LEFT JOIN dp USING (query_id) WHERE dp.chunk_id = doc_id
    UNION ALL SELECT query_id, doc_id, 0.0 FROM qall CROSS JOIN dall WHERE (query_id, doc_id) NOT IN (SELECT (query_id, chunk_id) FROM dp)),
de AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM ds) WHERE rank < 40)
"""

QUESTIONS = "q AS (SELECT item_id AS query_id, text FROM benchmark)"


def fused(parents: bool = False) -> str:
    """CTE fu: both legs fused; with parents the queries of q have parent_id."""
    pick = "parent_id AS query_id" if parents else "query_id"
    join = "JOIN (SELECT query_id, parent_id FROM q) USING (query_id)" if parents else ""
    return f"""
fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS fused, greatest(coalesce(max(d), 0.0), 0.0) AS dense, greatest(coalesce(max(s), 0.0), 0.0) AS sparse
    FROM (SELECT {pick}, chunk_id, rank, score AS d, NULL AS s FROM de {join} UNION ALL SELECT {pick}, chunk_id, rank, NULL, score FROM st {join}) GROUP BY ALL)"""


def reranked(source: str, order: str, questions: str = "q", ls: str = "ls", qt: str = "qt") -> str:
    """CTE rr: the best 8 of the first 80 of source(query_id, chunk_id, {order}) by the main questions' overlap."""
    return f"""
qs AS (SELECT query_id, sum(qtf) AS q_tokens FROM {qt} GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order} DESC, chunk_id) - 1 AS pool_rank FROM {source}) WHERE pool_rank < 80),
rs AS (SELECT pool.query_id, pool.chunk_id, d.source AS doc_source, coalesce(round(CASE WHEN q_tokens > 0 AND p_tokens > 0 THEN coalesce(overlap, 0) / q_tokens / (1.0 + ln(1.0 + p_tokens) / 10.0) ELSE 0.0 END, 6), 0.0) AS rerank
    FROM pool JOIN (SELECT doc_id, source, len(list_distinct({tok("text")})) AS p_tokens FROM documents) d ON d.doc_id = pool.chunk_id
    LEFT JOIN qs ON qs.query_id = pool.query_id LEFT JOIN {ls} ON {ls}.query_id = pool.query_id AND {ls}.chunk_id = pool.chunk_id),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) - 1 AS rank FROM rs) WHERE rank < 8 AND (rerank >= 0.15 OR rank = 0))"""


__all__ = ["DENSE", "ORACLE_SQL", "QUERIES", "QUESTIONS", "TERMS", "checkpoint", "chunks", "content", "count_tokens", "fused", "query", "questions", "reranked", "sentences", "table", "tok"]
