"""Queries over retrieval: legs, fusion, fallback, reranking, strategies, graph, context, grounding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import dense_topk as nearest
from ..operators import answering as a
from ..operators import dense_index, sparse_index
from ..operators import feedback as fb
from ..operators import graph as kg
from ..operators import retrieval as r
from ..operators.access import MetadataFilter
from ..operators.models import stream_model
from ..session import shared_dir
from . import strategies as s
from .base import DENSE, QUESTIONS, TERMS, checkpoint, chunks, content, count_tokens, fused, query, questions, reranked, sentences, table

_DENSE_SQL = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON {on} WHERE a.vec_id % 50 = 0)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM c) WHERE rank < 40
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the rows whose id is divisible by 50, against all rows."""
    v = table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(_DENSE_SQL.format(on="true"))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows = _vectors(spark, sf_dir)
    return nearest(q, rows, r.TOP_DENSE)


@query(_DENSE_SQL.format(on="b.label IN (1, 3)"))
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows = _vectors(spark, sf_dir)
    return nearest(q, MetadataFilter({"label": ["1", "3"]}).apply(rows), r.TOP_DENSE)


@query(f"WITH {QUESTIONS}, {TERMS} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM st")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.sparse_topk(questions(spark, sf_dir), chunks(spark, sf_dir))


def _index_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sievework-{name}-{uuid.uuid4().hex[:12]}"


@query(f"WITH {QUESTIONS}, {TERMS} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM st")
def sparse_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse leg over a stored index of all documents."""
    path = _index_folder(spark, "postings")
    sparse_index.build(chunks(spark, sf_dir), path)
    return sparse_index.SparseIndex(spark, path).search(questions(spark, sf_dir), r.TOP_SPARSE)[0]


@query(_DENSE_SQL.format(on="true"))
def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search over stored vectors in blocks around centres."""
    q, rows = _vectors(spark, sf_dir)
    path = _index_folder(spark, "vectors")
    dense_index.build(rows, path)
    return dense_index.DenseIndex(spark, path).search(q, r.TOP_DENSE)[0]


@query(f"WITH {QUESTIONS}, {TERMS}, {DENSE} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM de")
def embedded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.embedded_topk(questions(spark, sf_dir), chunks(spark, sf_dir))


@query(f"WITH {QUESTIONS}, {TERMS}, {DENSE}, {fused()} SELECT query_id, chunk_id, fused, dense, sparse FROM fu")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.hybrid(questions(spark, sf_dir), chunks(spark, sf_dir))


@query(f"""
WITH {QUESTIONS}, {TERMS}, m AS (SELECT ls.*, lang = 'es' AND source IN ('src1', 'src2') AS ok FROM ls JOIN documents ON doc_id = chunk_id),
f AS (SELECT query_id, chunk_id, sparse AS score, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, chunk_id) - 1 AS rank FROM m WHERE ok AND sparse > 0),
n AS (SELECT query_id FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM f WHERE rank < 40 GROUP BY 1) USING (query_id) WHERE coalesce(n, 0) < 5)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank, false AS relaxed FROM f WHERE rank < 40 AND query_id NOT IN (SELECT query_id FROM n)
UNION ALL SELECT query_id, chunk_id, score, CAST(rank AS INTEGER), true FROM st WHERE query_id IN (SELECT query_id FROM n)
""")
def filter_relax_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    narrow = MetadataFilter({"lang": ["es"], "source": ["src1", "src2"]})
    return r.with_fallback(r.sparse_topk(q, narrow.apply(c)), r.sparse_topk(q, c), q)


@query(f"WITH {QUESTIONS}, {TERMS}, {reranked('st', 'score')} SELECT query_id, chunk_id, rerank, CAST(rank AS INTEGER) AS rank FROM rr")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    return r.rerank(r.sparse_topk(q, c).drop("rank"), q, c, order="score").select("query_id", "chunk_id", "rerank", "rank")


#: Features from labels and events: good documents are official, bad ones deprecated, unlabelled ones have defaults.
_FEATURES = """
pop AS (SELECT user_id AS doc_id, round(count(*) / (SELECT count(*) FROM events), 6) AS popularity FROM events GROUP BY 1),
ft AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'official' ELSE 'deprecated' END AS authority, 30 * toxic AS freshness_days, coalesce(popularity, 0.0) AS popularity, 0.25 AS feedback_score FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) LEFT JOIN pop USING (doc_id))
"""
_FINAL = """
fi AS (SELECT query_id, chunk_id, rerank, round(rerank + 0.05 * exp(-greatest(coalesce(freshness_days, 9999), 0) / 365.0) + 0.05 * CASE coalesce(authority, 'draft') WHEN 'official' THEN 1.0 WHEN 'draft' THEN 0.4 WHEN 'deprecated' THEN 0.0 ELSE 0.3 END
    + 0.03 * greatest(least(coalesce(popularity, 0.0) + coalesce(feedback_score, 0.0), 1.0), 0.0) - CASE WHEN authority = 'deprecated' THEN 0.20 ELSE 0.0 END, 6) AS final FROM rr LEFT JOIN ft ON doc_id = chunk_id),
fo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) - 1 AS rank FROM fi)
"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts", "event_id")
    pop = fb.popularity(fb.numbered(hits, "ts", "event_id")).select("doc_id", "popularity")
    return labels.join(pop, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "official").otherwise("deprecated").alias("authority"), (30 * F.col("toxic")).alias("freshness_days"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"), F.lit(0.25).alias("feedback_score"))


def context(spark: SparkSession, sf_dir: str) -> s.Context:
    q = questions(spark, sf_dir).withColumns({"intent": F.lit("factoid"), "n_sub": F.lit(1)})
    return s.Context(q, chunks(spark, sf_dir), features(spark, sf_dir))


_HYBRID = f"{QUESTIONS}, {TERMS}, {DENSE}, {fused()}, {reranked('fu', 'fused')}, {_FEATURES}, {_FINAL}"
_RESULT = "SELECT query_id, chunk_id, chunk_id AS doc_id, rerank, final, CAST(rank AS INTEGER) AS rank FROM fo"


@query(f"WITH {_HYBRID} {_RESULT}")
def business_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid strategy: both legs, fusion, rerank, signals."""
    return s.run("hybrid", context(spark, sf_dir))


@query(f"WITH {QUESTIONS}, {TERMS}, {DENSE} SELECT query_id, chunk_id, chunk_id AS doc_id, score AS rerank, score AS final, CAST(rank AS INTEGER) AS rank FROM de WHERE rank < 8")
def naive_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.run("naive", context(spark, sf_dir))


@query(f"WITH {_HYBRID}, g AS (SELECT *, max(rerank) OVER (PARTITION BY query_id) >= 0.30 AS good FROM fo) SELECT query_id, chunk_id, chunk_id AS doc_id, rerank, final, CAST(rank AS INTEGER) AS rank FROM g WHERE CASE WHEN good THEN rerank >= 0.30 ELSE rank = 0 END")
def self_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.run("self_rag", context(spark, sf_dir))


@query(f"WITH {_HYBRID} SELECT query_id, coalesce(max(rerank), 0.0) >= 0.30 AS correct FROM q LEFT JOIN fo USING (query_id) GROUP BY 1")
def corrective_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = context(spark, sf_dir)
    poor = s._poor(s.retrieve(ctx), ctx.queries).withColumn("poor", F.lit(True))
    return ctx.queries.join(poor, "query_id", "left").select("query_id", F.col("poor").isNull().alias("correct"))


_REFINED = r"array_to_string(list_sort(list_distinct(string_split_regex(trim(lower(text)), '\\s+'))), ' ')"


@query(f"""
WITH f AS (WITH {_HYBRID} SELECT query_id, chunk_id, rerank, final, rank FROM fo), q0 AS (SELECT item_id AS query_id, text FROM benchmark),
poor AS (SELECT query_id, text FROM q0 LEFT JOIN (SELECT query_id, max(rerank) AS best FROM f GROUP BY 1) USING (query_id) WHERE coalesce(best, 0) < 0.30),
g AS (WITH {_HYBRID.replace(QUESTIONS, f"q AS (SELECT query_id, {_REFINED} AS text FROM poor)", 1)} SELECT query_id, chunk_id, rerank, final, rank FROM fo),
u AS (SELECT *, 0 AS source FROM f WHERE query_id IN (SELECT query_id FROM poor) UNION ALL SELECT *, 1 FROM g),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source, rank) AS k FROM u) WHERE k = 1),
s AS (SELECT query_id FROM poor LEFT JOIN (SELECT query_id, max(rerank) AS best FROM b GROUP BY 1) USING (query_id) WHERE coalesce(best, 0) < 0.30),
m AS (SELECT query_id, chunk_id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) - 1 AS place FROM b)
SELECT query_id, chunk_id, chunk_id AS doc_id, rerank, final, CAST(rank AS INTEGER) AS rank, 'correct' AS branch FROM f WHERE query_id NOT IN (SELECT query_id FROM poor)
UNION ALL SELECT query_id, chunk_id, chunk_id, rerank, rerank, CAST(place AS INTEGER), CASE WHEN query_id IN (SELECT query_id FROM s) THEN 'fallback' ELSE 'refine' END FROM m WHERE place < 8 AND (rerank >= 0.15 OR place = 0)
""")
def corrective_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.run("corrective", context(spark, sf_dir))


def _sub_sql(texts: str) -> str:
    """The hybrid strategy over sub-queries; reranking goes by the main question."""
    return f"""
    WITH q0 AS (SELECT item_id AS query_id, text FROM benchmark), q1 AS (SELECT DISTINCT query_id AS parent_id, unnest({texts}) AS text FROM q0),
    q AS (SELECT parent_id * 64 + row_number() OVER (PARTITION BY parent_id ORDER BY text) AS query_id, parent_id, text FROM q1), {TERMS}, {DENSE}, {fused(True)},
    mt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM q0) GROUP BY ALL),
    ml AS (SELECT query_id, doc_id AS chunk_id, CAST(sum(least(qtf, tf)) AS BIGINT) AS overlap FROM mt JOIN dt USING (token) GROUP BY ALL),
    {reranked('fu', 'fused', 'q0', 'ml', 'mt')}, {_FEATURES}, {_FINAL} {_RESULT}"""


_WORDS = r"string_split_regex(trim(text), '\s+')"


_FUSION_SQL = _sub_sql(f"CASE WHEN len({_WORDS}) > 1 THEN list_concat([text], list_transform(range(0, least(4, len({_WORDS}) - 1)), lambda k: array_to_string(list_concat({_WORDS}[k + 2:], {_WORDS}[1:k]), ' '))) ELSE [text] END")
_HYDE_SQL = _sub_sql(f"[text, text || ' ' || {sentences('text')}[1]]")


@query(_FUSION_SQL)
def rag_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.run("fusion", context(spark, sf_dir))


@query(_HYDE_SQL)
def hyde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.run("hyde", context(spark, sf_dir))


_ROUTE = r"""CASE WHEN regexp_matches(lower(trim(text)), '^(hi|hello|hey|thanks|thank you)\b') THEN 'hyde' WHEN regexp_matches(lower(text), '\b(compare|difference|versus|vs)\b') THEN 'fusion'
    WHEN starts_with(lower(trim(text)), 'how ') THEN 'fusion' WHEN len(string_split_regex(trim(text), '\s+')) <= 12 THEN 'hybrid' ELSE 'hyde' END"""
_ROUTED = "SELECT x.*, '{0}' AS route FROM ({1}) x JOIN (SELECT item_id AS query_id, {2} AS route FROM benchmark) y ON y.query_id = x.query_id AND y.route = '{0}'"


@query(" UNION ALL ".join(_ROUTED.format(name, sql, _ROUTE) for name, sql in (("fusion", _FUSION_SQL), ("hybrid", f"WITH {_HYBRID} {_RESULT}"), ("hyde", _HYDE_SQL))))
def adaptive_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = context(spark, sf_dir)
    return s.run("adaptive", s.replace(ctx, queries=checkpoint(s.plan_queries(ctx.queries.select("query_id", "text")))))


@query(f"""WITH {_HYBRID}, ag AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) - 1 AS place FROM fo)
SELECT query_id, chunk_id, chunk_id AS doc_id, rerank, rerank AS final, CAST(place AS INTEGER) AS rank FROM ag WHERE place < 8 AND (rerank >= 0.15 OR place = 0)""")
def agentic_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.run("agentic", context(spark, sf_dir))


# --- graph ------------------------------------------------------------------------------------------------------------------

#: Entities of a document: its capitalised words of twelve letters and more.
_ENTITY = "[A-Z][a-z]{11,}"
#: All its capitalised words: runs of letters, marks and digits of any script and length that begin with a capital.
_WORD, _CAPITAL = r"[\p{L}\p{M}\p{N}]+", r"^[\p{Lu}\p{Lt}]"


def _graph_sql(entities: str) -> str:
    return f"""
me AS (SELECT DISTINCT doc_id AS chunk_id, lower(unnest({entities})) AS entity FROM documents),
ed AS (SELECT x.entity AS a, y.entity AS b, count(*) AS w FROM me x JOIN me y ON x.chunk_id = y.chunk_id AND x.entity <> y.entity GROUP BY ALL),
en AS (SELECT DISTINCT entity FROM me), ma AS (SELECT query_id, entity FROM q JOIN en ON contains(lower(text), entity)),
h1 AS (SELECT DISTINCT query_id, b AS entity FROM ma JOIN ed ON a = entity WHERE (query_id, b) NOT IN (SELECT (query_id, entity) FROM ma)),
ne AS (SELECT query_id, entity, 0 AS hop FROM ma UNION ALL SELECT query_id, entity, 1 FROM h1),
gs AS (SELECT query_id, chunk_id, sum(CASE WHEN hop = 0 THEN 2.0 ELSE 1.0 END) AS score, list_sort(list(DISTINCT entity)) AS matched FROM ne JOIN me USING (entity) GROUP BY ALL),
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM gs) WHERE rank < 40)
"""


_GRAPH = _graph_sql(f"regexp_extract_all(text, '{_ENTITY}')")
_WHOLE_GRAPH = _graph_sql(f"list_filter(regexp_extract_all(text, '{_WORD}'), lambda w: regexp_matches(w, '{_CAPITAL}'))")


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("chunk_id", F.regexp_extract_all("text", F.lit(_ENTITY), F.lit(0)).alias("entities"))
    return checkpoint(kg.mentions(c))


def whole_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, chunk_id of all capitalised words."""
    named = F.filter(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), lambda w: F.rlike(w, F.lit(_CAPITAL)))
    return checkpoint(kg.mentions(chunks(spark, sf_dir).select("chunk_id", F.array_distinct(named).alias("entities"))))


@query(f"WITH {QUESTIONS}, {_GRAPH} SELECT a, b, w FROM ed")
def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.edges(entity_mentions(spark, sf_dir))


@query(f"""WITH {QUESTIONS}, {_GRAPH}, h2 AS (SELECT DISTINCT query_id, b AS entity FROM h1 JOIN ed ON a = entity WHERE (query_id, b) NOT IN (SELECT (query_id, entity) FROM ne))
SELECT query_id AS key, entity, CAST(hop AS INTEGER) AS hop FROM ne UNION ALL SELECT query_id, entity, 2 FROM h2""")
def kg_neighbors2(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = entity_mentions(spark, sf_dir)
    seeds = kg.match_entities(questions(spark, sf_dir), m.select("entity").distinct())
    return kg.neighbours(seeds.withColumnRenamed("query_id", "key"), checkpoint(kg.edges(m)), 2)


@query(f"WITH {QUESTIONS}, {_GRAPH} SELECT query_id, chunk_id, score, matched, CAST(rank AS INTEGER) AS rank FROM gr")
def graph_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = entity_mentions(spark, sf_dir)
    return kg.graph_search(questions(spark, sf_dir), m, checkpoint(kg.edges(m)))


@query(f"""WITH {_HYBRID}, {_WHOLE_GRAPH}, li AS (SELECT query_id, chunk_id, rank FROM fo UNION ALL SELECT query_id, chunk_id, rank FROM gr),
f2 AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS fused FROM li GROUP BY ALL),
p2 AS (SELECT f2.*, coalesce(round(CASE WHEN q_tokens > 0 AND p_tokens > 0 THEN coalesce(overlap, 0) / q_tokens / (1.0 + ln(1.0 + p_tokens) / 10.0) ELSE 0.0 END, 6), 0.0) AS rerank FROM f2
    JOIN (SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS p_tokens FROM documents) ON doc_id = f2.chunk_id LEFT JOIN qs ON qs.query_id = f2.query_id LEFT JOIN ls ON ls.query_id = f2.query_id AND ls.chunk_id = f2.chunk_id),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) - 1 AS rank FROM p2)
SELECT query_id, chunk_id, chunk_id AS doc_id, rerank, rerank AS final, CAST(rank AS INTEGER) AS rank FROM r2 WHERE rank < 8 AND (rerank >= 0.15 OR rank = 0)""")
def hybrid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.run("hybrid_graph", s.replace(context(spark, sf_dir), mentions=whole_mentions(spark, sf_dir)))


@query(f"""WITH {_HYBRID}, {_WHOLE_GRAPH},
gp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pool_rank FROM gr),
g2 AS (SELECT gp.query_id, gp.chunk_id, coalesce(round(CASE WHEN q_tokens > 0 AND p_tokens > 0 THEN coalesce(overlap, 0) / q_tokens / (1.0 + ln(1.0 + p_tokens) / 10.0) ELSE 0.0 END, 6), 0.0) AS rerank FROM gp
    JOIN (SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS p_tokens FROM documents) ON doc_id = gp.chunk_id LEFT JOIN qs ON qs.query_id = gp.query_id LEFT JOIN ls ON ls.query_id = gp.query_id AND ls.chunk_id = gp.chunk_id WHERE pool_rank <= 80),
g3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) - 1 AS place FROM g2)
SELECT query_id, chunk_id, chunk_id AS doc_id, rerank, rerank AS final, CAST(place AS INTEGER) AS rank FROM g3 WHERE place < 8 AND (rerank >= 0.15 OR place = 0)
UNION ALL SELECT query_id, chunk_id, chunk_id, rerank, final, CAST(rank AS INTEGER) FROM fo WHERE query_id NOT IN (SELECT query_id FROM gr)""")
def graph_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.run("graph", s.replace(context(spark, sf_dir), mentions=whole_mentions(spark, sf_dir)))


@query(f"WITH {QUESTIONS}, {TERMS} SELECT query_id, CASE WHEN text LIKE '%|%' THEN 'table' ELSE 'text' END AS kind, count(*) AS n FROM st JOIN documents ON doc_id = chunk_id GROUP BY ALL")
def multimodal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("chunk_type", F.when(F.contains("text", F.lit("|")), "table"))
    return s.modality_mix(r.sparse_topk(questions(spark, sf_dir), c), c)


# --- context and grounding ------------------------------------------------------------------------------------------------------

_BUDGET = f"""
cb0 AS (SELECT query_id, chunk_id, rerank, {count_tokens('text')} AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS place FROM rr JOIN documents ON doc_id = chunk_id),
cb AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS used FROM cb0 WHERE place <= 8) WHERE place = 1 OR used <= 3500)
"""


def _budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    best = r.rerank(r.sparse_topk(q, c).drop("rank"), q, c, order="score").select("query_id", "chunk_id", "rerank")
    return a.context_budget(best.join(c.select("chunk_id", "text"), "chunk_id"), score="rerank").drop("text")


@query(f"WITH {QUESTIONS}, {TERMS}, {reranked('st', 'score')}, {_BUDGET} SELECT query_id, chunk_id, rerank, tokens, CAST(place AS INTEGER) AS place, CAST(used AS BIGINT) AS used FROM cb")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse top-k, rerank and token budget for every question."""
    return _budgeted(spark, sf_dir)


@query(f"""WITH {QUESTIONS}, {TERMS}, {reranked('st', 'score')}, {_BUDGET}, k AS (SELECT *, CASE WHEN (place - 1) % 2 = 0 THEN place - 1 ELSE 2 * count(*) OVER (PARTITION BY query_id) - (place - 1) END AS k FROM cb)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INTEGER) AS cite FROM k""")
def attention_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.attention_reorder(_budgeted(spark, sf_dir)).select("query_id", "chunk_id", "cite")


@query(f"""WITH {QUESTIONS}, {TERMS}, ev AS (SELECT query_id, d.text AS evidence FROM st JOIN documents d ON doc_id = chunk_id WHERE rank = 0),
cl AS (SELECT query_id, unnest({sentences('text')}) AS claim FROM q),
ok AS (SELECT query_id, {content('claim', text.GROUNDING_STOP)} AS c, {content("coalesce(evidence, '')", text.GROUNDING_STOP)} AS e, evidence FROM cl LEFT JOIN ev USING (query_id))
SELECT query_id AS answer_id, round(avg(CASE WHEN evidence IS NULL AND len(c) > 0 THEN 0.0 WHEN len(c) = 0 OR len(list_intersect(c, e)) / len(c) >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS score FROM ok GROUP BY 1""")
def grounding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a question's text as claims that cite its best document."""
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    best = r.sparse_topk(q, c, 1).join(c.select("chunk_id", "text"), "chunk_id")
    claims = q.select(F.col("query_id").alias("answer_id"), F.posexplode(text.sentences(F.col("text"))).alias("claim_no", "text")).withColumn("cite", F.array(F.lit(1)))
    return a.grounding(claims, best.select(F.col("query_id").alias("answer_id"), F.lit(1).alias("cite"), "text")).select("answer_id", "score")


@query(f"""WITH {QUESTIONS}, s AS (SELECT query_id, {sentences('text')}[1] AS said FROM q)
SELECT query_id, n - 1 AS n, parts[n] AS delta, CAST(NULL AS VARCHAR) AS reason FROM (SELECT query_id, regexp_extract_all(said, '\\S+\\s*') AS parts, unnest(range(1, len(regexp_extract_all(said, '\\S+\\s*')) + 1)) AS n FROM s)""")
def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stub answer to every question over the question's own text, as the parts in which it is said."""
    asked = F.to_json(F.struct(F.col("text").alias("question"), F.array(F.struct(F.lit(1).alias("cite"), F.col("text").alias("text"))).alias("context")))
    return stream_model(questions(spark, sf_dir).select("query_id", asked.alias("asked")), "asked", "answer_parts")


@query()
def online_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole online pipeline for every question."""
    from .answer import answer

    return answer(context(spark, sf_dir)).drop("citations")


@query(f"""WITH {QUESTIONS}, {TERMS}, t AS (SELECT query_id, source FROM st JOIN documents ON doc_id = chunk_id WHERE rank < 8)
SELECT query_id AS case_id, coalesce(max(CASE WHEN contains(lower(source), 'src' || query_id % 20) THEN 1.0 ELSE 0.0 END), 0.0) AS hit FROM q LEFT JOIN t USING (query_id) GROUP BY 1""")
def eval_context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question's results hold its expected source."""
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    cases = q.select(F.col("query_id").alias("case_id"), F.concat(F.lit("SRC"), (F.col("query_id") % 20).cast("string")).alias("relevant_source_contains"))
    found = r.sparse_topk(q, c, 8).join(c.select("chunk_id", "source"), "chunk_id").select(F.col("query_id").alias("case_id"), F.lit("").alias("doc_id"), F.col("source").alias("title"))
    return fb.retrieval_hit(cases, found)


@query(f"""WITH {QUESTIONS}, {TERMS}, b AS (SELECT query_id, q.text AS question, d.text AS answer FROM st JOIN q USING (query_id) JOIN documents d ON doc_id = chunk_id WHERE rank = 0),
t AS (SELECT query_id, {content('answer', text.EVALUATION_STOP)} AS p, {content('question', text.EVALUATION_STOP)} AS g FROM b)
SELECT query_id AS case_id, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(list_intersect(p, g)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) END, 6) AS correctness,
    round(CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(p, g)) / len(g) END, 6) AS relevancy FROM t""")
def eval_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best document against its question as prediction and ideal."""
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    best = r.sparse_topk(q, c, 1).join(c.select("chunk_id", F.col("text").alias("answer")), "chunk_id").join(q.withColumnRenamed("text", "query"), "query_id")
    return fb.case_metrics(best.select(F.col("query_id").alias("case_id"), "query", "answer", F.col("query").alias("ideal"), F.lit(1.0).alias("score"))).select("case_id", "correctness", "relevancy")

# --- a graph over whole vocabularies -------------------------------------------------------------------------------------------

#: Part names as chunks whose words are entities, questions made of market segments and part types.
_PARTS_SQL = """
me AS (SELECT DISTINCT p_partkey AS chunk_id, lower(unnest(string_split(p_type, ' '))) AS entity FROM part UNION SELECT p_partkey, lower(p_brand) FROM part),
ed AS (SELECT x.entity AS a, y.entity AS b, count(*) AS w FROM me x JOIN me y ON x.chunk_id = y.chunk_id AND x.entity <> y.entity GROUP BY ALL),
q AS (SELECT CAST(row_number() OVER (ORDER BY p_brand) AS BIGINT) AS query_id, 'Which parts does ' || p_brand || ' make?' AS text FROM (SELECT DISTINCT p_brand FROM part)),
ma AS (SELECT query_id, entity FROM q JOIN (SELECT DISTINCT entity FROM me) ON contains(lower(text), entity)),
h1 AS (SELECT DISTINCT query_id, b AS entity FROM ma JOIN ed ON a = entity WHERE (query_id, b) NOT IN (SELECT (query_id, entity) FROM ma)),
ne AS (SELECT query_id, entity, 0 AS hop FROM ma UNION ALL SELECT query_id, entity, 1 FROM h1),
h2 AS (SELECT DISTINCT query_id, b AS entity FROM h1 JOIN ed ON a = entity WHERE (query_id, b) NOT IN (SELECT (query_id, entity) FROM ne)),
gs AS (SELECT query_id, chunk_id, sum(CASE WHEN hop = 0 THEN 2.0 ELSE 1.0 END) AS score, list_sort(list(DISTINCT entity)) AS matched FROM ne JOIN me USING (entity) GROUP BY ALL),
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM gs) WHERE rank < 40)
"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    rows = checkpoint(kg.mentions(p.select(F.col("p_partkey").alias("chunk_id"), F.concat(F.split("p_type", " "), F.array("p_brand")).alias("entities"))))
    brands = fb.numbered(p.select("p_brand").distinct(), "p_brand")
    return rows, brands.select(F.col("seq").cast("long").alias("query_id"), F.concat(F.lit("Which parts does "), "p_brand", F.lit(" make?")).alias("text"))


@query(f"WITH {_PARTS_SQL} SELECT query_id AS key, entity, CAST(hop AS INTEGER) AS hop FROM ne UNION ALL SELECT query_id, entity, 2 FROM h2")
def part_neighbors2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities within two hops of a question's brand, over the words of all parts."""
    m, q = _parts(spark, sf_dir)
    seeds = kg.match_entities(q, m.select("entity").distinct())
    return kg.neighbours(seeds.withColumnRenamed("query_id", "key"), checkpoint(kg.edges(m)), 2)


@query(f"WITH {_PARTS_SQL} SELECT query_id, chunk_id, score, matched, CAST(rank AS INTEGER) AS rank FROM gr")
def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by a question's brand and its neighbours."""
    m, q = _parts(spark, sf_dir)
    return kg.graph_search(q, m, checkpoint(kg.edges(m)))


@query(f"WITH {_HYBRID} SELECT query_id, CASE WHEN text LIKE '%|%' THEN 'table' ELSE 'text' END AS kind, count(*) AS n FROM fo JOIN documents ON doc_id = chunk_id GROUP BY ALL")
def multimodal_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multimodal strategy's notes: how many results of each question are tables."""
    ctx = context(spark, sf_dir)
    ctx = s.replace(ctx, chunks=ctx.chunks.withColumn("chunk_type", F.when(F.contains("text", F.lit("|")), "table")))
    notes = s.run("multimodal", ctx).select("query_id", "notes").dropDuplicates(["query_id"])
    return notes.select("query_id", F.explode("notes").alias("kind", "n"))
