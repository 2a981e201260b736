"""Sparse and dense legs, rank fusion, reranking, business signals. Query sets are tables; all queries run in one plan.

Conventions: queries(query_id, text), chunks(chunk_id, doc_id, text, ...). Scores are rounded before they are ranked, ties
go to the smaller id, ranks for fusion count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import lexical_topk, query_terms
from ..functions.text import tokenize
from ..functions.vectors import dense_topk, embed, md5_hash

# The retrieval defaults and signal weights.
TOP_DENSE = TOP_SPARSE = 40
RRF_K = 60
RERANK_TOP, RERANK_POOL, RERANK_LEAST, STARVED = 8, 80, 0.15, 5
W_RECENCY, W_AUTHORITY, W_POPULARITY, DEPRECATED = 0.05, 0.05, 0.03, 0.20
AUTHORITY = {"official": 1.0, "draft": 0.4, "deprecated": 0.0}
OTHER_AUTHORITY = 0.3
DIGITS = 6


def top(rows: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best rows a query with their rank from 0; Spark limits groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def postings(chunks: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """chunk_id, token, tf; only of tokens in vocabulary(token), if given, so that other tokens aren't shuffled."""
    rows = chunks.select("chunk_id", F.explode(tokenize(F.col("text"))).alias("token"))
    if vocabulary is not None:
        rows = rows.join(vocabulary, "token", "left_semi")
    return rows.groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))


def sparse_topk(queries: DataFrame, chunks: DataFrame, k: int = TOP_SPARSE) -> DataFrame:
    """query_id, chunk_id, score, rank of the best positive scores; a stored collection is searched by sparse_index."""
    return lexical_topk(queries, chunks, k)


def embedded_topk(queries: DataFrame, chunks: DataFrame, k: int = TOP_DENSE, hashed=md5_hash, backend=None) -> DataFrame:
    """query_id, chunk_id, score, rank by cosine of embeddings (stored ones, where the chunks have them); negative cosines stay."""
    q = embed(queries.select("query_id", "text"), hashed=hashed, backend=backend, weights=False).select("query_id", F.col("dense").alias("vector"))
    held = chunks if "dense" in chunks.columns else embed(chunks.select("chunk_id", "text"), hashed=hashed, backend=backend, weights=False)
    d = held.select(F.col("chunk_id").alias("id"), F.col("dense").alias("vector"))
    return dense_topk(q, d, k).withColumnRenamed("id", "chunk_id")


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, fused: sum of 1 / (k + rank) over the ranked lists (one a leg and sub-query), ranks from 0."""
    return lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS).alias("fused"))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fused score with the best score of either leg, floored at 0, one pass over the union."""
    both = dense.select("query_id", "chunk_id", "rank", F.col("score").alias("d"), F.lit(None).cast("double").alias("s")).unionByName(
        sparse.select("query_id", "chunk_id", "rank", F.lit(None).cast("double").alias("d"), F.col("score").alias("s"))
    )
    best = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0))
    return both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS).alias("fused"), best("d").alias("dense"), best("s").alias("sparse"))


def hybrid(queries: DataFrame, chunks: DataFrame, parents: DataFrame | None = None, hashed=md5_hash, backend=None) -> DataFrame:
    """Fusion of both legs over all queries; parents(query_id, parent_id) pools sub-queries into one result each."""
    dense, sparse = embedded_topk(queries, chunks, hashed=hashed, backend=backend), sparse_topk(queries, chunks)
    if parents is not None:
        pool = lambda rows: rows.join(parents, "query_id").drop("query_id").withColumnRenamed("parent_id", "query_id")
        dense, sparse = pool(dense), pool(sparse)
    return fuse(dense, sparse)


def with_fallback(found: DataFrame, again: DataFrame, queries: DataFrame, least: int = STARVED) -> DataFrame:
    """found, but queries with fewer than `least` candidates get the results of the relaxed search instead."""
    n = queries.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
    starved = n.where(F.col("n") < least).select("query_id")
    return found.join(starved, "query_id", "left_anti").withColumn("relaxed", F.lit(False)).unionByName(again.join(starved, "query_id", "left_semi").withColumn("relaxed", F.lit(True)))


def passage(chunks: DataFrame) -> Column:
    """What a reranker reads of a chunk: prefix, text and table, as far as there are some."""
    return F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in ("contextual_prefix", "text", "table_markdown") if c in chunks.columns))


def rerank_score(overlap: Column, query_tokens: Column, passage_tokens: Column) -> Column:
    """Share of the query's tokens in the passage, damped by the number of the passage's distinct tokens."""
    damp = 1.0 + F.log1p(passage_tokens.cast("double")) / 10.0
    return F.coalesce(F.round(F.when((query_tokens > 0) & (passage_tokens > 0), overlap / query_tokens / damp).otherwise(F.lit(0.0)), DIGITS), F.lit(0.0))


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, pool: int = RERANK_POOL, keep: int = RERANK_TOP, least: float = RERANK_LEAST, order: str = "fused") -> DataFrame:
    """The `keep` best of each query's first `pool` candidates; below `least` only the very best stays.

    Candidate pairs are few (pool a query), and only they meet the passages' tokens.
    """
    pairs = top(candidates, pool, order).withColumnRenamed("rank", "pool_rank")
    terms = query_terms(queries)
    totals = terms.groupBy("query_id").agg(F.sum("qtf").alias("q_tokens"))
    needed = chunks.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", passage(chunks).alias("text"))
    shared = postings(needed, terms.select("token").distinct()).join(terms, "token")
    shared = shared.join(pairs.select("query_id", "chunk_id"), ["query_id", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.sum(F.least("qtf", "tf")).alias("overlap"))
    sizes = needed.select("chunk_id", F.size(F.array_distinct(tokenize(F.col("text")))).alias("p_tokens"))
    scored = pairs.join(sizes, "chunk_id").join(totals, "query_id", "left").join(shared, ["query_id", "chunk_id"], "left")
    scored = scored.withColumn("rerank", rerank_score(F.coalesce("overlap", F.lit(0)), F.coalesce("q_tokens", F.lit(0)), F.col("p_tokens"))).drop("overlap", "q_tokens", "p_tokens")
    return top(scored, keep, "rerank").where((F.col("rerank") >= least) | (F.col("rank") == 0))


def business_score(score: Column, freshness_days: Column, authority: Column, popularity: Column, feedback: Column) -> Column:
    """Relevance with small bounded boosts; deprecated documents are demoted."""
    recency = F.exp(-F.greatest(freshness_days, F.lit(0)) / 365.0)
    trust = F.lit(OTHER_AUTHORITY)
    for name, value in AUTHORITY.items():
        trust = F.when(authority == name, F.lit(value)).otherwise(trust)
    liked = F.greatest(F.least(popularity + feedback, F.lit(1.0)), F.lit(0.0))
    return F.round(score + W_RECENCY * recency + W_AUTHORITY * trust + W_POPULARITY * liked - F.when(authority == "deprecated", F.lit(DEPRECATED)).otherwise(F.lit(0.0)), DIGITS)


def apply_signals(results: DataFrame, features: DataFrame) -> DataFrame:
    """final score and order after a left join with document features; missing ones take the defaults."""
    joined = results.join(features.select("doc_id", "authority", "freshness_days", "popularity", "feedback_score"), "doc_id", "left")
    final = business_score(F.col("rerank"), F.coalesce("freshness_days", F.lit(9999)), F.coalesce("authority", F.lit("draft")), F.coalesce("popularity", F.lit(0.0)), F.coalesce("feedback_score", F.lit(0.0)))
    return joined.withColumn("final", final).drop("authority", "freshness_days", "popularity", "feedback_score")
