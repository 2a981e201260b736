"""After retrieval: context budget, citations, grounding, guardrails, budget tiers, semantic cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_tokens, lexical_entails
from ..functions.vectors import _by_length, _whole

# Context and grounding limits, tiers, and the guardrails' patterns (in their order).
CONTEXT_TOKENS, CONTEXT_CHUNKS = 3500, 8
GROUNDING_LEAST = 0.6
QUERY_TOKENS = 512
SIMPLE_INTENTS = ("factoid", "policy_lookup", "faq")
MULTISTEP_INTENTS = ("comparison", "multi_hop", "howto")
SIMPLE_TIER = {"role": "small", "top_n": 4, "context_tokens": 1500, "output_tokens": 512}
COMPLEX_TIER = {"role": "large", "top_n": 8, "context_tokens": 3500, "output_tokens": 1024}
SIMPLE_CONFIDENCE = 0.30
CACHE_SIMILARITY, CACHE_ENTRIES = 0.90, 2000
PII = {
    "EMAIL": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "PHONE": r"\b(?:\+?\d{1,2}[\s-]?)?(?:\(?\d{3}\)?[\s-]?)\d{3}[\s-]?\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]?){13,16}\b",
}
INJECTION = (
    r"(?i)(ignore (all |the )?(previous|prior|above) instructions|"
    r"disregard (the |your )?(system|previous)|reveal (the |your )?(system prompt|instructions)|"
    r"you are now|act as (an? )?(dan|jailbreak)|print your (system )?prompt)"
)
TOXIC = r"(?i)\b(kill yourself|slur1|slur2)\b"


# --- context ----------------------------------------------------------------------------------------------------------


def block_text(rank: Column, title: Column, section: Column, freshness: Column, body: Column) -> Column:
    """A numbered source block."""
    where = F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] (source: "), where, F.lit(", "), F.coalesce(freshness, F.lit("None")), F.lit(")\n"), body)


def context_budget(results: DataFrame, tokens: Column | None = None, budget: int = CONTEXT_TOKENS, most: int = CONTEXT_CHUNKS, score: str = "final") -> DataFrame:
    """Results in score order up to the first that overflows the budget; the first always stays. Adds used (running tokens).

    A final score of exactly 0 counts as none: the rerank score stands in.
    """
    n = count_tokens(F.col("text")) if tokens is None else tokens
    by = F.coalesce(F.nullif(score, F.lit(0.0)), F.col("rerank")) if score == "final" and "rerank" in results.columns else F.col(score)
    order = Window.partitionBy("query_id").orderBy(by.desc(), "chunk_id")
    rows = results.withColumn("tokens", n).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    rows = rows.withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("place") == 1) | (F.col("used") <= budget))


def attention_reorder(rows: DataFrame) -> DataFrame:
    """Best blocks at both ends: odd places ascending, then even ones descending; cite is the new number from 1."""
    r = F.col("place") - 1
    n = F.count("*").over(Window.partitionBy("query_id"))
    key = F.when(r % 2 == 0, r).otherwise(2 * n - r)
    keyed = rows.withColumn("_key", key)
    return keyed.withColumn("cite", F.row_number().over(Window.partitionBy("query_id").orderBy("_key"))).drop("_key")


def assemble(rows: DataFrame) -> DataFrame:
    """query_id, context text and citations of budgeted, reordered rows (a bounded number a query)."""
    null = F.lit(None).cast("string")
    have = lambda c: F.col(c) if c in rows.columns else null
    body = F.coalesce(F.nullif(have("table_markdown"), F.lit("")), F.col("text"))
    block = rows.withColumn("block", block_text(F.col("cite"), have("title"), have("section"), have("freshness_date"), body))
    grouped = block.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cite", "block", "chunk_id", "doc_id", have("title").alias("title"), have("section").alias("section")))).alias("b"), F.max("used").alias("used_tokens"))
    return grouped.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"), F.transform("b", lambda x: F.struct(x["cite"], x["chunk_id"], x["doc_id"], x["title"], x["section"])).alias("citations"), "used_tokens")


# --- grounding --------------------------------------------------------------------------------------------------------


def grounding(claims: DataFrame, evidence: DataFrame, least: float = GROUNDING_LEAST) -> DataFrame:
    """answer_id, score, grounded, unsupported of claims(answer_id, claim_no, text, cite) against evidence(answer_id, cite, text).

    Cited evidence is joined in cite order; a claim without citations is unsupported; no claims, score 0.
    """
    cited = claims.select("answer_id", "claim_no", F.posexplode("cite").alias("at", "cite")).join(evidence.select("answer_id", "cite", F.col("text").alias("evidence")), ["answer_id", "cite"])
    joined = cited.groupBy("answer_id", "claim_no").agg(F.array_sort(F.collect_list(F.struct("at", "evidence"))).alias("e"))
    joined = joined.select("answer_id", "claim_no", F.array_join(F.transform("e", lambda x: x["evidence"]), " ").alias("evidence"))
    rows = claims.join(joined, ["answer_id", "claim_no"], "left")
    ok = (F.size(F.coalesce("cite", F.array().cast("array<int>"))) > 0) & lexical_entails(F.col("text"), F.coalesce("evidence", F.lit("")))
    rows = rows.withColumn("ok", ok)
    out = rows.groupBy("answer_id").agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("score"), F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("claim_no", "text")))), lambda x: x["text"]).alias("unsupported"))
    return out.withColumn("grounded", F.col("score") >= least)


# --- guardrails -------------------------------------------------------------------------------------------------------


def pii_spans(text: Column) -> Column:
    """Array of (entity, match) in the patterns' order; word characters as Unicode has them."""


    def found(entity: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)), lambda x: F.struct(F.lit(entity).alias("entity"), x.alias("match")))

    return F.concat(*(found(e, p) for e, p in PII.items()))


def redact_pii(text: Column) -> Column:
    """Each found string replaced wherever it stands, one after another, so an earlier kind may consume a later one's."""
    return F.aggregate(F.array_distinct(pii_spans(text)), text, lambda t, s: F.replace(t, s["match"], F.concat(F.lit("[REDACTED_"), s["entity"], F.lit("]"))))


def strip_injection(text: Column) -> Column:
    return F.regexp_replace(text, INJECTION, "[removed]")


def check_input(rows: DataFrame, text: str = "text", allowed: Column | None = None, pii: str = "block", injection: str = "sanitize", most: int = QUERY_TOKENS) -> DataFrame:
    """Adds reason (null if admitted), flags and sanitized; the first failing check wins: length, rate, personal data, injection."""
    t = F.col(text)
    has_pii, injected = F.size(pii_spans(t)) > 0, t.rlike(INJECTION) if injection != "off" else F.lit(False)
    reason = F.when(count_tokens(t) > most, "query_too_long")
    if allowed is not None:
        reason = reason.when(~allowed, "rate_limited")
    if pii == "block":
        reason = reason.when(has_pii, "pii_in_query")
    if injection == "block":
        reason = reason.when(injected, "prompt_injection")
    clean = redact_pii(t) if pii == "redact" else t
    out = rows.withColumn("reason", reason)
    flag = F.when(F.col("reason") == "query_too_long", F.array(F.lit("length"))).when(F.col("reason") == "rate_limited", F.array(F.lit("rate_limit"))).when(F.col("reason") == "pii_in_query", F.array(F.lit("pii")))
    flags = flag.otherwise(F.array_compact(F.array(F.when(has_pii if pii != "off" else F.lit(False), F.lit("pii")), F.when(injected, F.lit("injection")))))
    return out.withColumn("flags", flags).withColumn("sanitized", F.when(F.col("reason").isNull(), strip_injection(clean) if injection != "off" else clean).otherwise(t))


def check_output(rows: DataFrame, text: str = "answer", pii: str = "redact", toxicity: str = "block") -> DataFrame:
    """Adds reason and safe: toxic answers are blocked, personal data redacted or blocked."""
    t = F.col(text)
    toxic = t.rlike(TOXIC) if toxicity == "block" else F.lit(False)
    has_pii = F.size(pii_spans(t)) > 0
    reason = F.when(toxic, "toxic_output")
    if pii == "block":
        reason = reason.when(has_pii, "pii_in_output")
    safe = redact_pii(t) if pii == "redact" else t
    return rows.withColumn("reason", reason).withColumn("safe", F.when(F.col("reason").isNull(), safe).otherwise(F.lit("")))


# --- routing and caches -----------------------------------------------------------------------------------------------


def is_simple(intent: Column, n_sub_queries: Column, confidence: Column) -> Column:
    return intent.isin(*SIMPLE_INTENTS) & (n_sub_queries <= 1) & (confidence >= SIMPLE_CONFIDENCE)


def budget_tier(intent: Column, n_sub_queries: Column, confidence: Column) -> Column:
    """Struct of the tier's role and limits."""
    simple = F.coalesce(is_simple(intent, n_sub_queries, confidence), F.lit(False))
    pick = lambda k: F.when(simple, F.lit(SIMPLE_TIER[k])).otherwise(F.lit(COMPLEX_TIER[k])).alias(k)
    return F.struct(F.when(simple, F.lit("simple")).otherwise(F.lit("complex")).alias("tier"), *(pick(k) for k in SIMPLE_TIER))


def adaptive_route(intent: Column, n_sub_queries: Column) -> Column:
    """Several steps: fusion; a plain lookup: hybrid; else a hypothetical answer."""
    return F.when(intent.isin(*MULTISTEP_INTENTS) | (n_sub_queries > 1), "fusion").when(intent.isin(*SIMPLE_INTENTS), "hybrid").otherwise("hyde")


def needs_retrieval(intent: Column) -> Column:
    return F.coalesce(intent != "chitchat", F.lit(True))


#: Bytes of cached vectors that a task holds at once.
CACHE_BYTES = 1 << 26


def cache_lookup(queries: DataFrame, entries: DataFrame, least: float = CACHE_SIMILARITY, newest: int = CACHE_ENTRIES, own: bool = False, most_bytes: int = CACHE_BYTES) -> DataFrame:
    """query_id, seq, similarity: the best entry at cosine >= least within the same scope; the earliest of equals.

    entries(seq, scope, vector) is a ring: only the `newest` count, found without a global sort of all of them. They reach
    the tasks as a matrix a scope, in slices of at most `most_bytes`, and each batch of queries meets its scopes' matrices,
    so no (query, entry) rows exist. With `own` the queries are entries themselves and don't find theirs.
    """
    spark = queries.sparkSession
    held = entries.orderBy(F.desc("seq")).limit(newest).select("seq", "scope", "vector").toArrow()  # `newest` rows
    held = held.sort_by("seq")
    width = max(pc.max(pc.list_value_length(held.column("vector"))).as_py() or 1, 1) if held.num_rows else 1
    step = max(1, most_bytes // (8 * width))
    found = spark.createDataFrame([], "query_id long, seq long, similarity double")
    for low in range(0, held.num_rows, step):
        part = held.slice(low, step)
        scopes: dict = {}
        for length, (at, x) in _by_length(_whole(part.column("vector")), True).items():
            of = part.column("scope").take(pa.array(at)).to_pylist()
            seqs = part.column("seq").to_numpy()[at].astype(np.int64)
            for scope in dict.fromkeys(of):
                mine = np.array([s == scope for s in of])
                scopes[scope, length] = seqs[mine], x[mine]
        shared = spark.sparkContext.broadcast(scopes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, of, out = b.column(0).to_numpy(), b.column(1).to_pylist(), []
                for length, (at, x) in _by_length(b.column(2), True).items():
                    for scope in dict.fromkeys(of[i] for i in at.tolist()):
                        if scope is None or (scope, length) not in shared.value:
                            continue
                        seqs, vectors = shared.value[scope, length]
                        mine = np.array([of[i] == scope for i in at.tolist()])
                        scores = np.round(x[mine] @ vectors.T, 6) + 0.0
                        if own:
                            scores[ids[at[mine]][:, None] == seqs[None, :]] = -2.0
                        best = scores.argmax(axis=1)  # the first, so the earliest, of equals
                        score = scores[np.arange(len(best)), best]
                        out += [(int(q), int(s), float(v)) for q, s, v in zip(ids[at[mine]], seqs[best], score, strict=True) if v >= least]
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "seq", "similarity"])

        found = found.unionByName(queries.select(F.col("query_id").cast("long").alias("query_id"), "scope", "vector").mapInArrow(run, "query_id long, seq long, similarity double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "seq")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "seq", "similarity")


def response_cache(requests: DataFrame, key: Column) -> DataFrame:
    """Exact cache over a stream of requests(seq, ...): hit is whether an earlier request has the key."""
    keyed = requests.withColumn("key", key)
    first = keyed.groupBy("key").agg(F.min("seq").alias("first_seq"))
    return keyed.join(first, "key").withColumn("hit", F.col("seq") > F.col("first_seq"))
