"""The online pipeline over a set of questions, and ingestion end to end."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import simhash
from ..functions.text import sentences
from ..functions.vectors import embed
from ..operators import access
from ..operators import answering as a
from ..operators import ingest as i
from ..operators.feedback import numbered, rate_limited
from ..operators.models import Tracer, map_model, stream_model
from ..settings import DEFAULTS
from ..sources.tables import CacheStore, Collections, cache_key
from . import strategies as s
from .base import checkpoint

# Fixed value: what is said when an answer isn't grounded.
ABSTENTION = "There isn't enough in the documents to answer this with confidence; the closest sources are listed."


#: What the role `answer` returns; any other text is an answer whose sentences cite the first block.
ANSWER = "answer string, claims array<struct<text:string,cite:array<int>>>"


def guarded(queries: DataFrame, settings: dict = DEFAULTS, allowed=None) -> DataFrame:
    """queries with reason, flags and sanitized, as the settings' input guard has it."""
    g = settings["guardrails"]["input"]
    return a.check_input(queries, allowed=allowed, pii=g["pii"], injection=g["injection"], most=g["max_query_tokens"])


def _by_sources(asked: DataFrame, ctx: s.Context, strategy: str, entitlements: list[str] | None) -> DataFrame:
    """The strategy over questions that share a source plan, with that plan's filter and the plain one as its fallback."""
    if "source" not in asked.columns or entitlements is None:
        return s.run(strategy, s.replace(ctx, queries=asked))
    keyed = checkpoint(asked.withColumn("_plan", F.to_json(F.struct("source.equals", "source.must_access_tags"))).drop("source"))
    plans = [r[0] for r in keyed.select("_plan").distinct().collect()]  # combinations of facets
    found = None
    for plan in plans:
        wanted = json.loads(plan or "{}")
        which = access.build_filter(wanted.get("equals") or {}, wanted.get("must_access_tags") or [], entitlements)
        one = s.run(strategy, s.replace(ctx, queries=keyed.where(F.col("_plan").eqNullSafe(F.lit(plan))).drop("_plan"), filter=which, relaxed=access.relaxed(entitlements)))
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    return s.run(strategy, s.replace(ctx, queries=asked.drop("source"))) if found is None else found


def retrieved(admitted: DataFrame, ctx: s.Context, strategy: str, settings: dict = DEFAULTS, entitlements: list[str] | None = None) -> DataFrame:
    """query_id, question, tier and the blocks in the order of the prompt (cite from 1) of planned questions."""
    asked = admitted.where("needs_retrieval")
    divided = s.replace(s.configured(ctx, settings), sub_queries=checkpoint(s.sub_queries_of(asked)))
    found = checkpoint(_by_sources(asked, divided, strategy, entitlements))
    confidence = found.groupBy("query_id").agg(F.max("final").alias("confidence"))
    tier = asked.join(confidence, "query_id", "left").select("query_id", F.col("text").alias("question"), a.budget_tier(F.col("intent"), F.col("n_sub"), F.coalesce("confidence", F.lit(0.0))).alias("t"))
    limits = settings["generation"]
    results = found.join(tier, "query_id").where((F.col("rank") < F.col("t.top_n")) & (F.col("rank") < limits["max_context_chunks"])).join(ctx.chunks.drop("doc_id"), "chunk_id")
    kept = a.context_budget(results, budget=limits["context_budget_tokens"], most=limits["max_context_chunks"])
    return checkpoint(a.attention_reorder(kept.where((F.col("place") == 1) | (F.col("used") <= F.col("t.context_tokens")))))


def prompts_of(placed: DataFrame) -> DataFrame:
    """query_id, asked: the question and all its blocks as JSON, in the order of their numbers."""
    body = F.coalesce(F.nullif("table_markdown", F.lit("")), F.col("text")) if "table_markdown" in placed.columns else F.col("text")
    blocks = placed.groupBy("query_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("cite", body.alias("text")))).alias("context"))
    return blocks.select("query_id", F.to_json(F.struct("question", "context")).alias("asked"))


def answered(checked: DataFrame, ctx: s.Context, strategy: str = "hybrid", settings: dict = DEFAULTS, entitlements: list[str] | None = None, facets: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a checked question (guarded): blocked, direct, grounded or abstained, with answer, citations and score."""
    out = settings["guardrails"]["output"]
    admitted = checkpoint(s.plan_queries(checked.where("reason is null").select("query_id", F.col("sanitized").alias("text")), facets))
    direct = map_model(admitted.where(~F.col("needs_retrieval")).select("query_id", "text"), "text", "said", "direct")
    direct = direct.select("query_id", F.coalesce("said", F.lit("")).alias("answer"), F.lit(True).alias("direct"))
    placed = retrieved(admitted, ctx, strategy, settings, entitlements)
    context = a.assemble(placed)
    generated = checkpoint(map_model(prompts_of(placed), "asked", "said", "answer").withColumn("said", F.coalesce("said", F.lit(""))))
    record = F.from_json("said", ANSWER)
    plain = F.transform(sentences(F.col("said")), lambda x: F.struct(x.alias("text"), F.array(F.lit(1)).alias("cite")))
    generated = generated.withColumn("r", record).select("query_id", F.coalesce("r.answer", "said").alias("answer"), F.when(F.col("r.answer").isNull(), plain).otherwise(F.coalesce("r.claims", F.array().cast("array<struct<text:string,cite:array<int>>>"))).alias("claims"))
    claims = generated.select(F.col("query_id").alias("answer_id"), F.posexplode("claims").alias("claim_no", "c")).select("answer_id", "claim_no", "c.text", F.coalesce("c.cite", F.array().cast("array<int>")).alias("cite"))
    graded = a.grounding(claims, placed.select(F.col("query_id").alias("answer_id"), "cite", "text"), out["grounding_min"])
    rows = generated.select("query_id", "answer").join(graded.withColumnRenamed("answer_id", "query_id"), "query_id", "left").join(context, "query_id", "left")
    grounded = F.coalesce("grounded", F.lit(False))
    served = rows.select("query_id", F.when(grounded, F.col("answer")).otherwise(F.lit(ABSTENTION)).alias("answer"), grounded.alias("grounded"), F.coalesce("score", F.lit(0.0)).alias("score"), "citations", "used_tokens", F.lit(False).alias("direct"))
    safe = a.check_output(served.unionByName(direct, allowMissingColumns=True), pii=out["pii"], toxicity=out["toxicity"])
    safe = safe.select("query_id", F.col("safe").alias("answer"), "grounded", "score", "citations", "used_tokens", F.col("reason").alias("output_reason"), "direct")
    every = checked.select("query_id", "reason", "flags").join(safe, "query_id", "left")
    # A question whose search found nothing has no row in safe: it is abstained from.
    status = F.when(F.col("reason").isNotNull(), "blocked").when(F.col("output_reason").isNotNull(), "blocked").when(F.col("direct"), "direct").when(F.col("grounded"), "grounded").otherwise("abstained")
    every = every.withColumn("status", status)
    return every.withColumn("answer", F.when((F.col("status") == "abstained") & F.col("answer").isNull(), F.lit(ABSTENTION)).otherwise(F.col("answer"))).drop("direct")


def answer(ctx: s.Context, strategy: str = "hybrid", settings: dict = DEFAULTS, entitlements: list[str] | None = None, facets: dict[str, list[str]] | None = None) -> DataFrame:
    """The context's questions through guard and answered(): guard, plan (parts and sources), retrieve, route by confidence, assemble,
    generate from question and context, check claims against what they cite, guard again. What later stages read several times
    (a few rows a question) is written in between.
    """
    return answered(checkpoint(guarded(ctx.queries.select("query_id", "text"), settings)), ctx, strategy, settings, entitlements, facets)


def stop_reason(text: str) -> str | None:
    """Why an answer that is being said must stop, from its running text: what check_output's default settings block."""
    return "toxic_output" if re.search(a.TOXIC, text) else None


def streamed(ctx: s.Context, strategy: str = "hybrid", settings: dict = DEFAULTS, role: str = "answer_parts") -> DataFrame:
    """query_id, n, delta, reason: answers to the context's admitted questions, part by part as the role says them."""
    checked = checkpoint(guarded(ctx.queries.select("query_id", "text"), settings))
    admitted = checkpoint(s.plan_queries(checked.where("reason is null").select("query_id", F.col("sanitized").alias("text"))))
    return stream_model(prompts_of(retrieved(admitted, ctx, strategy, settings)), "asked", role, stop_reason)


def ingest_run(
    documents: DataFrame, registry: DataFrame | None, checkpoint: Callable[[DataFrame], DataFrame], enrichment: DataFrame | None = None, role: str | None = None, full_rebuild: bool = False,
    known: DataFrame | None = None, enrichment_cache: DataFrame | None = None, section_role: str | None = None, section_cache: DataFrame | None = None,
) -> dict[str, DataFrame | None]:
    """What an ingest makes of source documents: unchanged ones are skipped, near-duplicates resolved, the rest chunked.

    known(doc_id, fp, seq, combination, bits) holds earlier runs' fingerprints: a copy of one of their documents is a duplicate. enrichment
    is a table, or made by a model role whose results by content are in enrichment_cache; section_role summarises each section by itself,
    and section_cache(block_hash, summary) spares those of an edited document that are as they were. A document that the role
    fails on has the status failed and no chunks, the others go on.

    Returns chunks; status(doc_id, status, content_hash, duplicate_of, error) of every document, whose ingested and failed rows
    go into the registry; prints, to be added to known; sections(doc_id, section, heading, block_hash); both caches.
    """
    new = documents if registry is None or full_rebuild else i.changed(documents, registry)
    new = checkpoint(new)
    parts = checkpoint(i.sections(new))
    text = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", F.concat_ws("\n", "heading", i.section_text()).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    # Fingerprints are resolved in the order of the documents' ids, by consecutive numbers.
    keyed = checkpoint(numbered(text, "doc_id").select(F.col("seq").cast("long").alias("doc_id"), F.col("doc_id").alias("name"), "text"))
    prints = checkpoint(simhash(keyed.select("doc_id", "text")))
    earlier = checkpoint(i.known_duplicates(prints.join(keyed.select("doc_id", "name"), "doc_id").select(F.col("name").alias("doc_id"), "fp"), known))
    open_ = prints.join(keyed.select("doc_id", "name"), "doc_id").join(earlier.select(F.col("doc_id").alias("name")), "name", "left_anti").select("doc_id", "fp")
    found = i.greedy_duplicates(checkpoint(open_), checkpoint)
    dup = found.join(keyed.select("doc_id", "name"), "doc_id").join(keyed.select(F.col("doc_id").alias("duplicate_of"), F.col("name").alias("original")), "duplicate_of", "left").select(F.col("name").alias("doc_id"), F.col("original").alias("duplicate_of"))
    dup = checkpoint(dup.unionByName(earlier))
    fresh = new.join(dup.where("duplicate_of is not null").select("doc_id"), "doc_id", "left_anti")
    failed = None
    if role is not None:
        made, enrichment_cache = i.enriched(parts, fresh, enrichment_cache, role=role)
        made, enrichment_cache = checkpoint(made), checkpoint(enrichment_cache)
        failed = made.where("error is not null").select("doc_id", "error")
        fresh, enrichment = fresh.join(failed, "doc_id", "left_anti"), made.where("error is null").drop("error")
    kept = checkpoint(parts.join(fresh.select("doc_id"), "doc_id", "left_semi"))
    hashes = i.section_hashes(kept)
    if section_role is not None:
        summaries, section_cache = i.section_summaries(kept, section_cache, section_role)
        summaries, section_cache = checkpoint(summaries), checkpoint(section_cache)
        enrichment = i.with_summaries(fresh, enrichment, summaries)
    chunks = i.chunk_documents(kept, fresh, enrichment)
    status = documents.select("doc_id", "content_hash").join(new.select("doc_id", F.lit(True).alias("is_new")), "doc_id", "left").join(dup, "doc_id", "left")
    status = status.join(failed, "doc_id", "left") if failed is not None else status.withColumn("error", F.lit(None).cast("string"))
    kind = F.when(F.col("is_new").isNull(), "skipped").when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("error").isNotNull(), "failed").otherwise("ingested")
    named = prints.join(keyed.select("doc_id", "name"), "doc_id").join(fresh.select(F.col("doc_id").alias("name")), "name", "left_semi").select(F.col("name").alias("doc_id"), "fp", F.col("doc_id").alias("seq"))
    return {
        "chunks": chunks, "status": status.select("doc_id", kind.alias("status"), "content_hash", "duplicate_of", "error"), "prints": i.fingerprint_rows(named), "sections": hashes,
        "enrichment_cache": enrichment_cache, "section_cache": section_cache,
    }


def ingest(documents: DataFrame, registry: DataFrame | None, checkpoint: Callable[[DataFrame], DataFrame], enrichment: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(chunks, status) of ingest_run()."""
    made = ingest_run(documents, registry, checkpoint, enrichment, **options)
    return made["chunks"], made["status"]


def summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


RATE_WINDOW_S = 60
# What is said instead of an answer.
REFUSALS = {
    "query_too_long": "The question is too long; please shorten it.",
    "rate_limited": "Too many requests; please wait a moment.",
    "pii_in_query": "The question holds personal data and wasn't processed.",
    "prompt_injection": "This request can't be processed.",
}


class Service:
    """Answers sets of questions with limits, caches, usage records and traces kept in collections below a folder.

    A question goes through: the input guard with the user's admission limit, then (sanitized) the exact cache (text, entitlements,
    collection, strategy), the semantic cache (nearest earlier question of the same entitlements), planning, answered(). Grounded answers
    enter both caches; hits of the used chunks' documents are appended to `hits`, a span a stage to `spans`, admitted requests to
    `requests`.
    """

    def __init__(self, root: str, ctx: s.Context, entitlements: list[str], strategy: str = "hybrid", settings: dict = DEFAULTS, user: str = "anonymous", collection: str = "chunks", facets: dict[str, list[str]] | None = None):
        spark = ctx.chunks.sparkSession
        self.spark, self.ctx, self.strategy, self.settings, self.collection, self.user, self.facets = spark, ctx, strategy, settings, collection, user, facets
        self.entitlements, self.scope = list(entitlements), ",".join(sorted(entitlements))
        self.cache, self.records = CacheStore(spark, root, "answers"), Collections(spark, root)

    def ask(self, queries: DataFrame, now: float) -> DataFrame:
        """query_id, status, answer, score, citations (JSON), cache (exact, semantic or null), trace_id of queries(query_id, text)."""
        tracer = Tracer(f"ask-{uuid.uuid4().hex[:16]}")
        with tracer.span("ask"):
            out = self._ask(queries, now, tracer)
        self.records.append("spans", self.spark.createDataFrame(tracer.spans, "trace_id string, span_id long, parent_id long, name string, tokens long, cost double, ms double"))
        return out.withColumn("trace_id", F.lit(tracer.trace_id))

    def _guard(self, queries: DataFrame, now: float) -> DataFrame:
        """queries checked; a request beyond the user's limit in the last minute is refused, and refused ones don't count."""
        most = self.settings["guardrails"]["input"]["rate_limit_per_min"]
        new = queries.select(F.lit(self.user).alias("user_id"), F.lit(float(now)).alias("at"), F.col("query_id").alias("id"))
        old = None
        if self.records.target("requests"):
            old = self.records.read("requests").where((F.col("user_id") == self.user) & (F.col("at") >= now - RATE_WINDOW_S) & (F.col("at") <= now))
            old = old.select("user_id", "at", F.lit(-1).cast("long").alias("id"))
        judged = rate_limited(new if old is None else old.unionByName(new), most, RATE_WINDOW_S).where("id >= 0").select(F.col("id").alias("query_id"), "allowed")
        checked = checkpoint(guarded(queries.select("query_id", "text").join(judged, "query_id"), self.settings, F.col("allowed")).drop("allowed"))
        admitted = checked.where("reason is null or reason <> 'rate_limited'").select(F.lit(self.user).alias("user_id"), F.lit(float(now)).alias("at"))
        self.records.append("requests", admitted)
        return checked

    def _ask(self, queries: DataFrame, now: float, tracer: Tracer) -> DataFrame:
        at, semantic = F.lit(float(now)), self.settings["optimization"]
        with tracer.span("guard.input"):
            checked = self._guard(queries, now)
        plain = F.regexp_replace(F.lower(F.trim("sanitized")), r"\s+", " ")
        keyed = checkpoint(checked.where("reason is null").withColumn("key", cache_key("ans", self.collection, F.lit(self.scope), F.lit(self.strategy), plain)))
        shape = "status string, answer string, score double, citations string"
        with tracer.span("response_cache"):
            looked = checkpoint(self.cache.get(keyed, at))
            exact = looked.where("value is not null").withColumn("v", F.from_json("value", shape)).select("query_id", "v.*", F.lit("exact").alias("cache"))
            rest = looked.where("value is null").drop("value")
        with tracer.span("semantic_cache"):
            vectors = checkpoint(embed(rest.select("query_id", "key", F.col("sanitized").alias("text")), hashed=self.ctx.hashed, backend=self.ctx.backend).withColumn("scope", F.lit(f"{self.scope}|{self.strategy}")).select("query_id", "key", "scope", F.col("dense").alias("vector")))
            known = None
            if semantic["semantic_cache"] and self.records.target("semantic"):
                entries = self.records.read("semantic")
                near = a.cache_lookup(vectors, entries.select("seq", "scope", "vector"), semantic["semantic_cache_threshold"], semantic["semantic_cache_max_entries"]).join(entries.select("seq", "value"), "seq")
                known = checkpoint(near.withColumn("v", F.from_json("value", shape)).select("query_id", "v.*", F.lit("semantic").alias("cache")))
                rest = checkpoint(rest.join(known, "query_id", "left_anti"))
        with tracer.span("answer"):
            todo = checked.where("reason is not null").select("query_id", "reason", "flags", "sanitized").unionByName(rest.select("query_id", "reason", "flags", "sanitized"))
            full = checkpoint(answered(checkpoint(todo), self.ctx, self.strategy, self.settings, self.entitlements if self.facets else None, self.facets))
            refusal = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in REFUSALS.items() for x in (F.lit(k), F.lit(v)))), F.coalesce("reason", F.lit(""))), F.lit("This answer can't be shared."))
            made = full.select("query_id", "status", F.when(F.col("status") == "blocked", refusal).otherwise(F.col("answer")).alias("answer"), F.coalesce("score", F.lit(0.0)).alias("score"), F.to_json("citations").alias("citations"), F.lit(None).cast("string").alias("cache"))
        with tracer.span("record"):
            good = checkpoint(made.where("status = 'grounded'").join(vectors, "query_id").withColumn("value", F.to_json(F.struct("status", "answer", "score", "citations"))))
            if good.limit(1).count():
                self.cache.set(good.select("key", "value"), at, self.settings["caching"]["response_ttl_s"])
                last = self.records.read("semantic").agg(F.max("seq")).first()[0] if self.records.target("semantic") else 0
                entries = numbered(good.select("query_id", "scope", "vector", "value"), "query_id").withColumn("seq", F.col("seq") + F.lit(last or 0)).drop("query_id")
                self.records.append("semantic", entries)
            used = full.select(F.explode("citations").alias("c")).select(F.col("c.doc_id").alias("doc_id"), at.alias("at"))
            if used.limit(1).count():
                self.records.append("hits", used)
        parts = exact.unionByName(made)
        return parts if known is None else parts.unionByName(known)
