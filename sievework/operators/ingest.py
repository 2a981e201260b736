"""Ingestion: hash diff, normalising, near-duplicate resolution, enrichment, chunking, indexing, RAPTOR levels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import sliced
from ..functions.hashing import block_keys, hamming, simhash
from ..functions.text import clean_text, content_hash, count_tokens, render_document, sentences, table_markdown
from ..functions.vectors import embed, md5_hash
from ..session import checkpoint, merged
from ..sources.files import BLOCK
from ..sources.tables import replace_documents

# Chunk size and overlap, near-duplicate distance, tree depth.
TARGET, OVERLAP = 384, 0.15
MAX_DISTANCE = 3
RAPTOR_LEVELS = 2
SECTION = f"struct<heading:string,level:int,blocks:array<{BLOCK}>>"


# --- hash diff ----------------------------------------------------------------------------------------------------


def changed(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents that the registry(doc_id, content_hash, status) doesn't hold as ingested with the same hash."""
    done = registry.where("status = 'ingested'").select("doc_id", "content_hash")
    return documents.join(done, ["doc_id", "content_hash"], "left_anti")


# --- normalising --------------------------------------------------------------------------------------------------


def sections(documents: DataFrame) -> DataFrame:
    """doc_id, section (from 0), heading, level, blocks: a heading opens a section, text before the first is in section ''."""
    rows = documents.select("doc_id", F.posexplode("blocks").alias("pos", "b"))
    is_heading = (F.col("b.kind") == "text") & (F.col("b.heading_level") > 0)
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("is_heading", is_heading).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(order))
    text = F.when(F.col("b.kind") == "text", clean_text(F.col("b.text"))).otherwise(F.col("b.text"))
    rows = rows.withColumn("b", F.col("b").withField("text", text)).where("is_heading or b.kind <> 'text' or b.text <> ''")
    heading = F.max(F.when(F.col("is_heading"), F.struct(F.col("b.text").alias("heading"), F.col("b.heading_level").alias("level"))))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "b")))), lambda x: x["b"])
    out = rows.groupBy("doc_id", "section").agg(heading.alias("h"), body.alias("blocks"))
    return out.select("doc_id", "section", F.coalesce("h.heading", F.lit("")).alias("heading"), F.coalesce("h.level", F.lit(0)).alias("level"), "blocks")


def section_text():
    """A section's blocks as text: images by their caption, tables as Markdown, joined by blank lines."""
    one = lambda b: F.when(b["kind"] == "image", F.concat(F.lit("!["), b["text"], F.lit("]("), b["src"], F.lit(")"))).when((b["kind"] == "table") & (F.size(b["rows"]) > 0), table_markdown(b["headers"], b["rows"])).otherwise(b["text"])
    return F.array_join(F.transform("blocks", one), "\n\n")


# --- near-duplicates ----------------------------------------------------------------------------------------------


def near_pairs(prints: DataFrame, most: int = MAX_DISTANCE) -> DataFrame:
    """a < b with Hamming distance <= most over fingerprints(doc_id, fp): at that distance they share a key of block_keys.

    Equal fingerprints are one representative first, so copies make no pairs among themselves.
    """
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    keyed = reps.select("doc_id", "fp", F.explode(block_keys(F.col("fp"), most)).alias("k")).select("doc_id", "fp", "k.combination", "k.bits")
    left, right = keyed.alias("l"), merged(keyed).alias("r")
    met = left.join(right, (F.col("l.combination") == F.col("r.combination")) & (F.col("l.bits") == F.col("r.bits")) & (F.col("l.doc_id") < F.col("r.doc_id")))
    distance = hamming(F.col("l.fp"), F.col("r.fp"))
    return met.where(distance <= most).select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b"), distance.cast("int").alias("distance")).distinct()


def greedy_duplicates(prints: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], most: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, duplicate_of (null if kept): each document against the earlier kept ones, in doc_id order.

    Fix point instead of a loop over documents: a document is kept once no earlier neighbour is kept or undecided, and
    dropped once an earlier one is kept; it ends after as many rounds as the longest chain has links.
    """
    reps = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    pairs = checkpoint(near_pairs(prints, most).select("a", "b"))
    state = checkpoint(reps.select(F.col("rep").alias("id"), F.lit(0).alias("s"), F.lit(None).cast("long").alias("of")))
    while True:
        seen = pairs.join(merged(state.select(F.col("id").alias("a"), F.col("s").alias("sa"))), "a").groupBy("b").agg(F.min(F.when(F.col("sa") == 1, F.col("a"))).alias("kept"), F.max((F.col("sa") == 0).cast("int")).alias("open"))
        nxt = state.join(merged(seen.withColumnRenamed("b", "id")), "id", "left")
        s = F.when(F.col("s") != 0, F.col("s")).when(F.coalesce("open", F.lit(0)) == 1, 0).when(F.col("kept").isNotNull(), 2).otherwise(1)
        state = checkpoint(nxt.select("id", s.alias("s"), F.when(s == 2, F.coalesce("of", "kept")).alias("of")))
        if state.where("s = 0").limit(1).count() == 0:
            break
    out = prints.join(merged(reps), "fp").join(merged(state), F.col("rep") == F.col("id"))
    return out.select("doc_id", F.when(F.col("s") == 2, F.col("of")).when(F.col("doc_id") != F.col("rep"), F.col("rep")).alias("duplicate_of"))


def resolve_duplicates(documents: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return greedy_duplicates(checkpoint(simhash(documents)), checkpoint)


def fingerprint_rows(prints: DataFrame, most: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fp, seq, combination, bits of kept documents(doc_id, fp, seq): what later runs meet, a row a block key."""
    return prints.select("doc_id", "fp", "seq", F.inline(block_keys(F.col("fp"), most)))


def known_duplicates(prints: DataFrame, known: DataFrame | None, most: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, duplicate_of of the prints(doc_id, fp) near a fingerprint of an earlier run, the first such one's document.

    known is a table of fingerprint_rows(); a document's own earlier fingerprint doesn't count. Equal new fingerprints are
    one first, and they meet only the stored rows of their block keys.
    """
    if known is None:
        return prints.select("doc_id", F.col("doc_id").alias("duplicate_of")).where("false")
    asked = prints.select(F.col("fp").alias("new_fp")).distinct().select("new_fp", F.inline(block_keys(F.col("new_fp"), most)))
    others = known.join(merged(prints.select("doc_id")), "doc_id", "left_anti")
    met = others.join(merged(asked), ["combination", "bits"]).where(hamming(F.col("fp"), F.col("new_fp")) <= most)
    first = met.groupBy("new_fp").agg(F.min_by("doc_id", F.struct("seq", "doc_id")).alias("duplicate_of"))
    return prints.join(merged(first), F.col("fp") == F.col("new_fp")).select("doc_id", "duplicate_of")


# --- sections by their content ------------------------------------------------------------------------------------


def section_hashes(parts: DataFrame) -> DataFrame:
    """doc_id, section, heading, block_hash (of heading and blocks) of sections()."""
    return parts.select("doc_id", "section", "heading", content_hash(F.col("heading"), F.col("blocks")).alias("block_hash"))


def section_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, same, recomputed, gone: distinct contents of a document's sections that both versions, the new or the old one alone has."""
    rows = new.select("doc_id", "block_hash", F.lit(1).alias("n"), F.lit(0).alias("o")).unionByName(old.select("doc_id", "block_hash", F.lit(0).alias("n"), F.lit(1).alias("o")))
    held = rows.groupBy("doc_id", "block_hash").agg(F.max("n").alias("n"), F.max("o").alias("o"))
    count = lambda n, o: F.count_if((F.col("n") == n) & (F.col("o") == o))
    return held.groupBy("doc_id").agg(count(1, 1).alias("same"), count(1, 0).alias("recomputed"), count(0, 1).alias("gone"))


def section_summaries(parts: DataFrame, cache: DataFrame | None = None, role: str = "summarise") -> tuple[DataFrame, DataFrame]:
    """(doc_id, section_summaries by heading; the cache(block_hash, summary)): a role's call for each content that the cache lacks."""
    from .models import map_model

    rows = section_hashes(parts).join(parts.select("doc_id", "section", section_text().alias("body")), ["doc_id", "section"])
    compute = lambda need: map_model(need.select("block_hash", "body"), "body", "summary", role).where("summary_error is null").select("block_hash", "summary")
    made, full = cached_map(rows, "block_hash", cache, compute)
    first = made.groupBy("doc_id", "heading").agg(F.min_by("summary", "section").alias("summary"))
    return first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("heading", "summary"))).alias("section_summaries")), full


def with_summaries(documents: DataFrame, enrichment: DataFrame | None, summaries: DataFrame) -> DataFrame:
    """An enrichment whose section summaries are these; without one, nothing else is known of the documents."""
    none = F.create_map().cast("map<string,string>")
    if enrichment is None:
        enrichment = documents.select("doc_id", F.lit("").alias("doc_summary"), none.alias("table_descriptions"))
    out = enrichment.drop("section_summaries").join(summaries, "doc_id", "left")
    return out.withColumn("section_summaries", F.coalesce("section_summaries", none))


# --- chunking -----------------------------------------------------------------------------------------------------

_PARAGRAPH, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")


def tokens_of(text: str) -> int:
    return int(len(text.split()) * 1.3) + 1


def split_units(text: str, target: int) -> list[tuple[str, int]]:
    """Paragraphs, those above the target as sentences, with their token counts."""
    out = []
    for p in filter(None, (x.strip() for x in _PARAGRAPH.split(text))):
        parts = [p] if tokens_of(p) <= target else [s.strip() for s in _SENTENCE.split(p)]
        out += [(s, tokens_of(s)) for s in parts if s]
    return out


def greedy_pack(text: str, target: int = TARGET, overlap: float = OVERLAP) -> list[str]:
    """Units in order, a new chunk when the next one doesn't fit; it starts with the last units that fit the overlap."""
    done, window, size = [], [], 0
    for unit in split_units(text, target):
        if window and size + unit[1] > target:
            done.append(window)
            keep, room = len(window), overlap * target
            while keep and window[keep - 1][1] <= room:
                keep -= 1
                room -= window[keep][1]
            window = window[keep:]
            size = sum(n for _, n in window)
        window = [*window, unit]
        size += unit[1]
    return [" ".join(t for t, _ in w) for w in [*done, window] if w]


def chunk_texts(rows: DataFrame, target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, position, text, token_count of rows(doc_id, text): a fold over units in an Arrow batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            out = [(d, k, c, tokens_of(c)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, c in enumerate(greedy_pack(t or "", target, overlap))]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())], names=["doc_id", "position", "text", "token_count"])

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, position int, text string, token_count int")


#: What a chunk inherits from its document, with the value where nothing is known.
METADATA = {
    "uri": "string", "doc_type": "string", "audience": "array<string>", "topics": "array<string>", "entities": "array<string>", "authority": "string",
    "freshness_date": "string", "access_tags": "array<string>", "keywords": "array<string>",
}
UNKNOWN = {"doc_type": "other", "authority": "draft"}


def metadata(documents: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """doc_id, title and METADATA of each document: the enrichment's values, access tags by default the document's own."""
    rows = documents
    if enrichment is not None:
        known = [c for c in METADATA if c in enrichment.columns]
        rows = documents.drop(*known).join(enrichment.select("doc_id", *known), "doc_id", "left")
    for name, kind in METADATA.items():
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit(UNKNOWN.get(name)).cast(kind)
        rows = rows.withColumn(name, F.coalesce(F.col(name).cast(kind), empty) if name in rows.columns else empty)
    if "acl_tags" in rows.columns:
        rows = default_acl(rows)
    return rows.select("doc_id", "title", *METADATA)


CHUNK = "chunk_id string, doc_id string, position int, chunk_type string, section string, text string, contextual_prefix string, table_markdown string, asset_uri string, token_count int, content_hash string"


def chunk_documents(sectioned: DataFrame, documents: DataFrame, enrichment: DataFrame | None = None, caption=None) -> DataFrame:
    """Chunks of sectioned documents: per section images, then tables, then prose; positions run through the document.

    enrichment(doc_id, doc_summary, section_summaries MAP, table_descriptions MAP) gives prefixes and table texts by
    heading; caption(src, alt) may name images, else their alternative text or address stands. Each chunk carries its
    document's METADATA, access tags included, so that filters act on chunks.
    """
    joined = sectioned.join(documents.select("doc_id", "title"), "doc_id")
    if enrichment is not None:
        joined = joined.join(enrichment.select("doc_id", "doc_summary", "section_summaries", "table_descriptions"), "doc_id", "left")
    else:
        joined = joined.withColumns({"doc_summary": F.lit(""), "section_summaries": F.create_map().cast("map<string,string>"), "table_descriptions": F.create_map().cast("map<string,string>")})
    summary = F.coalesce(F.try_element_at("section_summaries", F.col("heading")), F.col("doc_summary"), F.lit(""))
    described = F.coalesce(F.nullif(F.try_element_at("table_descriptions", F.col("heading")), F.lit("")), F.lit(""))
    prefix = F.concat(F.lit("Document: "), F.col("title"), F.when(F.col("heading") != "", F.concat(F.lit(" > Section: "), F.col("heading"))).otherwise(""), F.lit(". "), summary)
    rows = joined.withColumn("prefix", F.trim(prefix))
    kinds = lambda k: F.filter("blocks", lambda b: b["kind"] == k)
    name = caption or (lambda src, alt: F.coalesce(F.nullif(alt, F.lit("")), F.concat(F.lit("Image asset at "), src)))
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    whole = section_text()
    base = ["doc_id", "section", "heading", "prefix"]
    images = rows.select(*base, F.lit(0).alias("g"), F.posexplode(kinds("image")).alias("n", "b")).select(*base, "g", "n", F.lit("image").alias("chunk_type"), name(F.col("b.src"), F.col("b.text")).alias("text"), null.alias("table_markdown"), F.col("b.src").alias("asset_uri"), none.alias("table_headers"), F.col("b.text").alias("alt"))
    tables = rows.select(*base, whole.alias("whole"), described.alias("described"), F.lit(1).alias("g"), F.posexplode(kinds("table")).alias("n", "b"))
    tables = tables.select(*base, "g", "n", F.lit("table").alias("chunk_type"), F.coalesce(F.nullif("described", F.lit("")), "whole").alias("text"), table_markdown(F.col("b.headers"), F.col("b.rows")).alias("table_markdown"), null.alias("asset_uri"), F.col("b.headers").alias("table_headers"), null.alias("alt"))
    prose = rows.select(F.struct(*base).alias("key"), F.array_join(F.transform(kinds("text"), lambda b: b["text"]), "\n\n").alias("text")).where("text <> ''").withColumnRenamed("key", "doc_id")
    prose = chunk_texts(prose.select(F.to_json("doc_id").alias("doc_id"), "text"))
    prose = prose.withColumn("k", F.from_json("doc_id", rows.select(*base).schema.simpleString())).select(*(F.col(f"k.{c}").alias(c) for c in base), F.lit(2).alias("g"), F.col("position").alias("n"), F.lit("text").alias("chunk_type"), "text", null.alias("table_markdown"), null.alias("asset_uri"), none.alias("table_headers"), null.alias("alt"))
    every = images.unionByName(tables).unionByName(prose)
    every = every.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "g", "n")) - 1)
    digest = F.sha2(F.concat_ws("\x1f", "text", F.coalesce("table_markdown", F.lit(""))), 256)
    out = every.withColumn("content_hash", digest).withColumn("chunk_id", F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("position").cast("string"), "text"), 256))
    out = out.select("chunk_id", "doc_id", "position", "chunk_type", F.col("heading").alias("section"), "text", F.col("prefix").alias("contextual_prefix"), "table_markdown", "table_headers", "asset_uri", "alt", count_tokens(F.col("text")).alias("token_count"), "content_hash")
    return out.join(metadata(documents, enrichment), "doc_id")


#: Fields of a chunk's payload beside its inherited metadata.
PAYLOAD = ("doc_id", "text", "table_markdown", "chunk_type", "contextual_prefix", "position", "content_hash", "embedding_version")


def payload(chunks: DataFrame):
    """A chunk's payload as a struct: what filters, rerank and citations need, the metadata among it."""
    return F.struct(*(c for c in (*PAYLOAD, "title", "section", *METADATA, "table_headers", "asset_uri", "alt") if c in chunks.columns))


def embedding_text():
    return F.trim(F.concat_ws("\n", F.nullif("contextual_prefix", F.lit("")), "text"))


# --- enrichment and caches of model results -------------------------------------------------------------------------


def cached_map(rows: DataFrame, key: str, cache: DataFrame | None, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """rows joined with results by key: only keys that the cache(key, ...) lacks are computed, each once. Returns (rows, new cache).

    Computed results are written, as both returned tables read them and a model isn't to be asked twice.
    """
    needed = rows.dropDuplicates([key])
    missing = needed if cache is None else needed.join(cache.select(key), key, "left_anti")
    new = checkpoint(compute(missing))
    full = new if cache is None else cache.unionByName(new)
    return rows.join(full, key), full


def default_acl(rows: DataFrame) -> DataFrame:
    """Suggested access tags, the document's own where there are none."""
    return rows.withColumn("access_tags", F.when(F.size(F.coalesce("access_tags", F.array().cast("array<string>"))) == 0, F.col("acl_tags")).otherwise(F.col("access_tags")))


ENRICHED = (
    "doc_summary string, section_summaries array<struct<heading:string,summary:string>>, table_descriptions array<struct<section_heading:string,description:string>>, "
    "custom_metadata struct<topics:array<string>,entities:array<string>,doc_type:string,audience:array<string>,freshness_date:string,authority:string,access_tags:array<string>>, keywords array<string>"
)


def enriched(parts: DataFrame, documents: DataFrame, cache: DataFrame | None = None, role: str = "enrich") -> tuple[DataFrame, DataFrame]:
    """(doc_id, error, doc_summary, maps of summaries and table descriptions, metadata), and the cache by content hash.

    Each different content is rendered and sent to the role once; an answer that fails or isn't such a record is an error of
    its documents alone.
    """
    from .models import map_model

    text = parts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "heading", "level", section_text().alias("text")))), lambda x: F.struct(x["heading"].alias("heading"), x["level"].alias("level"), x["text"].alias("text"))).alias("sections"))
    rendered = documents.select("doc_id", "title", "content_hash").join(text, "doc_id").select("doc_id", "content_hash", render_document(F.col("title"), F.col("sections")).alias("content"))
    compute = lambda rows: map_model(rows.select("content_hash", "content"), "content", "answer", role).select("content_hash", "answer", F.col("answer_error").alias("error"))
    asked, full = cached_map(rendered, "content_hash", cache, compute)
    record = F.from_json("answer", ENRICHED)
    rows = asked.withColumn("r", record).withColumn("error", F.coalesce("error", F.when(F.col("r").isNull() | F.col("r.doc_summary").isNull(), F.lit("the answer isn't a record"))))
    first = lambda a, key, value: F.map_from_entries(F.filter(F.transform(F.coalesce(a, F.array()), lambda x: F.struct(x[key].alias("key"), x[value].alias("value"))), lambda x, i: ~F.exists(F.slice(F.coalesce(a, F.array()), 1, i), lambda y: y[key] == x["key"])))
    meta = [F.col(f"r.custom_metadata.{c}").alias(c) for c in METADATA if c not in ("uri", "keywords")]
    out = rows.select("doc_id", "error", "r.doc_summary", first(F.col("r.section_summaries"), "heading", "summary").alias("section_summaries"), first(F.col("r.table_descriptions"), "section_heading", "description").alias("table_descriptions"), *meta, F.col("r.keywords").alias("keywords"))
    return out, full.where("error is null") if "error" in full.columns else full


def embedded(chunks: DataFrame, cache: DataFrame | None = None, version: str = "hashed@1", hashed=md5_hash, backend=None) -> tuple[DataFrame, DataFrame]:
    """(chunks with dense, sparse and embedding_version; the cache by text): prefix and text are embedded, each text once a version."""
    keyed = chunks.withColumn("embed_key", F.sha2(F.concat_ws("\x1f", F.lit(version), embedding_text()), 256)).withColumn("embedded_text", embedding_text())
    compute = lambda rows: embed(rows.select("embed_key", "embedded_text"), "embedded_text", hashed=hashed, backend=backend).drop("embedded_text")
    rows, full = cached_map(keyed, "embed_key", cache, compute)
    return rows.drop("embed_key", "embedded_text").withColumn("embedding_version", F.lit(version)), full


def index_documents(chunks: DataFrame, touched: DataFrame, store, alias: str = "chunks", cache: DataFrame | None = None, as_of=None, **options) -> dict[str, DataFrame]:
    """Embeds chunks and writes the next versions of four collections: the chunks, where touched documents' old ones go and the new ones
    come; document `features`, usage kept; entity `mentions`; and the `edges` between entities.

    Returns them, and the embedding cache.
    """
    from .feedback import document_features, merge_features
    from .graph import edges, mentions

    rows, full = embedded(chunks, cache, **options)
    held = lambda name: store.read(name) if store.target(name) else None
    old = held(alias)
    store.reindex(alias, lambda: replace_documents(old, rows, touched))
    known = chunks.groupBy("doc_id").agg(*(F.first(c).alias(c) for c in ("authority", "freshness_date", "doc_type")))
    features = document_features(known, F.current_date() if as_of is None else as_of)
    usage = held("features")
    if usage is None:
        features = features.withColumns({"popularity": F.lit(0.0), "feedback_score": F.lit(0.0)})
    store.reindex("features", lambda: features if usage is None else merge_features(usage, features))
    named = mentions(chunks.select("chunk_id", "entities")).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    before = held("mentions")
    store.reindex("mentions", lambda: replace_documents(before, named, touched))
    store.reindex("edges", lambda: edges(store.read("mentions").select("entity", "chunk_id")))
    return {"chunks": store.read(alias), "features": store.read("features"), "mentions": store.read("mentions"), "edges": store.read("edges"), "cache": full}


# --- RAPTOR -------------------------------------------------------------------------------------------------------


def lead_sentences(text, n: int = 1):
    """The stub summary: the first sentences."""
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def raptor_tree(leaves: DataFrame, summarise=lead_sentences, levels: int = RAPTOR_LEVELS) -> DataFrame:
    """leaves(chunk_id, doc_id, section, position, text) with summary rows: level 1 a section, then roll-ups a document.

    A document with more than one summary rolls up until one is left or the levels end. Summaries' texts are joined in
    order; positions are 10000 x level + number.
    """
    order = Window.partitionBy("doc_id").orderBy("first")
    grouped = leaves.groupBy("doc_id", "section").agg(F.min("position").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("joined"))
    out = leaves.select(F.col("chunk_id").cast("string").alias("chunk_id"), "doc_id", "section", F.col("position").cast("long").alias("position"), "text", F.lit(0).alias("level"))
    current = grouped.withColumn("n", F.row_number().over(order) - 1).select("doc_id", "section", "n", summarise(F.col("joined")).alias("text"))
    for level in range(1, levels + 1):
        made = current.withColumn("level", F.lit(level)).withColumn("position", (10_000 * level + F.col("n")).cast("long"))
        made = made.withColumn("chunk_id", F.concat_ws("-", F.lit("raptor"), F.col("doc_id").cast("string"), F.lit(str(level)), F.col("n").cast("string")))
        out = out.unionByName(made.select("chunk_id", "doc_id", "section", "position", "text", "level"))
        up = current.groupBy("doc_id").agg(F.count("*").alias("c"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("joined")).where("c > 1")
        current = up.select("doc_id", F.lit("").alias("section"), F.lit(0).alias("n"), summarise(F.col("joined")).alias("text"))
    return out
