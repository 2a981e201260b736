"""Queries over ingestion, stores, tools and parts of answers, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answering as a
from ..operators import feedback as fb
from ..operators import graph as kg
from ..operators import ingest as i
from ..operators import retrieval as r
from ..operators.models import map_model
from ..session import shared_dir
from ..sources import files, tables
from . import queries_retrieval as qr
from . import strategies as s
from .base import DENSE, QUESTIONS, TERMS, chunks, count_tokens, query, questions, reranked, sentences, table

# --- ingestion ----------------------------------------------------------------------------------------------------------------

_CUSTOMER_DOCS = """
c AS (SELECT 'customer-' || c_custkey AS doc_id, c_custkey AS k, c_name AS name, c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey),
o AS (SELECT o_custkey AS k, '| Order | Status |\n| --- | --- |\n' || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', '\n' ORDER BY o_orderkey) AS md FROM orders GROUP BY 1),
h AS (SELECT c.*, md, CASE WHEN segment = 'BUILDING' THEN 'Builds.' ELSE '' END AS summary, CASE WHEN segment = 'MACHINERY' THEN 'Orders of ' || name || '.' END AS orders_summary, CASE WHEN segment = 'MACHINERY' THEN 'Listed orders.' END AS described FROM c LEFT JOIN o USING (k)),
x AS (
    SELECT doc_id, 0 AS position, 'image' AS chunk_type, name AS section, CASE WHEN k % 2 = 0 THEN 'portrait' ELSE 'Image asset at img/' || k || '.png' END AS text, NULL AS table_markdown, 'img/' || k || '.png' AS asset_uri, trim('Document: ' || name || ' > Section: ' || name || '. ' || summary) AS prefix FROM h
    UNION ALL SELECT doc_id, 1, 'text', name, 'In ' || nation || '. Segment: ' || segment || '.', NULL, NULL, trim('Document: ' || name || ' > Section: ' || name || '. ' || summary) FROM h
    UNION ALL SELECT doc_id, 2, 'table', 'Orders', coalesce(described, md), md, NULL, trim('Document: ' || name || ' > Section: Orders. ' || coalesce(orders_summary, summary)) FROM h WHERE md IS NOT NULL
)"""


def _customer_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as source documents (headings, prose, an image, their orders as a table), and an enrichment of them."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    rows = c.join(o, "c_custkey", "left").withColumn("doc_id", F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")))
    none, empty = F.array().cast("array<string>"), F.array().cast("array<array<string>>")

    def block(kind, body, level=0, headers=none, cells=empty, src=""):
        src = F.lit(src) if isinstance(src, str) else src
        return F.struct(F.lit(kind).alias("kind"), body.alias("text"), F.lit(level).alias("heading_level"), headers.alias("headers"), cells.alias("rows"), src.alias("src"))

    cells = F.transform("o", lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    image = F.concat(F.lit("img/"), F.col("c_custkey").cast("string"), F.lit(".png"))
    parts = [
        block("text", F.col("c_name"), 1), block("text", F.concat(F.lit("In "), "n_name", F.lit("."))), block("image", F.when(F.col("c_custkey") % 2 == 0, "portrait").otherwise(""), src=image),
        block("text", F.concat(F.lit("Segment:  "), "c_mktsegment", F.lit("."))), block("text", F.lit("Orders"), 2),
    ]
    orders = F.when(F.col("o").isNotNull(), F.array(block("table", F.lit(""), headers=F.array(F.lit("Order"), F.lit("Status")), cells=cells)))
    blocks = F.concat(F.array(*parts).cast(f"array<{files.BLOCK}>"), F.coalesce(orders.cast(f"array<{files.BLOCK}>"), F.array().cast(f"array<{files.BLOCK}>")))
    docs = files.as_source(rows.select("doc_id", blocks.alias("blocks"), "c_name"), "table", title=F.col("c_name"))
    machine = F.col("c_mktsegment") == "MACHINERY"
    some = lambda value: F.when(machine, F.map_from_arrays(F.array(F.lit("Orders")), F.array(value))).otherwise(F.create_map().cast("map<string,string>"))
    enrichment = rows.select("doc_id", F.when(F.col("c_mktsegment") == "BUILDING", "Builds.").otherwise("").alias("doc_summary"), some(F.concat(F.lit("Orders of "), "c_name", F.lit("."))).alias("section_summaries"), some(F.lit("Listed orders.")).alias("table_descriptions"))
    return docs, enrichment


@query(f"WITH {_CUSTOMER_DOCS} SELECT doc_id, CAST(position AS INTEGER) AS position, chunk_type, section, text, table_markdown, asset_uri, prefix, prefix || '\n' || text AS embedded FROM x")
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders through sections, enrichment and chunking: images, tables and prose with prefixes and positions."""
    docs, enrichment = _customer_sources(spark, sf_dir)
    made = i.chunk_documents(i.sections(docs), docs, enrichment)
    return made.select("doc_id", "position", "chunk_type", "section", "text", "table_markdown", "asset_uri", F.col("contextual_prefix").alias("prefix"), i.embedding_text().alias("embedded"))


@query(f"""WITH {_CUSTOMER_DOCS}, s AS (SELECT doc_id, name, 'In ' || nation || '.\n\n![' || CASE WHEN k % 2 = 0 THEN 'portrait' ELSE '' END || '](img/' || k || '.png)\n\nSegment: ' || segment || '.' AS body, md FROM h)
SELECT doc_id, md5(substr(name || '\n# ' || name || '\n' || body || '\n## Orders' || CASE WHEN md IS NULL THEN '' ELSE '\n' || md END, 1, 12000)) AS digest FROM s""")
def rendered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a model sees them: title and sections as Markdown."""
    docs, _ = _customer_sources(spark, sf_dir)
    parts = i.sections(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "heading", "level", i.section_text().alias("text")))), lambda x: F.struct(x["heading"].alias("heading"), x["level"].alias("level"), x["text"].alias("text"))).alias("sections"))
    return docs.select("doc_id", "title").join(parts, "doc_id").select("doc_id", F.md5(text.render_document(F.col("title"), F.col("sections"))).alias("digest"))


@query("""WITH s AS (SELECT s_suppkey, s_name, n_name, s_acctbal < 0 AS owes FROM supplier JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT s_suppkey, 0 AS pos, 'text' AS kind, s_name AS text, 1 AS level, NULL AS cell FROM s UNION ALL SELECT s_suppkey, 1, 'text', 'From ' || n_name, 0, NULL FROM s
    UNION ALL SELECT s_suppkey, 2, 'text', 'Balance', 3, NULL FROM s UNION ALL SELECT s_suppkey, 3, 'table', '', 0, CASE WHEN owes THEN 'owes' ELSE 'owns' END FROM s)
SELECT 's' || s_suppkey AS doc_id, CAST(pos AS INTEGER) AS pos, kind, text, CAST(level AS INTEGER) AS level, cell, CASE WHEN s_suppkey % 3 = 0 THEN 'restricted' WHEN s_suppkey % 3 = 1 THEN 'acme.org:all,user:a@b' ELSE 'user:a@b' END AS tags FROM b""")
def structured_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents of a document service (JSON with styles, runs, a table and permissions), parsed to blocks and access tags."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    run = lambda *parts: F.array(*(F.struct(F.struct(p.alias("content")).alias("textRun")) for p in parts))
    null = F.lit(None).cast("struct<tableRows:array<struct<tableCells:array<struct<content:array<struct<paragraph:struct<elements:array<struct<textRun:struct<content:string>>>>>>>>>>>")
    words = lambda style, *parts: F.struct(F.struct(F.struct(F.lit(style).alias("namedStyleType")).alias("paragraphStyle"), run(*parts).alias("elements")).alias("paragraph"), null.alias("table"))
    cell = lambda value: F.struct(F.array(F.struct(F.struct(run(value).alias("elements")).alias("paragraph"))).alias("content"))
    line = lambda value: F.struct(F.array(cell(value)).alias("tableCells"))
    grid = F.struct(F.lit(None).cast("struct<paragraphStyle:struct<namedStyleType:string>,elements:array<struct<textRun:struct<content:string>>>>").alias("paragraph"), F.struct(F.array(line(F.lit("State")), line(F.when(F.col("s_acctbal") < 0, "owes\n").otherwise("owns\n"))).alias("tableRows")).alias("table"))
    content = F.array(words("TITLE", F.col("s_name")), words("NORMAL_TEXT", F.lit("From "), F.col("n_name"), F.lit("\n")), words("NORMAL_TEXT", F.lit("\n")), words("HEADING_3", F.lit("Balance")), grid)
    user, domain = (F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in (("user", "a@b"), ("domain", "acme.org")))
    left = F.col("s_suppkey") % 3
    permissions = F.when(left == 0, F.array().cast("array<struct<type:string,value:string>>")).when(left == 1, F.array(domain, user)).otherwise(F.array(user))
    docs = files.structured_documents(rows.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc_id"), F.to_json(F.struct(F.col("s_name").alias("title"), F.struct(content.alias("content")).alias("body"))).alias("json"), permissions.alias("permissions")))
    return docs.select("doc_id", F.posexplode("blocks").alias("pos", "b"), F.array_join("acl_tags", ",").alias("tags")).select("doc_id", "pos", "b.kind", "b.text", F.col("b.heading_level").alias("level"), F.get(F.get("b.rows", F.lit(0)), F.lit(0)).alias("cell"), "tags")


@query(f"""
WITH t AS (SELECT conv_id, role, array_to_string(list(text ORDER BY turn), ' ') AS j, min(turn) AS f FROM conversations GROUP BY ALL),
a AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS n, coalesce({sentences('j')}[1], '') AS text FROM t),
b AS (SELECT conv_id, coalesce({sentences('j')}[1], '') AS text FROM (SELECT conv_id, array_to_string(list(text ORDER BY n), ' ') AS j FROM a GROUP BY conv_id HAVING count(*) > 1))
SELECT 'raptor-' || conv_id || '-1-' || n AS chunk_id, conv_id AS doc_id, role AS section, 10000 + n AS position, text, 1 AS level FROM a UNION ALL SELECT 'raptor-' || conv_id || '-2-0', conv_id, '', 20000, text, 2 FROM b""")
def raptor_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary rows of conversations' trees: names, positions and texts."""
    turns = table(spark, sf_dir, "conversations")
    leaves = turns.select(F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("role").alias("section"), F.col("turn").cast("int").alias("position"), "text")
    return i.raptor_tree(leaves).where("level > 0")


# --- stores and features --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def collection_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, appended part by part to a collection that had another version before, read through its alias."""
    store = tables.Collections(spark, f"{shared_dir(spark)}/sievework-store-{uuid.uuid4().hex[:12]}")
    rows = table(spark, sf_dir, "orders")
    store.reindex("orders", lambda: rows.where("o_orderstatus = 'O'"))
    store.reindex("orders", lambda: rows.where("o_orderstatus = 'F'"))
    store.append("orders", rows.where("o_orderstatus not in ('O', 'F')"))
    store.append("orders", rows.where("o_orderstatus = 'O'").withColumn("late", F.lit(True)))
    return store.read("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT event_id AS key FROM (SELECT event_id, epoch_us(ts) / 1000000 AS born, CASE event_type WHEN 'view' THEN 604800 WHEN 'click' THEN 0 WHEN 'purchase' THEN NULL ELSE 2592000 END AS ttl, max(epoch_us(ts)) OVER () / 1000000 AS now FROM events)
WHERE coalesce(ttl, 0) = 0 OR born + ttl > now""")
def cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries with a time to live by their type: those alive at the time of the last one."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ttl = F.when(F.col("event_type") == "view", 604_800).when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", F.lit(None)).otherwise(2_592_000)
    now = e.agg(F.max(at)).first()[0]
    return tables.live(e.select(F.col("event_id").alias("key"), at.alias("stored_at"), ttl.cast("int").alias("ttl_s")), F.lit(now)).select("key")


@query(f"""WITH {qr._FEATURES}, o AS (SELECT doc_id, authority, popularity, feedback_score FROM ft), n AS (SELECT doc_id, 'official' AS authority FROM documents WHERE lang = 'de')
SELECT doc_id, coalesce(n.authority, o.authority) AS authority, coalesce(popularity, 0.0) AS popularity, CASE WHEN o.doc_id IS NULL THEN 0.0 ELSE feedback_score END AS feedback_score FROM o FULL JOIN n USING (doc_id)""")
def feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All German documents come again as official ones: static features are new, usage stays."""
    old = qr.features(spark, sf_dir).select("doc_id", "authority", "popularity", "feedback_score")
    new = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.lit("official").alias("authority"))
    return fb.merge_features(old, new)


@query("SELECT p_partkey, round((p_size + 3) * p_retailprice / 7 - p_partkey % 5, 4) AS value FROM part")
def calculator_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent's calculator as a role, over an expression a part."""
    asked = F.format_string("(%s + 3) * %s / 7 - %s %% 5", F.col("p_size").cast("string"), F.col("p_retailprice").cast("decimal(18,4)").cast("string"), F.col("p_partkey").cast("string"))
    said = map_model(table(spark, sf_dir, "part").select("p_partkey", asked.alias("asked")), "asked", "said", "calculator")
    return said.select("p_partkey", F.round(F.element_at(F.split("said", " = "), -1).cast("double"), 4).alias("value"))


# --- retrieval ------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {QUESTIONS}, {TERMS}, {DENSE}, u AS (SELECT query_id, chunk_id, score, rank, 0 AS source FROM st UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM de)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source, rank) AS k FROM u) WHERE k = 1""")
def keep_first_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical results, then those of the dense leg that aren't among them."""
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    shaped = lambda rows: rows.select("query_id", "chunk_id", F.col("chunk_id").alias("doc_id"), F.col("score").alias("rerank"), F.col("score").alias("final"), "rank")
    return s.keep_first([shaped(r.sparse_topk(q, c)), shaped(r.embedded_topk(q, c))]).select("query_id", "chunk_id", F.col("final").alias("score"), "rank")


@query(f"""WITH {QUESTIONS}, {TERMS}, {reranked('st', 'score')}, {qr._BUDGET}, k AS (SELECT *, CASE WHEN (place - 1) % 2 = 0 THEN place - 1 ELSE 2 * count(*) OVER (PARTITION BY query_id) - (place - 1) END AS k FROM cb),
n AS (SELECT query_id, chunk_id, used, row_number() OVER (PARTITION BY query_id ORDER BY k) AS cite FROM k)
SELECT query_id, md5(string_agg('[' || cite || '] (source: ' || lang || ' > ' || source || ', None)' || chr(10) || text, chr(10) || chr(10) ORDER BY cite)) AS digest, string_agg(chunk_id, ',' ORDER BY cite) AS cited, CAST(max(used) AS BIGINT) AS used_tokens
FROM n JOIN documents ON doc_id = chunk_id GROUP BY 1""")
def assembled_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that is put together for every question, and what its numbers stand for."""
    c = chunks(spark, sf_dir).select("chunk_id", "doc_id", "text", F.col("lang").alias("title"), F.col("source").alias("section"))
    placed = a.attention_reorder(qr._budgeted(spark, sf_dir)).join(c, "chunk_id")
    made = a.assemble(placed)
    return made.select("query_id", F.md5("context").alias("digest"), F.array_join(F.transform("citations", lambda x: x["chunk_id"].cast("string")), ",").alias("cited"), "used_tokens")


@query(f"""WITH {qr._PARTS_SQL}, al AS (SELECT p_partkey AS chunk_id FROM part WHERE p_size <= 25)
SELECT query_id, chunk_id, score, matched, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS INTEGER) AS rank FROM gs WHERE chunk_id IN (SELECT chunk_id FROM al) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40""")
def part_graph_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph search where only small parts may be seen: the filter acts before the limit."""
    m, q = qr._parts(spark, sf_dir)
    allowed = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("chunk_id"))
    return kg.graph_search(q, m, qr.checkpoint(kg.edges(m)), allowed=allowed)


@query(f"WITH {qr._PARTS_SQL} SELECT count(DISTINCT entity) AS entities, count(DISTINCT chunk_id) AS chunks FROM me")
def part_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.stats(qr._parts(spark, sf_dir)[0])


_HAS_PII = "(" + " OR ".join(f"regexp_matches({{0}}, '{p.replace(chr(39), chr(39) * 2)}')" for p in a.PII.values()) + ")"
_INTENT = r"""CASE WHEN regexp_matches(lower(trim(text)), '^(hi|hello|hey|thanks|thank you)\b') THEN 'chitchat' WHEN regexp_matches(lower(text), '\b(compare|difference|versus|vs)\b') THEN 'comparison'
    WHEN starts_with(lower(trim(text)), 'how ') THEN 'howto' WHEN len(string_split_regex(trim(text), '\s+')) <= 12 THEN 'factoid' ELSE 'other' END"""


@query(f"""WITH {qr._HYBRID},
i AS (SELECT query_id, CASE WHEN {count_tokens('text')} > 512 THEN 'query_too_long' WHEN {_HAS_PII.replace('{0}', 'text')} THEN 'pii_in_query' END AS reason, {_INTENT} AS intent FROM q),
t AS (SELECT i.*, intent = 'factoid' AND coalesce(best, 0) >= 0.30 AS simple FROM i LEFT JOIN (SELECT query_id, max(final) AS best FROM fo GROUP BY 1) USING (query_id)),
p AS (SELECT t.query_id, chunk_id, simple, text, {count_tokens('text')} AS tokens, row_number() OVER (PARTITION BY t.query_id ORDER BY CASE WHEN final <> 0 THEN final ELSE rerank END DESC, chunk_id) AS place
    FROM fo JOIN t USING (query_id) JOIN documents d ON d.doc_id = chunk_id WHERE rank < CASE WHEN simple THEN 4 ELSE 8 END AND reason IS NULL AND intent <> 'chitchat'),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS used FROM p),
k AS (SELECT * FROM u WHERE place = 1 OR used <= CASE WHEN simple THEN 1500 ELSE 3500 END),
c AS (SELECT query_id, count(*) AS n_cited, CAST(max(used) AS BIGINT) AS used_tokens, max(CASE WHEN place = 1 THEN coalesce({sentences('text')}[1], '') END) AS said FROM k GROUP BY 1),
s AS (SELECT t.query_id, reason, CASE WHEN reason IS NOT NULL OR regexp_matches(coalesce(said, ''), '{a.TOXIC}') THEN 'blocked' WHEN intent = 'chitchat' THEN 'direct' WHEN coalesce(said, '') <> '' THEN 'grounded' ELSE 'abstained' END AS status, n_cited, used_tokens, said FROM t LEFT JOIN c USING (query_id))
SELECT query_id, reason, status, CAST(CASE status WHEN 'grounded' THEN 1 ELSE 0 END AS DOUBLE) AS score, n_cited, used_tokens, CASE WHEN status = 'grounded' THEN CASE WHEN {_HAS_PII.replace('{0}', 'said')} THEN 'redacted' ELSE md5(said) END END AS digest FROM s""")
def online_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole online pipeline for every question: what becomes of it, with the answer's digest (those with personal data are redacted)."""
    from .answer import answer

    out = answer(qr.context(spark, sf_dir))
    said = F.when(F.contains("answer", F.lit("[REDACTED_")), "redacted").otherwise(F.md5("answer"))
    score = F.when(F.col("status") == "grounded", F.col("score")).otherwise(0.0)
    return out.select("query_id", "reason", "status", score.alias("score"), F.size("citations").cast("long").alias("n_cited"), "used_tokens", F.when(F.col("status") == "grounded", said).alias("digest"))
