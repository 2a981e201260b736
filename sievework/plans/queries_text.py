"""Queries over text: tokens, hashes, parsing, shingles, near-duplicates, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import ingest as i
from ..sources import files, tables
from .base import checkpoint, chunks, count_tokens, query, sentences, table, tok


@query(f"SELECT doc_id, CAST(len({tok('text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({tok('text')})) AS INTEGER) AS n_distinct, {count_tokens('text')} AS model_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), text.count_tokens(F.col("text")).alias("model_tokens"))


@query("SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("""
SELECT doc_id, sha256(text) AS content_hash FROM documents
WHERE NOT (lang IN ('en', 'es'))
""")
def registry_incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior run has English and Spanish ingested, French with an older hash, German failed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    stale = F.when(F.col("lang") == "fr", F.reverse("content_hash")).otherwise(F.col("content_hash"))
    registry = docs.select("doc_id", stale.alias("content_hash"), F.when(F.col("lang") == "de", "failed").otherwise("ingested").alias("status"))
    return i.changed(docs, registry).select("doc_id", "content_hash")


@query("""
WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT c_custkey AS key, coalesce(event_type, 'none') AS status, coalesce(value, 0.0) AS value FROM customer LEFT JOIN (SELECT * FROM r WHERE r = 1) ON user_id = c_custkey
UNION ALL SELECT user_id, event_type, value FROM r WHERE r = 1 AND user_id NOT IN (SELECT c_custkey FROM customer)
""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the registry's old rows, events as writes; the last write of a key wins."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("none").alias("status"), F.lit(0.0).alias("value"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("status"), "value", "ts", "event_id")
    return tables.merge(old, new.withColumn("at", F.struct("ts", "event_id")), "key", F.col("at")).select("key", "status", "value")


@query("""
SELECT doc_id, lang AS status FROM documents WHERE source NOT IN (SELECT source FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)
UNION ALL SELECT doc_id, 'new' FROM documents WHERE source IN (SELECT source FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0) AND text LIKE '%.%'
""")
def replace_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a toxic junk document are ingested again; their old chunks go, texts without a full stop don't return."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    touched = docs.join(labels.where("toxic = 1 and quality = 0"), "doc_id").select("source").distinct()
    old = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), F.col("lang").alias("status"))
    new = docs.join(touched, "source", "left_semi").where(F.contains("text", F.lit("."))).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), F.lit("new").alias("status"))
    return tables.replace_documents(old, new, touched.withColumnRenamed("source", "doc_id")).select(F.col("id").alias("doc_id"), "status")


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g')) AS text FROM pages
""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, len(c) AS n_cells, array_to_string(c, '/') AS cells, count(*) AS n
FROM (SELECT doc_id, list_transform(string_split(regexp_replace(trim(line), '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c)) AS c FROM l WHERE line LIKE '%|%') GROUP BY ALL
""")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit("|")))
    cells = lines.select("doc_id", files.split_row_column(F.col("line")).alias("c"))
    return cells.groupBy("doc_id", F.size("c").cast("long").alias("n_cells"), F.array_join("c", "/").alias("cells")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, chr(1))) AS digest, CAST(list_max(list_transform(s, lambda x: length(x))) AS INTEGER) AS longest FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "\x01")).alias("digest"), F.array_max(F.transform(s, lambda x: F.length(x))).alias("longest"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g')) AS text FROM documents
""")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


#: A fold over a document's units: state is the next unit and the first one of the open chunk; s holds sums of tokens before each unit.
_PACK = f"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p FROM documents),
u AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN {count_tokens('x')} <= 384 THEN [x] ELSE {sentences('x')} END)) AS u FROM p),
v AS (SELECT doc_id, unnest(u) AS unit, unnest(range(1, len(u) + 1)) AS i FROM u),
w AS (SELECT doc_id, i, unit, {count_tokens('unit')} AS n FROM v),
d AS (SELECT doc_id, list(s ORDER BY i) AS s FROM (SELECT doc_id, i, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (SELECT * FROM w UNION ALL SELECT doc_id, max(i) + 1, NULL, 0 FROM w GROUP BY doc_id)) GROUP BY doc_id),
r AS (SELECT doc_id, s, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi FROM d
    UNION ALL SELECT doc_id, s, i + 1, CASE WHEN fits THEN a ELSE a2 END, CASE WHEN NOT fits THEN a END, CASE WHEN NOT fits THEN i - 1 END
    FROM (SELECT *, i = a OR s[i + 1] - s[a] <= 384 AS fits, list_filter(range(a, i + 1), lambda j: s[i] - s[j] <= 57.6)[1] AS a2 FROM r WHERE i < len(s))),
e AS (SELECT doc_id, i, 0 AS k, lo, hi FROM r WHERE lo IS NOT NULL UNION ALL SELECT doc_id, i, 1, a, i - 1 FROM r WHERE i = len(s) AND a < i),
t AS (SELECT e.doc_id, e.i, e.k, string_agg(unit, ' ' ORDER BY w.i) AS text FROM e JOIN w ON w.doc_id = e.doc_id AND w.i BETWEEN lo AND hi GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS position, text, {count_tokens('text')} AS token_count FROM t
"""


@query(_PACK)
def chunk_greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.chunk_texts(table(spark, sf_dir, "documents"))


_SHINGLES = f"SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) WHEN len(t) > 0 THEN t ELSE [text] END AS s FROM (SELECT doc_id, text, {tok('text')} AS t FROM documents)"


@query(f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, CAST(len(list_distinct(s)) AS INTEGER) AS n_distinct FROM ({_SHINGLES})")
def shingle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.shingles(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.size(F.array_distinct(s)).alias("n_distinct"))


_VOTES = ", ".join(f"sum((h >> {k}) & 1) AS b{k}" for k in range(hashing.BITS))
_BITS = " + ".join(f"CASE WHEN 2 * b{k} > n THEN {1 << k}::BIGINT ELSE 0 END" for k in range(hashing.BITS))
_SIMHASH = f"""
sh AS ({_SHINGLES}), hs AS (SELECT doc_id, CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) AS h FROM (SELECT doc_id, unnest(s) AS x FROM sh)),
fp AS (SELECT doc_id, {_BITS} AS fp FROM (SELECT doc_id, count(*) AS n, {_VOTES} FROM hs GROUP BY doc_id))
"""


@query(f"WITH {_SIMHASH} SELECT doc_id, fp FROM fp")
def simhash_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.simhash(table(spark, sf_dir, "documents"))


@query(f"""WITH {_SIMHASH}, r AS (SELECT fp, min(doc_id) AS doc_id FROM fp GROUP BY fp)
SELECT x.doc_id AS a, y.doc_id AS b, CAST(bit_count(xor(x.fp, y.fp)) AS INTEGER) AS distance FROM r x JOIN r y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.fp, y.fp)) <= 3""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.near_pairs(checkpoint(hashing.simhash(table(spark, sf_dir, "documents"))))


@query(f"""WITH {_SIMHASH}, s AS (SELECT doc_id, fp, source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') AS early FROM fp JOIN documents USING (doc_id)),
k AS (SELECT fp, min(doc_id) AS doc_id FROM s WHERE early GROUP BY fp)
SELECT s.doc_id, min(k.doc_id) AS duplicate_of FROM s JOIN k ON bit_count(xor(s.fp, k.fp)) <= 3 WHERE NOT early GROUP BY 1""")
def near_dup_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run's documents (ten sources) against the stored fingerprints of a first run (the ten others)."""
    first = F.col("source").isin([f"src{k}" for k in range(10)])
    docs = table(spark, sf_dir, "documents")
    prints = checkpoint(hashing.simhash(docs).join(docs.select("doc_id", first.alias("early")), "doc_id"))
    known = checkpoint(i.fingerprint_rows(prints.where("early").select("doc_id", "fp", F.col("doc_id").alias("seq"))))
    return i.known_duplicates(prints.where("not early").select("doc_id", "fp"), known)


@query("""WITH o AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS x, 1 AS o FROM documents),
n AS (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(text, '[0-9]', '#', 'g'), chr(10))) AS x, 1 AS n FROM documents)
SELECT doc_id, count(*) FILTER (o = 1 AND n = 1) AS same, count(*) FILTER (o IS NULL) AS recomputed, count(*) FILTER (n IS NULL) AS gone FROM o FULL JOIN n USING (doc_id, x) GROUP BY 1""")
def section_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit that masks all digits, lines as sections: how many sections of each document have to be computed anew."""
    docs = table(spark, sf_dir, "documents")

    def parts(body: Column) -> DataFrame:
        block = F.struct(F.lit("text").alias("kind"), F.col("line").alias("text"), F.lit(0).alias("heading_level"), F.array().cast("array<string>").alias("headers"), F.array().cast("array<array<string>>").alias("rows"), F.lit("").alias("src"))
        return docs.select("doc_id", F.posexplode(F.split(body, "\n")).alias("section", "line")).select("doc_id", "section", F.lit("").alias("heading"), F.array(block).alias("blocks"))

    return i.section_diff(i.section_hashes(parts(F.regexp_replace("text", "[0-9]", "#"))), i.section_hashes(parts(F.col("text"))))


@query(f"""WITH RECURSIVE {_SIMHASH}, r AS (SELECT fp, min(doc_id) AS id FROM fp GROUP BY fp),
p AS (SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.id < y.id WHERE bit_count(xor(x.fp, y.fp)) <= 3),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT a AS id FROM p UNION SELECT b FROM p)),
e AS (SELECT b AS id, list(a ORDER BY a) AS earlier FROM p GROUP BY b),
g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT g.n + 1, CASE WHEN len(list_intersect(coalesce(earlier, []), kept)) = 0 THEN list_append(kept, o.id) ELSE kept END FROM g JOIN o ON o.n = g.n + 1 LEFT JOIN e ON e.id = o.id),
k AS (SELECT kept FROM g ORDER BY n DESC LIMIT 1),
f AS (SELECT r.fp, r.id, list_min(list_intersect(earlier, kept)) AS of FROM r CROSS JOIN k LEFT JOIN e ON e.id = r.id)
SELECT doc_id, coalesce(of, CASE WHEN doc_id <> id THEN id END) AS duplicate_of FROM fp JOIN f USING (fp)""")
def near_dup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.resolve_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), checkpoint)


@query("""
SELECT 'customer/' || c_custkey AS doc_id, c_name AS title, c_name || ' in ' || n_name || ', ' || r_name || '. Segment: ' || c_mktsegment || '.' AS text
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def row_template_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    sentence = F.concat("c_name", F.lit(" in "), "n_name", F.lit(", "), "r_name", F.lit(". Segment: "), "c_mktsegment", F.lit("."))
    return files.row_documents(rows, F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")), F.col("c_name"), sentence).drop("content_hash")


@query("""
SELECT doc_id, [lang, source] AS tags FROM documents WHERE list_has_any([lang, source], ['de', 'src3']) AND lang IN ('de', 'en')
""")
def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.access import build_filter

    rows = table(spark, sf_dir, "documents").withColumn("access_tags", F.array("lang", "source"))
    wanted = build_filter({"lang": ["de", "en"]}, ["de", "src3", "secret"], ["de", "src3", "src4"])
    return wanted.apply(rows).select("doc_id", F.col("access_tags").alias("tags"))


@query(f"""
WITH t AS (SELECT conv_id, role, array_to_string(list(text ORDER BY turn), ' ') AS j, min(turn) AS f FROM conversations GROUP BY ALL),
a AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS n, coalesce({sentences('j')}[1], '') AS text FROM t),
b AS (SELECT conv_id, coalesce({sentences('j')}[1], '') AS text FROM (SELECT conv_id, array_to_string(list(text ORDER BY n), ' ') AS j FROM a GROUP BY conv_id HAVING count(*) > 1))
SELECT conv_id AS doc_id, 0 AS level, count(*) AS n, NULL AS text FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 1, count(*), NULL FROM a GROUP BY conv_id UNION ALL SELECT conv_id, 2, 1, text FROM b
""")
def raptor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, roles as sections: rows a level, and the roll-up's text."""
    turns = table(spark, sf_dir, "conversations")
    leaves = turns.select(F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("role").alias("section"), F.col("turn").cast("int").alias("position"), "text")
    tree = i.raptor_tree(leaves)
    return tree.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.max(F.when(F.col("level") == 2, F.col("text"))).alias("text"))


@query()
def ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources through the whole ingestion; chunks that come out."""
    from .answer import ingest

    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), text.strip_html(F.col("html")).alias("text"))
    docs = files.as_source(files.markdown_blocks(rows), "web", title=F.col("doc_id"))
    return ingest(docs, None, checkpoint)[0]


@query("SELECT chunk_id, doc_id, text FROM (SELECT doc_id AS chunk_id, doc_id, text FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return tables.delete_by_doc(chunks(spark, sf_dir), gone)[0].select("chunk_id", "doc_id", "text")


#: Documents as sources of one text block, their language as access tag, the labels' verdict as authority.
_ACCESS_SQL = """
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
t AS (SELECT d.doc_id, trim(regexp_replace(regexp_replace(text, '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS body, lang, quality FROM documents d LEFT JOIN l USING (doc_id))
SELECT doc_id, [lang] AS access_tags, CASE quality WHEN 1 THEN 'official' WHEN 0 THEN 'deprecated' ELSE 'draft' END AS authority, 'other' AS doc_type
FROM t WHERE body <> '' AND lang IN ('de', 'fr') AND coalesce(quality, 1) = 1
"""


@query(_ACCESS_SQL)
def ingest_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunking with metadata, then the filter of a user with two entitlements on the chunks: the documents that user may see."""
    from ..operators.access import build_filter

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    block = F.array(F.struct(F.lit("text").alias("kind"), F.col("text"), F.lit(0).alias("heading_level"), F.array().cast("array<string>").alias("headers"), F.array().cast("array<array<string>>").alias("rows"), F.lit("").alias("src")))
    rows = docs.select("doc_id", block.cast(f"array<{files.BLOCK}>").alias("blocks"), F.array("lang").alias("tags"))
    sources = files.as_source(rows.drop("tags"), "table", title=F.lit("")).drop("acl_tags").join(rows.select("doc_id", F.col("tags").alias("acl_tags")), "doc_id")
    authority = labels.select("doc_id", F.when(F.col("quality") == 1, "official").otherwise("deprecated").alias("authority"), F.lit("").alias("doc_summary"), F.create_map().cast("map<string,string>").alias("section_summaries"), F.create_map().cast("map<string,string>").alias("table_descriptions"))
    chunks = i.chunk_documents(i.sections(sources), sources, authority)
    seen = build_filter({"authority": ["official", "draft"]}, ["de", "fr", "secret"], ["de", "fr", "es"]).apply(chunks)
    return seen.groupBy("doc_id").agg(F.first("access_tags").alias("access_tags"), F.first("authority").alias("authority"), F.first("doc_type").alias("doc_type"))
