"""Operator 5, quality rules with cross-document line frequency, in DataFrame functions only.

Base rules come from each text alone. The cross-document part hashes every normalised line (lower case, digits as
one sign, single blanks) and counts, for each host (the source column), the distinct documents that have it; copies of
a whole text count as one document, so that a text isn't its own boilerplate. A line in more than `SHARE` of a host's
distinct documents, and in more than `LEAST` of them, is frequent; a document is rejected when fewer than
`REMAINS` of its words are left without such lines. The query (judged, held to its SQL) counts their words;
cleaned_documents, the pipeline's stage, takes them out of the texts, and there a line in more than `MOST` of a host's
distinct documents is frequent whatever its share, since a share grows with the host.

Scale: judging never shuffles texts. The shuffles are of (host, line hash, text hash) rows, deduplicated and counted with
map-side aggregation, of the frequent lines' occurrences, and of one narrow row a document. The join with frequent lines
deals the rows of a line over `SALTS` parts, since one line may be in a third of all rows. Only cleaned_documents
shuffles texts, by document, to meet the places of their frequent lines.

Defined results: a null text counts as empty, has no words and fails the base rules; a null source is a host of its
own; repeated rows get equal results each and count as one document; an empty table gives no rows; extra columns are
neither read nor passed on (kept_documents and cleaned_documents pass the columns of documents on); doc_id may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, salted_join, table, unpacked, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line is frequent in more than this share, and more than this number, of a host's distinct documents.
SHARE, LEAST = 0.2, 10
#: In cleaned_documents a line in more than this number of a host's distinct documents is frequent too.
MOST = 40
#: Share of a document's words that must be left.
REMAINS = 0.3


def bind(value: Column, body) -> Column:
    """body(v) with v bound to value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more: windows are hashed, sorted, compared to neighbours."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

    places = lambda w: F.array_distinct(F.flatten(F.transform(bind(F.sort_array(windows(w)), repeated), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(F.size(places(words)))


def base_measures(text: Column) -> Column:
    """Struct of the per-text measures."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), r"\s+", " "))


def line_rows(docs: DataFrame) -> DataFrame:
    """host, doc_id, fp (the text's hash), n_words (the text's), pos (the line's place in the text), h (the normalised line's hash), n (the line's words): one row a line."""
    line = lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.struct(i.alias("pos"), F.xxhash64(normal_line(x)).alias("h"), F.size(words_of(x)).alias("n")))
    hashed = F.array_compact(F.transform(F.split("text", "\n"), line))
    with_all = docs.select("host", "doc_id", "fp", bind(hashed, lambda x: F.struct(F.aggregate(x, F.lit(0), lambda s, y: s + y["n"]).alias("n_words"), x.alias("x"))).alias("y"))
    return with_all.select("host", "doc_id", "fp", "y.n_words", F.explode("y.x").alias("x")).select("host", "doc_id", "fp", "n_words", "x.pos", "x.h", "x.n")


def frequent_lines(lines: DataFrame, docs: DataFrame, share: float = SHARE, least: int = LEAST, most: int | None = None) -> DataFrame:
    """host and h of the lines above the limits."""
    counts = lines.select("host", "h", "fp").distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    hosts = docs.select("host", "fp").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    above = counts.where(F.col("n_docs") > least)
    high = F.col("n_docs") > share * F.col("host_docs")
    if most is not None:
        high |= F.col("n_docs") > most
    return above.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(high).select("host", "h")


def prepared(docs: DataFrame) -> DataFrame:
    """docs with host and fp: the source (null is a host of its own) and the text's hash."""
    host = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("host", host).withColumn("fp", F.xxhash64("text", F.length("text")))


def hit_lines(docs: DataFrame, share: float = SHARE, least: int = LEAST, most: int | None = None) -> DataFrame:
    """doc_id, fp, host, n_words, pos, n of the frequent lines of prepared documents; repeated rows count once."""
    lines = written(line_rows(docs), "lines")
    frequent = frequent_lines(lines, docs.select("host", "fp"), share, least, most)
    hit = salted_join(lines, frequent, ["host", "h"], "inner", F.struct("fp", "pos"), grows=False)
    return hit.groupBy("doc_id", "fp", "host", "n_words", "pos").agg(F.max("n").alias("n"))


def removed_words(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """doc_id, fp, host, n_words, n_line_words (words in frequent lines) of prepared documents that have a frequent line."""
    return hit_lines(docs, share, least).groupBy("doc_id", "fp", "host", "n_words").agg(F.sum("n").alias("n_line_words"))


def depleted(n_words: Column, gone: Column, remains: float = REMAINS) -> Column:
    return n_words - gone < remains * n_words


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_d"]) & (a["fp"] == b["_f"]) & (a["host"] == b["_h"])


def failed_base(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judged(docs: DataFrame, share: float = SHARE, least: int = LEAST, remains: float = REMAINS) -> DataFrame:
    """One row a document: the base measures, base_failed, n_line_words (words in frequent lines), kept."""
    docs = prepared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"))
    removed = removed_words(docs, share, least).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("host").alias("_h"), "n_line_words")
    base = docs.select("doc_id", "fp", "host", base_measures(F.col("text")).alias("m")).select("doc_id", "fp", "host", "m.*")
    out = base.join(removed, same_document(base, removed), "left")
    out = out.select("doc_id", *MEASURES, failed_base(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), F.coalesce("n_line_words", F.lit(0)).cast("long").alias("n_line_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted(F.col("n_words"), F.col("n_line_words"), remains))


def kept_documents(docs: DataFrame, share: float = SHARE, least: int = LEAST, remains: float = REMAINS) -> DataFrame:
    """The rows of docs that pass, unchanged. Base rules act beside the text; only depleted documents' keys meet it."""
    ready = prepared(packed(docs, *USED).withColumn("_text", F.col("text")))
    removed = removed_words(ready, share, least)
    gone = written(removed.where(depleted(F.col("n_words"), F.col("n_line_words"), remains)).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("host").alias("_h")), "depleted")
    words = words_of(F.col("text"))
    passed = ready.where(bind(words, lambda w: ~failed_base(F.size(w), repeated_words(w))))
    return unpacked(passed.join(gone, same_document(passed, gone), "left_anti").withColumn("text", F.col("_text")), docs, *USED)


def cleaned_documents(docs: DataFrame, share: float = SHARE, least: int = LEAST, remains: float = REMAINS, most: int | None = MOST) -> DataFrame:
    """The rows of docs that pass, without their frequent lines; n_chars, if there, made to fit where lines went."""
    ready = prepared(packed(docs, *USED).withColumn("_text", F.col("text")))
    hits = hit_lines(ready, share, least, most).groupBy("doc_id", "fp", "host", "n_words").agg(F.sum("n").alias("gone"), F.collect_list("pos").alias("pos"))
    bad = depleted(F.col("n_words"), F.col("gone"), remains)
    hits = written(hits.select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("host").alias("_h"), bad.alias("_bad"), F.when(~bad, F.col("pos")).alias("_pos")), "hits")
    words = words_of(F.col("text"))
    passed = ready.where(bind(words, lambda w: ~failed_base(F.size(w), repeated_words(w))))
    out = passed.join(hits, same_document(passed, hits), "left").where(~F.coalesce("_bad", F.lit(False)))
    rest = bind(F.split("_text", "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_pos")), lambda i: F.get(x, i)), "\n"))
    out = out.withColumn("text", F.when(F.col("_pos").isNull(), F.col("_text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_pos").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return unpacked(out, docs, *USED)


#: Columns that are read; all others pass unread.
USED = ("doc_id", "text", "source", "n_chars")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('s' || source, '') AS host FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM w)
), m AS (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), t AS (
    SELECT r, count(DISTINCT p) AS n_repeat_words FROM m GROUP BY r
), x AS (
    SELECT r, doc_id, host, text, trim(regexp_replace(regexp_replace(lower(u), '[0-9]+', '0', 'g'), '\s+', ' ', 'g')) AS h, len(regexp_extract_all(u, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT r, doc_id, host, text, unnest(l) AS u FROM w)
), f AS (
    SELECT host, h FROM (SELECT host, h, count(DISTINCT text) AS n FROM x GROUP BY host, h) JOIN (SELECT host, count(DISTINCT text) AS of FROM d GROUP BY host) USING (host) WHERE n > 10 AND n > 0.2 * of
), e AS (
    SELECT r, sum(n) AS gone FROM x JOIN f USING (host, h) GROUP BY r
), a AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_line_words
    FROM w LEFT JOIN t USING (r) LEFT JOIN e USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_words - n_line_words < 0.3 * n_words AS kept
FROM a
"""
