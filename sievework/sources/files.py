"""File sources: Markdown, text and HTML folders, structured JSON documents, templated rows, golden cases."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import sliced
from ..functions.text import strip_html, title_of

# Suffixes that a folder scan takes, and the line forms of Markdown.
TEXT_SUFFIXES = ("md", "markdown", "txt")
HTML_SUFFIXES = ("html", "htm")
HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$")
IMAGE = re.compile(r"^!\[([^\]]*)\]\(([^)]+)\)\s*$")

BLOCK = "struct<kind:string,text:string,heading_level:int,headers:array<string>,rows:array<array<string>>,src:string>"
SOURCE = f"doc_id string, uri string, source_type string, title string, blocks array<{BLOCK}>, acl_tags array<string>, content_hash string"


def block(kind: str, text: str = "", level: int = 0, headers: list | None = None, rows: list | None = None, src: str = "") -> dict:
    return {"kind": kind, "text": text, "heading_level": level, "headers": headers or [], "rows": rows or [], "src": src}


def split_row(line: str) -> list[str]:
    """Cells of a table line."""
    return [c.strip() for c in line.strip().strip("|").split("|")]


def split_row_column(line: Column) -> Column:
    """split_row as a column expression."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def parse_markdown(text: str) -> list[dict]:
    """Blocks of a Markdown text: each line is a heading, else an image, else opens a table (if a rule follows), else is text."""
    lines, out, held = text.splitlines(), [], []

    def release() -> None:
        whole = "\n".join(held).strip()
        held.clear()
        if whole:
            out.append(block("text", whole))

    rest = iter(range(len(lines)))
    for k in rest:
        line = lines[k]
        if m := HEADING.match(line):
            release()
            out.append(block("text", m[2].strip(), len(m[1])))
        elif m := IMAGE.match(line.strip()):
            release()
            out.append(block("image", m[1].strip(), src=m[2].strip()))
        elif "|" in line and TABLE_RULE.match("".join(lines[k + 1 : k + 2])):
            release()
            end = k + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            out.append(block("table", headers=split_row(line), rows=[split_row(x) for x in lines[k + 2 : end]]))
            for _ in range(end - k - 1):
                next(rest)
        else:
            held.append(line)
    release()
    return out


def markdown_blocks(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows(doc_id, text) as doc_id and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("heading_level", pa.int32()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("src", pa.string())]))
        for b in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_markdown(t or "") for t in b.column(1).to_pylist()], kind)], names=["doc_id", "blocks"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, blocks array<{BLOCK}>")


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads is a file; patterns and missing paths aren't."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def load_path(spark: SparkSession, path: str, acl_tags: list[str] | None = None) -> DataFrame:
    """Documents of a file (any suffix or none) or a folder (known suffixes, recursively); invalid UTF-8 is replaced, not an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    if not is_file(spark, path):
        files = files.where(suffix.isin(*TEXT_SUFFIXES, *HTML_SUFFIXES))
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    raw = files.select(uri.alias("doc_id"), suffix.alias("suffix"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    is_html = F.col("suffix").isin(*HTML_SUFFIXES)
    plain = raw.where(~is_html)
    parsed = markdown_blocks(plain)
    page_block = F.array(F.struct(F.lit("text").alias("kind"), strip_html(F.col("text")).alias("text"), F.lit(0).alias("heading_level"), F.array().cast("array<string>").alias("headers"), F.array().cast("array<array<string>>").alias("rows"), F.lit("").alias("src")))
    pages = raw.where(is_html).select("doc_id", page_block.cast(f"array<{BLOCK}>").alias("blocks"))
    return as_source(parsed.unionByName(pages), "file", acl_tags)


def as_source(rows: DataFrame, source_type: str, acl_tags: list[str] | None = None, title: Column | None = None) -> DataFrame:
    """rows(doc_id, blocks) as source documents; the hash covers address, title and blocks, not the time of reading."""
    tags = F.array(*(F.lit(t) for t in (acl_tags or ["public"])))
    out = rows.withColumn("uri", F.col("doc_id").cast("string")).withColumn("source_type", F.lit(source_type)).withColumn("title", title_of(F.col("uri")) if title is None else title).withColumn("acl_tags", tags)
    digest = F.sha2(F.to_json(F.struct("uri", "title", "blocks"), {"ignoreNullFields": "false"}), 256)
    return out.withColumn("content_hash", digest).select("doc_id", "uri", "source_type", "title", "blocks", "acl_tags", "content_hash")


#: A structured document: paragraphs and tables of nested elements.
_TEXT = "array<struct<textRun:struct<content:string>>>"
_CELL = f"array<struct<paragraph:struct<elements:{_TEXT}>>>"
STRUCTURED = f"struct<title:string,body:struct<content:array<struct<paragraph:struct<paragraphStyle:struct<namedStyle:string,namedStyleType:string>,elements:{_TEXT}>,table:struct<tableRows:array<struct<tableCells:array<struct<content:{_CELL}>>>>>>>>>"


def structured_documents(rows: DataFrame, json: str = "json") -> DataFrame:
    """rows(doc_id, json, permissions ARRAY<STRUCT<type, value>> optional) of a document service as source documents."""
    doc = rows.withColumn("d", F.from_json(json, STRUCTURED))
    run = lambda e: F.array_join(F.transform(e, lambda x: F.coalesce(x["textRun"]["content"], F.lit(""))), "")
    cell = lambda c: F.trim(F.array_join(F.transform(c["content"], lambda p: run(p["paragraph"]["elements"])), " "), F.lit(" \n"))
    null = F.array().cast("array<string>")

    def one(c: Column) -> Column:
        style = F.coalesce(c["paragraph"]["paragraphStyle"]["namedStyle"], c["paragraph"]["paragraphStyle"]["namedStyleType"], F.lit(""))
        level = F.when(style == "TITLE", 1).otherwise(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(style, r"^HEADING_(\d)", 1), F.lit("")), F.lit("9")).cast("int"), F.lit(0)))
        table = F.transform(c["table"]["tableRows"], lambda r: F.transform(r["tableCells"], cell))
        is_table = c["table"].isNotNull()
        return F.struct(
            F.when(is_table, "table").otherwise("text").alias("kind"), F.when(is_table, "").otherwise(F.trim(run(c["paragraph"]["elements"]), F.lit(" \n"))).alias("text"),
            F.when(is_table, 0).otherwise(level).alias("heading_level"), F.when(is_table, F.get(table, F.lit(0))).otherwise(null).alias("headers"),
            F.when(is_table, F.slice(table, 2, 1 << 30)).otherwise(F.array().cast("array<array<string>>")).alias("rows"), F.lit("").alias("src"),
        )

    blocks = F.filter(F.transform("d.body.content", one), lambda b: (b["kind"] == "table") | (b["text"] != ""))
    out = doc.select("doc_id", blocks.alias("blocks"), F.col("d.title").alias("t"), *([acl_of(F.col("permissions")).alias("acl")] if "permissions" in rows.columns else []))
    done = as_source(out, "gdoc", title=F.coalesce("t", F.lit("")))
    return done if "permissions" not in rows.columns else done.drop("acl_tags").join(out.select("doc_id", F.col("acl").alias("acl_tags")), "doc_id")


def acl_of(permissions: Column) -> Column:
    """Access tags of permission entries; none that can be read means restricted."""
    tags = F.filter(F.transform(permissions, lambda p: F.when(p["type"] == "domain", F.concat(p["value"], F.lit(":all"))).when(p["type"] == "user", F.concat(F.lit("user:"), p["value"]))), lambda t: t.isNotNull())
    return F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, tags).otherwise(F.array(F.lit("restricted")))


def row_documents(rows: DataFrame, doc_id: Column, title: Column, text: Column) -> DataFrame:
    """Rows of a database rendered as documents of one text block."""
    return rows.select(doc_id.alias("doc_id"), title.alias("title"), text.alias("text"), F.sha2(F.concat_ws("\x1f", title, text), 256).alias("content_hash"))


def load(spark: SparkSession, uri: str, structured: DataFrame | None = None, **options) -> DataFrame:
    """Dispatch by address: gdoc:// goes to the structured-document connector, everything else is a path."""
    if uri.startswith("gdoc://"):
        if structured is None:
            raise ValueError("a gdoc:// address needs the service's rows")
        return structured_documents(structured.where(F.col("doc_id") == uri.removeprefix("gdoc://")))
    return load_path(spark, uri, **options)


def golden_cases(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """Evaluation cases as a table."""
    fields = ("id", "query", "ideal_answer", "relevant_source_contains", "expect")
    rows = [tuple(str(c.get(f) or "") for f in fields) + (list(c.get("tags") or []),) for c in cases]
    return spark.createDataFrame(rows, "id string, query string, ideal_answer string, relevant_source_contains string, expect string, tags array<string>")
