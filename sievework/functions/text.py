"""Text functions as Column builders: tokens, counts, sentences, cleaning, shingles, keys. All but NFKC stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, words-to-tokens factor, and the stop lists of grounding and of evaluation.
TOKEN = "[a-z0-9]+"
TOKENS_PER_WORD = 1.3
GROUNDING_STOP = "the a an of to for is are was were be by on in at and or with from as it this that you your our we they their his her its can may will within".split()
EVALUATION_STOP = "the a an of to for is are was were be by on in at and or with from as it this that you your our we they their can may will have has do how long".split()
HTML_RAW = r"(?is)<(script|style).*?>.*?</\1>"
HTML_TAG = r"(?s)<[^>]+>"


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; accented letters separate."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def count_tokens(text: Column) -> Column:
    """Estimated model tokens: a constant per word, rounded down, and one more."""
    return (F.floor(F.size(words(text)) * F.lit(TOKENS_PER_WORD)) + 1).cast("int")


def sentences(text: Column) -> Column:
    """Trimmed parts after . ! ? and white space, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")


def strip_html(html: Column) -> Column:
    """Scripts, styles and tags become blanks, white space single; character references stay."""
    plain = F.regexp_replace(F.regexp_replace(html, HTML_RAW, " "), HTML_TAG, " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def clean_text(text: Column, nfkc: bool = False) -> Column:
    """NFKC (by a pandas UDF, on demand), de-hyphenation at line ends, single blanks, trimmed."""
    out = _nfkc(text) if nfkc else text
    return F.regexp_replace(F.regexp_replace(dehyphenate(out), r"[ \t]+", " "), r"^\s+|\s+$", "")


def _nfkc(text: Column) -> Column:
    import unicodedata

    from pyspark.sql.functions import PandasUDFType, pandas_udf

    return pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x)), "string", PandasUDFType.SCALAR)(text)


def shingles(text: Column, k: int = 3) -> Column:
    """k-token shingles; fewer tokens stand for themselves; without tokens the text itself."""
    t = tokenize(text)
    many = F.transform(F.array(t), lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: F.array_join(F.slice(a, i + 1, F.lit(k)), " ")))[0]
    return F.when(F.size(t) >= k, many).when(F.size(t) > 0, t).otherwise(F.array(text))


def content_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct tokens of three or more letters that aren't stop words."""
    stop_words = F.array(*(F.lit(s) for s in (stop or GROUNDING_STOP)))
    return F.filter(F.array_distinct(tokenize(text)), lambda x: (F.length(x) > 2) & ~F.array_contains(stop_words, x))


def lexical_entails(claim: Column, evidence: Column, threshold: float = 0.6) -> Column:
    """Whether most content tokens of a claim are in the evidence; a claim without any is."""
    c = content_tokens(claim)
    return F.when(F.size(c) == 0, F.lit(True)).otherwise(F.size(F.array_intersect(c, content_tokens(evidence))) / F.size(c) >= threshold)


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 over sets of content tokens; two empty sets agree."""
    p, g = content_tokens(predicted, EVALUATION_STOP), content_tokens(gold, EVALUATION_STOP)
    both = F.size(F.array_intersect(p, g))
    none = (F.size(p) == 0) & (F.size(g) == 0)
    return F.when(none, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def answer_relevancy(answer: Column, question: Column) -> Column:
    q = content_tokens(question, EVALUATION_STOP)
    return F.when(F.size(q) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(q, content_tokens(answer, EVALUATION_STOP))) / F.size(q))


def content_hash(*parts: Column) -> Column:
    """SHA-256 over a canonical JSON form of the parts."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def cache_key(*parts: Column) -> Column:
    """Key of an answer cache: lower case, white space collapsed, all parts count (collection, strategy, entitlements)."""
    return F.sha2(F.concat_ws("\x1f", *(F.regexp_replace(F.lower(F.trim(p)), r"\s+", " ") for p in parts)), 256)


def entity_norm(name: Column) -> Column:
    return F.lower(F.trim(name))


def title_of(path: Column) -> Column:
    """File name without suffix, _ and - as blanks."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.trim(F.translate(stem, "_-", "  "))


def days_since(iso: Column, as_of: Column) -> Column:
    """Days from an ISO date to as_of, not below 0; 9999 if there is none or it can't be read."""
    days = F.datediff(as_of, F.try_to_timestamp(iso).cast("date"))
    return F.when(days.isNull(), F.lit(9999)).otherwise(F.greatest(days, F.lit(0)))


def render_document(title: Column, sections: Column, most: int = 12_000) -> Column:
    """Title and sections(heading, level, text) as Markdown for a model, cut to a number of characters."""
    head = lambda s: F.when(s["heading"] != "", F.concat(F.repeat(F.lit("#"), F.greatest(s["level"], F.lit(1))), F.lit(" "), s["heading"])).otherwise(F.lit(None))
    parts = F.flatten(F.transform(sections, lambda s: F.filter(F.array(head(s), s["text"]), lambda x: x.isNotNull() & (x != ""))))
    return F.substring(F.concat_ws("\n", title, F.array_join(parts, "\n")), 1, most)


def table_markdown(headers: Column, rows: Column) -> Column:
    """A table as Markdown; missing headers become c0, c1, ...; a table without rows is empty."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    width = F.size(F.get(rows, F.lit(0)))
    names = F.when(F.size(headers) > 0, headers).otherwise(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit("c"), i.cast("string"))))
    rule = F.transform(names, lambda _: F.lit("---"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(names), line(rule)), F.transform(rows, line)), "\n")).otherwise(F.lit(""))
