"""Operator 2, secret scan: fixed patterns and a randomness test battery with false-discovery control.

Base spans come from three patterns. The battery looks at every run of 20 or more token characters outside them, of a
longer run that a base span touches at the parts beside it: it infers
the encoding (the smallest alphabet that holds the run), and tests the run's symbols as draws from that alphabet by

* chi-squared uniformity of the alphabet (in equal bins of at least four expected symbols),
* Wald-Wolfowitz runs about the middle of the alphabet,
* lag-1 serial correlation.

A secret passes all three (each at `KEEP` / 3, Bonferroni). That alone would pass short words too, so the discovery
p-value is the chance that ordinary text of the same length over the same alphabet is as even as the run: the lower
tail of the non-central chi-squared whose non-centrality grows with the length (`TEXT_BIAS` a symbol). All runs of all
texts are one family: a first pass counts p-values over lengths in a histogram of fixed size, the Benjamini-Hochberg step at
level `FDR` weighted by length (a run's weight is its length over the mean one) finds the cut there, at a bin's upper edge,
and the second pass takes the runs below it. Equal runs of a text are one test.

Two map-only passes. Defined results: a null or empty text has no spans (base_sha256 is that of the empty string); texts of any
length are scanned whole; repeated rows are scanned each for itself; an empty table gives no rows; other columns are
neither read nor passed on; doc_id may be null.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .word_bpe import enter

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

#: Runs that the battery looks at.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
SHORTEST = 20
#: Alphabets from small to large; the first that holds a run is its encoding.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36 upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
KEEP, FDR = 0.003, 0.05
#: Bins of the histogram a power of ten.
BINS = 50
#: Non-centrality a symbol of natural text: its letters' squared deviation from evenness over the evenness.
TEXT_BIAS = 1.2
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def upper_chi2(x: float, df: int) -> float:
    """Wilson-Hilferty approximation of the upper tail."""
    if x <= 0:
        return 1.0
    h = 2 / (9 * df)
    return upper_normal(((x / df) ** (1 / 3) - (1 - h)) / math.sqrt(h))


def encoding(run: str) -> str | None:
    """Name of the smallest alphabet that holds the run."""
    held = set(run.rstrip("="))
    return next((n for n, i in INDEX.items() if held <= i.keys()), None)


def battery(run: str) -> tuple[float, float] | None:
    """(p-value of the randomness tests, discovery p-value) of a run; None if no alphabet holds it."""
    name = encoding(run)
    if name is None:
        return None
    index = INDEX[name]
    x = [index[c] for c in run.rstrip("=")]
    n, k = len(x), len(index)
    bins = max(2, min(k, n // 4))
    counts = [0] * bins
    for v in x:
        counts[v * bins // k] += 1
    widths = [0] * bins
    for v in range(k):
        widths[v * bins // k] += 1
    chi = sum((c - n * w / k) ** 2 / (n * w / k) for c, w in zip(counts, widths, strict=True))
    p_even = upper_chi2(chi, bins - 1)
    high = [v * 2 >= k for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(u != v for u, v in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * upper_normal(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    else:
        p_runs = 0.0
    m = sum(x) / n
    s = sum((v - m) ** 2 for v in x)
    r = sum((u - m) * (v - m) for u, v in zip(x, x[1:], strict=False)) / s if s else 1.0
    p_serial = 2 * upper_normal(abs(r + 1 / n) * math.sqrt(n))
    # Ordinary text repeats few symbols: count pairs of equal symbols, which bins hide.
    whole = [0] * k
    for v in x:
        whole[v] += 1
    full = sum((c - n / k) ** 2 for c in whole) * k / n
    nc = TEXT_BIAS * n * min(1.0, k / 36)
    df = k - 1
    p_text = upper_normal((df + nc - full) / math.sqrt(2 * (df + 2 * nc)))
    return min(1.0, 3 * min(p_even, p_runs, p_serial)), p_text


def parts(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches of `SHORTEST` characters and more from start to end outside the taken spans, which are sorted."""
    for s, e in taken:
        if s >= end:
            break
        if s - start >= SHORTEST:
            yield start, s
        start = max(start, e)
    if end - start >= SHORTEST:
        yield start, end


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[float, int, float, list[tuple[int, int]]]]:
    """(discovery p-value over length, length, p-value of the randomness tests, places) of a text's different runs outside the taken spans."""
    places: dict[str, list[tuple[int, int]]] = {}
    taken, at = sorted(taken), 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        for s, e in parts(*m.span(), taken[at : bisect_left(taken, (m.end(),), at)]):
            places.setdefault(text[s:e], []).append((s, e))
    return [(p[1] / len(run), len(run), p[0], at) for run, at in places.items() if (p := battery(run))]


def step_up(counts: dict[int, tuple[int, int]], fdr: float = FDR) -> float:
    """The Benjamini-Hochberg cut on p-value over length, from (runs, their lengths' sum) by bin of `edge`; -1 if nothing passes."""
    tests, chars = (sum(c) for c in zip(*counts.values(), strict=True)) if counts else (0, 0)
    cut, below = -1.0, 0
    for b in sorted(counts, reverse=True):  # from the smallest p-values
        below += counts[b][0]
        if edge(b) * chars / tests <= fdr * below / tests:
            cut = edge(b)
    return cut


def edge(b: int) -> float:
    """The greatest value of a bin."""
    return 10 ** (-b / BINS)


def bin_of(x: float) -> int:
    return min(300 * BINS, math.floor(-math.log10(max(x, 1e-300)) * BINS + 1e-9))


def battery_spans(text: str, taken: list[tuple[int, int]], cut: float | None = None, fdr: float = FDR, keep: float = KEEP) -> list[tuple[int, int]]:
    """Runs outside the taken spans that the battery finds random, below the cut of a whole corpus (None: of this text alone)."""
    found = candidates(text, taken)
    if cut is None:
        cut = step_up(binned(found), fdr)
    return sorted(place for p, _, r, at in found if r >= keep and p <= cut for place in at)


def binned(found: list[tuple]) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    for p, n, *_ in found:
        b = bin_of(p)
        tests, chars = out.get(b, (0, 0))
        out[b] = tests + 1, chars + n
    return out


def corpus_cut(docs: DataFrame, fdr: float = FDR) -> float:
    """The cut over all texts of docs; at most 300 * BINS rows a task are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("secrets")
        total: dict[int, tuple[int, int]] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    for k, (n, c) in binned(candidates(text, [s[1:] for s in base_spans(text)])).items():
                        old = total.get(k, (0, 0))
                        total[k] = old[0] + n, old[1] + c
        rows = [(k, n, c) for k, (n, c) in total.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["bin", "n", "chars"])

    rows = docs.select("text").mapInArrow(run, "bin int, n long, chars long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).collect()
    return step_up({r["bin"]: (r["n"], r["chars"]) for r in rows}, fdr)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns by start, then kind as listed."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(text: str | None, cut: float | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, each a kind with start and end in code points."""
    text = text or ""
    base = base_spans(text)
    more = [("random", *s) for s in battery_spans(text, [s[1:] for s in base], cut)]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str | None, cut: float | None = None, mark: str = "[secret]") -> str | None:
    """The text with every span (overlapping ones as one) replaced by the mark."""
    if text is None:
        return None
    out, at = [], 0
    for _, s, e in scan(text, cut)[1]:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: counts by kind, the hash of the base spans, all spans."""
    cut = corpus_cut(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("secrets")
        for b in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                base, spans = scan(text, cut)
                kinds = [s[0] for s in spans]
                for c, v in zip(columns, (*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                    c.append(v)
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by a mark and n_chars, if there, made to fit."""
    names = docs.columns
    at = names.index("text")
    cut = corpus_cut(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("secrets")
        for b in batches:
            texts = [redact(t, cut) for t in b.column(at).to_pylist()]
            arrays = [*b.columns]
            arrays[at] = pa.array(texts, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                arrays[k] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
