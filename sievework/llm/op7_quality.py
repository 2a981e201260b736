"""Operator 7, quality classifier by importance resampling over hashed n-grams.

Two bag-of-n-grams models over `BUCKETS` hash buckets: the target's from labelled good documents (at most
`TRAIN_DOCS` of them by hash order, a documented bound), the raw one's from all documents. A document's log importance
weight is the sum over its n-grams of log p_target - log p_raw. Adding Gumbel noise, drawn from a hash of seed and
document, and taking the k greatest keys samples k documents without replacement by these weights.

n-grams are those of token forms: a token between white space becomes its outline (letters by case and length class,
digits, the punctuation itself) with a mark if it repeats one of the three before it, then single forms and pairs are
hashed; so they generalise to words never seen. A token longer than `PART` (text without white space, base64) counts as
its consecutive parts of that length, so all of it has its weight. k is `share` of all documents; None takes the share of all
documents whose weight is not below the `1 - RECALL` quantile of the weights of labelled good documents.

Two passes of map-only work: bucket counts (summed before the shuffle; their number is fixed) and weights. The k-th
key is found exactly by narrowing histograms of the keys, so no sort of all rows and no rows on the driver.

Defined results: a null or empty text has weight 0 and takes part; a text of any length is read whole; ties of keys go to the smaller doc_id, then
repeated rows are kept or dropped together (so a few rows more than k may stay); an empty table gives no rows;
without good labels all weights are 0 and every row is kept; a null doc_id draws its noise as any other value.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written
from .op9_toxicity import training_rows
from .word_bpe import Memo, enter

BUCKETS = 1 << 15
TRAIN_DOCS = 20_000
#: Share of labelled good documents whose weight k has to reach.
RECALL = 0.9998
SEED = 20
#: Pseudo-count of a bucket.
SMOOTH = 0.5
#: Characters of the parts that longer tokens are split into.
PART = 64
_RUNS = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[^\W\d_A-ZÀ-ÖØ-Þ]+|\d+|_|(?:(?!\w).)", re.S)
_CLASS = (1, 3, 7, 15)


def form(chunk: str) -> str:
    """Outline of a token between white space."""
    out = []
    for r in _RUNS.findall(chunk):
        c = r[0]
        kind = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if kind in "9Aa":
            out.append(f"{kind}{sum(len(r) > k for k in _CLASS)}")
        elif out and out[-1][0] == kind:
            out[-1] = kind + "+"
        else:
            out.append(kind)
    return "".join(dict.fromkeys(out)) if len(out) > 6 else "".join(out)


def quick_form(chunk: str) -> str:
    """form() without a pattern for the most common tokens: a lower-case word, with one sign after it or not."""
    n = len(chunk)
    if n <= PART and chunk.islower():
        if chunk.isalpha():
            return "a" + _LENGTH[n]
        last = chunk[-1]
        if last in ",.;:!?" and n > 1 and chunk[:-1].isalpha():
            return "a" + _LENGTH[n - 1] + last
    return form(chunk)


_LENGTH = [str(sum(n > k for k in _CLASS)) for n in range(PART + 1)]
_form_hash = Memo(lambda f: zlib.crc32(f.encode("utf-8", "replace")) << 32, 50_000)
#: A token's form hash in the high 32 bits, its own hash (only ever compared within a text) in the low ones.
_tokens = Memo(lambda chunk: _form_hash[quick_form(chunk)] | hash(chunk) & 0xFFFFFFFF, 120_000)


def parts(text: str) -> list[str]:
    """The tokens between white space, those longer than `PART` in consecutive parts."""
    chunks = text.split()
    if max(map(len, chunks), default=0) <= PART:
        return chunks
    return [c[i : i + PART] for c in chunks for i in range(0, len(c), PART)]


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of a text's n-grams: single forms and pairs, with the repeat mark in the form."""
    both = np.array(list(map(_tokens.__getitem__, parts(text or ""))), np.uint64)
    if not len(both):
        return np.zeros(0, np.int64)
    again = np.zeros(len(both), bool)
    for back in (1, 2, 3):
        again[back:] |= both[back:] == both[:-back]
    shape = (both >> np.uint64(31)) & np.uint64(0x1FFFFFFFE) | again
    grams = np.concatenate((shape * np.uint64(0x9E3779B97F4A7C15), (shape[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (shape[1:] * np.uint64(0x165667B19E3779F9))))
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return (grams >> np.uint64(64 - 15)).astype(np.int64)


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """n-grams by bucket over the text column of rows; each task sends one row a bucket it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality", _tokens.release)
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(buckets(t), minlength=BUCKETS)
        _tokens.release()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32), pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p = (target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)
    q = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    return np.log(p) - np.log(q)


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs with log_weight after its columns."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema, T.StructField("log_weight", T.DoubleType())])
    names = [*docs.columns, "log_weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality", _tokens.release)
        for b in batches:
            w = [float(ratio[buckets(t)].sum()) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64())], names=names)
        _tokens.release()

    return docs.mapInArrow(run, schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise drawn from a hash of seed and key."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_key(keys: DataFrame, k: int, column: str = "key") -> float | None:
    """The k-th greatest value of a column: histograms of ever narrower ranges, each of 4096 rows at most."""
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return None
    if k <= 0:
        return float("inf")
    above, inside = 0, n
    while lo < hi and inside > 4096:
        width = (hi - lo) / 4096
        if width <= 0 or lo + width == lo:
            break
        bin_ = F.least(F.floor((F.col(column) - lo) / width), F.lit(4095))
        rows = keys.where(F.col(column).between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if above + r["n"] >= k:
                if r["n"] == inside and r["lo"] == lo and r["hi"] == hi:
                    return lo if r["lo"] == r["hi"] else _tail(keys, column, lo, hi, k - above)
                lo, hi, inside = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
    return lo if lo == hi else _tail(keys, column, lo, hi, k - above)


def _tail(keys: DataFrame, column: str, lo: float, hi: float, k: int) -> float:
    """The k-th greatest value between lo and hi, by counts of distinct values there."""
    rows = keys.where(F.col(column).between(lo, hi)).groupBy(column).count().orderBy(F.desc(column)).limit(k).collect()
    for r in rows:
        k -= r["count"]
        if k <= 0:
            return r[0]
    return lo


def keyed(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs with log_weight and sample_key."""
    return weights(docs, ratio).withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id")))


def learn_ratio(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Log ratios by bucket; zeros if there are no good documents."""
    target = bucket_counts(good)
    return log_ratio(target, bucket_counts(docs)) if target.sum() else np.zeros(BUCKETS)


def least_key(keys: DataFrame, good: DataFrame, ratio: np.ndarray, share: float | None) -> float | None:
    """The least key that stays (None: all stay)."""
    if not ratio.any():
        return None
    if share is None:
        least = weights(good.select("text"), ratio).agg(F.percentile_approx("log_weight", 1 - RECALL, 100_000)).first()[0]
        k = keys.where(F.col("log_weight") >= F.lit(float("-inf") if least is None else least)).count()
    else:
        k = round(share * keys.count())
    return kth_key(keys, k, "sample_key")


def decided(docs: DataFrame, labels: DataFrame, share: float | None) -> tuple[np.ndarray, DataFrame, float | None]:
    """(log ratios, written keys of all documents without their texts, the least key that stays)."""
    good = training_rows(docs.selectExpr("cast(doc_id as long) doc_id", "text"), labels, "quality", TRAIN_DOCS).where("y = 1")
    ratio = learn_ratio(docs, good)
    keys = written(keyed(docs.selectExpr("cast(doc_id as long) doc_id", "text"), ratio).drop("text"), "quality")
    return ratio, keys, least_key(keys, good, ratio, share)


def fit(docs: DataFrame, labels: DataFrame, share: float | None = None) -> tuple[np.ndarray, float | None]:
    """The log ratios by bucket and the least key that stays (None: all stay)."""
    ratio, _, cut = decided(docs, labels, share)
    return ratio, cut


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key and kept (whether the row is among the sampled ones) of every row of docs."""
    _, keys, cut = decided(docs, labels, share)
    return keys.withColumn("kept", F.lit(True) if cut is None else F.col("sample_key") >= F.lit(cut))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
