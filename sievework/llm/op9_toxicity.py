"""Operator 9, toxicity by maximum-scoring segments over token log-odds.

Training (labelled rows outside the held-out fold, at most `TRAIN_DOCS` of them by hash order, a documented bound):
tokens are words and their beginnings (insults are inflected), counted once for each different word before them, so
that copies of a text or passage count once, in toxic and clean texts; log-odds come from a Dirichlet prior of half a count plus the token's overall frequency.
Tokens whose signed root of the likelihood ratio reaches `Z` form the lexicon. The lexicon comes from three parts in four of
these rows (by the text's hash), the extreme-value law and the calibration from the fourth part, which it hasn't seen. A word
scores its best token's log-odds, once in a passage (a spelling that comes again while the passage's running score lives
is drift, after that it scores anew); any other word the log-ratio of all of them together, a small negative drift.

Scoring (every row, whole text): a linear-time scan finds all maximal scoring segments of the text's word scores.
Their scores follow an extreme-value law in clean text: lambda solves sum p_i exp(lambda s_i) = 1 over clean words,
K comes from the training texts. A segment is significant if its expected number by chance, K n exp(-lambda S), is
below `E_VALUE`. The score is the logistic calibration, on the training rows, of the best segment's and the significant
segments' normalised scores. Labels, lang, source and doc_id are never inputs of a score.

Map-only but for the word counts of the bounded training sample. Defined results: a null or empty text scores as a
text without any toxic word; a text of any length is scored whole; without usable labels of both kinds every score is 0; a doc_id labelled twice counts
as toxic if any row says so; repeated rows are scored each for itself; an empty table gives no rows; other columns
are neither read nor passed on; a null doc_id is never a training row and not held out.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .word_bpe import Memo, enter

TRAIN_DOCS = 20_000
#: One training text in so many is kept for the calibration.
APART = 4
#: Weight of the prior in words, least z-score and least count among toxic texts of a lexicon word.
PRIOR, Z, LEAST = 100.0, 4.5, 4
#: Lengths of the beginnings that are tokens.
BEGINNINGS = range(3, 9)
E_VALUE = 0.05
#: Pairs of words that a task counts before it sends them on.
PAIRS = 100_000
CUT = 0.7
#: A passage ends when its running score has dropped from its peak by so many times the lexicon's greatest score.
DROP = 1.0
STRIP = string.punctuation + "“”‘’«»¡¿…–—"
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_segments long, spans string"


def word(chunk: str) -> str:
    """A chunk between white space as a word: lower case, without punctuation around it."""
    return chunk.lower().strip(STRIP)


def tokens(w: str) -> list[str]:
    """A word (marked by a blank after it) and its beginnings."""
    return [w + " ", *(w[:k] for k in BEGINNINGS if k <= len(w))]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in one pass over the scores.

    Candidates are kept with the running total left of and at their end. A new positive score is joined leftwards
    with the nearest candidate that starts lower, as long as it ends lower than the new one.
    """
    found: list[tuple[int, int, float, float]] = []
    total = 0.0
    for k, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, left = k, total
        total += s
        right = total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((start, k + 1, left, right))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - lf) for a, b, lf, r in found]


class Model:
    """The lexicon with its drift, the extreme-value parameters and the calibration."""

    def __init__(self, lexicon: dict[str, float], drift: float, lam: float):
        self.lexicon, self.drift, self.lam, self.log_k = lexicon, drift, lam, 0.0
        self.weights: list[float] = []
        self._memo: Memo | None = None

    def __getstate__(self):
        return {**self.__dict__, "_memo": None}

    def hits(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """Number of words, and (place, score) of those in the lexicon; each counts once in a passage.

        A passage ends where the drift has used up its score, or `DROP` times the lexicon's greatest one since its peak.
        """
        if self._memo is None:
            get = self.lexicon.get
            self._memo = Memo(lambda c: max([get(t, 0.0) for t in tokens(word(c))]) if c else 0.0)
        found = list(map(self._memo.__getitem__, text.split()))
        if not any(found):
            return len(found), []
        words, out = text.split(), []
        most = DROP * max(self.lexicon.values())
        seen: set[str] = set()
        at, total, peak = 0, 0.0, 0.0
        for k, s in enumerate(found):
            if not s:
                continue
            total += (k - at) * self.drift
            at = k
            if total <= 0 or peak - total > most:
                seen.clear()
                total = peak = 0.0
            if words[k] not in seen:
                seen.add(words[k])
                out.append((k, s))
                total += s
                peak = max(peak, total)
                at = k + 1
        return len(found), out

    def found(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, maximal segments; stretches of other words count as one score of their summed drift."""
        n, hits = self.hits(text)
        scores, places, at = [], [], 0
        for k, s in hits:
            if k > at:
                scores.append((k - at) * self.drift)
                places.append(at)
            scores.append(s)
            places.append(k)
            at = k + 1
        places.append(at)
        return n, [(places[a], places[b - 1] + 1, s) for a, b, s in segments(scores)]

    def features(self, n: int, segs: list[tuple[int, int, float]]) -> list[float]:
        """Best segment's normalised score, the sum over those above chance, the best one's plain score, all on a log scale."""
        if not segs:
            return [-math.asinh(10.0), 0.0, 0.0]
        base = self.log_k + math.log(max(1, n))
        most = max(s for _, _, s in segs)
        rest = sum(max(0.0, self.lam * s - base) for s in (x[2] for x in segs))
        return [math.asinh(self.lam * most - base), math.log1p(rest), math.log1p(most)]

    def significant(self, n: int, segs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        base = self.log_k + math.log(max(1, n))
        return [x for x in segs if base - self.lam * x[2] <= math.log(E_VALUE)]

    def score(self, n: int, segs: list[tuple[int, int, float]]) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(n, segs), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def solve_lambda(clean: list[tuple[float, float]]) -> float:
    """The positive root of sum p exp(lambda s) = 1 over (score, probability); 1 if there is none in reach."""
    def over(lam: float) -> float:
        return sum(p * math.exp(min(700.0, lam * s)) for s, p in clean) - 1

    lo, hi = 1e-6, 1.0
    while over(hi) < 0 and hi < 64:
        hi *= 2
    if over(hi) < 0 or over(lo) > 0:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if over(mid) < 0 else (lo, mid)
    return hi


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights of a logistic regression, the constant first, by damped Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, usable=None) -> DataFrame:
    """(text, y) of at most `most` labelled documents, those of the smallest hashes, equal texts once; the sample alone is broadcast."""
    known = labels.selectExpr("cast(doc_id as long) doc_id", f"cast({label} as int) y").where(f"doc_id is not null and y is not null")
    if usable is not None:
        known = known.where(usable)
    sample = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("y").alias("y"))


def word_counts(rows: DataFrame) -> DataFrame:
    """word (a token), a and b: in how many different contexts toxic and clean texts of (text, y) have it.

    A context is the word before, so that copies of one text or passage count once, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[set, set] = (set(), set())

        def batch() -> pa.RecordBatch:
            pairs = [(w, before, y) for y, s in enumerate(seen) for w, before in s if w]
            columns = list(zip(*pairs, strict=True)) or [(), (), ()]
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=["word", "before", "y"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = list(map(word, (text or "").split()))
                seen[0 if y == 1 else 1].update(zip(words, ["", *words], strict=False))
                if len(seen[0]) + len(seen[1]) > PAIRS:
                    yield batch()
        yield batch()

    pairs = rows.mapInArrow(run, "word string, before string, y int").distinct()
    words = pairs.groupBy("word").agg(F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b"))
    starts = F.array(F.concat("word", F.lit(" ")), F.lit(""), *(F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in BEGINNINGS))
    return words.select(F.explode(starts).alias("word"), "a", "b").where("word is not null").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, "toxic", TRAIN_DOCS, "crc32(cast(doc_id as string)) % 3 <> 1")
    apart = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(APART)) == 0, F.lit(False))
    counts = word_counts(rows.where(~apart))
    totals = counts.where("word = ''").selectExpr("a ta", "b tb")
    prior = 0.5 + F.lit(PRIOR) * (F.col("a") + F.col("b")) / (F.col("ta") + F.col("tb"))
    odds = lambda y, t: F.log((F.col(y) + prior) / (F.col(t) + PRIOR))
    share = lambda y, t: F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) * (F.col("ta") + F.col("tb")) / ((F.col("a") + F.col("b")) * F.col(t)))).otherwise(0.0)
    z = (F.signum("odds") * F.sqrt(F.greatest(F.lit(0.0), 2 * (share("a", "ta") + share("b", "tb"))))).alias("z")
    picked = (
        counts.where((F.col("a") >= LEAST) & (F.col("word") != "")).join(F.broadcast(totals), F.lit(True)).where("ta > 0 and tb > 0")
        .select("word", "a", "b", "ta", "tb", prior.alias("prior"), (odds("a", "ta") - odds("b", "tb")).alias("odds"))
        .select("*", z).where(F.col("z") >= Z).orderBy(F.desc("z"), "word").collect()
    )  # words of the bounded sample alone
    if not picked:
        return Model({}, 0.0, 1.0)
    ta, tb = picked[0]["ta"], picked[0]["tb"]
    lexicon = {r["word"]: r["odds"] for r in picked}
    # Nested beginnings count the same words: the largest of a family's counts is the shortest one's.
    top = [r for r in picked if not any(r["word"].strip()[:k] in lexicon for k in BEGINNINGS if k < len(r["word"]))]
    in_a, in_b = min(0.5, sum(r["a"] for r in top) / ta), min(0.4, (sum(r["b"] for r in top) + 0.5) / (tb + 1))
    drift = min(-1e-3, math.log(max(1e-9, 1 - in_a) / max(1e-9, 1 - in_b)))
    clean = [(r["odds"], (r["b"] + r["prior"]) / (tb + PRIOR)) for r in top] + [(drift, 1 - in_b)]
    model = Model(lexicon, drift, solve_lambda(clean))
    return calibrate(model, rows.where(apart))


def calibrate(model: Model, rows: DataFrame) -> Model:
    """K from clean texts' best segments, then the logistic weights, over rows apart from the lexicon's.

    A number or three a text of the bounded sample come to the driver, however long the texts are.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for b in batches:
            found = [model.found(t or "") for t in b.column(0).to_pylist()]
            top = [model.lam * max(s for _, _, s in segs) - math.log(max(1, n)) if segs else None for n, segs in found]
            yield pa.RecordBatch.from_arrays([pa.array(top, pa.float64())], names=["best"])

    clean = [r["best"] for r in rows.where("y <> 1").mapInArrow(best, "best double").collect()]
    tops = [x for x in clean if x is not None]
    # Clean texts without any lexicon word have no segment; the law's location is taken over those that have one.
    model.log_k = (float(np.median(tops)) - 0.3665 if tops else 0.0) + math.log(max(len(tops) / max(1, len(clean)), 1e-6))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for b in batches:
            x = [model.features(*model.found(t or "")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = rows.mapInArrow(measured, "x array<double>, y int").collect()
    y = np.array([float(r["y"] == 1) for r in got])
    if 0 < y.sum() < len(y):
        model.weights = fit_logistic(np.array([r["x"] for r in got]), y)
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: held_out, score, predicted, and the significant segments as word ranges."""
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for b in batches:
            scores, counts, spans = [], [], []
            for t in b.column(2).to_pylist():
                n, segs = model.found(t or "")
                scores.append(model.score(n, segs))
                sure = model.significant(n, segs)
                counts.append(len(sure))
                spans.append(",".join(f"{s}:{e}" for s, e, _ in sure))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(crc32(cast(doc_id as string)) % 3 = 1, false) held_out", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
