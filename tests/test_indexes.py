"""Stored sparse and dense indexes against a comparison of all pairs; what they skip."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F
from sievework.functions.lexical import lexical_topk
from sievework.operators import dense_index, sparse_index


def tokens(text):
    return Counter(re.findall("[a-z0-9]+", (text or "").lower()))


def plain_sparse(queries, chunks, k):
    weight = lambda n: 1 + math.log(n)
    out = set()
    for q, text in queries:
        asked = tokens(text)
        scored = []
        for c, body in chunks:
            has = tokens(body)
            s = sum(weight(n) * weight(has[t]) for t, n in asked.items() if t in has)
            if s > 0:
                scored.append((-round(s, 6), c))
        out |= {(q, c, -s, i) for i, (s, c) in enumerate(sorted(scored)[:k])}
    return out


def corpus(n, ids=lambda i: i):
    """Short texts of one language and a few long ones of another, copies, empty ones, accents."""
    draw = random.Random(2)
    ours, theirs = [f"w{i}" for i in range(300)], [f"Vé{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = theirs if i % 3 else ours
        rows.append((ids(i), " ".join(draw.choices(words, k=draw.choice([0, 3, 10, 40, 400 if i % 50 == 0 else 20])))))
    rows += [(ids(n + i), rows[7][1]) for i in range(30)] + [(ids(n + 40), None), (ids(n + 41), "İ ẞ K 1"), (ids(n + 42), "w1 " * 9000)]
    questions = [(i, " ".join(draw.choices(ours, k=draw.randrange(1, 25)))) for i in range(12)] + [(50, "nothing known"), (51, ""), (52, None), (53, "W1, w1; k")]
    return questions, rows


def rows_of(df):
    return {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    questions, rows = corpus(900)
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").withColumn("tag", F.when(F.col("chunk_id") % 2 == 0, "even").otherwise("odd")).repartition(5)
    path = str(tmp_path_factory.mktemp("sparse"))
    sparse_index.build(chunks, path, span=32, segment=4)
    return questions, rows, spark.createDataFrame(questions, "query_id long, text string"), chunks, sparse_index.SparseIndex(spark, path)


def test_one_pass(spark, made):
    questions, rows, q, chunks, _ = made
    want = plain_sparse(questions, rows, 10)
    assert rows_of(lexical_topk(q, chunks, 10)) == want
    assert rows_of(lexical_topk(q, chunks, 10, query_block=3)) == want


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_stored_index(made, k):
    questions, rows, q, _, index = made
    found, counts = index.search(q, k)
    assert rows_of(found) == plain_sparse(questions, rows, k)
    stats = counts.collect()
    assert len(stats) == 13  # three questions share no token with any text
    if k == 1:
        assert sum(r["scored"] for r in stats) < 0.7 * sum(r["spans"] for r in stats)
    if k == 2000:
        assert all(r["scored"] == r["spans"] for r in stats)


def test_stored_index_filters_before_the_limit(made):
    questions, rows, q, _, index = made
    found, _ = index.search(q, 10, visible=F.col("tag") == "odd", query_block=4)
    assert rows_of(found) == plain_sparse(questions, [r for r in rows if r[0] % 2], 10)


def test_stored_index_of_named_chunks_and_none(spark, tmp_path):
    questions, rows = corpus(60, ids=lambda i: f"c-{i:04d}")
    q = spark.createDataFrame(questions, "query_id long, text string")
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    sparse_index.build(chunks, f"{tmp_path}/a", span=8, segment=2)
    assert rows_of(sparse_index.SparseIndex(spark, f"{tmp_path}/a").search(q, 5)[0]) == plain_sparse(questions, rows, 5)
    assert rows_of(lexical_topk(q, chunks, 5)) == plain_sparse(questions, rows, 5)
    sparse_index.build(chunks.where("false"), f"{tmp_path}/b")
    assert sparse_index.SparseIndex(spark, f"{tmp_path}/b").search(q, 5)[0].collect() == []


def plain_dense(queries, rows, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    out = set()
    for q, a in queries:
        scored = sorted((-round(float(unit(a) @ unit(b)), 6) + 0.0, i) for i, b in rows if b is not None and len(b) == len(a) and all(x is not None and math.isfinite(x) for x in b))
        out |= {(q, i, -s + 0.0, r) for r, (s, i) in enumerate(scored[:k])}
    return out


def vectors(n, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, 16))
    rows = [(i, (centres[i % 9] + 0.15 * draw.normal(size=16)).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * 5), (n + 3, [float("nan")] + [1.0] * 15), (n + 4, [0.0] * 16), (n + 5, [None] + [1.0] * 15)] + [(n + 10 + i, rows[4][1]) for i in range(12)]
    return rows


@pytest.mark.parametrize("k", [1, 7, 3000])
def test_dense_index(spark, tmp_path, k):
    rows = vectors(1500)
    queries = [(i, v) for i, v in rows[:40]] + [(9000, [-x for x in rows[0][1]]), (9001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    dense_index.build(df, str(tmp_path), n_centres=12, block_rows=100)
    found, counts = dense_index.DenseIndex(spark, str(tmp_path)).search(spark.createDataFrame(queries, "query_id long, vector array<double>"), k)
    assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in found.collect()} == plain_dense(queries, rows, k)
    stats = [r for r in counts.collect() if r["query_id"] < 9000]
    if k == 7:
        assert sum(r["scored"] for r in stats) < 0.6 * sum(r["blocks"] for r in stats)


def test_dense_index_filters_and_empty(spark, tmp_path):
    rows = vectors(300)
    queries = spark.createDataFrame(rows[:5], "query_id long, vector array<double>")
    df = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("tag", F.col("id") % 3)
    dense_index.build(df, f"{tmp_path}/a", n_centres=5, block_rows=50)
    found = dense_index.DenseIndex(spark, f"{tmp_path}/a").search(queries, 9, visible=F.col("tag") == 1, query_block=2)[0]
    assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in found.collect()} == plain_dense(rows[:5], [r for r in rows if r[0] % 3 == 1], 9)
    dense_index.build(df.where("false"), f"{tmp_path}/b")
    assert dense_index.DenseIndex(spark, f"{tmp_path}/b").search(queries, 3)[0].collect() == []
