"""Joins whose small side grows with the input stay off the driver; batches in Python are bounded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.functions import batches, hashing, lexical, vectors
from sievework.llm import op6_minhash
from sievework.operators import graph, ingest, models
from sievework.plans import base
from sievework.session import checkpoint


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def prints(spark):
    return checkpoint(spark.range(200).select(F.col("id").alias("doc_id"), F.xxhash64(F.col("id") % 150).bitwiseAND(F.lit((1 << 60) - 1)).alias("fp")))


def test_near_pairs_broadcast_nothing(prints):
    assert "Broadcast" not in plan(ingest.near_pairs(prints))


def test_greedy_duplicates_broadcast_nothing(prints):
    seen = []

    def held(df):
        seen.append(plan(df))
        return checkpoint(df)

    out = ingest.greedy_duplicates(prints, held)
    assert not [p for p in [*seen, plan(out)] if "Broadcast" in p]
    assert out.where("duplicate_of is not null").count() == 50


def test_components_broadcast_nothing(spark, monkeypatch):
    seen, written = [], op6_minhash.written

    def held(df, what):
        seen.append(plan(df))
        return written(df, what)

    monkeypatch.setattr(op6_minhash, "written", held)
    links = written(spark.range(40).select(F.col("id"), (F.col("id") - F.col("id") % 4).alias("hub")), "given")
    assert sorted({r["label"] for r in op6_minhash.components(links).collect()}) == list(range(0, 40, 4))
    assert not [p for p in seen if "Broadcast" in p]


# --- Python -------------------------------------------------------------------------------------------------------------


def test_slices_are_bounded_and_whole():
    texts = ["x" * 100] * 700 + [None, "y" * 5000, ""] * 3
    cut = list(batches.sliced(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]), 0, 256, 2000))
    assert [t for b in cut for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows == 1 or b.num_rows <= 256 and sum(len(t or "") for t in b.column(0).to_pylist()) <= 2000 for b in cut)


def test_slices_of_lists_are_bounded_and_whole():
    rows = [[1] * 100, None, [], [None, 5], *([[7] * 300] * 20), [2] * 5000]
    for column in (pa.array(rows), pa.array([r and ["abcdefgh"] * len(r) for r in rows], pa.list_(pa.string()))):
        column = pa.concat_arrays([column.slice(1), column.slice(0, 1)]).slice(0, len(rows))  # values with an offset, too
        cut = list(batches.sliced(iter([pa.RecordBatch.from_arrays([column], names=["t"])]), 0, 256, 8 * 1000))
        assert [t for b in cut for t in b.column(0).to_pylist()] == column.to_pylist()
        assert all(b.num_rows == 1 or sum(len(t or ()) for t in b.column(0).to_pylist()) <= 1000 for b in cut)
        assert len(cut) < 12


def test_simhash_counts_slices_of_bounded_bytes(spark, monkeypatch):
    seen, whole = spark.sparkContext.accumulator(0), batches.sliced

    def watched(rows, by):
        for b in whole(rows, by):
            values = b.column(by).flatten()
            if b.num_rows > 1 and 8 * len(values) > batches.BYTES:
                raise ValueError(f"{b.num_rows} rows, {len(values)} values at once")
            seen.add(1)
            yield b

    monkeypatch.setattr(hashing, "sliced", watched)
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("w"), (i * (F.col("id") % 5 + 1)).cast("string"))), " ")
    rows = spark.range(100).coalesce(1).select(F.col("id").alias("doc_id"), words.alias("text"))
    got = {r["doc_id"]: r["fp"] for r in hashing.simhash(rows).collect()}
    assert seen.value >= 3 and len(got) == 100 and all(got[i] == got[i % 5] for i in got) and len(set(got.values())) == 5


def test_calls_come_in_slices_of_bounded_bytes(spark, monkeypatch):
    whole = batches.sliced

    def watched(rows, by, most):
        for b in whole(rows, by, most):
            assert b.num_rows == 1 or sum(len(t) for t in b.column(by).to_pylist()) <= batches.BYTES
            yield b

    monkeypatch.setattr(models, "sliced", watched)
    rows = spark.range(60).coalesce(1).select("id", F.repeat(F.lit("word "), 10_000).alias("t"))
    got = models.map_model(rows, "t", "o", "refine").collect()
    assert [r["id"] for r in got] == list(range(60)) and all(r["o_error"] is None for r in got)


def test_entities_come_in_blocks_of_bounded_bytes(spark):
    entities = spark.range(150_000).select(F.concat(F.lit("entity of the graph "), F.lpad(F.col("id").cast("string"), 12, "0")).alias("entity"))  # 4.8 MB
    q = spark.createDataFrame([(i, f"What of Entity of the Graph {i:012d}?") for i in (0, 77, 149_999, 150_000)], "query_id long, text string")
    found = graph.match_entities(q, entities)
    assert plan(found).count("MapInArrow") >= 3
    assert sorted(r["query_id"] for r in found.collect()) == [0, 77, 149_999]


def test_best_gives_all_of_the_best():
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 30, (7, 900)).astype(float)
    best, met = batches.Best(7, 5), [[] for _ in range(7)]
    for low in range(0, 900, 64):
        for q, i in zip(*best.places(scores[:, low : low + 64]), strict=True):
            met[q].append(low + i)
    for q in range(7):
        order = lambda i: (-scores[q, i], i)  # noqa: B023, E731
        assert sorted(met[q], key=order)[:5] == sorted(range(900), key=order)[:5]
        assert len(met[q]) < 200


def test_texts_are_embedded_in_slices(spark, sf_small):
    rows = base.chunks(spark, sf_small)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    many = rows.unionByName(rows).unionByName(rows).unionByName(rows).coalesce(1)
    got = vectors.embed(many.select("chunk_id", "text"), backend=lambda texts: [([float(len(texts))], {}) for _ in texts], weights=False)
    assert got.columns == ["chunk_id", "text", "dense"]
    n, largest = got.agg(F.count("*"), F.max(F.col("dense")[0])).first()
    assert n == 4 * rows.count() and largest <= batches.ROWS


def test_lexical_best_over_many_slices(spark):
    rows = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word "), F.repeat(F.lit("other "), (F.col("id") % 50 + 1).cast("int"))).alias("text")).coalesce(1)
    q = spark.createDataFrame([(1, "other")], "query_id long, text string")
    found = [(r["chunk_id"], r["rank"]) for r in lexical.lexical_topk(q, rows, 3).orderBy("rank").collect()]
    assert found == [(49, 0), (99, 1), (149, 2)]


def test_lexical_texts_come_in_slices_of_bounded_rows_and_bytes(spark, monkeypatch):
    whole = lexical.counted

    def watched(texts, tokens):
        size = sum(len(t or "") for t in texts.to_pylist())
        if len(texts) > batches.ROWS or len(texts) > 1 and size > batches.BYTES:
            raise ValueError(f"{len(texts)} texts of {size} characters at once")
        return whole(texts, tokens)

    monkeypatch.setattr(lexical, "counted", watched)
    rows = checkpoint(spark.range(900).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word "), F.repeat(F.lit("other "), F.when(F.col("id") < 300, 3000).otherwise(F.col("id").cast("int")))).alias("text")).coalesce(1))
    q = spark.createDataFrame([(1, "other")], "query_id long, text string")
    found = [(r["chunk_id"], r["rank"]) for r in lexical.lexical_topk(q, rows, 3).orderBy("rank").collect()]
    assert found == [(0, 0), (1, 1), (2, 2)]


def test_dense_scores_come_in_slices_of_bounded_rows(spark, monkeypatch):
    whole = vectors._by_length

    def watched(column, unit):
        if len(column) > 1024:
            raise ValueError(f"{len(column)} rows at once")
        return whole(column, unit)

    rows = checkpoint(spark.range(6000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0), (F.col("id") % 7).cast("double")).alias("vector")).coalesce(1))
    q = rows.where("id > 0 and id % 1000 = 0").select(F.col("id").alias("query_id"), "vector")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6000")  # the slices bind, whatever the batches
    try:
        monkeypatch.setattr(vectors, "_by_length", watched)
        found = vectors.dense_topk(q, rows, 3, unit=False).where("rank = 0").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {(r["query_id"], r["id"]) for r in found} == {(i, 5999) for i in range(1000, 6000, 1000)}
