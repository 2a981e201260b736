"""The pipeline's stages one by one on a small table."""

import corpus_pipeline
from pyspark.sql import functions as F

from sievework.llm import op2_secrets, op5_lines, op6_minhash, op7_quality
from sievework.llm.common import table, written


def test_stages_take_effect(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    columns = docs.columns
    first = written(corpus_pipeline.quality_classifier(spark, docs, sf_small), "t1")
    kept = {r["doc_id"] for r in op7_quality.resample(docs, table(spark, sf_small, "labels")).collect() if r["kept"]}
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == kept and 0 < len(kept) < docs.count()
    second = written(corpus_pipeline.quality_rules(spark, first, sf_small), "t2")
    assert second.columns == columns
    assert {r["doc_id"] for r in second.collect()} == {r["doc_id"] for r in op5_lines.judged(first).collect() if r["kept"]}
    third = written(corpus_pipeline.near_dedup(spark, second, sf_small), "t3")
    assert {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in op6_minhash.near_duplicates(second, op6_minhash.STAGE_PER_CENT).collect() if r["kept"]}
    fourth = written(corpus_pipeline.secret_scan(spark, third, sf_small), "t4")
    assert fourth.columns == columns and fourth.count() == third.count()
    assert all(not op2_secrets.scan(r["text"])[0] and r["n_chars"] == len(r["text"]) for r in fourth.collect())
    last = corpus_pipeline.packing(spark, fourth, sf_small).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in third.collect()}
    assert len(corpus_pipeline.run(spark, sf_small).collect()) == len(last)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "secret_scan", "packing"]


def test_columns_of_any_name_pass_the_stages(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    extra = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("host", "fp", "log_weight", "sample_key", "_text", "_pos", "_d", "pos", "n", "h", "gone", "cluster", "bucket", "label", "doc id")}
    wide = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = {tuple(r) for r in stage(spark, docs, sf_small).collect()}
        out = stage(spark, wide, sf_small)
        assert out.columns == wide.columns and out.schema == wide.schema, name
        rows = out.collect()
        assert {tuple(r[c] for c in docs.columns) for r in rows} == plain, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in extra), name


def test_nulls_and_repeated_rows(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    text = docs.orderBy("doc_id").first()["text"]
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, text, "en", "s", 5), (None, text, "en", "s", 5), (7, text, "en", None, 5), (7, text, "en", None, 5), (8, text, "en", "s", 5), (9, "x" * 300_000, "en", "s", 300_000)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_small).schema == odd.schema, name
    got = sorted((r["doc_id"] or -1 for r in corpus_pipeline.near_dedup(spark, odd, sf_small).collect()))
    assert got == [-1, -1, 1, 2, 7, 9]
    assert corpus_pipeline.secret_scan(spark, odd, sf_small).count() == 8
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, odd, sf_small).collect()} == {None, 1, 2, 7, 8, 9}


def test_empty_table(spark, sf_small, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "labels"):
        table(spark, sf_small, name).limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
