"""Stateful and windowed streams over files, run to their end."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from sievework.streaming import stateful

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def drained(spark, stream, name, mode="append"):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def source(spark, tmp_path, name, rows, schema):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
        for f in glob.glob(f"{tmp_path}/{name}/{k}/*.parquet"):  # files are taken by age
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def test_admission(spark, tmp_path):
    at = [0, 0, 0, 61]
    rows = [[(1, i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(at[:2])], [(1, 2, T0), (2, 9, T0)], [(1, 3, T0 + dt.timedelta(seconds=61))]]
    stream = source(spark, tmp_path, "a", rows, "user_id long, id long, at timestamp")
    got = {(r["user_id"], r["id"]): r["allowed"] for r in drained(spark, stateful.admission(stream, 2, 60), "admission")}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): False, (2, 9): True, (1, 3): True}


def test_feedback(spark, tmp_path):
    rows = [[(1, T0, 1.0)], [(1, T0 + dt.timedelta(seconds=5), 1.0), (2, T0, -1.0)]]
    stream = source(spark, tmp_path, "f", rows, "doc_id long, at timestamp, delta double")
    got = {(r["doc_id"], r["n"]): round(r["feedback_score"], 6) for r in drained(spark, stateful.feedback_stream(stream), "feedback", "update")}
    assert got == {(1, 1): 0.2, (1, 2): 0.36, (2, 1): -0.2}


def test_windows_drop_late_rows(spark, tmp_path):
    row = lambda m, v: (1, T0 + dt.timedelta(minutes=m), v)
    rows = [[row(1, 1.0), row(2, 2.0)], [row(200, 5.0)], [row(201, 5.0)], [row(3, 100.0), row(400, 1.0)]]
    stream = source(spark, tmp_path, "w", rows, "user_id long, ts timestamp, value double")
    got = {r["start"]: (r["n"], r["total"]) for r in drained(spark, stateful.tumbling(stream, "1 hour", "10 minutes"), "tumbling")}
    assert got[T0] == (2, 3.0)


def test_batches_merge_into_a_table(spark, tmp_path):
    seen = {}

    def apply(batch, epoch):
        for r in batch.groupBy("doc_id").agg(F.sum("delta").alias("s")).collect():
            seen[r["doc_id"]] = seen.get(r["doc_id"], 0.0) + r["s"]

    stream = source(spark, tmp_path, "m", [[(1, T0, 1.0)], [(1, T0, 2.0)]], "doc_id long, at timestamp, delta double")
    q = stream.writeStream.foreachBatch(stateful.merge_batches(apply)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == {1: 3.0}
