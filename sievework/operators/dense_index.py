"""Stored vectors in blocks around centres, and exact cosine search that skips blocks by a bound.

build() gives every vector of unit length to the nearest of `CENTRES` centres (a bounded sample, moved to the means of their
members `ROUNDS` times) and lays the rows out by centre and angle to it: a block is a folder of vectors that have one centre
and whose angles lie between two numbers, so a crowded centre is many rings. The directory has a row a block.

A query at an angle of t to a centre is at least t - high, and low - t, away from all vectors of a ring [low, high], so the cosine of
the greater of these bounds the block's scores. search() scores each query's most promising blocks first, takes the k-th score as
the least that counts, and then reads only blocks whose bound reaches it. Results are those of a full pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import _by_length, _whole
from ..session import checkpoint

CENTRES, SAMPLE, ROUNDS = 64, 8192, 4
#: Rows a block should have; a block has at least one.
BLOCK_ROWS = 65_536
DIGITS, SLACK = 6, 1e-5


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    size = np.sqrt((x * x).sum(axis=1))
    return x / np.where(size == 0, 1.0, size)[:, None]


def centres_of(rows: DataFrame, n: int = CENTRES, sample: int = SAMPLE) -> np.ndarray:
    """Centres of unit length from the `sample` rows with the least hashes of their ids: the first n, moved to their members' means."""
    held = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()  # bounded
    found = _by_length(_whole(held.column("vector")), True)
    if not found:
        return np.zeros((0, 0))
    x = max((v for _, v in found.values()), key=len)
    centres = x[:n].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                mean = x[near == c].mean(axis=0)
                centres[c] = mean / (np.linalg.norm(mean) or 1.0)
    return centres


def build(rows: DataFrame, path: str, n_centres: int = CENTRES, block_rows: int = BLOCK_ROWS) -> None:
    """Writes rows(id, vector, ...) below path; null, empty, non-finite vectors and those of another length than the centres' stay out."""
    spark = rows.sparkSession
    usable = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | F.abs(v).isin(float("inf"))))
    centres = centres_of(usable, n_centres)
    shared = spark.sparkContext.broadcast(centres)
    at = rows.columns.index("vector")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, (places, x) in _by_length(b.column(at), True).items():
                if length != shared.value.shape[1]:
                    continue
                cosines = np.clip(x @ shared.value.T, -1.0, 1.0)
                near = np.argmax(cosines, axis=1)
                angles = np.arccos(cosines[np.arange(len(x)), near])
                part = b.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(angles), *part.columns], names=["centre", "angle", *b.schema.names])

    placed = checkpoint(usable.mapInArrow(run, f"centre int, angle double, {fields}"))
    total = placed.count()
    rings = max(1, -(-total // block_rows))
    ordered = placed.repartitionByRange(max(rings, 1), "centre", "angle", "id").withColumn("block", F.concat_ws("-", "centre", F.spark_partition_id()))
    held = checkpoint(ordered)
    held.write.mode("overwrite").partitionBy("block").parquet(f"{path}/vectors")
    table = pa.table({"centre": np.arange(len(centres), dtype=np.int32), "vector": pa.array(list(centres), pa.list_(pa.float64()))})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    directory = held.groupBy("block", "centre").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    directory.coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")  # last: where it is, the index is whole


class DenseIndex:
    """Search over vectors that build() wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.blocks = spark.read.parquet(f"{path}/blocks").orderBy("block").toArrow()  # a row a file
        # Without rows there is no folder to take columns from.
        self.vectors = spark.read.parquet(f"{path}/vectors").withColumn("block", F.col("block").cast("string")) if self.blocks.num_rows else spark.createDataFrame([], "block string, id long, vector array<double>")
        centres = spark.read.parquet(f"{path}/centres").orderBy("centre").toArrow()
        self.centres = np.array(centres.column("vector").to_pylist()) if centres.num_rows else np.zeros((0, 0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest cosine that a vector of each block can have with each query (query, block)."""
        angles = np.arccos(np.clip(queries @ self.centres.T, -1.0, 1.0))[:, self.blocks.column("centre").to_numpy()]
        low, high = self.blocks.column("low").to_numpy(), self.blocks.column("high").to_numpy()
        apart = np.maximum(np.maximum(angles - high, low - angles), 0.0)
        return np.cos(np.minimum(apart, np.pi))

    def _scored(self, names: np.ndarray, vectors: np.ndarray, wanted: np.ndarray, k: int, visible) -> DataFrame | None:
        """query_id, id, score of the k best of every wanted (query, block)."""
        labels = np.array(self.blocks.column("block").to_pylist(), object)
        chosen = {labels[j]: np.flatnonzero(wanted[:, j]) for j in np.flatnonzero(wanted.any(axis=0))}
        if not chosen:
            return None
        shared = self.spark.sparkContext.broadcast((names, vectors, chosen))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked, chosen = shared.value
            for b in batches:
                labels = np.array(b.column(0).to_pylist(), object)
                for label in np.unique(labels):
                    of = chosen.get(label)
                    if of is None:
                        continue
                    part = b.filter(pa.array(labels == label))
                    for length, (at, x) in _by_length(part.column(2), True).items():
                        if length != asked.shape[1]:
                            continue
                        scores = np.round(asked[of] @ x.T, DIGITS) + 0.0
                        keep = min(k, scores.shape[1])
                        least = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
                        q, i = np.nonzero(scores >= least[:, None])
                        yield pa.RecordBatch.from_arrays([pa.array(names[of][q]), part.column(1).take(pa.array(at[i])), pa.array(scores[q, i])], names=["query_id", "id", "score"])

        rows = self.vectors.where(F.col("block").isin(list(chosen)))  # folders that no query wants aren't read
        rows = rows if visible is None else rows.where(visible)
        kind = self.vectors.schema["id"].dataType.simpleString()
        return rows.select("block", "id", "vector").mapInArrow(run, f"query_id long, id {kind}, score double")

    def search(self, queries: DataFrame, k: int, visible=None, query_block: int = 4096) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, score, rank from 0 of the k nearest by cosine; query_id, blocks, scored) of queries(query_id, vector)."""
        kind = self.vectors.schema["id"].dataType.simpleString()
        schema = f"query_id long, id {kind}, score double"
        found, counts = self.spark.createDataFrame([], schema), self.spark.createDataFrame([], "query_id long, blocks long, scored long")
        n = max(1, -(-queries.count() // query_block))
        for block in range(n):
            part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block)
            held = part.select("query_id", "vector").toArrow()
            usable = _by_length(_whole(held.column("vector")), True).get(self.centres.shape[1]) if held.num_rows else None
            if usable is None or not self.blocks.num_rows:
                continue
            names, vectors = held.column("query_id").to_numpy()[usable[0]], usable[1]
            bounds = self.bounds(vectors)
            order = np.argsort(-bounds, axis=1, kind="stable")
            sizes = self.blocks.column("n").to_numpy()[order]
            enough = np.cumsum(sizes, axis=1) - sizes < k  # blocks until k rows are met
            wanted = np.zeros(bounds.shape, bool)
            np.put_along_axis(wanted, order, enough, axis=1)
            first = checkpoint(self._scored(names, vectors, wanted, k, visible))
            w = Window.partitionBy("query_id").orderBy(F.desc("score"))
            least = first.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("query_id", "score").toArrow()  # a number a query
            floor = dict(zip(least.column("query_id").to_pylist(), least.column("score").to_pylist(), strict=True))
            rest = (bounds + SLACK >= np.array([floor.get(q, -2.0) for q in names.tolist()])[:, None]) & ~wanted
            second = self._scored(names, vectors, rest, k, visible)
            found = found.unionByName(first if second is None else first.unionByName(second))
            scored = wanted.sum(axis=1) + rest.sum(axis=1)
            counts = counts.unionByName(self.spark.createDataFrame(pa.table({"query_id": names, "blocks": np.full(len(names), bounds.shape[1]), "scored": scored})))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1), counts
