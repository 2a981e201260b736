"""Vector functions: cosine as columns for few pairs, hashed embeddings, and block-wise dense top-k by matrix products."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import SCORES, Best, sliced
from .text import TOKEN

DIM, SPARSE_SPACE = 256, 1 << 20
_TOKEN = re.compile(TOKEN).findall
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Full cosine; a zero norm counts as one."""
    one = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def sparse_dot(a: Column, b: Column) -> Column:
    """Sum of products over the keys that two maps share."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.element_at(b, k))


def blake_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")


def md5_hash(token: str) -> int:
    """The first 60 bits of MD5, which SQL engines have too."""
    return int(hashlib.md5(token.encode()).hexdigest()[:15], 16)


def hashed_vectors(texts: list[str | None], dim: int = DIM, hashed: Callable[[str], int] = blake_hash, weights_too: bool = True) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
    """Rows of unit length (signed hashed bags of words, weights 1 + ln tf) and, if asked for, the unsigned weights by hashed token.

    Each different token of the batch is hashed once; the rows are filled by one scatter.
    """
    place: dict[str, int] = {}
    rows, tokens, weights = [], [], []
    for i, t in enumerate(texts):
        for token, tf in Counter(_TOKEN((t or "").lower())).items():
            rows.append(i)
            tokens.append(place.setdefault(token, len(place)))
            weights.append(1.0 + math.log(tf))
    slots = np.array([hashed(t) for t in place], dtype=object)
    axis = np.array([int(h % dim) for h in slots], np.int64)
    sign = np.array([1.0 - 2.0 * (hashed(t + "#") % 2) for t in place])
    dense = np.zeros((len(texts), dim))
    sparse: list[dict[int, float]] = [{} for _ in texts]
    if rows:
        at, w = np.array(tokens), np.array(weights)
        np.add.at(dense, (np.array(rows), axis[at]), sign[at] * w)
        for i, k, x in zip(rows, tokens, weights, strict=True) if weights_too else ():
            sparse[i][int(slots[k] % SPARSE_SPACE)] = x
    size = np.sqrt((dense * dense).sum(axis=1))
    return dense / np.where(size == 0, 1.0, size)[:, None], [list(s.items()) for s in sparse]


def embed_text(text: str | None, dim: int = DIM, hashed: Callable[[str], int] = blake_hash) -> tuple[list[float], dict[int, float]]:
    """hashed_vectors of one text."""
    dense, sparse = hashed_vectors([text], dim, hashed)
    return dense[0].tolist(), dict(sparse[0])


def embed(rows: DataFrame, text: str = "text", dim: int = DIM, hashed: Callable[[str], int] = blake_hash, backend: Callable | None = None, weights: bool = True) -> DataFrame:
    """rows with dense ARRAY<DOUBLE> and sparse MAP<INT, DOUBLE>; backend(list of texts) -> list of (dense, sparse) replaces the hashing one.

    Without weights there is no column sparse. Texts are embedded in slices of bounded rows and bytes.
    """
    from pyspark.sql import types as T

    at = rows.columns.index(text)
    made = [T.StructField("dense", T.ArrayType(T.DoubleType())), T.StructField("sparse", T.MapType(T.IntegerType(), T.DoubleType()))]
    schema = T.StructType([*rows.schema, *made[: 1 + weights]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            texts = b.column(at).to_pylist()
            if backend:
                out = backend(texts)
                dense, held = pa.array([d for d, _ in out], pa.list_(pa.float64())), [list(s.items()) for _, s in out]
            else:
                matrix, held = hashed_vectors(texts, dim, hashed, weights)
                dense = pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, dim, dtype=np.int32), matrix.ravel())
            new = [dense, pa.array(held, pa.map_(pa.int32(), pa.float64()))] if weights else [dense]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *("dense", "sparse")[: len(new)]])

    return rows.mapInArrow(run, schema)


def _by_length(column: pa.ListArray, unit: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and (unit-length) rows of the usable vectors by their length; null, empty and non-finite ones are left out."""
    offsets = column.offsets.to_numpy()  # of a slice, too
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    usable = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
    out = {}
    for n in np.unique(sizes[usable & (sizes > 0)]).tolist():
        at = np.flatnonzero(usable & (sizes == n))
        x = values[starts[at][:, None] + np.arange(n)]
        fine = np.isfinite(x).all(axis=1)
        at, x = at[fine], x[fine]
        if unit and len(at):
            size = np.sqrt((x * x).sum(axis=1))
            x = x / np.where(size == 0, 1.0, size)[:, None]
        if len(at):
            out[n] = at, x
    return out


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.ListArray:
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.chunk(0) if isinstance(one, pa.ChunkedArray) else one


def dense_topk(queries: DataFrame, rows: DataFrame, k: int, unit: bool = True, digits: int = 6, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank (from 0) of the k nearest rows(id, vector) of each of queries(query_id, vector).

    Queries come to the tasks in blocks of bounded size; each block is one map-only pass of matrix products over slices of
    rows that gives what reaches a query's k-th best score in the task so far, ties kept, so the window meets few rows. Filters on rows go before.
    Vectors of different lengths may be mixed, only those of one length meet; null or non-finite ones take no part.
    """
    spark = rows.sparkSession
    schema = f"query_id long, id {rows.schema['id'].dataType.simpleString()}, score double"
    n = queries.count()
    blocks = max(1, -(-n // query_block))
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held = part.select("query_id", "vector").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        ids = np.array(held.column("query_id").to_pylist(), np.int64)
        asked = {n: (ids[at], q) for n, (at, q) in _by_length(_whole(held.column("vector")), unit).items()}
        shared = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            best = {n: Best(len(names), k) for n, (names, _) in asked.items()}
            step = max(16, min(1024, SCORES // max((len(names) for names, _ in asked.values()), default=1)))
            for b in (b.slice(low, step) for b in batches for low in range(0, b.num_rows, step)):
                for n, (at, x) in _by_length(b.column(1), unit).items():
                    if n not in asked:  # only vectors of one length meet
                        continue
                    names, q = asked[n]
                    scores = np.round(q @ x.T, digits) + 0.0
                    qi, xi = best[n].places(scores)
                    if not len(qi):
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(names[qi]), b.column(0).take(pa.array(at[xi])), pa.array(scores[qi, xi])], names=["query_id", "id", "score"])

        one = rows.select("id", "vector").mapInArrow(run, schema)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], f"{schema}, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
