"""Lexical scores by blocks: the queries' weights as a matrix, texts as batches of counted tokens, top-k a batch.

A score is the sum over shared tokens of (1 + ln count in the query) x (1 + ln count in the text). Queries come to the tasks
in blocks of bounded size; a batch of texts meets a block in one matrix product, so no row for a (query, text) pair exists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import SCORES, Best, sliced
from .text import tokenize

DIGITS = 6
QUERY_BLOCK = 512
#: Cells of a dense matrix held at once.
CELLS = 1 << 20
APART = "[^a-z0-9]+"


@dataclass
class Asked:
    """A block of queries: their ids, the block's tokens, and for each token its queries and their weights, one after another."""

    names: np.ndarray
    tokens: pa.Array
    starts: np.ndarray
    queries: np.ndarray
    weights: np.ndarray

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Weights of these tokens (by code) for all queries."""
        out = np.zeros((len(codes), len(self.names)))
        for i, c in enumerate(codes.tolist()):
            part = slice(self.starts[c], self.starts[c + 1])
            out[i, self.queries[part]] = self.weights[part]
        return out


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, token, qtf."""
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[Asked]:
    """Blocks of about `size` queries; each holds a row a query and distinct token."""
    n = max(1, -(-queries.count() // size))
    for block in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block)
        held = query_terms(part).toArrow()
        if not held.num_rows:
            continue
        names, at = np.unique(held.column("query_id").to_numpy(), return_inverse=True)
        encoded = held.column("token").combine_chunks().dictionary_encode()
        encoded = encoded.chunk(0) if isinstance(encoded, pa.ChunkedArray) else encoded
        code, weight = encoded.indices.to_numpy(), 1.0 + np.log(held.column("qtf").to_numpy().astype(np.float64))
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(encoded.dictionary) + 1))
        yield Asked(names, encoded.dictionary, starts, at[order], weight[order])


def counted(texts: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token's code and count of the tokens that occur in lower-case texts; other tokens are left out."""
    parts = pc.split_pattern_regex(texts, APART)
    rows, codes = pc.list_parent_indices(parts).to_numpy(), pc.index_in(pc.list_flatten(parts), value_set=tokens)
    known = codes.is_valid().to_numpy(zero_copy_only=False)
    keys, n = np.unique(rows[known].astype(np.int64) * len(tokens) + codes.drop_null().to_numpy(), return_counts=True)
    return keys // len(tokens), keys % len(tokens), n


def products(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, n: int, asked: Asked) -> np.ndarray:
    """Scores of n texts (rows sorted) for all queries of a block."""
    out = np.zeros((n, len(asked.names)))
    low = 0
    while low < n:
        first = np.searchsorted(rows, low)
        used = np.unique(codes[first : np.searchsorted(rows, min(n, low + 256))])
        high = min(n, low + max(1, min(256, CELLS // max(1, len(used)))))
        part = slice(first, np.searchsorted(rows, high))
        used, at = np.unique(codes[part], return_inverse=True)
        matrix = np.zeros((high - low, len(used)))
        matrix[rows[part] - low, at] = 1.0 + np.log(counts[part].astype(np.float64))
        out[low:high] = matrix @ asked.rows(used)
        low = high
    return np.round(out, DIGITS)


def best_pairs(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, query) places of each query's k best positive scores, with all that tie with the k-th."""
    n = scores.shape[0]
    if not n:
        return np.empty(0, int), np.empty(0, int)
    least = np.partition(scores, n - min(k, n), axis=0)[n - min(k, n)]
    return np.nonzero((scores >= least) & (scores > 0))


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, chunk_id, score, rank (from 0) of the best positive scores: one map-only pass over the texts for each block of queries."""
    spark = chunks.sparkSession
    kind = chunks.schema["chunk_id"].dataType
    source = chunks.select("chunk_id", F.lower("text").alias("text"))
    schema = f"query_id long, chunk_id {kind.simpleString()}, score double"
    found = None
    for asked in blocks(queries, query_block):
        shared = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            best = Best(len(asked.names), k)
            for b in sliced(batches, 1, max(16, min(256, SCORES // len(asked.names)))):
                scores = products(*counted(b.column(1), asked.tokens), b.num_rows, asked)
                of, at = best.places(np.where(scores > 0, scores, -1.0).T)
                some = scores[at, of] > 0
                at, of = at[some], of[some]
                if not len(at):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(asked.names[of]), b.column(0).take(pa.array(at)), pa.array(scores[at, of])], names=["query_id", "chunk_id", "score"])

        one = source.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
