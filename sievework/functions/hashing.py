"""SimHash over shingles, in SQL functions (MD5) or by Arrow (BLAKE2b), bands and Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import sliced
from .text import shingles

BITS = 60


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def md5_bits(text: Column) -> Column:
    """The first 60 bits of MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def simhash(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp of each row: sign votes of all shingles' bits (repeats vote again, ties are 0).

    Shingles are hashed in the JVM; a slice's hashes are counted bit by bit over all its rows at once, and nothing is shuffled.
    """
    hashes = docs.select("doc_id", F.array_compact(F.transform(shingles(F.col("text"), k), md5_bits)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            column = b.column(1)
            votes, n = column.flatten().to_numpy(), np.asarray(pc.fill_null(pc.list_value_length(column), 0))
            starts = np.cumsum(n) - n
            fp = np.zeros(len(n), np.int64)
            some = n > 0
            for i in range(BITS if len(votes) else 0):
                for_it = np.add.reduceat((votes >> i) & 1, starts[some])
                fp[some] |= (2 * for_it > n[some]).astype(np.int64) << i
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, mask=np.asarray(column.is_null()))], names=["doc_id", "fp"])

    return hashes.mapInArrow(run, f"doc_id {hashes.schema['doc_id'].dataType.simpleString()}, fp long")


def simhash_blake(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp over 64 bits of BLAKE2b, as signed long: the reference's own fingerprint."""
    from .vectors import blake_hash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            out = []
            for s in b.column(1).to_pylist():
                votes = [0] * 64
                for x in s or []:
                    h = blake_hash(x)
                    for i in range(64):
                        votes[i] += 1 if h >> i & 1 else -1
                fp = sum(1 << i for i in range(64) if votes[i] > 0)
                out.append(fp - (1 << 64) if fp >> 63 else fp)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingles(F.col("text"), k).alias("s")).mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: Column, most: int, kept: int = 3) -> Column:
    """Keys (combination, bits): a fingerprint's 64 bits in most + kept blocks, each combination of `kept` blocks is one key.

    Two fingerprints at a distance of at most `most` differ in at most as many blocks, so they share one. With 3 of 6
    blocks a key has 30 bits and more: few fingerprints meet by chance, however many there are.
    """
    n = most + kept
    edges = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return F.array(*(F.struct(F.lit(c).alias("combination"), F.xxhash64(*(part[i] for i in blocks)).alias("bits")) for c, blocks in enumerate(combinations(range(n), kept))))
