"""A stored inverted index over chunks in spans, with each token's greatest count a span, and search that skips spans.

build() orders chunks by length class and then by their least token hash (texts of one language, and copies, lie together), and
cuts the order into spans of `SPAN` chunks. A row of the index is a token of a span: the chunks that have it and how often. A
frequent token thus has a row in each span and is never one long list. Segments of `SEGMENT` spans are folders, so a search
reads the segments that it needs.

search() works in three steps for each block of queries: the bounds of all spans (from the greatest counts alone, a narrow read of
the index), exact scores of each query's most promising spans, which give a k-th score from below, and exact scores of the spans
whose bound reaches it. Bounds are rows of (query, span), never of (query, chunk); results are the same as without an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexical import APART, Asked, best_pairs, blocks, products
from ..functions.text import tokenize
from ..session import checkpoint

SPAN, SEGMENT, SEEDS = 256, 64, 2
#: Bounds are sums in another order than scores, which are rounded.
SLACK = 2e-6


def _inverted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in order, where each one's entries start, and the entries: place of the text and count."""
    parts = pc.split_pattern_regex(texts, APART)
    flat, rows = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    some = pc.not_equal(flat, "")
    encoded = flat.filter(some).dictionary_encode()
    tokens = encoded.dictionary
    order = pc.sort_indices(tokens).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys, n = np.unique(place[encoded.indices.to_numpy()] * len(texts) + rows[some.to_numpy(zero_copy_only=False)], return_counts=True)
    return tokens.take(pa.array(order)), np.searchsorted(keys // len(texts), np.arange(len(order) + 1)), (keys % len(texts)).astype(np.int16), n.astype(np.int32)


def build(chunks: DataFrame, path: str, span: int = SPAN, segment: int = SEGMENT) -> None:
    """Writes the index of chunks(chunk_id, text, ...) below path: its rows, and the chunks' other columns with their place.

    A null or empty text has no tokens; the rows of a repeated chunk_id are indexed each.
    """
    tokens = tokenize(F.coalesce("text", F.lit("")))
    band = -F.floor(F.log2(F.size(tokens) + 1))
    least = F.array_min(F.transform(tokens, lambda t: F.xxhash64(t)))
    kept = [c for c in chunks.columns if c != "text"]
    keyed = chunks.select(*(F.col(c) for c in kept), F.lower(F.coalesce("text", F.lit(""))).alias("_text"), band.alias("_band"), least.alias("_least"))
    order = ("_band", "_least", "chunk_id")
    at = len(kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*kept).schema)
    layout = pa.struct([("token", pa.string()), ("places", pa.list_(pa.int16())), ("counts", pa.list_(pa.int32())), ("most", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held = TaskContext.get().partitionId() << 32, 0, []

        def spans(rows: pa.Table) -> pa.RecordBatch:
            token, starts, places, counts = _inverted(rows.column(at).combine_chunks())
            if len(token):
                ends = pa.array(starts.astype(np.int32))
                most = np.maximum.reduceat(counts, starts[:-1])
                postings = pa.StructArray.from_arrays([token, pa.ListArray.from_arrays(ends, pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(counts)), pa.array(most)], fields=list(layout))
            else:
                postings = pa.array([], layout)
            names = rows.select(range(at)).combine_chunks().to_struct_array()
            names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
            return pa.RecordBatch.from_arrays([pa.array([first + number]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.ListArray.from_arrays(pa.array([0, len(postings)], pa.int32()), postings)], names=["span", "chunks", "postings"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < span:
                continue
            rows = pa.Table.from_batches(held)
            while rows.num_rows >= span:
                yield spans(rows.slice(0, span))
                rows, number = rows.slice(span), number + 1
            held = rows.to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield spans(rows)

    made = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"span long, chunks array<struct<{_struct(fields)}>>, postings array<struct<token: string, places: array<smallint>, counts: array<int>, most: int>>")
    folder = F.concat_ws("-", F.shiftright("span", 32), F.floor((F.col("span") % (1 << 32)) / segment)).alias("segment")
    held = checkpoint(made.select(folder, "*"))
    # One task a segment at most writes its folder: a few files however many partitions there were.
    held.select("segment", "span", F.inline("postings")).repartition("segment").sortWithinPartitions("segment", "span", "token").write.mode("overwrite").partitionBy("segment").parquet(f"{path}/postings")
    held.select("segment", "span", F.posexplode("chunks").alias("place", "c")).select("segment", "span", "place", "c.*").write.mode("overwrite").parquet(f"{path}/chunks")


def _struct(fields: str) -> str:
    return fields.replace("` ", "`: ")


class SparseIndex:
    """Search over an index that build() wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.postings = spark.read.schema("span long, token string, places array<smallint>, counts array<int>, most int, segment string").parquet(f"{path}/postings")
        self.chunks = spark.read.parquet(f"{path}/chunks")

    def bounds(self, asked) -> DataFrame:
        """query (place in the block), segment, span, bound of the spans that share a token with a query."""
        shared = self.spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked: Asked = shared.value
            for b in batches:
                codes = pc.index_in(b.column(2), value_set=asked.tokens)
                known = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
                if not len(known):
                    continue
                spans, codes, most = b.column(1).to_numpy()[known], codes.drop_null().to_numpy(), b.column(3).to_numpy()[known]
                names, where, at = np.unique(spans, return_index=True, return_inverse=True)
                sums = np.zeros((len(names), len(asked.names)))
                for low in range(0, len(at), 1024):
                    part = slice(low, low + 1024)
                    np.add.at(sums, at[part], asked.rows(codes[part]) * (1.0 + np.log(most[part].astype(np.float64)))[:, None])
                i, q = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(q), b.column(0).take(pa.array(known[where][i])), pa.array(names[i]), pa.array(sums[i, q])], names=["query", "segment", "span", "bound"])

        narrow = self.postings.select("segment", "span", "token", "most").mapInArrow(run, "query long, segment string, span long, bound double")
        return narrow.groupBy("query", "segment", "span").agg(F.sum("bound").alias("bound"))

    def scores(self, asked, wanted: DataFrame, k: int, visible: DataFrame | None) -> DataFrame:
        """query, span, place, score of the k best chunks (and ties) of each wanted(query, segment, span)."""
        shared = self.spark.sparkContext.broadcast(asked)
        words = self.spark.createDataFrame(pa.table({"token": asked.tokens}))
        segments = [r[0] for r in wanted.select("segment").distinct().collect()]  # folders, as many as the driver lists anyway
        spans = wanted.groupBy("span").agg(F.collect_list("query").alias("queries"))
        rows = self.postings.where(F.col("segment").isin(segments)).join(spans.select("span"), "span", "left_semi").join(words, "token", "left_semi").select("span", "token", "places", "counts")
        if visible is not None:
            spans = spans.join(visible.groupBy("span").agg(F.collect_list("place").alias("visible")), "span")
        else:
            spans = spans.withColumn("visible", F.lit(None).cast("array<int>"))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            asked: Asked = shared.value
            empty = pa.table({"query": pa.array([], pa.int64()), "span": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})
            if not right.num_rows or not left.num_rows:
                return empty
            places, sizes = pc.list_flatten(left.column("places")).to_numpy().astype(np.int64), pc.list_value_length(left.column("places")).to_numpy()
            codes = np.repeat(pc.index_in(left.column("token"), value_set=asked.tokens).to_numpy(), sizes)
            counts = pc.list_flatten(left.column("counts")).to_numpy()
            order = np.lexsort((codes, places))
            n = int(places.max()) + 1
            wanted = np.array(right.column("queries")[0].as_py())
            scores = products(places[order], codes[order], counts[order], n, asked)[:, wanted]
            if right.column("visible")[0].is_valid:
                hidden = np.ones(n, bool)
                seen = np.array(right.column("visible")[0].as_py(), np.int64)
                hidden[seen[seen < n]] = False
                scores[hidden] = 0.0
            at, of = best_pairs(scores, k)
            return pa.table({"query": wanted[of], "span": np.full(len(at), right.column("span")[0].as_py()), "place": at.astype(np.int32), "score": scores[at, of]})

        return rows.groupBy("span").cogroup(spans.groupBy("span")).applyInArrow(run, "query long, span long, place int, score double")

    def search(self, queries: DataFrame, k: int, visible=None, query_block: int = 512) -> tuple[DataFrame, DataFrame]:
        """(query_id, chunk_id, score, rank of the k best positive scores; query_id, spans, scored: how many spans shared a token and how many were scored).

        visible, a condition on the chunks' columns, acts before any score counts.
        """
        shown = None if visible is None else checkpoint(self.chunks.where(visible).select("span", "place"))
        found, counts = [], []
        for asked in blocks(queries, query_block):
            bounds = checkpoint(self.bounds(asked))
            order = Window.partitionBy("query").orderBy(F.desc("bound"), "span")
            seeds = checkpoint(bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEEDS).select("query", "segment", "span"))
            first = checkpoint(self.scores(asked, seeds, k, shown))
            best = Window.partitionBy("query").orderBy(F.desc("score"))
            least = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query", F.col("score").alias("least"))
            rest = bounds.join(seeds, ["query", "span"], "left_anti").join(least, "query", "left").where(F.col("bound") + SLACK >= F.coalesce("least", F.lit(0.0)))
            rest = checkpoint(rest.select("query", "segment", "span"))
            second = self.scores(asked, rest, k, shown)
            names = self.spark.createDataFrame(pa.table({"query": np.arange(len(asked.names)), "query_id": asked.names}))
            found.append(first.unionByName(second).join(names, "query").drop("query"))
            scored = seeds.unionByName(rest).groupBy("query").agg(F.count("*").alias("scored"))
            counts.append(bounds.groupBy("query").agg(F.count("*").alias("spans")).join(scored, "query", "left").join(names, "query").select("query_id", "spans", F.coalesce("scored", F.lit(0)).alias("scored")))
        kind = self.chunks.schema["chunk_id"].dataType.simpleString()
        if not found:
            return self.spark.createDataFrame([], f"query_id long, chunk_id {kind}, score double, rank int"), self.spark.createDataFrame([], "query_id long, spans long, scored long")
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        # Ties beyond the k-th in a span were kept; the ids that decide them are fetched for rows that can still be among the k.
        cut = Window.partitionBy("query_id").orderBy(F.desc("score"))
        rows = rows.withColumn("r", F.rank().over(cut)).where(F.col("r") <= k).drop("r")
        named = rows.join(self.chunks.select("span", "place", "chunk_id"), ["span", "place"])
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        top = named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", (F.col("rank") - 1).alias("rank"))
        stats = counts[0]
        for more in counts[1:]:
            stats = stats.unionByName(more)
        return top, stats
