"""Operator 1, exact top-k inner-product search with two cover trees.

Queries and data are both indexed: a node covers its points by a centre and a measured radius; its children's centres
are a net of its points (farthest-first, so they are separated by at least the radius they cover), and each child
takes the points it is nearest to. A pair (query node, data node) holds no score above

    <cq, cd> + rq |cd| + rd |cq| + rq rd

and goes when that is below the worst k-th score among the node's queries (equal bounds stay, as ties go by id).

Scale: the queries are a stated set. They are searched in blocks of about `QUERY_BLOCK`, one block after another, so that
what comes to the driver and is broadcast at a time is bounded whatever the table's size; for each block one map-only pass over the data builds trees over `DATA_BLOCK` rows
at a time and keeps k rows a query and task, which then meet in a window that Spark limits before its shuffle.

Defined results: vectors that are null or hold null or non-finite components take no part, nor does a null vec_id;
only vectors of one length meet; a candidate with the query's own vec_id is the query's own; repeated rows are
candidates each, equal queries (id and vector) are one query; scores beyond a long are clipped to it; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K, EVERY, SCALE = 10, 100, 1024.0
QUERY_BLOCK, DATA_BLOCK = 4096, 1 << 16
#: Rows of a leaf, queries of a leaf (few, so that a group's bound is tight), children of a node.
LEAF, QUERY_LEAF, FANOUT = 96, 8, 12
EXACT = float(1 << 53)


class Node:
    __slots__ = ("centre", "norm", "radius", "rows", "kids")

    def __init__(self, centre: np.ndarray, radius: float, rows: np.ndarray, kids: list):
        self.centre, self.radius, self.rows, self.kids = centre, radius, rows, kids
        self.norm = float(np.sqrt((centre * centre).sum()))


def build(points: np.ndarray, rows: np.ndarray | None = None, centre: np.ndarray | None = None, far: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Cover tree over points[rows]; far: the rows' distances to the centre."""
    if rows is None:
        rows = np.arange(len(points))
    if centre is None:
        centre = points[rows[0]]
    if far is None:
        far = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
    radius = float(far.max())
    if len(rows) <= leaf or radius == 0:
        return Node(centre, radius, rows, [])
    own = points[rows]
    centres, nearest, owner = [centre], far.copy(), np.zeros(len(rows), np.int32)
    while len(centres) < FANOUT:
        at = int(nearest.argmax())
        if nearest[at] <= radius / 4 or nearest[at] == 0:
            break
        new = own[at]
        d = np.sqrt(((own - new) ** 2).sum(axis=1))
        closer = d < nearest
        owner[closer] = len(centres)
        nearest = np.where(closer, d, nearest)
        centres.append(new)
    if len(centres) == 1:
        return Node(centre, radius, rows, [])
    kids = []
    for k, c in enumerate(centres):
        mine = owner == k
        if mine.any():
            kids.append(build(points, rows[mine], c, nearest[mine], leaf))
    return Node(centre, radius, rows, kids)


class Search:
    """Best k candidates of each query so far; data blocks are searched one after another."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.tree = build(vectors, leaf=QUERY_LEAF) if len(ids) else None
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.largest = float(np.abs(vectors).max(initial=0.0))
        self.wide: dict[int, list[tuple[int, int]]] = {}  # exact integers, where doubles don't hold the scores

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if self.tree is None or not len(ids):
            return
        if self.wide or vectors.shape[1] * self.largest * float(np.abs(vectors).max(initial=0.0)) >= EXACT:
            self.add_wide(ids, vectors)
            return
        self.search(self.tree, build(vectors), ids, vectors)

    def add_wide(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        data = [[int(x) for x in v] for v in vectors]
        for q, own in enumerate(self.ids.tolist()):
            query = [int(x) for x in self.vectors[q]]
            best = self.wide.get(q) or [(int(s), int(i)) for s, i in zip(self.scores[q], self.found[q], strict=True) if s > -np.inf]
            best += [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(query, v, strict=True)))), i) for i, v in zip(ids.tolist(), data, strict=True) if i != own]
            self.wide[q] = sorted(best, key=lambda x: (-x[0], x[1]))[: self.k]

    def search(self, queries: Node, data: Node, ids: np.ndarray, vectors: np.ndarray) -> None:
        stack = [(np.inf, queries, data)]
        while stack:
            bound, q, d = stack.pop()
            if bound < self.scores[q.rows, -1].min():
                continue
            if not q.kids and not d.kids:
                self.base(q.rows, d.rows, ids, vectors)
                continue
            if q.kids and (not d.kids or q.radius >= d.radius):
                pairs = [(x, d) for x in q.kids]
            else:
                pairs = [(q, x) for x in d.kids]
            bounds = [float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius for a, b in pairs]
            stack += [(bounds[i] * (1 + 1e-9) + 1e-3 if bounds[i] > 0 else bounds[i] * (1 - 1e-9) + 1e-3, *pairs[i]) for i in np.argsort(bounds, kind="stable")]

    def base(self, q_rows: np.ndarray, d_rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Scores of a group of queries against a group of rows; ties go to smaller ids."""
        k = self.k
        for lo in range(0, len(d_rows), 4096):
            rows = d_rows[lo : lo + 4096]
            scores, names = self.vectors[q_rows] @ vectors[rows].T, ids[rows]
            for q, s in zip(q_rows.tolist(), scores, strict=True):
                good = s >= self.scores[q, -1]
                good &= names != self.ids[q]
                if not good.any():
                    continue
                both = np.concatenate((self.scores[q], s[good]))
                who = np.concatenate((self.found[q], names[good]))
                if len(both) > 8 * k:  # all that can be among the k, ties included
                    least = np.partition(both, len(both) - k)[len(both) - k]
                    both, who = both[both >= least], who[both >= least]
                order = np.lexsort((who, -both))[:k]
                self.scores[q], self.found[q] = both[order], who[order]

    def results(self) -> Iterator[tuple[int, int, int]]:
        """(place of the query, vec_id, score)."""
        for q in range(len(self.ids)):
            if q in self.wide:
                yield from ((q, i, s) for s, i in self.wide[q])
            else:
                yield from ((q, int(i), int(s)) for s, i in zip(self.scores[q], self.found[q], strict=True) if s > -np.inf)


def quantised(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and floor(1024 x) of the usable vectors."""
    usable = pc.and_(pc.is_valid(ids), pc.is_valid(vectors))
    ids, vectors = ids.filter(usable), vectors.filter(usable)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")), np.float64)
    names = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        x = values[starts[at][:, None] + np.arange(d)[None, :]]
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * x)
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            out[d] = names[at][fine], x[fine]
    return out


def top_k(rows: DataFrame, every: int = EVERY, k: int = K, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score over rows(vec_id, embedding); queries are the rows with vec_id divisible by every."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b)
        one, shared = search_block(rows, block, k, data_block, b)
        if one is None:
            continue
        if blocks > 1:  # one block after another: its few rows are written, what was broadcast for it goes
            one = written(one, "topk")
            shared.destroy()
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_block(rows: DataFrame, queries: DataFrame, k: int, data_block: int, block: int) -> tuple[DataFrame | None, Broadcast | None]:
    """(query (its number, by block, length and place), query_id, vec_id, score: the best k of each query in each task; what it broadcasts)."""
    held = queries.toArrow().combine_chunks()  # about QUERY_BLOCK vectors
    if not held.num_rows:
        return None, None
    column = lambda name: held.column(name).combine_chunks()
    by_length = quantised(column("vec_id"), column("embedding"))
    if not by_length:
        return None, None
    shared = rows.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: Search(ids, x, k) for d, (ids, x) in shared.value.items()}
        waiting: dict[int, list] = {d: [] for d in searches}

        def flush(d: int) -> None:
            if waiting[d]:
                searches[d].add(np.concatenate([w[0] for w in waiting[d]]), np.concatenate([w[1] for w in waiting[d]]))
                waiting[d] = []

        for b in batches:
            for d, (ids, x) in quantised(b.column(0), b.column(1)).items():
                if d in searches:
                    waiting[d].append((ids, x))
                    if sum(len(w[0]) for w in waiting[d]) >= data_block:
                        flush(d)
        out = []
        for d, s in searches.items():
            flush(d)
            out += [((block << 40) + (d << 24) + q, int(s.ids[q]), i, v) for q, i, v in s.results()]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query long, query_id long, vec_id long, score long"), shared


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of a query and a row.
ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v AS q JOIN v AS d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
