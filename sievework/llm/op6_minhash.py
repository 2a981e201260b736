"""Operator 6, MinHash near-duplicates with sequential Bayesian verification.

1. One map-only pass hashes each text's 5-word shingles, takes `BANDS` x `ROWS` MinHash values and one hash of the whole
   word sequence. Texts of equal word sequences become one representative, so exact copies cost nothing later.
2. Representatives that share a band with another one are candidates. Their clusters (connected through band
   buckets, not yet verified) hold every pair that may be linked; a pair at similarity 0.85 shares no band with a
   probability of 2e-8, one at 0.8 of 3e-6.
3. A cluster of up to `SMALL` texts is verified in one task. A larger one is verified in blocks: first all members
   against the `HUBS` members that share most buckets with others, then, where that left more than one component,
   the members outside the largest component against all blocks. Work on a large group of near copies is so linear
   as long as they have common neighbours, and exact in any case; no pair rows are ever made.
4. Verification compares signatures in batches of `BATCH` hashes. After each, a pair goes when the posterior
   probability (uniform prior) that its similarity reaches the threshold falls below `MISS`; survivors are
   confirmed on the full shingle sets. Pairs that are already connected are skipped, as only components count.
5. Components come from min-label propagation with pointer jumping over the confirmed links, in rounds of joins that
   are cut by written tables.

Hot keys: a band bucket, a group of equal texts or a hub may hold a third of all rows; such keys are aggregated
before the shuffle and looked up by salted joins.

Defined results: null or empty texts have no shingles, are linked with nothing and kept; fewer than five words are
one shingle; repeated rows of one doc_id are one document in several rows; an empty table gives no rows; extra
columns are neither read nor passed on; rows with a null doc_id come back unlinked with a null component and kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import merged, salted_join, table, written
from .word_bpe import Memo, enter

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: A link: PER_CENT * union <= 100 * intersection.
PER_CENT = 85
#: The pipeline's stage links from here.
STAGE_PER_CENT = 80
SHINGLE = 5
SMALL, BLOCK, HUBS = 512, 512, 32
BATCH, MISS = 16, 1e-9
_ODD = np.random.default_rng(6).integers(0, 1 << 63, size=(2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(w: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")


_words = Memo(_word_hash, 60_000)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's shingles: A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_words.__getitem__, words)), np.uint64)
    n = len(h)
    k = min(SHINGLE, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out * _P + h[i : n - k + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of a set of hashes."""
    out = np.empty(HASHES, np.uint32)
    for lo in range(0, HASHES, 8):
        a, b = _ODD[0, lo : lo + 8, None], _ODD[1, lo : lo + 8, None]
        least = np.full(8, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(shingles), 4096):
            x = shingles[None, at : at + 4096] ^ b
            x = x * a
            x ^= x >> np.uint64(32)
            x = x * a
            least = np.minimum(least, x.min(axis=1))
        out[lo : lo + 8] = (least >> np.uint64(32)).astype(np.uint32)
    return out


@lru_cache
def least_matches(n: int, per_cent: int = PER_CENT, miss: float = MISS) -> int:
    """The fewest matches in n hashes with P(similarity >= threshold | matches) >= miss under a uniform prior.

    P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, below = per_cent / 100, 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def survivors(sig: np.ndarray, others: np.ndarray, per_cent: int = PER_CENT) -> np.ndarray:
    """Places of the rows of others that no batch of hashes prunes against sig."""
    at, matches = np.arange(len(others)), np.zeros(len(others), np.int32)
    for lo in range(0, HASHES, BATCH):
        matches = matches + (others[at, lo : lo + BATCH] == sig[lo : lo + BATCH]).sum(axis=1)
        keep = matches >= least_matches(lo + BATCH, per_cent)
        at, matches = at[keep], matches[keep]
        if not len(at):
            break
    return at[np.argsort(-matches, kind="stable")]


def linked(a: np.ndarray, b: np.ndarray, per_cent: int = PER_CENT) -> bool:
    """The exact rule on full sets."""
    na, nb = len(a), len(b)
    if not na or not nb or 100 * min(na, nb) < per_cent * max(na, nb):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (na + nb - both)


class Groups:
    """Union-find over small integers with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def verify(sigs: np.ndarray, sets: list[np.ndarray], left: list[int], right: list[int], groups: Groups, per_cent: int) -> list[tuple[int, int]]:
    """Confirmed links between members left and right that connect what isn't connected yet."""
    links = []
    right_at = np.array(right, np.int64)
    others = sigs[right_at] if len(right) else sigs[:0]
    for i in left:
        root = groups.find(i)
        for j in right_at[survivors(sigs[i], others, per_cent)].tolist():
            if i != j and groups.find(j) != root and linked(sets[i], sets[j], per_cent):
                groups.join(i, j)
                root = groups.find(i)
                links.append((i, j))
    return links


# --- stages on tables ---------------------------------------------------------------------------------------------

PREPARED = "doc_id long, n_shingles long, fp binary, sig binary"


def prepare(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (hash of the word sequence), sig (MinHash values as bytes; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        enter("minhash", _words.release)
        for b in batches:
            n, fp, sig = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                fp.append(hashlib.blake2b(b" ".join((t or b"").lower().split()), digest_size=16).digest())
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "fp", "sig"])
        _words.release()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, PREPARED)


def band_rows(reps: DataFrame) -> DataFrame:
    """id, bucket (hash of band number and its values)."""
    size = 4 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("sig", k * size + 1, size)) for k in range(BANDS)))
    return reps.select("id", F.explode(keys).alias("bucket"))


def components(links: DataFrame) -> DataFrame:
    """id, label (least id in its component) of every id in links(id, hub), by min labels along links and over hubs.

    A round takes, for each hub, the least label of its members (aggregated before the shuffle), hands it back to the
    members (salted), and follows each label to that label's own label.
    """
    links = written(links.distinct(), "links")
    labels = links.select("id").union(links.select("hub")).distinct().select("id", F.col("id").alias("label"))
    labels = written(labels, "labels")
    while True:
        at_hub = salted_join(links, labels.withColumnRenamed("id", "hub").withColumnRenamed("label", "hub_label"), ["hub"], "inner", F.col("id")).join(merged(labels), "id")
        low = at_hub.select("hub", F.least("label", "hub_label").alias("low")).groupBy("hub").agg(F.min("low").alias("low"))
        back = salted_join(links, low, ["hub"], "inner", F.col("id")).select("id", F.col("low").alias("label"))
        found = labels.union(back).union(low.select(F.col("hub").alias("id"), F.col("low").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
        found = written(found, "labels")
        jump = salted_join(found.withColumnRenamed("label", "via"), found.select(F.col("id").alias("via"), F.col("label").alias("far")), ["via"], "left", F.col("id"))
        new = written(jump.select("id", F.least("via", F.coalesce("far", "via")).alias("label")), "labels")
        changed = new.join(merged(labels.withColumnRenamed("label", "was")), "id").where("label <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def bucket_links(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links of candidates to their buckets' least members, degree by id: members met in its buckets)."""
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    met = salted_join(bands, sizes, ["bucket"], "inner", F.col("id"))
    return met.select("id", "hub"), met.groupBy("id").agg(F.sum("n").alias("degree"))


MEMBER = "cluster long, id long, degree long, sig binary, text binary"
LINK = "id long, hub long"


def _members(table: pa.Table) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """ids, signatures and shingle sets of a group, those of the highest degree first."""
    enter("minhash", _words.release)
    table = table.sort_by([("degree", "descending"), ("id", "ascending")])
    ids = table.column("id").to_pylist()
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(ids), HASHES)
    return ids, sigs, [shingle_set(t) for t in table.column("text").to_pylist()]


def _link_table(ids: list[int], links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"id": pa.array([max(ids[i], ids[j]) for i, j in links], pa.int64()), "hub": pa.array([min(ids[i], ids[j]) for i, j in links], pa.int64())})


def links_of_small(members: DataFrame, per_cent: int) -> DataFrame:
    """Spanning links of clusters of bounded size."""

    def run(group: pa.Table) -> pa.Table:
        ids, sigs, sets = _members(group)
        everyone = list(range(len(ids)))
        return _link_table(ids, verify(sigs, sets, everyone, everyone, Groups(len(ids)), per_cent))

    return members.groupBy("cluster").applyInArrow(run, LINK)


def links_to_hubs(members: DataFrame, hubs: DataFrame, per_cent: int) -> DataFrame:
    """Links of a large cluster's blocks, each held against the cluster's hubs."""

    def run(key: tuple, group: pa.Table, centre: pa.Table) -> pa.Table:
        if not group.num_rows or not centre.num_rows:
            return _link_table([], [])
        ids, sigs, sets = _members(pa.concat_tables([centre.select(group.column_names), group]))
        own = set(centre.column("id").to_pylist())
        first = {}
        for k, i in enumerate(ids):
            first.setdefault(i, k)
        groups = Groups(len(ids))
        for k, i in enumerate(ids):
            groups.join(first[i], k)
        left = [first[i] for i in own]
        left.sort()
        return _link_table(ids, verify(sigs, sets, left, sorted(set(first.values())), groups, per_cent))

    return members.groupBy("cluster", "block").cogroup(hubs.groupBy("cluster", "block")).applyInArrow(run, LINK)


def links_of_rest(members: DataFrame, rest: DataFrame, per_cent: int) -> DataFrame:
    """Links between blocks of all members and blocks of those outside the largest component.

    members: (cluster, block, part, label, ...) repeated for every part of the rest; rest: the same for every block.
    """

    def run(key: tuple, group: pa.Table, odd: pa.Table) -> pa.Table:
        if not group.num_rows or not odd.num_rows:
            return _link_table([], [])
        both = pa.concat_tables([odd.select(group.column_names), group]).sort_by([("degree", "descending"), ("id", "ascending")])
        ids, sigs, sets = _members(both)
        labels = both.column("label").to_pylist()
        groups, first, place = Groups(len(ids)), {}, {}
        for k, (i, lab) in enumerate(zip(ids, labels, strict=True)):
            groups.join(first.setdefault(lab, k), k)
            place.setdefault(i, k)
        left = sorted({place[i] for i in odd.column("id").to_pylist()})
        right = sorted({place[i] for i in group.column("id").to_pylist()})
        return _link_table(ids, verify(sigs, sets, left, right, groups, per_cent))

    return members.groupBy("cluster", "block", "part").cogroup(rest.groupBy("cluster", "block", "part")).applyInArrow(run, LINK)


def confirmed_links(reps: DataFrame, docs: DataFrame, per_cent: int) -> DataFrame | None:
    """Spanning links between representatives; None if no two share a band."""
    near, degree = bucket_links(written(band_rows(reps.where("sig is not null")), "bands"))
    near = written(near.distinct(), "near")
    if near.limit(1).count() == 0:
        return None
    clusters = components(near)
    sizes = clusters.groupBy("label").agg(F.count("*").alias("size"))
    placed = salted_join(clusters, sizes, ["label"], "inner", F.col("id")).withColumnRenamed("label", "cluster")
    placed = placed.join(merged(degree), "id").join(merged(reps.select("id", "sig")), "id")
    texts = docs.selectExpr("cast(doc_id as long) id", "cast(text as binary) text").where("id is not null")
    # A repeated doc_id has several texts only if the input contradicts itself; the representative's hash decides.
    members = written(placed.join(texts, "id").groupBy("cluster", "size", "id", "degree", "sig").agg(F.min("text").alias("text")), "members")
    small = members.where(F.col("size") <= SMALL).select("cluster", "id", "degree", "sig", "text")
    links = written(links_of_small(small, per_cent), "small")
    large = members.where(F.col("size") > SMALL).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).cast("int"))
    if large.limit(1).count() == 0:
        return links
    columns = ["cluster", "block", "id", "degree", "sig", "text"]
    from pyspark.sql import Window

    # The hubs of a cluster: best of each block first, then of these (bounded groups in both windows).
    by_block = Window.partitionBy("cluster", "block").orderBy(F.desc("degree"), "id")
    by_cluster = Window.partitionBy("cluster").orderBy(F.desc("degree"), "id")
    best = large.select("cluster", "block", "size", "id", "degree").withColumn("r", F.row_number().over(by_block)).where(F.col("r") <= HUBS)
    best = best.withColumn("r", F.row_number().over(by_cluster)).where(F.col("r") <= HUBS)
    hubs = best.select("cluster", "id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)).alias("to"))
    hubs = hubs.join(merged(large.select("cluster", "id", "degree", "sig", "text")), ["cluster", "id"]).withColumnRenamed("to", "block").select(*columns)
    hubs = written(hubs, "hubs")
    first = written(links_to_hubs(large.select(*columns), hubs, per_cent), "hublinks")
    labels = components(first) if first.limit(1).count() else None
    if labels is None:
        labelled = large.withColumn("label", F.col("id"))
    else:
        labelled = large.join(merged(labels), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = written(labelled, "labelled")
    by_label = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = by_label.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    rest = labelled.join(main, "cluster").where("label <> main").withColumn("parts", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"))
    columns = ["cluster", "block", "part", "label", "id", "degree", "sig", "text"]
    parts = rest.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    odd = parts.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1))).select(*columns)
    everyone = labelled.join(main.where("all > most").select("cluster", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("parts")), "cluster")
    everyone = everyone.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*columns)
    second = written(links_of_rest(everyone, written(odd, "rest"), per_cent), "restlinks")
    return links.union(first).union(second)


def near_duplicates(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text)."""
    rows = written(prepare(docs), "prepared")
    known = rows.where("doc_id is not null and n_shingles > 0")
    reps = written(known.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")), "reps")
    links = confirmed_links(reps, docs, per_cent)
    if links is None or links.limit(1).count() == 0:
        final = reps.select("fp", F.col("id").alias("component_id"))
    else:
        labels = components(links)
        final = reps.join(merged(labels), "id", "left").select("fp", F.coalesce("label", "id").alias("component_id"))
    out = salted_join(rows.select("doc_id", "n_shingles", "fp"), final, ["fp"], "left", F.col("doc_id"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, per_cent: int = STAGE_PER_CENT) -> DataFrame:
    """One document of each component: the rows of docs but those whose doc_id isn't its component's least.

    Of several rows of one doc_id one stays; rows without a doc_id all do.
    """
    found = written(near_duplicates(docs, per_cent), "components")
    gone = written(found.where("not kept").select(F.col("doc_id").alias("_d")).distinct(), "dropped")  # a table of known size, so that a small one is broadcast
    many = written(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n")).where("_n > 1").select("_d"), "repeated")
    rest = docs.join(gone, docs["doc_id"] == gone["_d"], "left_anti")
    if many.limit(1).count() == 0:
        return rest
    once = rest.join(many, rest["doc_id"] == many["_d"], "left_semi").dropDuplicates(["doc_id"])
    return rest.join(many, rest["doc_id"] == many["_d"], "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
o AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, o.b FROM r JOIN o ON o.a = r.b)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) ON a = doc_id
"""
