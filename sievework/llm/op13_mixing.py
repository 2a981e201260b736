"""Operator 13, mixing sources to target weights, in DataFrame functions only.

Sources in code-point order (null last) weigh 5, 2, 1, 5, ... and share `EPOCHS` times all words by weight; a source's
target stops at `REPEATS` times its words, and the excess goes to the others by weight until none is above (the level of a
water filling, found from running sums over the sources in the order in which they fill up).

Words are dealt out in blocks of equal size, the same for all sources: a hundredth of the smallest positive target, at
least 1 and at most `BLOCK` words. Sainte-Lague apportionment gives the blocks to the sources by the highest quotients
target / (2 k + 1), and a source's blocks to its shards in the same way by their words. A shard is the documents that
start in a stretch of `SHARD` blocks of the source's seeded order (MD5 of seed and doc_id), so its size is bounded but for
the length of its last document. In a shard of n blocks with a quota of q every block is taken q div n times, and a run of
q mod n blocks from a seeded place (around the end) once more: few documents are cut, and none is taken more than
REPEATS times.

Highest quotients need no list of all seats: rounding shares a little below the quota gives seats that are surely among
the highest, and only about three more quotients a source (or shard) are ranked for the rest.

Scale: texts are read once, for their word counts. Three narrow columns a document are range-partitioned by source and
seeded order, so a source that holds a third of all rows lies in many partitions; positions are running sums over
partitions. Sources and shards are tables, never lists on the driver, which sees a few sums.

Defined results: a null or empty text has size 0 and takes 0; a null source is the last one; null and repeated doc_ids are
documents of their own (equal rows may swap what they take); no words at all give targets of 0; an empty table gives no
rows; extra columns are neither read nor passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running, settled, table, written

WEIGHTS = (5, 2, 1)
EPOCHS, REPEATS = 1.5, 2
BLOCK, SHARD, SEED = 64, 4096, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, place (from 0), target of sizes(source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = running(totals, [F.col("source").isNull(), F.col("source")], "sources").withColumnRenamed("seq", "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = by_name.withColumn("w", weight).withColumn("cap", REPEATS * F.col("source_size"))
    filled = running(weighed, [F.col("cap") / F.col("w"), F.col("place")], "filled", caps="cap", weights="w")
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("w").alias("w")).first()
    wanted = F.lit(EPOCHS * (whole["words"] or 0))
    full = F.col("cap") / F.col("w") <= (wanted - F.col("caps")) / (F.lit(whole["w"] or 1) - F.col("weights"))
    held = written(filled.withColumn("full", full), "targets")
    capped = held.where("full").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")).first()
    left = (whole["w"] or 0) - (capped["w"] or 0)
    level = (EPOCHS * (whole["words"] or 0) - (capped["cap"] or 0)) / left if left else 0.0
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.lit(float(level)) * F.col("w"))
    return held.select("source", "source_size", "place", target.alias("target"))


def apportioned(units: DataFrame, group: str, place: str, share: str, seats: str) -> DataFrame:
    """units with quota: a group's seats (the same number in each of its rows) by the highest quotients share / (2 k + 1).

    Ties go to the smaller place. With n units of a group, seats rounded from shares scaled to seats - n / 2 are at most
    `seats` and each among the highest; shares scaled to seats + n / 2 bound how many more a unit can get.
    """
    of = units.groupBy(group).agg(F.count("*").alias("_n"), F.sum(share).alias("_all"))
    met = units.join(of, group)
    scaled = lambda by: F.when(F.col("_all") > 0, F.col(share) * F.greatest(F.col(seats) + by * F.col("_n") / 2, F.lit(0.0)) / F.col("_all")).otherwise(F.lit(0.0))
    based = written(met.withColumn("_sure", F.floor(scaled(-1) + 0.5)).withColumn("_may", F.floor(scaled(1) + 0.5) + 1).drop("_n", "_all"), "base")
    rest = based.groupBy(F.col(group).alias("_g")).agg((F.max(seats) - F.sum("_sure")).alias("_rest"))
    more = based.where((F.col("_may") > F.col("_sure")) & (F.col(share) > 0)).select(group, place, share, F.explode(F.sequence("_sure", F.col("_may") - 1)).alias("k"))
    ranked = written(running(more, [F.col(group), -(F.col(share) / (2 * F.col("k") + 1)), F.col(place), F.col("k")], "quotients"), "ranked")
    first = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("seq").alias("_first")).join(rest, "_g")
    won = ranked.join(first, F.col(group) == F.col("_g")).where(F.col("seq") - F.col("_first") < F.col("_rest"))
    won = won.groupBy(F.col(group).alias("_g"), F.col(place).alias("_p")).agg(F.count("*").alias("_more"))
    out = based.join(won, (F.col(group) == F.col("_g")) & (F.col(place) == F.col("_p")), "left")
    return out.withColumn("quota", F.col("_sure") + F.coalesce("_more", F.lit(0))).drop("_sure", "_may", "_g", "_p", "_more")


def overlap(start: Column, end: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(end, high) - F.greatest(start, low), F.lit(0))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, quota_words (the source's seats in words): one row a document."""
    settled(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    sources = written(source_targets(sizes), "sources")
    sums = sources.agg(F.sum("target").alias("all"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    block = int(min(max((sums["least"] or 0) // 100, 1), BLOCK))
    seats = F.lit(int((sums["all"] or 0) / block + 0.5)).cast("long")
    quotas = apportioned(sources.withColumn("all", F.lit(0)).withColumn("seats", seats), "all", "place", "target", "seats")
    blocks = lambda words: F.ceil(words / block).cast("long")
    quotas = written(quotas.withColumn("quota", F.least("quota", REPEATS * blocks(F.col("source_size")))).select("source", "source_size", "place", "target", "quota"), "quotas")

    some = sizes.where("size > 0")
    placed = running(some, [F.col("source").isNull(), F.col("source"), seeded(F.col("doc_id")), F.col("doc_id"), F.col("size")], "placed", at="size")
    of = quotas.withColumnRenamed("source", "_s")
    starts = running(quotas, [F.col("place")], "starts", first="source_size").select(F.col("source").alias("_s"), "source_size", "place", "target", "first")
    met = placed.join(starts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("at", F.col("at") - F.col("first"))
    held = written(met.select("doc_id", "size", "source_size", "place", "target", "at", F.floor(F.col("at") / (SHARD * block)).alias("shard")), "held")
    shards = held.groupBy("place", "shard").agg(F.min("at").alias("begin"), F.sum("size").alias("words"))
    shards = shards.join(quotas.select("place", F.col("quota").alias("seats")), "place")
    shards = apportioned(shards, "place", "shard", "words", "seats")
    n = blocks(F.col("words"))
    quota = F.least("quota", REPEATS * n)
    place = F.conv(F.substring(seeded(F.col("place"), F.col("shard")), 1, 8), 16, 10).cast("long") % n
    shards = shards.select("place", "shard", "begin", "words", F.floor(quota / n).alias("times"), (quota % n).alias("extra"), place.alias("from"), n.alias("n"))
    lot = held.join(written(shards, "shards"), ["place", "shard"])
    start = F.col("at") - F.col("begin")
    run = lambda low, high: overlap(start, start + F.col("size"), low * block, F.least(high * block, F.col("words")))
    end = F.col("from") + F.col("extra")
    taken = F.col("times") * F.col("size") + run(F.col("from"), F.least(end, F.col("n"))) + run(F.lit(0), F.greatest(end - F.col("n"), F.lit(0)))
    full = lot.join(quotas.select("place", (F.col("quota") * block).alias("quota_words")), "place").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "quota_words")
    none = sizes.where("size = 0").join(of, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), (F.col("quota") * block).alias("quota_words"))
    return full.unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("quota_words")


ORACLE = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
    SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s
), f AS (
    SELECT *, CAST(cap AS DOUBLE) / w <= (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS is_full
    FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
    SELECT (1.5 * sum(source_size) - coalesce(sum(cap) FILTER (is_full), 0)) / CAST(nullif(sum(w) FILTER (NOT is_full), 0) AS DOUBLE) AS level FROM f
), t AS (
    SELECT source, source_size, place, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE level * w END AS target FROM f, l
), b AS (
    SELECT CAST(least(greatest(floor(coalesce(min(target) FILTER (target > 0), 0) / 100), 1), 64) AS BIGINT) AS block, sum(target) AS whole FROM t
), n AS (
    SELECT *, CAST(floor(whole / block + 0.5) AS BIGINT) AS seats FROM b
), q AS (
    SELECT place, k, target / (2 * k + 1) AS quotient FROM (SELECT place, target, unnest(range(0, CAST(target / block AS BIGINT) + 2 + (SELECT count(*) FROM t))) AS k FROM t, b WHERE target > 0)
), a AS (
    SELECT place, count(*) AS quota FROM (SELECT place, row_number() OVER (ORDER BY quotient DESC, place, k) AS r FROM q) , n WHERE r <= seats GROUP BY place
), u AS (
    SELECT t.*, least(coalesce(quota, 0), 2 * CAST(ceil(source_size / block) AS BIGINT)) AS quota FROM t LEFT JOIN a USING (place), b
), p AS (
    SELECT doc_id, size, source_size, place, target, quota,
        sum(size) OVER (PARTITION BY place ORDER BY md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS pos
    FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), h AS (
    SELECT p.*, CAST(floor(pos / (4096 * block)) AS BIGINT) AS shard FROM p, b WHERE size > 0
), g AS (
    SELECT place, shard, min(pos) AS begin, CAST(sum(size) AS DOUBLE) AS words, max(quota) AS seats FROM h GROUP BY place, shard
), z AS (
    SELECT place, shard, k, words / (2 * k + 1) AS quotient, seats FROM (SELECT *, unnest(range(0, CAST(words * 2 / block AS BIGINT) + 3)) AS k FROM g, b)
), y AS (
    SELECT place, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard, k) AS r FROM z) WHERE r <= seats GROUP BY place, shard
), x AS (
    SELECT place, shard, begin, words, CAST(ceil(words / block) AS BIGINT) AS n, least(coalesce(y.quota, 0), 2 * CAST(ceil(words / block) AS BIGINT)) AS quota,
        CAST('0x' || substr(md5('mix-1:' || place || ':' || shard), 1, 8) AS BIGINT) % CAST(ceil(words / block) AS BIGINT) AS start
    FROM g LEFT JOIN y USING (place, shard), b
), e AS (
    SELECT doc_id, size, source_size, target, pos - begin AS lo, pos - begin + size AS hi, x.quota // n AS times, start, start + x.quota % n AS stop, n, words, block FROM h JOIN x USING (place, shard), b
)
SELECT doc_id, size, source_size, target,
    CAST(times * size + greatest(least(hi, least(least(stop, n) * block, words)) - greatest(lo, start * block), 0) + greatest(least(hi, greatest(stop - n, 0) * block, words) - lo, 0) AS BIGINT) AS taken
FROM e
UNION ALL
SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) FROM p WHERE size = 0
"""
