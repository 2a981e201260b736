"""Document features from usage, evaluation, sampling, drift, costs, metrics and memories."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_relevancy, days_since, token_f1, tokenize
from ..session import checkpoint

# Feedback smoothing, sampling and drift defaults, gate thresholds, prices in USD per 1000 tokens (in, out).
KEEP, MOVE = 0.8, 0.2
SAMPLE_RATE, MAX_DROP = 0.1, 0.1
GATE = {"faithfulness": 0.85, "relevancy": 0.80, "recall": 0.75}
PRICES = {
    "gpt-4o": (0.0025, 0.01),
    "gpt-4o-mini": (0.00015, 0.0006),
    "qwen2.5:32b-instruct": (0.00010, 0.00030),
    "qwen2.5:7b-instruct": (0.00002, 0.00006),
}
LOCAL_PRICE = (0.00005, 0.00015)


# --- features ---------------------------------------------------------------------------------------------------------


def document_features(documents: DataFrame, as_of: Column) -> DataFrame:
    """Static features of documents(doc_id, authority, freshness_date, doc_type)."""
    return documents.select("doc_id", F.coalesce("authority", F.lit("draft")).alias("authority"), days_since(F.col("freshness_date"), as_of).alias("freshness_days"), F.coalesce("doc_type", F.lit("other")).alias("doc_type"))


def popularity(hits: DataFrame) -> DataFrame:
    """doc_id, hits, popularity_at_last_hit (share of all hits at the document's latest one), popularity (share at the end).

    hits(seq, doc_id) with consecutive seq from 1, so the running total at a hit is its seq and no global window is needed.
    """
    per = hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.max("seq").alias("last_seq"))
    total = hits.agg(F.count("*").alias("all_hits"))
    joined = per.join(F.broadcast(total), F.lit(True))  # one row
    return joined.select("doc_id", "hits", F.round(F.col("hits") / F.col("last_seq"), 6).alias("popularity_at_last_hit"), F.round(F.col("hits") / F.col("all_hits"), 6).alias("popularity"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with consecutive seq from 1 in a global order.

    The range-partitioned rows are written with their partition's number, so that counting and numbering see the same
    partitions whatever runtime re-planning does; each partition is then numbered for itself.
    """
    parts = checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    start = F.get(F.array(*(F.lit(o).cast("long") for o in offsets or [0])), F.col("_part"))
    return parts.withColumn("seq", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + start).drop("_part")


#: Steps folded by one task into one step, level by level.
FOLD = 1024
_STEP = "struct<a:double,b:double,low:double,high:double>"


def _then(s: Column, t: Column) -> Column:
    """The step f -> t(s(f)), where a step is f -> clamp(a f + b, low, high) with a >= 0: again such a step."""
    clamp = lambda x: F.greatest(F.least(x, t["high"]), t["low"])
    return F.struct((s["a"] * t["a"]).alias("a"), (t["a"] * s["b"] + t["b"]).alias("b"), clamp(t["a"] * s["low"] + t["b"]).alias("low"), clamp(t["a"] * s["high"] + t["b"]).alias("high"))


def folded(steps: DataFrame, key: str, fold: int = FOLD) -> DataFrame:
    """key, step: all of a key's steps(key, seq, step) in the order of seq as one step.

    Composition is associative, so stretches of `fold` numbers are folded first, then stretches of these, and so on: however
    many steps a key has, a task holds `fold` of them.
    """
    last = steps.agg(F.max("seq")).first()[0]
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    rows = steps.select(key, F.col("seq").cast("long").alias("seq"), "step")
    while True:
        last = (last or 0) // fold
        made = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "step"))), start, lambda s, x: _then(s, x["step"]))
        rows = rows.groupBy(key, F.floor(F.col("seq") / fold).alias("seq")).agg(made.cast(_STEP).alias("step"))
        if not last:
            return rows.select(key, "step")


def feedback_score(votes: DataFrame) -> DataFrame:
    """doc_id, feedback_score: f <- clamp(0.8 f + 0.2 delta, -1, 1) over votes(doc_id, at, delta) in order."""
    step = F.struct(F.lit(KEEP).alias("a"), (MOVE * F.col("delta").cast("double")).alias("b"), F.lit(-1.0).alias("low"), F.lit(1.0).alias("high"))
    rows = folded(checkpoint(numbered(votes.select("doc_id", "at", "delta"), "doc_id", "at").select("doc_id", "seq", step.alias("step"))), "doc_id")
    return rows.select("doc_id", F.round(F.greatest(F.least(F.col("step.b"), F.col("step.high")), F.col("step.low")), 6).alias("feedback_score"))


def vote(value: Column) -> Column:
    return F.when(value >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def merge_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """A re-ingest replaces static features and keeps usage."""
    usage = old.select("doc_id", F.col("popularity").alias("_p"), F.col("feedback_score").alias("_f"))
    fresh = new.join(usage, "doc_id", "left").withColumns({"popularity": F.coalesce("_p", F.lit(0.0)), "feedback_score": F.coalesce("_f", F.lit(0.0))}).drop("_p", "_f")
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def rate_limited(requests: DataFrame, most: int = 30, window_s: float = 60) -> DataFrame:
    """user_id, at, id, allowed over requests(user_id, at (seconds, not null), id): at most `most` admitted ones in the last window.

    Denied requests don't count, so whether one is admitted hangs on all of the user's before it. Each user's requests come
    sorted and are read as a stream; what is held of them is the times of the at most `most` admitted ones that still count.
    """
    rows = requests.select("user_id", F.col("at").cast("double").alias("at"), "id")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, counting = object(), deque()
        for b in batches:
            allowed = []
            for who, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if who != user:
                    user, counting = who, deque()
                while counting and at - counting[0] > window_s:
                    counting.popleft()
                allowed.append(len(counting) < most)
                if allowed[-1]:
                    counting.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(allowed, pa.bool_())], names=["user_id", "at", "id", "allowed"])

    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "at", "id")
    return ordered.mapInArrow(run, f"user_id {kind['user_id']}, at double, id {kind['id']}, allowed boolean")


# --- evaluation ---------------------------------------------------------------------------------------------------------


def retrieval_hit(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """case_id, hit: whether a retrieved document's id or title contains the case's needle; an empty needle is always hit."""
    hay = F.lower(F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("title", F.lit(""))))
    needle = F.lower("relevant_source_contains")
    met = cases.select("case_id", "relevant_source_contains").join(retrieved, "case_id", "left")
    found = F.max(F.when(needle == "", 1.0).when(F.contains(hay, needle), 1.0).otherwise(0.0))
    return met.groupBy("case_id").agg(F.coalesce(found, F.lit(0.0)).alias("hit"))


def case_metrics(answers: DataFrame) -> DataFrame:
    """answers(case_id, query, answer, ideal, score) with correctness, relevancy and faithfulness."""
    return answers.select("case_id", F.round(token_f1(F.col("answer"), F.col("ideal")), 6).alias("correctness"), F.round(answer_relevancy(F.col("answer"), F.col("query")), 6).alias("relevancy"), F.col("score").alias("faithfulness"))


def aggregate_metrics(per_case: DataFrame) -> DataFrame:
    """metric, value: means over the cases that have it, of per_case(case_id, metrics MAP)."""
    return per_case.select(F.explode("metrics").alias("metric", "v")).groupBy("metric").agg(F.round(F.avg("v"), 6).alias("value"))


def gate(metrics: DataFrame, thresholds: dict[str, float] | None = None, all_ok: bool = True) -> DataFrame:
    """passed: every threshold is met (a missing metric is 0) and every case was ok."""
    wanted = metrics.sparkSession.createDataFrame(list((thresholds or GATE).items()), "metric string, least double")
    return wanted.join(metrics, "metric", "left").agg((F.coalesce(F.bool_and(F.coalesce("value", F.lit(0.0)) >= F.col("least")), F.lit(True)) & F.lit(all_ok)).alias("passed"))


def judgement(score: Column) -> Column:
    """A 1 to 5 grade on the unit scale."""
    return (score - 1) / 4.0


def traffic_sample(served: DataFrame, rate: float = SAMPLE_RATE) -> DataFrame:
    """Served answers for review: all negative, ungrounded or abstained ones, and a stable share of the others."""
    forced = F.coalesce(F.col("feedback") < 0, F.lit(False)) | ~F.col("grounded") | F.col("abstained")
    every = max(1, int(1 / rate)) if rate > 0 else 10**9
    return served.where(forced | (F.conv(F.substring(F.md5(F.col("trace_id").cast("string")), 1, 8), 16, 10).cast("long") % every == 0))


def live_scores(sample: DataFrame, *by: str) -> DataFrame:
    """faithfulness, thumbs_up_rate, abstain_rate; without rows 1, 1 and 0."""
    mean = lambda c, empty: F.round(F.coalesce(F.avg(c), F.lit(empty)), 6)
    up = F.when(F.col("feedback").isNotNull(), (F.col("feedback") > 0).cast("double"))
    faith = F.when(F.col("grounded"), F.col("grounding_score")).otherwise(0.0)
    return sample.groupBy(*by).agg(mean(faith, 1.0).alias("faithfulness"), mean(up, 1.0).alias("thumbs_up_rate"), mean(F.col("abstained").cast("double"), 0.0).alias("abstain_rate"))


def drift(current: DataFrame, baseline: DataFrame, most: float = MAX_DROP) -> DataFrame:
    """metric, was, now of what fell (abstain_rate: rose) by more than `most`; both sides have one row."""
    long = lambda rows, name: rows.select(F.explode(F.create_map(*(x for m in ("faithfulness", "thumbs_up_rate", "abstain_rate") for x in (F.lit(m), F.col(m))))).alias("metric", name))
    both = long(current, "now").join(long(baseline, "was"), "metric")
    drop = F.when(F.col("metric") == "abstain_rate", F.col("now") - F.col("was")).otherwise(F.col("was") - F.col("now"))
    return both.where(F.round(drop, 6) > most).select("metric", "was", "now")


def promote_failures(sample: DataFrame) -> DataFrame:
    """New golden cases from disliked or ungrounded answers."""
    failed = F.coalesce(F.col("feedback") < 0, F.lit(False)) | ~F.col("grounded")
    return sample.where(failed).select(F.concat(F.lit("prod-"), F.substring(F.col("trace_id").cast("string"), 1, 8)).alias("id"), "query", F.lit("").alias("ideal_answer"), F.lit("answer").alias("expect"), F.array(F.lit("from_production"), F.lit("needs_review")).alias("tags"))


# --- costs, metrics, memory -----------------------------------------------------------------------------------------------


def cost(model: Column, prompt: Column, completion: Column) -> Column:
    rate = lambda i: F.coalesce(F.try_element_at(F.create_map(*(x for m, p in PRICES.items() for x in (F.lit(m), F.lit(p[i])))), model), F.lit(LOCAL_PRICE[i]))
    return prompt / 1000.0 * rate(0) + completion / 1000.0 * rate(1)


def metric_name(name: Column, labels: Column) -> Column:
    """name{a=x,b=y} with labels (a map) sorted."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(labels) > 0, F.concat(name, F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(name)


def metric_rollup(points: DataFrame) -> DataFrame:
    """key, n, total, mean of points(name, labels, value)."""
    return points.groupBy(metric_name(F.col("name"), F.col("labels")).alias("key")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


def exposition(points: DataFrame) -> DataFrame:
    """line: each counter of points(name, labels, value) as a line of the common text format for scrapers, labels sorted and quoted."""
    quoted = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    parts = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"]), F.lit('"')))
    name = F.when(F.size("labels") > 0, F.concat("name", F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(F.col("name"))
    return points.groupBy(name.alias("key")).agg(F.sum("value").alias("v")).select(F.concat("key", F.lit(" "), F.col("v").cast("string")).alias("line"))


def trace_totals(spans: DataFrame) -> DataFrame:
    """Tokens, cost and time by trace over flat spans(trace_id, span_id, parent_id, tokens, cost, ms)."""
    return spans.groupBy("trace_id").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.max(F.when(F.col("parent_id").isNull(), F.col("ms"))).alias("ms"), F.count("*").alias("spans"))


def memory_recall(questions: DataFrame, facts: DataFrame, keep: int = 3) -> DataFrame:
    """user, query_id, fact, score: the facts of a user that share most distinct tokens; ties by the later text."""
    shared = F.size(F.array_intersect(F.array_distinct(tokenize(F.col("query"))), F.array_distinct(tokenize(F.col("fact")))))
    met = questions.join(facts, "user").withColumn("score", shared).where("score > 0")
    w = Window.partitionBy("user", "query_id").orderBy(F.desc("score"), F.desc("fact"))
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).select("user", "query_id", "fact", "score", "place")
