"""Evaluation suites over golden cases, the model-free gate, and the judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import answer_relevancy, token_f1
from ..operators import answering as a
from ..operators import feedback as fb
from ..operators import retrieval as r
from ..operators.models import map_model, roles, structured
from ..settings import parse
from ..sources.files import golden_cases

#: Least recall of the model-free gate.
RECALL = 0.75
JUDGEMENT = "faithfulness int, relevancy int, correctness int, reasoning string, unsupported_claims array<string>"


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a YAML or JSON file (a list, or under cases) that Spark reads."""
    rows = parse("\n".join(x[0] for x in spark.read.text(path, wholetext=True).collect()))  # one file
    return golden_cases(spark, rows["cases"] if isinstance(rows, dict) else rows)


def score_cases(cases: DataFrame, served: DataFrame, cited: DataFrame) -> DataFrame:
    """case_id, metrics MAP, ok of cases(id, query, ideal_answer, relevant_source_contains, expect) and served(case_id, answer, grounded, score, blocked, abstained).

    cited(case_id, doc_id, title) are the sources of the answers. A refusal case is right when it is blocked or abstained; the
    others have recall, faithfulness, relevancy and correctness and are ok unless blocked.
    """
    rows = cases.withColumnRenamed("id", "case_id").join(served, "case_id", "left")
    hit = fb.retrieval_hit(cases.select(F.col("id").alias("case_id"), "relevant_source_contains"), cited)
    rows = rows.join(hit, "case_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    refused = no(F.col("blocked")) | no(F.col("abstained"))
    answer = F.coalesce("answer", F.lit(""))
    metrics = F.create_map(
        F.lit("context_recall"), F.coalesce("hit", F.lit(0.0)), F.lit("faithfulness"), F.when(no(F.col("grounded")), F.col("score")).otherwise(0.0),
        F.lit("answer_relevancy"), F.round(answer_relevancy(answer, F.col("query")), 6), F.lit("answer_correctness"), F.round(token_f1(answer, F.col("ideal_answer")), 6),
    )
    is_refusal = F.col("expect") == "refusal"
    refusal = F.create_map(F.lit("refusal_correct"), refused.cast("double"))
    return rows.select("case_id", F.when(is_refusal, refusal).otherwise(metrics).alias("metrics"), F.when(is_refusal, refused).otherwise(~no(F.col("blocked"))).alias("ok"))


def run_suite(cases: DataFrame, answer: Callable[[DataFrame], DataFrame], thresholds: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """metrics, per_case and passed of the pipeline over a suite.

    answer(queries(query_id, text)) -> query_id, answer, status, score, grounded, citations (with doc_id). Cases are numbered by id.
    """
    keyed = fb.numbered(cases, "id").withColumnRenamed("seq", "query_id")
    out = answer(keyed.select("query_id", F.col("query").alias("text"))).join(keyed.select("query_id", F.col("id").alias("case_id")), "query_id")
    served = out.select("case_id", "answer", F.coalesce("grounded", F.lit(False)).alias("grounded"), F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("status") == "blocked").alias("blocked"), (F.col("status") == "abstained").alias("abstained"))
    cited = out.select("case_id", F.explode("citations").alias("c")).select("case_id", F.col("c.doc_id").cast("string").alias("doc_id"), F.coalesce("c.title", F.lit("")).alias("title"))
    per_case = score_cases(cases, served, cited)
    metrics = fb.aggregate_metrics(per_case)
    everyone = per_case.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok")).first()["ok"]
    gate = {"faithfulness": 0.85, "answer_relevancy": 0.80, "context_recall": 0.75} if thresholds is None else thresholds
    return {"metrics": metrics, "per_case": per_case, "passed": fb.gate(metrics, gate, everyone)}


def ci_gate(cases: DataFrame, chunks: DataFrame, least: float = RECALL) -> tuple[bool, float, list[str]]:
    """(passed, recall, failures) without a model: cases must find their source, refusals must be caught by the input guard."""
    keyed = fb.numbered(cases, "id").withColumnRenamed("seq", "query_id").withColumnRenamed("query", "text")
    asked = keyed.where("expect <> 'refusal'")
    found = r.top(r.hybrid(asked.select("query_id", "text"), chunks), 2 * r.TOP_DENSE, "fused")
    named = found.join(asked.select("query_id", F.col("id").alias("case_id")), "query_id").join(chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("title") if "title" in chunks.columns else F.lit("").alias("title")), "chunk_id")
    hits = fb.retrieval_hit(asked.select(F.col("id").alias("case_id"), "relevant_source_contains"), named)
    guarded = a.check_input(keyed.where("expect = 'refusal'").select("id", "text"))
    missed = guarded.where(F.col("reason").isNull() & ~F.array_contains("flags", "injection")).select(F.concat(F.col("id"), F.lit(": not caught by the input guard")).alias("f"))
    lost = hits.where("hit < 1").select(F.concat(F.col("case_id"), F.lit(": its source wasn't found")).alias("f"))
    failures = sorted(x["f"] for x in missed.unionByName(lost).collect())  # a line a case of a suite
    recall = hits.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("v")).first()["v"]
    return recall >= least and not failures, recall, failures


def judge(rows: DataFrame, role: str = "judge") -> DataFrame:
    """rows(case_id, question, answer, context, ideal) with faithfulness, relevancy, correctness on the unit scale, unsupported_claims and judge_error."""
    asked = rows.withColumn("asked", F.to_json(F.struct("question", "answer", "context", "ideal"), {"ignoreNullFields": "false"}))
    out = map_model(asked, "asked", "judge", role).withColumn("j", F.from_json("judge", JUDGEMENT))
    grade = lambda c: F.round(fb.judgement(F.col(f"j.{c}")), 6).alias(c)
    return out.select(*rows.columns, grade("faithfulness"), grade("relevancy"), grade("correctness"), "j.unsupported_claims", "judge_error")


def judge_stub(asked: str | None) -> str:
    """Grades from 1 to 5 by shared words: of the answer with the context, with the question, with the ideal answer."""
    import json
    import re

    s = json.loads(asked or "{}")
    words = {k: set(re.findall(r"[a-z0-9]{3,}", (s.get(k) or "").lower())) for k in ("question", "answer", "context", "ideal")}
    share = lambda part, whole: len(words[part] & words[whole]) / len(words[part]) if words[part] else 1.0
    grades = {"faithfulness": share("answer", "context"), "relevancy": share("question", "answer"), "correctness": share("ideal", "answer")}
    return structured(json.dumps({k: 1 + round(4 * v) for k, v in grades.items()} | {"reasoning": "shared words", "unsupported_claims": []}), json.dumps)


roles.add("judge", judge_stub)
