"""Command line: python -m sievework.cli doctor | ingest PATH | index | ask QUESTION | eval SUITE, over collections below --root."""

from __future__ import annotations

import argparse
import importlib.util
import json
import shutil
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings
from .operators import access, dense_index, feedback, models, sparse_index
from .operators import ingest as i
from .plans import answer as online
from .plans import evaluation, strategies
from .plans.base import checkpoint
from .session import local_session
from .sources import files, tables


def doctor(spark: SparkSession | None = None) -> list[tuple[str, bool, str]]:
    """(component, ready, detail) of what the engine needs."""
    out = [("java", shutil.which("java") is not None, shutil.which("java") or "not found")]
    out += [(m, importlib.util.find_spec(m) is not None, "") for m in ("pyspark", "pyarrow", "numpy", "pandas")]
    if spark is not None:
        out.append(("session", spark.range(3).count() == 3, spark.version))
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        out.append(("shared folder", bool(shared) or spark.sparkContext.master.startswith("local"), shared or "a temporary one (local mode)"))
    return out


def ingest_path(spark: SparkSession, root: str, path: str, full_rebuild: bool = False, role: str | None = None, section_role: str | None = None, chosen: dict = settings.DEFAULTS) -> dict[str, int]:
    """Ingests a file or folder into the collections; how many documents were processed, skipped, duplicates and failed.

    Near-duplicates are found over all runs (`fingerprints`), and results of models are kept (`enrichment`, `summaries`,
    `embeddings`), so an edited document asks again only for what changed.
    """
    store = tables.Collections(spark, root)
    held = lambda name: store.read(name) if store.target(name) else None
    registry = held("registry")
    made = online.ingest_run(
        files.load_path(spark, path), registry, checkpoint, role=role, full_rebuild=full_rebuild, known=None if full_rebuild else held("fingerprints"), enrichment_cache=held("enrichment"), section_role=section_role, section_cache=held("summaries"),
    )
    status = checkpoint(made["status"])
    done = checkpoint(status.where("status = 'ingested'").select("doc_id"))
    indexed = i.index_documents(checkpoint(made["chunks"]), done, store, cache=held("embeddings"), backend=models.backend(chosen))
    store.reindex("embeddings", lambda: indexed["cache"])
    for name, rows in (("enrichment", made["enrichment_cache"] if role else None), ("summaries", made["section_cache"] if section_role else None)):
        if rows is not None:
            store.reindex(name, lambda rows=rows: rows)
    for name in ("fingerprints", "sections"):
        rows, old = checkpoint(made["prints" if name == "fingerprints" else name]), held(name)
        if name == "fingerprints" and old is not None:
            last = old.agg(F.max("seq")).first()[0] or 0
            rows = rows.withColumn("seq", F.col("seq") + last)
        # A new document's rows are appended; only an edited one's old rows make a rewrite necessary.
        if old is not None and not old.join(done, "doc_id", "left_semi").isEmpty():
            store.reindex(name, lambda rows=rows, old=old: tables.replace_documents(old, rows, done))
        else:
            store.append(name, rows)
    seen = status.where("status in ('ingested', 'failed')").select("doc_id", "content_hash", "status")
    store.reindex("registry", lambda: tables.merge(registry, seen, "doc_id"))
    counts = {r["status"]: r["n"] for r in online.summary(status).collect()}
    return {"processed": counts.get("ingested", 0), "skipped": counts.get("skipped", 0), "duplicates": counts.get("duplicate", 0), "failed": counts.get("failed", 0)}


def index_folder(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/_indexes/{version}"


def build_indexes(spark: SparkSession, root: str) -> str:
    """Stores the sparse and the dense index of the present version of the chunks, and removes those of versions that are gone."""
    store = tables.Collections(spark, root)
    version = store.target("chunks")
    chunks, folder = store.read("chunks").drop("sparse"), index_folder(root, version)
    sparse_index.build(chunks.drop("dense"), f"{folder}/sparse")
    dense_index.build(chunks.drop("text").withColumnsRenamed({"chunk_id": "id", "dense": "vector"}), f"{folder}/dense")
    for name in tables.Collections(spark, f"{root.rstrip('/')}/_indexes").list():
        if name not in store.list():
            store.remove(f"_indexes/{name}")
    return folder


def context(spark: SparkSession, root: str, queries: DataFrame, entitlements: list[str], chosen: dict = settings.DEFAULTS) -> strategies.Context:
    """A context over the ingested chunks as a user with these entitlements sees them, with their stored vectors, document features
    (popularity from the recorded hits), entity graph, and the indexes of this version if build_indexes made them."""
    store = tables.Collections(spark, root)
    held = lambda name: store.read(name) if store.target(name) else None
    features, hits = held("features"), held("hits")
    if features is not None and hits is not None:
        used = feedback.popularity(feedback.numbered(hits, "at", "doc_id")).select("doc_id", F.col("popularity").alias("_p"))
        features = features.join(used, "doc_id", "left").withColumn("popularity", F.coalesce("_p", "popularity")).drop("_p")
    relaxed = access.relaxed(entitlements)
    mentions = held("mentions")
    ctx = strategies.Context(
        queries, store.read("chunks").drop("sparse"), features, None if mentions is None else mentions.select("entity", "chunk_id"), held("edges"), access.build_filter({}, [], entitlements), relaxed, backend=models.backend(chosen),
    )
    folder = index_folder(root, store.target("chunks"))
    if store.exists(f"_indexes/{store.target('chunks')}/dense/blocks/_SUCCESS"):
        ctx = strategies.replace(ctx, postings=sparse_index.SparseIndex(spark, f"{folder}/sparse"), vectors=dense_index.DenseIndex(spark, f"{folder}/dense"))
    return strategies.configured(ctx, chosen)


def ask(spark: SparkSession, root: str, question: str, entitlements: list[str], strategy: str | None = None, now: float | None = None, chosen: dict = settings.DEFAULTS, user: str = "anonymous") -> dict:
    queries = spark.createDataFrame([(1, question)], "query_id long, text string")
    service = online.Service(root, context(spark, root, queries, entitlements, chosen), entitlements, strategy or chosen["rag"]["strategy"], chosen, user)
    return service.ask(queries, time.time() if now is None else now).first().asDict()


def evaluate(spark: SparkSession, root: str, suite: str, entitlements: list[str], chosen: dict = settings.DEFAULTS) -> tuple[bool, dict[str, float]]:
    cases = evaluation.load_golden(spark, suite)
    run = lambda queries: online.answer(context(spark, root, queries, entitlements, chosen), chosen["rag"]["strategy"], chosen)
    report = evaluation.run_suite(cases, run, chosen["eval"]["gate_thresholds"])
    return report["passed"].first()["passed"], {r["metric"]: r["value"] for r in report["metrics"].collect()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework", description=__doc__)
    p.add_argument("--root", default="collections", help="folder of the collections")
    p.add_argument("--settings", help="a YAML or JSON file")
    p.add_argument("--entitlements", default="public", help="access tags of the user, separated by commas")
    p.add_argument("--user", default="anonymous", help="whom the limit of requests counts for")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor")
    one = sub.add_parser("ingest")
    one.add_argument("path")
    one.add_argument("--full-rebuild", action="store_true")
    sub.add_parser("index")
    sub.add_parser("ask").add_argument("question")
    sub.add_parser("eval").add_argument("suite")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or local_session()
    tags = [t for t in args.entitlements.split(",") if t]
    if args.command == "doctor":
        checks = doctor(spark)
        for name, ok, detail in checks:
            print(f"{name:14} {'ok' if ok else 'FAIL'}  {detail}")
        return 0 if all(ok for _, ok, _ in checks) else 1
    chosen = settings.load(spark, args.settings)
    if args.command == "ingest":
        counts = ingest_path(spark, args.root, args.path, args.full_rebuild, chosen=chosen)
        print(json.dumps(counts))
        return 0 if not counts["failed"] else 1
    if args.command == "index":
        print(build_indexes(spark, args.root))
        return 0
    if args.command == "ask":
        print(ask(spark, args.root, args.question, tags, chosen=chosen, user=args.user)["answer"])
        return 0
    passed, metrics = evaluate(spark, args.root, args.suite, tags, chosen)
    print(json.dumps({"passed": passed} | metrics, sort_keys=True))
    return 0 if passed else 2


if __name__ == "__main__":
    sys.exit(main())
