"""Graph queries over all capitalised words: small tables against SQL, the search by mentions against the one by edges."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievework.operators import graph
from sievework.plans import strategies
from sievework.session import checkpoint

#: Names of a few letters, of one and of letters beyond ASCII; capitals within a word or after a digit begin none.
TEXTS = ["Of Oslo and some rain.", "we met Łódź there, Ñu too", "plan B here, Oslo Rome", "then Rome said nothing", "no capital, iPhone 9Lives", None]


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tiny"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    put("documents", [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    put("benchmark", [(0, "is it oslo"), (1, "łódź"), (2, "9lives, iphone?"), (3, "xyz")], "item_id long, text string")
    put("labels", [(0, 1, 0)], "doc_id long, quality int, toxic int")
    spark.sql("select 1L event_id, 0L user_id, timestamp'2024-01-01' ts").coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def sql_rows(folder, sql, columns):
    c = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "events"):
        c.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    found = c.execute(sql)
    at = [[d[0] for d in found.description].index(x) for x in columns]
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", ["graph_rag", "hybrid_graph"])
def test_words_of_any_length_and_script_are_entities(spark, tiny, name):
    df = entry.queries()[name](spark, tiny)
    got = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert got == sql_rows(tiny, entry.oracle_sql()[name], df.columns)


def test_graph_rag_goes_by_short_names(spark, tiny):
    """Only the graph's own results have no signals; questions that name no entity go to hybrid."""
    found = entry.queries()["graph_rag"](spark, tiny).collect()
    assert {r["query_id"] for r in found if r["final"] == r["rerank"]} == {0, 1}


def test_hybrid_graph_fuses_what_short_names_reach(spark, tiny, monkeypatch):
    """Document 3 shares no word with the first question, only a neighbour of its entity."""
    seen = []
    fuse = strategies.r.rrf
    monkeypatch.setattr(strategies.r, "rrf", lambda lists, k: (seen.append(lists), fuse(lists, k))[1])
    entry.queries()["hybrid_graph"](spark, tiny).collect()
    assert not seen[-1].where("query_id = 0 and chunk_id = 3").isEmpty()


@pytest.mark.parametrize(("hops", "size"), [(0, 256), (1, 256), (1, 70), (2, 256)])
def test_search_by_mentions_equals_search_by_edges(spark, hops, size):
    rng = np.random.default_rng(hops)
    pairs = {(f"e{rng.integers(0, 40)}x", int(c)) for c in range(90) for _ in range(rng.integers(1, 4))}
    rows = checkpoint(spark.createDataFrame(sorted(pairs), "entity string, chunk_id long"))
    asked = [(i, " ".join(f"E{rng.integers(0, 60)}x" for _ in range(1 + i % 2))) for i in range(130)] + [(500, ""), (501, None)]
    q = spark.createDataFrame(asked, "query_id long, text string")
    allowed = rows.where("chunk_id % 3 <> 0").select("chunk_id")
    want = graph.graph_search(q, rows, checkpoint(graph.edges(rows)), hops, 7, allowed).drop("matched").collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # chunks go over batches
    try:
        got = graph.mention_search(q, rows, hops, 7, allowed, size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = got.select("query_id", "chunk_id", "score", "rank").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) > 300 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_search_by_mentions_makes_no_pairs(spark):
    """A chunk of 20,000 entities would have 400 million of them."""
    rows = checkpoint(spark.range(20_000).select(F.concat(F.lit("e"), "id", F.lit("x")).alias("entity"), F.lit(1).cast("long").alias("chunk_id")).unionByName(spark.createDataFrame([("e7x", 2)], "entity string, chunk_id long")))
    q = spark.createDataFrame([(1, "what of e5x"), (2, "nothing")], "query_id long, text string")
    assert [tuple(r) for r in graph.mention_search(q, rows).select("query_id", "chunk_id", "score", "rank").orderBy("rank").collect()] == [(1, 1, 20_001.0, 0), (1, 2, 1.0, 1)]
    assert graph.mention_search(q.where("query_id = 2"), rows).isEmpty()
