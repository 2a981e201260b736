"""Source mixing: the SQL of the query (all quotients ranked) on odd tables, targets by repeated resharing, exact quotas."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sievework.llm import op13_mixing as op


def plain_targets(sizes):
    """Excess reshared again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: op.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def check(df):
    rows = op.mixed(df).collect()
    table = [(r["doc_id"], r["source"], r["text"]) for r in df.select("doc_id", "source", "text").collect()]
    assert len(rows) == len(table)
    duck = duckdb.connect()
    duck.execute("create table documents(doc_id bigint, source varchar, text varchar)")
    if table:
        duck.executemany("insert into documents values (?, ?, ?)", table)
    flat = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert Counter(map(flat, rows)) == Counter(map(flat, duck.execute(op.ORACLE).fetchall()))
    sizes = defaultdict(int)
    for _, source, text in table:
        sizes[source] += len([w for w in _words(text)])
    wanted = plain_targets(sizes)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4)) for r in rows) == Counter((d, len(_words(t)), sizes[s], round(wanted[s], 4)) for d, s, t in table)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    return rows


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def text(draw, most):
    return " ".join(["word"] * draw.randrange(0, most))


def table(spark, seed, sources, rows, most, hot=0):
    draw = random.Random(seed)
    docs = [(i, draw.choice(sources), text(draw, most)) for i in range(rows)] + [(10_000 + i, sources[0], text(draw, most)) for i in range(hot)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string")


def test_whole_table_near_targets(spark, sf_small):
    rows = check(spark.read.parquet(f"{sf_small}/documents.parquet"))
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 1 for s in target)


def test_hot_source_and_nulls_and_reruns(spark):
    df = table(spark, 0, ["ü", "Z", "a", "", "é", None], 150, 90, hot=100)
    rows = check(df)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.02)
    key = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert key(rows) == key(op.mixed(df.repartition(7)).collect())


def test_odd_rows(spark):
    docs = [(None, None, None), (1, "a", ""), (1, "a", " \t\n"), (2, "b", "one"), (2, "b", "one"), (3, "c", "x " * 40_000), (None, "a", "two words"), (4, "d", " 　 y")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "7 AS size", "8 AS place", "'x' AS seq", "9 AS _part", "1 AS quota")
    check(df)
    assert op.mixed(df.where("false")).collect() == []
    assert [(r["size"], r["target"], r["taken"]) for r in op.mixed(df.where("text is null")).collect()] == [(0, 0.0, 0)]


def test_apportionment_equals_ranking_all_quotients(spark):
    draw = random.Random(4)
    units, want = [], {}
    for g in range(25):
        shares = [draw.choice([0, 1, 2, 7, 7, 100, draw.randrange(1, 5000)]) for _ in range(draw.randrange(1, 14))]
        seats = draw.randrange(0, 60) if sum(shares) else 0
        units += [(g, p, s, seats) for p, s in enumerate(shares)]
        best = sorted((-s / (2 * k + 1), p, k) for p, s in enumerate(shares) if s for k in range(seats + 1))[:seats]
        won = Counter(p for _, p, _ in best)
        want |= {(g, p): won[p] for p in range(len(shares))}
    df = spark.createDataFrame(units, "g long, p long, share long, seats long")
    got = {(r["g"], r["p"]): r["quota"] for r in op.apportioned(df, "g", "p", "share", "seats").collect()}
    assert got == want
    assert not math.isnan(sum(got.values()))
