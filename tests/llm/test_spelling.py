"""Spelling variants against a plain count and a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from sievework.llm import op11_spelling as op


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 5}


def plain(docs):
    n = counts(docs)
    form, out = {}, {}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    close = {w: [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, []) if v != w and near(w, v)] for w in n}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), None if form[w] is None else n[form[w]])
    return out


def same(df, docs):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    assert found == plain(docs)
    return found


def test_keys_of_strings_with_a_place_out():
    words = ["abcabc", "aabbcc", "zzzzzz", "éÿabcd"]
    matrix = np.array([list(w.encode("latin-1")) for w in words]).astype(np.uint64)
    whole, less = op.deletion_keys(matrix)
    for i, w in enumerate(words):
        for p in range(6):
            rest = w[:p] + w[p + 1 :]
            assert less[i, p] == op.deletion_keys(np.array([list(rest.encode("latin-1"))]).astype(np.uint64))[0][0]
    assert len(set(whole.tolist())) == 4


def test_whole_table(spark, sf_small):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    assert any(f for f, *_ in same(op.query(spark, sf_small), docs).values())


def family(draw):
    """Texts whose words form chains, ties, doubled letters, large families of one place."""
    base = ["letter", "leterés", "banana", "aaaaaa", "Écoleés", "sentence"]
    vocabulary = list(base)
    for w in base:
        for _ in range(60):
            v = draw.choice([w, draw.choice(vocabulary)])
            i = draw.randrange(len(v))
            vocabulary.append(draw.choice([v[:i] + v[i + 1 :], v[:i] + draw.choice("abéz") + v[i:], v[:i] + draw.choice("abéz") + v[i + 1 :]]))
    return vocabulary + ["bott" + c + "m" for c in "abcdefghijklmnopqrstuvwxyz"]


def test_families_and_odd_rows(spark):
    draw = random.Random(3)
    words = family(draw)
    weights = [5 ** draw.randrange(0, 5) for _ in words]
    docs = [(draw.choice([None, *range(60)]), " ".join(w if draw.random() < 0.9 else w.upper() for w in draw.choices(words, weights, k=draw.randrange(0, 200)))) for _ in range(150)]
    docs += [(1, None), (2, ""), (None, "×÷" * 9), (3, "a" * 9_000 + " " + "a" * 8_999 + " " + "b" + "a" * 8_999)] + [(4, "x" * 5_000 + " " + "x" * 4_999)] * 7
    docs += [(5, " ".join(["chained"] * 700 + ["chaineds"] * 130 + ["chainedst"] * 25 + ["chainedsts"] * 5))]
    docs += docs[:20]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "'q' AS n", "2 AS id", "'s' AS lang")
    found = same(op.variants(df), docs)
    assert any(found[f][0] for f, *_ in found.values() if f)  # a chain of two forms
    assert op.variants(df.where("false")).collect() == []


def test_collisions_part_again(spark, monkeypatch):
    """With keys of three bits nearly all rows meet; the strings decide."""
    monkeypatch.setattr(op, "mixed", lambda h, length: h & np.uint64(7))
    docs = [(i, " ".join(family(random.Random(i)))) for i in range(40)]
    words = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(sorted(counts(docs).items()))], "id long, word string, n long")
    rows = []
    for r in words.collect():
        whole, less = op.deletion_keys(np.array([list(r["word"].encode("latin-1"))]).astype(np.uint64))
        rows += [(int(whole[0]), op.WHOLE, True, r["id"]), *((int(k), p, p == 0 or r["word"][p] != r["word"][p - 1], r["id"]) for p, k in enumerate(less[0]))]
    rows.sort()
    key, place, fresh, ids = (np.array(c) for c in zip(*rows, strict=True))
    met = [(int(ids[i]), int(place[i]), kind) for kind, which in enumerate(op.meeting(key, place, fresh)) for i in np.flatnonzero(which)]
    parts = op.neighbour_parts(spark.createDataFrame([(a, b, bool(c)) for a, b, c in met], "id long, place int, inserted boolean"), words)
    got = {r["word"]: r["n"] for r in parts.groupBy("word").agg({"near": "sum"}).toDF("word", "n").collect()}
    assert got == {w: v[3] for w, v in plain(docs).items() if v[3]}
