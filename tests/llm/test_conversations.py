"""Conversation repair against plain search: all edit sequences on short signatures, string DP on longer ones, whole tables."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from sievework.llm import op12_conversations as op

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def letter(role, fault):
    return op.LETTERS[op.INITIALS.index(role if role in "sua" else "?") * 4 + fault]


def brute(rows):
    """Least (cost, edits) of (initial, fault) rows over states of the pattern, sequences compared as strings."""
    nxt = lambda s, c: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, c))

    @cache
    def best(i, s, room):
        options = [(0, "")] if i == len(rows) and s in ("", "a") else []
        if room:
            for c in "ua":
                if nxt(s, c):
                    options += [(5 + k, "I" + e) for k, e in [best(i, nxt(s, c), room - 1)] if k < 10**6]
        if i < len(rows):
            role, fault = rows[i]
            moves = [("D", 2, s)]
            if fault < op.BLANK:
                extra = 5 if fault == op.CUT else 0
                moves += [("K", extra, nxt(s, role)), *(("R", 1 + extra, nxt(s, c)) for c in "ua")]
            for name, cost, to in moves:
                if to is not None:
                    k, e = best(i + 1, to, 3)
                    options.append((cost + k, name + e))
        return min(options, default=(10**9, ""))

    for i in reversed(range(len(rows))):  # from the end, so that no call goes deep
        for s in ("", "s", "u", "a"):
            best(i, s, 3)
    return best(0, "", 3)


def test_trie_equals_plain_search():
    draw = random.Random(5)
    words = [[(draw.choice("suuaaax"), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(draw.randrange(0, 14))] for _ in range(3000)]
    by_word = {"".join(letter(*r) for r in w): w for w in words}
    trie = op.Trie()
    for word in sorted(by_word):
        counts, cost, audit = trie.at(word)
        assert (cost, audit) == brute(tuple(by_word[word]))
        faults = [f for _, f in by_word[word]]
        initials = [r for r, _ in by_word[word]]
        assert counts == (faults.count(2), faults.count(3), faults.count(1), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)))
    assert trie.layers < sum(map(len, by_word)) * 0.95  # shared prefixes aren't computed again


def test_layers_are_shared():
    trie = op.Trie()
    for word in ["eieiei", "eieieiei", "eieieij"]:
        trie.at(word)
    assert trie.layers == 9


def test_long_signature():
    word = "".join(random.Random(1).choice("eiabcd") for _ in range(30_000))
    counts, cost, audit = op.Trie().at(word)
    assert len(audit.replace("I", "")) == len(word)


def plain(table):
    """The contract on a list of (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in table:
        by.setdefault(conv, [])
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(SPACES)
            faults.append(2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1)
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        cost, audit = brute(tuple((c if c and c in "sua" else "?", f) for c, f in zip(initials, faults, strict=True)))
        turns = [r[0] for r in rows if r[0] is not None]
        made, state, at = [], "", 0
        for e in audit:
            want = "a" if state == "u" else "u"
            if e == "I":
                made.append(op.ROLES[want] + ":")
                state = want
                continue
            _, role, text = rows[at]
            at += 1
            if e != "D":
                role = op.ROLES[want] if e == "R" else role
                made.append(f"{role}:{text}")
                state = role[0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def same(df, table):
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert found == plain(table)


def test_whole_table(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    same(op.query(spark, sf_small), [tuple(r) for r in rows.collect()])


def test_odd_rows(spark, monkeypatch):
    draw = random.Random(9)
    texts = [None, "", " \n\t", "yes.", "no", "wait! ", "wait! ", "line\n.", "é?", " ", "a" * 70_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "Unknown", "student"]
    table = [(draw.choice([None, *range(40)]), draw.choice([None, *range(9), -3]), draw.choice(roles), draw.choice(texts)) for _ in range(900)]
    table += [(77, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]  # a conversation over several segments
    table += [(78, t // 3, "user", None) for t in range(1100)]
    table += table[:50]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    clash = df.selectExpr("*", "1 AS seq", "'x' AS audit", "'y' AS live", "2 AS _part", "3 AS signature").repartition(5)
    same(op.repair(clash), table)


def test_all_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "hello.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in op.repair(df).select("conv_id", *COLUMNS).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert op.repair(df.where("false")).collect() == []


def test_repaired_rows_follow_the_pattern(spark, sf_small):
    rows = op.numbered_rows(spark.read.parquet(f"{sf_small}/conversations.parquet"))
    found = op.diagnosed(rows)
    made = {}
    for r in sorted(op.repaired_rows(rows, found).collect(), key=lambda r: (r["conv_id"], r["place"])):
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for r in op.repair(spark.read.parquet(f"{sf_small}/conversations.parquet")).collect():
        mine = made.get(r["conv_id"], [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in mine))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest() == r["repaired_sha256"]


@pytest.mark.parametrize("rows,cost,audit", [([], 0, ""), ([("u", 0)], 2, "D"), ([("s", 0), ("a", 0)], 1, "RK"), ([("u", 0), ("u", 0)], 1, "KR"), ([("u", 0), ("a", 1)], 4, "DD")])
def test_by_hand(rows, cost, audit):
    assert op.Trie().at("".join(letter(*r) for r in rows))[1:] == (cost, audit)
