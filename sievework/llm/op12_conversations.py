"""Operator 12, conversation structure repair by dynamic programming over a trie of role and fault signatures.

Each row of a conversation becomes one letter of a signature: its role's initial (s, u, a, other) and its first fault
(none, truncated, blank, duplicate). The repair is a cheapest sequence of edits that gives role initials `(s?(ua)+)?`: Keep 0,
Rerole 1, Delete 2 (all that a blank or duplicate row allows), Insert 5, and 5 more for a truncated row that stays;
ties go to the ASCII-least sequence of initials.

Signatures are range-partitioned and sorted, so those that share a prefix meet: walking them in order is a walk of their
prefix trie, of which only the present path is held. A node's layer has, for each of the four states of the pattern (nothing
yet, after s, after u, after a), the least cost, the way back, and how the states' best sequences compare; it is computed
once for all signatures below it. A terminal node gives the answer of every conversation that ends there.

Two best sequences of different states in one layer either differ at some place or one is the other and some inserts, so
their order is one small number, and extending a sequence never needs its letters: a layer takes constant time and room.

Scale: rows are numbered by range partitions (a conversation with a third of all rows lies in many), a duplicate is a row
that isn't the first of its (conversation, role, text hash), found by partial aggregation and joined by row number, and
signatures are made in segments of `SEGMENT` rows before they meet by conversation: what one task holds of a conversation is
a letter a row, as long as its audit. The hash of the repaired text reads its rows in order as a stream, digest by digest.

Defined results: a null conv_id is a conversation of its own, written as one space where the damage is drawn; a null turn
comes first, null roles and texts are one space; rows of one turn are ordered by role, then text; repeated rows are rows; a
conversation whose rows are all dropped gets zeros, an empty audit and the empty string's hash; an empty table gives no
rows; extra columns are neither read nor passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running, settled, table, written

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT = 1024
SPACE = " \t\n\x0b\x0c\r"
NONE, CUT, BLANK, AGAIN = range(4)
INITIALS = "sua?"
#: A signature's letters: initial by initial, fault by fault.
LETTERS = "abcdefghijklmnop"
ROLES = {"u": "user", "a": "assistant"}


# --- damage and faults, in column functions -----------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live of conversations after damage; a dropped row stays with live false."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    drawn = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("_k"))
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role"))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_k") != 0).alias("live"), F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_i")).drop("_i")


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, signature of numbered rows(seq, conv_id, turn, role, text, live)."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = rows.select("seq", "conv_id", "turn", "live", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"), F.substring(body, -1, 1).isin(".", "!", "?").alias("ended"), "role", F.sha2("text", 256).alias("digest"))
    narrow = written(narrow, "faults")
    first = narrow.where("live and not blank").groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("fresh"))
    judged = narrow.join(first, "seq", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("fresh").isNull(), AGAIN).when(~F.col("ended"), CUT).otherwise(NONE)
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    letter = F.substring(F.lit(LETTERS), role * 4 + fault + 1, F.lit(1))
    alive = lambda c: F.when(F.col("live"), c)
    turns = alive(F.col("turn"))
    parts = judged.groupBy("conv_id", F.floor(F.col("seq") / SEGMENT).alias("part")).agg(
        F.min(turns).alias("low"), F.max(turns).alias("high"), F.size(F.collect_set(turns)).cast("long").alias("n"), F.array_sort(F.collect_list(alive(F.struct("seq", letter.alias("x"))))).alias("x")
    )
    parts = parts.select("conv_id", F.struct("part", "low", "high", "n", F.array_join(F.col("x.x"), "").alias("x")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    some = F.filter("p", lambda p: p["low"].isNotNull())
    shared = F.aggregate(some, F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(p["high"].alias("last"), (s["n"] + p["n"] - F.coalesce(s["last"] == p["low"], F.lit(False)).cast("long")).alias("n")))["n"]
    gaps = F.array_max(F.transform(some, lambda p: p["high"])) - F.array_min(F.transform(some, lambda p: p["low"])) + 1 - shared
    return whole.select("conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), F.array_join(F.col("p.x"), "").alias("signature"))


# --- layers ---------------------------------------------------------------------------------------------------------------

#: States of the pattern: nothing yet, after s, after u, after a; NEXT is where an initial leads, EXPECTED what may be made up.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "?": (None,) * 4}
EXPECTED = "uuau"
FREE = (2, 2, 3, 2)
BELOW, ABOVE = -99, 99


class Layer:
    """cost and way back (previous state, edits) by state, and order[x][y]: BELOW or ABOVE if the best sequences of x and y
    differ somewhere, else how many inserts longer that of y is (both consumed the same rows)."""

    __slots__ = ("cost", "back", "order")

    def __init__(self, cost, back, order):
        self.cost, self.back, self.order = cost, back, order


def start() -> Layer:
    return Layer([0, None, None, None], [None] * 4, [[0] * 4 for _ in range(4)])


def with_inserts(layer: Layer) -> Layer:
    """The layer after any inserts; way back holds (state of layer, number of inserts)."""
    cost, via = list(layer.cost), [(s, 0) for s in range(4)]
    order = layer.order
    changed = True
    while changed:
        changed = False
        for s in range(4):
            if cost[s] is None:
                continue
            t, c = FREE[s], cost[s] + INSERT
            new = (via[s][0], via[s][1] + 1)
            if cost[t] is None or c < cost[t] or (c == cost[t] and compare(order, new, via[t]) == BELOW):
                cost[t], via[t], changed = c, new, True
    made = [[compare(order, via[x], via[y]) if cost[x] is not None and cost[y] is not None else 0 for y in range(4)] for x in range(4)]
    return Layer(cost, via, made)


def compare(order, a: tuple[int, int], b: tuple[int, int]) -> int:
    """Order of two sequences, each of a state's best one and some inserts."""
    known = order[a[0]][b[0]]
    return known if known in (BELOW, ABOVE) else known + b[1] - a[1]


def extended(layer: Layer, role: str, fault: int) -> Layer:
    """The next layer after a row."""
    ready = with_inserts(layer)
    options: list[list] = [[], [], [], []]
    stays = TRUNCATED if fault == CUT else 0
    for s in range(4):
        c = ready.cost[s]
        if c is None:
            continue
        options[s].append((c + DELETE, s, "D"))
        if fault < BLANK:
            if NEXT[role][s] is not None:
                options[NEXT[role][s]].append((c + stays, s, "K"))
            options[FREE[s]].append((c + REROLE + stays, s, "R"))

    def below(a, b) -> int:
        """Order of two sequences that end in an edit of this row."""
        if a[1] == b[1]:
            return 0 if a[2] == b[2] else BELOW if a[2] < b[2] else ABOVE
        known = ready.order[a[1]][b[1]]
        if known in (BELOW, ABOVE):
            return known
        if known > 0:  # b's has an insert where a's has this row's edit
            return BELOW if a[2] < "I" else ABOVE
        return BELOW if "I" < b[2] else ABOVE

    best: list = [None] * 4
    for s in range(4):
        for o in options[s]:
            if best[s] is None or o[0] < best[s][0] or (o[0] == best[s][0] and below(o, best[s]) == BELOW):
                best[s] = o
    order = [[below(best[x], best[y]) if best[x] and best[y] else 0 for y in range(4)] for x in range(4)]
    back = [None if b is None else (ready.back[b[1]][0], "I" * ready.back[b[1]][1] + b[2]) for b in best]
    return Layer([None if b is None else b[0] for b in best], back, order)


def answer(path: list[Layer]) -> tuple[int, str]:
    """Cost and edits of the best sequence at a terminal node; path holds the layers from the root."""
    ready = with_inserts(path[-1])
    none, pairs = ready.cost[0], ready.cost[3]
    end = 3 if none is None or (pairs is not None and (pairs < none or (pairs == none and ready.order[3][0] == BELOW))) else 0
    state, inserts = ready.back[end]
    edits = ["I" * inserts]
    for layer in reversed(path[1:]):
        state, made = layer.back[state]
        edits.append(made)
    return ready.cost[end], "".join(reversed(edits))


class Trie:
    """The present path of a walk through sorted signatures: layers and counts of faults and illegal pairs by depth."""

    def __init__(self):
        self.path, self.counts, self.word, self.layers = [start()], [(0, 0, 0, 0)], "", 0

    def at(self, word: str) -> tuple[tuple[int, int, int, int], int, str]:
        """Counts (blank, duplicate, truncated, illegal), cost and edits of word; only what the last word doesn't share is computed."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        del self.path[shared + 1 :], self.counts[shared + 1 :]
        for i in range(shared, len(word)):
            role, fault = INITIALS[LETTERS.index(word[i]) // 4], LETTERS.index(word[i]) % 4
            before = INITIALS[LETTERS.index(word[i - 1]) // 4] if i else None
            blank, again, cut, illegal = self.counts[-1]
            self.counts.append((blank + (fault == BLANK), again + (fault == AGAIN), cut + (fault == CUT), illegal + (before is not None and before + role not in ("su", "ua", "au"))))
            self.path.append(extended(self.path[-1], role, fault))
            self.layers += 1
        self.word = word
        return self.counts[-1], *answer(self.path)


ANSWER = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repair of sorted (conv_id, gaps, signature) rows."""
    trie, last = Trie(), None
    for b in batches:
        out = []
        for word in b.column(2).to_pylist():
            if word != last:
                counts, cost, audit = trie.at(word)
                made, last = (*counts, cost, audit), word
            out.append(made)
        columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(5)] + [pa.array([o[5] for o in out], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


# --- repaired texts -------------------------------------------------------------------------------------------------------


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, in order, as the edits say."""
    state = 0
    for edit in audit:
        if edit == "I":
            role, text = ROLES[EXPECTED[state]], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[EXPECTED[state]]
        state = NEXT[role[:1]][state]
        yield role, text


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[int | None, str, Iterator[tuple[str, str]]]]:
    """conv_id, audit and the rows' (role, text) as a stream; a conversation's first row is the one with its audit."""
    held = next(rows, None)
    while held is not None:
        conv, audit, nxt = held[0], held[4], []

        def texts(nxt=nxt):
            for r in rows:
                if r[1] < 0:
                    nxt.append(r)
                    return
                yield r[2], r[3]

        part = texts()
        yield conv, audit, part
        for _ in part:  # deleted rows at the end
            pass
        held = nxt[0] if nxt else None


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, repaired_sha256, a row a conversation; texts go into the digest as they come."""
    ids, out = [], []
    for conv, audit, rows in _conversations(_stream(batches)):
        digest, first = hashlib.sha256(), True
        for role, text in repaired(audit, rows):
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
        ids.append(conv)
        out.append(digest.hexdigest())
        if len(ids) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])
            ids, out = [], []
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])


def numbered_rows(conversations: DataFrame) -> DataFrame:
    """seq, conv_id, turn, role, text, live in the order of repair."""
    rows = damaged(conversations)
    return written(running(rows, [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")], "numbered"), "rows")


def diagnosed(rows: DataFrame) -> DataFrame:
    """ANSWER of numbered rows."""
    words = written(signatures(rows), "signatures")
    return words.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id").mapInArrow(answers, ANSWER)


def ordered(rows: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """conv_id, seq, role, text, audit: each conversation's audit (seq -1), then its rows, together and in order."""
    heads = diagnoses.select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    body = rows.where("live").select("conv_id", "seq", "role", "text", F.lit(None).cast("string").alias("audit"))
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "seq")


def repaired_rows(rows: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the repaired conversations themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for conv, audit, part in _conversations(_stream(batches)):
                for i, (role, text) in enumerate(repaired(audit, part)):
                    yield conv, i, role, text

        out: list[tuple] = []
        for r in made():
            out.append(r)
            if len(out) == 1000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return ordered(rows, diagnoses).mapInArrow(run, "conv_id long, place long, role string, text string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "place", "role", "text"])


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every original conversation."""
    settled(conversations.sparkSession)
    rows = numbered_rows(conversations)
    found = written(diagnosed(rows), "diagnosed")
    hashed = ordered(rows, found).mapInArrow(digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_c")
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
