"""Operator 11, spelling variant grouping by rolling-hash deletions.

Words are the runs of Latin letters of all texts, with the contract's planted misspellings, that are long and frequent
enough. Two words are near if they differ by one code point: by a replaced one, then taking the same place out of both
gives the same string, or by an inserted one, then taking a place out of the longer gives the shorter.

Every string with one place out gets a 64-bit key from polynomial hashes of the prefix before and the suffix after the
place, for all words of one length at once in NumPy; a word's own key marks its whole. Rows (key, place, word's number) are
partitioned by the keys' leading bits and sorted, and a streaming pass keeps those that meet: the same key and place, or the
same key as a whole word. The kept rows then fetch their words, and groups are formed on the strings themselves, so a
collision of keys parts again.

No pairs are made: within a group every word is near every other (a group has at most one word a letter for a place), so
a word's part is the group's size less one, and its best neighbour is the group's best or second. Forms grow by `RATIO` a
step, so chains are short, and doubling finds their ends in a few joins.

Scale: occurrences are counted with partial aggregation before the shuffle, so frequent words are no hot keys; from there on
everything grows with the vocabulary. Key rows carry no strings, so a word of many thousand letters stays cheap.

Defined results: a null or empty text has no runs; a null doc_id is written as an empty string where misspellings are
planted; repeated rows count each; ties of n go to the smaller form; an empty table gives no rows; extra columns are neither
read nor passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, PLANTED = 6, 5, 5, 199
WHOLE = -1
#: Base and mixing factors of the hashes: any odd numbers.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
CELLS = 1 << 20
GATHER = 1 << 16


def lowered(run: Column) -> Column:
    """A-Z alone in lower case; runs of ASCII letters by the faster function."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, capitals, capitals.lower()))


def counted_words(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    place = (h % F.length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = runs.select(F.when(h % PLANTED == 0, without).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = (h ^ np.uint64(length)) * MIX
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def deletion_keys(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of whole words, and of each word without its i-th place, of a matrix with a row of code points a word."""
    m, n = letters.shape
    prefix, suffix = np.zeros((m, n + 1), np.uint64), np.zeros((m, n + 1), np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
    for i in range(n):
        prefix[:, i + 1] = prefix[:, i] * BASE + letters[:, i]
    for i in range(n - 1, -1, -1):
        suffix[:, i] = letters[:, i] * power[n - 1 - i] + suffix[:, i + 1]
    return mixed(prefix[:, n].copy(), n), mixed(prefix[:, :n] * power[n - 1 - np.arange(n)] + suffix[:, 1:], n - 1)


def key_rows(words: DataFrame) -> DataFrame:
    """key, place (WHOLE for the word itself), id, fresh of words(id, word).

    Taking any letter out of a run of equal ones gives the same string; fresh marks the first, which is enough for insertions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), [w.encode("latin-1") for w in b.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts])
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                step = max(1, CELLS // n)
                for part in (at[i : i + step] for i in range(0, len(at), step)):
                    letters = np.frombuffer(b"".join(texts[i] for i in part), np.uint8).reshape(len(part), n).astype(np.uint64)
                    whole, less = deletion_keys(letters)
                    keys = np.concatenate([whole[:, None], less], axis=1)
                    fresh = np.ones(keys.shape, bool)
                    fresh[:, 2:] = letters[:, 1:] != letters[:, :-1]
                    for low in range(0, n + 1, CELLS):
                        piece = keys[:, low : low + CELLS]
                        places = np.arange(low - 1, low - 1 + piece.shape[1], dtype=np.int32)
                        columns = (piece.ravel().view(np.int64), np.tile(places, len(part)), np.repeat(ids[part], piece.shape[1]), fresh[:, low : low + CELLS].ravel())
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "place", "id", "fresh"])

    return words.select("id", "word").mapInArrow(run, "key long, place int, id long, fresh boolean")


def meeting(key: np.ndarray, place: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and place (whole groups of a key): which meet in a replacement, which in an insertion."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    spot = new.copy()
    spot[1:] |= place[1:] != place[:-1]
    run = np.cumsum(spot) - 1
    whole = place == WHOLE
    replaced = (np.bincount(run)[run] > 1) & ~whole
    inserted = (np.bincount(group, whole)[group] > 0) & fresh & ~whole
    return replaced, inserted | (whole & (np.bincount(group, inserted)[group] > 0))


def meeting_rows(rows: DataFrame) -> DataFrame:
    """id, place, inserted of the key rows that meet, by radix partitions of the keys, each sorted and read as a stream."""

    def found(key, place, ids, fresh):
        replaced, inserted = meeting(key, place, fresh)
        at = np.concatenate([np.flatnonzero(replaced), np.flatnonzero(inserted)])
        kind = np.arange(len(at)) >= replaced.sum()
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(place[at]), pa.array(kind)], names=["id", "place", "inserted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            n += b.num_rows
            if n >= GATHER:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key's group may go on
                if cut:
                    yield found(*(c[:cut] for c in columns))
                held = [[c[cut:] for c in columns]]
                n = len(held[0][0])
        if n:
            yield found(*(np.concatenate(c) for c in zip(*held, strict=True)))

    radix = F.shiftrightunsigned("key", 48)
    return rows.repartition(radix).sortWithinPartitions("key", "place").mapInArrow(run, "id long, place int, inserted boolean")


def neighbour_parts(met: DataFrame, words: DataFrame) -> DataFrame:
    """word, near (how many words of one group are near), best (struct of -n and word of the best of them)."""
    rows = met.join(words, "id")
    without = F.when(F.col("place") == WHOLE, F.col("word")).otherwise(F.concat(F.substring(F.col("word"), F.lit(1), F.col("place")), F.substring(F.col("word"), F.col("place") + 2, F.length("word"))))
    rows = rows.select(without.alias("string"), "place", "inserted", F.struct((-F.col("n")).alias("least"), F.col("word").alias("word")).alias("w"))
    same = rows.where(~F.col("inserted")).groupBy("string", "place").agg(F.array_sort(F.collect_list("w")).alias("w")).where(F.size("w") > 1)
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    same = same.select((F.size("w") - 1).alias("near"), first.alias("first"), second.alias("second"), F.explode("w").alias("w"))
    same = same.select("w.word", "near", F.when(F.col("w.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    whole = F.col("place") == WHOLE
    longer = rows.where("inserted").groupBy("string").agg(F.max(F.when(whole, F.col("w"))).alias("own"), F.array_sort(F.collect_set(F.when(~whole, F.col("w")))).alias("w")).where(F.col("own").isNotNull() & (F.size("w") > 0))
    of_own = longer.select("own.word", F.size("w").alias("near"), F.get("w", F.lit(0)).alias("best"))
    of_longer = longer.select("own", F.explode("w").alias("w")).select("w.word", F.lit(1).alias("near"), F.col("own").alias("best"))
    return same.unionByName(of_own).unionByName(of_longer)


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form), by doubling: each round joins every word's last known form with its own last one."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        stepped = written(known.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "roots")
        known = stepped.drop("_moved")
        if stepped.where("_moved").isEmpty():
            return known


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    settled(docs.sparkSession)
    words = written(counted_words(docs, least_count).withColumn("id", F.monotonically_increasing_id()), "words")
    met = written(meeting_rows(key_rows(words)), "meeting")
    parts = neighbour_parts(met, words).groupBy("word").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))
    joined = words.join(parts, "word", "left")
    fits = -F.col("best.least") >= ratio * F.col("n")
    out = written(joined.select("word", F.when(fits, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.least")).alias("form_n")), "forms")
    roots = with_roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
