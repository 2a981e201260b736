"""Operator 4, order-preserving packing of documents into token windows by dynamic programming.

The documents of an input partition, in its order, are one stream of tokens. Windows are cut from it without
changing the order: at document ends (free), after sentence ends (`SENTENCE` padding tokens' worth), or elsewhere
where neither comes for long (`FORCED`). Over the candidate positions b_0 < b_1 < ... the least cost is

    cost(j) = penalty(j) + min over i with b_j - b_i <= window of cost(i) + window - (b_j - b_i),

a sliding-window minimum of cost(i) + b_i, kept in a monotone queue: linear in the number of positions. The stream
is solved in segments of `SEGMENT` tokens; a segment's last two windows are left to the next one, so memory is
bounded whatever the partition's size and nothing is shuffled. A window's last tokens and padding fill it; only the
last window of a partition may be far from full. sequence_id is the partition's number times 2^33 plus the window's
number there, so a task that runs again on another executor gives the same rows.

Defined results: a null or empty text is its end id alone (one piece of one token); repeated rows are packed as
rows of their own; texts of any length are cut into as many pieces as needed; an empty table gives no rows; columns
other than doc_id and text are neither read nor passed on; doc_id may be null.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .op8_bpe import TOKENIZER, tokenizer_path
from .word_bpe import byte_alphabet, chunks, enter, folded, trim

WINDOW = 4096
#: The id after each document.
END_ID = 2
#: Penalties of a cut inside a document, in padding tokens: after a sentence, elsewhere.
SENTENCE, FORCED = 6, 24
#: Without a sentence end for so many tokens, a cut may come after each of them.
GAP = 96
SEGMENT = 1 << 19
#: Characters of texts that are encoded together.
GROUP = 1 << 24
#: Rows of a batch that goes out.
ROWS_OUT = 4096
#: Signs that are a piece of their own after a word.
SIGNS = ".,;:!?"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokenizer:
    """The library's ids of a text as little-endian unsigned 32-bit numbers.

    White space ends pieces and no id stands for it, so a text's ids are its chunks' ids in order. The different chunks of
    some texts go to the library many at once: plain words of folded texts (one piece; a sign after them is another) with
    blanks between, cut after the ids that close a piece, others with an added token's string between them, whose id
    marks where one ends. The texts' ids are then taken from that table. Nothing is kept from one group to the next.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer as Library
        from tokenizers import normalizers, pre_tokenizers

        self.library = Library.from_file(path)
        # For plain words in lower case with blanks between: nothing to normalise, each is a piece, its bytes are put in here.
        self.bare = Library(self.library.model)  # the same vocabulary, held once
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = byte_alphabet()
        self.as_bytes = {k: "".join(letters[b] for b in chr(k).encode()) for k in range(0x80, 0x100)}
        ends = [i for s, i in self.library.get_vocab(True).items() if s.removesuffix("</w>")[-1:] in set(".!?…。！？") and s.removesuffix("</w>")]
        self.ends = np.zeros(self.library.get_vocab_size(True) + 1, bool)
        self.ends[ends] = True
        self.closes = np.zeros(len(self.ends), bool)
        self.closes[[i for s, i in self.library.get_vocab(True).items() if s.endswith("</w>")]] = True
        self.mark, self.mark_id = next((t.content, i) for i, t in sorted(self.library.get_added_tokens_decoder().items()))
        self.signs = {sign: k for k, sign in enumerate(SIGNS)}
        self.sign_ids = [self.ids(sign) for sign in SIGNS]

    def ids(self, text: str, library=None) -> np.ndarray:
        return np.array((library or self.library).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def words(self, asked: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, their number by word) of plain words, some at a time."""
        for k in range(0, len(asked), 256):
            part = asked[k : k + 256]
            text = " ".join(part)
            ids = self.ids(text if text.isascii() else text.translate(self.as_bytes), self.bare)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("a plain word isn't one piece")
            yield ids, np.diff(stops, prepend=0)

    def others(self, asked: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, their number by chunk) of any chunks, some at a time; one that holds the mark goes alone."""
        group: list[str] = []
        for c in [*asked, None]:
            if group and (c is None or len(group) == 256 or self.mark in c):
                ids = self.ids(self.mark.join(group))
                at = ids == self.mark_id
                stops = np.append(np.flatnonzero(at), len(ids))
                yield ids[~at], np.diff(stops, prepend=-1) - 1
                group = []
            if c is not None and self.mark in c:
                ids = self.ids(c)
                yield ids, np.array([len(ids)])
            elif c is not None:
                group.append(c)

    def table(self, chunks: list[str], simple: bool) -> pa.ListArray:
        """The ids of each of different chunks; simple: they come from folded texts."""
        signs, first, second, rest = self.signs, [-1] * len(chunks), [-1] * len(chunks), []
        asked: list[str] = []
        if simple:
            words = [c for c in chunks if c.isalpha()]
            signed = [(k, c[:-1], signs[c[-1]]) for k, c in enumerate(chunks) if c and c[-1] in signs and c[:-1].isalpha()]
            asked = sorted({*words, *(w for _, w, _ in signed)}, key=str.isascii)  # those that need their bytes put in together
            number = dict(zip(asked, range(len(asked)), strict=True))
            first = [number.get(c, -1) for c in chunks]
            for k, w, sign in signed:
                first[k], second[k] = number[w], len(asked) + sign
            rest = [k for k, (c, a) in enumerate(zip(chunks, first, strict=True)) if a < 0 and c]
        else:
            rest = list(range(len(chunks)))
        for n, k in enumerate(rest, len(asked) + len(signs)):
            first[k] = n
        made = [*self.words(asked), *((x, np.array([len(x)])) for x in self.sign_ids), *self.others([chunks[k] for k in rest])]
        chunks.clear()
        parts = pa.ListArray.from_arrays(offsets([n for _, n in made]), np.concatenate([x for x, _ in made]))
        # A chunk is one of the parts, or two.
        both = np.array([first, second], np.int32).T
        used = both >= 0
        taken = parts.take(pa.array(np.ascontiguousarray(both)[used]))
        return pa.ListArray.from_arrays(taken.offsets.to_numpy()[offsets([used.sum(axis=1)])], taken.values)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, the end id last; some texts are taken together, `GROUP` characters or one text."""
        group: list[tuple[str, bool]] = []
        n = 0
        for t in texts:
            group.append(folded(t or ""))
            n += len(group[-1][0])
            if n >= GROUP:
                yield from self.encode_group(group)
                n = 0
        yield from self.encode_group(group)

    def encode_group(self, group: list[tuple[str, bool]]) -> Iterator[np.ndarray]:
        found = {}
        for simple in {s for _, s in group}:
            if simple:
                lists = pc.ascii_split_whitespace(pa.array([ascii_space(t) for t, s in group if s], pa.large_string()))
            else:
                lists = pa.array([chunks(t) for t, s in group if not s], pa.large_list(pa.large_string()))
            ends, coded = lists.offsets.to_numpy().copy(), lists.values.dictionary_encode()
            del lists  # the chunks themselves aren't needed any more
            ids = self.table(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), simple).take(coded.indices)
            stops = ids.offsets.to_numpy()[ends]
            del coded
            found[simple] = zip(stops[:-1].tolist(), stops[1:].tolist(), repeat(ids.values.to_numpy()), strict=False)
        kinds = [simple for _, simple in group]
        group.clear()
        for simple in kinds:
            start, stop, ids = next(found[simple])
            yield np.append(ids[start:stop], np.uint32(END_ID))


def offsets(counts: list[np.ndarray]) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)


def ascii_space(text: str) -> str:
    """White space of Latin-1 beyond ASCII as blanks, and none of the controls that the library keeps."""
    if not text.isascii():
        text = text.replace("\x85", " ").replace("\xa0", " ")
    return text


def cut_points(docs: list[np.ndarray], ends: np.ndarray, gap: int = GAP) -> tuple[list[int], list[int]]:
    """Positions in the stream of docs where a window may end, and what each costs."""
    stream, stops = np.concatenate(docs), np.cumsum([len(ids) for ids in docs])
    marks = np.union1d(np.flatnonzero(ends[np.minimum(stream, len(ends) - 1)]) + 1, stops)
    price = np.full(len(marks), SENTENCE)
    price[np.searchsorted(marks, stops)] = 0
    starts = np.concatenate(([0], marks[:-1]))
    extra = (marks - starts - 1) // gap  # forced cuts between two marks
    if extra.any():
        many = extra.sum()
        nth = np.arange(many) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        marks = np.concatenate((marks, np.repeat(starts, extra) + gap * nth))
        price = np.concatenate((price, np.full(many, FORCED)))
        order = np.argsort(marks, kind="stable")
        marks, price = marks[order], price[order]
    return marks.tolist(), price.tolist()


def best_cuts(where: list[int], cost: list[int], window: int = WINDOW) -> list[int]:
    """Window ends of least total cost; where ends with the stream's end, whose window's padding is free."""
    b, n = [0, *where], len(where)
    total, keys, back = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    queue, head = [0], 0  # queue[head:] is the monotone queue: places of rising keys, total + position
    for j in range(1, n):
        at = b[j]
        while at - b[queue[head]] > window:
            head += 1
        i = queue[head]
        back[j] = i
        total[j] = keys[i] + window - at + cost[j - 1]
        keys[j] = key = total[j] + at
        while len(queue) > head and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    # Without padding, the least total before the end counts.
    back[n] = min((k for k in range(bisect_left(b, b[n] - window), n)), key=lambda k: (total[k], -k)) if n else 0
    out, j = [], n
    while j:
        out.append(b[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Packs a stream of (doc_id, ids) into windows; rows come out as they are settled."""

    def __init__(self, ends: np.ndarray, first_id: int = 0, window: int = WINDOW, segment: int = SEGMENT):
        self.ends, self.next_id, self.window, self.segment = ends, first_id, window, segment
        self.held: list[tuple[object, np.ndarray, int, int]] = []  # doc_id, ids not yet packed, their start, the document's tokens
        self.tokens = 0

    def add(self, doc_id: object, ids: np.ndarray) -> list[tuple]:
        self.held.append((doc_id, ids, 0, len(ids)))
        self.tokens += len(ids)
        return self.pack(False) if self.tokens >= self.segment else []

    def pack(self, all_of_it: bool) -> list[tuple]:
        if not self.held:
            return []
        cuts = best_cuts(*cut_points([h[1] for h in self.held], self.ends, min(GAP, max(1, self.window // 32))), self.window)
        if not all_of_it:
            cuts = cuts[:-2]
        rows, k, at, begin = [], 0, 0, 0  # at: where document k begins
        for end in cuts:
            while at < end:
                doc_id, ids, start, whole = self.held[k]
                lo, hi = max(begin, at) - at, min(end, at + len(ids)) - at
                rows.append((doc_id, start + lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), whole, self.next_id, at + lo - begin))
                if at + len(ids) > end:
                    break
                at += len(ids)
                k += 1
            begin = end
            self.next_id += 1
        rest = self.held[k:]
        if rest and begin > at:
            doc_id, ids, start, whole = rest[0]
            rest[0] = doc_id, ids[begin - at :], start + begin - at, whole
        self.held, self.tokens = rest, self.tokens - begin
        return rows


_tokenizers: dict[str, Tokenizer] = {}


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        enter("packing", _tokenizers.clear)
        tok = _tokenizers.get(path) or _tokenizers.setdefault(path, Tokenizer(path))
        context = TaskContext.get()
        packer = Packer(tok.ends, (context.partitionId() if context else 0) << 33, window, segment)
        kinds = [pa.int64()] * 7
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        waiting: deque = deque()  # ids of the documents that go in

        def texts() -> Iterator[str | None]:
            for b in batches:
                waiting.extend(b.column(0).to_pylist())
                yield from b.column(1).to_pylist()

        rows: list[tuple] = []
        for ids in tok.encode(texts()):
            rows += packer.add(waiting.popleft(), ids)
            if len(rows) >= ROWS_OUT:
                yield batch(rows)
                rows = []
        if rows := rows + packer.pack(True):
            yield batch(rows)
        trim()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
