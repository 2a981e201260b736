"""Operator 8, BPE encoding and decoding by a bounded-lookahead streaming transducer (see word_bpe).

Map-only: each task streams Arrow batches. A text runs through in parts cut at white space; every piece goes through the
transducer, its ids through the decoder, and both into running hashes, so beside the text itself memory is constant.
What the transducer gave for a chunk between white space is remembered (`KEPT_CHUNKS`), as chunks repeat.

Defined results: a null or empty text has no tokens, its hashes are those of the empty string; a text of any length is
encoded whole; repeated rows give repeated rows; an empty table gives no rows; columns other than doc_id and text are
neither read nor passed on; doc_id may be null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .word_bpe import Memo, Merges, StreamingDecoder, chunks, enter, folded, slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: The public tokenizer's file, by its name in the installed package.
TOKENIZER = "word_bpe_49k.json"
#: Entries of one generation of the memo of chunks.
KEPT_CHUNKS = 300_000

#: Chunks longer than this stream into the hashes in groups of so many ids.
LONG, GROUP = 4096, 4096
#: A word with signs after it: two pieces.
SIGNED = re.compile("([a-zß-öø-ÿ]+)([.,;:!?$&*#%|]+)").fullmatch

_machines: dict[str, tuple[Merges, Memo]] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def digits(ids: list[int]) -> str:
    return repr(ids)[1:-1].replace(",", "")


def machine(path: str) -> tuple[Merges, Memo]:
    """The transducer of a file and its memo (ids in decimal, decoded text by chunk), one a worker process."""
    if path not in _machines:
        merges = Merges(path)

        def run(chunk: str) -> tuple[str, str]:
            if m := SIGNED(chunk):
                word, signs = memo[m[1]], memo[m[2]]
                return f"{word[0]} {signs[0]}", f"{word[1]} {signs[1]}"
            ids = list(merges.encode_chunk(chunk))
            decoder = StreamingDecoder(merges)
            return digits(ids), "".join([decoder.feed(i) for i in ids]) + decoder.finish()

        memo = Memo(run, KEPT_CHUNKS)
        _machines[path] = merges, memo
    return _machines[path]


def rendered(merges: Merges, memo: Memo, text: str) -> Iterator[tuple[str, str]]:
    """(ids in decimal, decoded text) of consecutive parts of a text; parts without tokens are left out."""
    for part in slices(folded(text)[0]):
        words = chunks(part)
        if len(part) > LONG and max(map(len, words), default=0) > LONG:
            for w in words:
                if len(w) <= LONG:
                    yield memo[w]
                    continue
                ids, decoder = merges.encode_chunk(w), StreamingDecoder(merges)
                while some := list(islice(ids, GROUP)):
                    yield digits(some), "".join([decoder.feed(i) for i in some]).removeprefix(" ")
        elif words:
            found = list(map(memo.__getitem__, words))
            yield " ".join([x[0] for x in found]), " ".join([x[1] for x in found])


def digest_text(merges: Merges, memo: Memo, text: str | None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids in decimal and of the decoded text."""
    n, gap, ids_hash, decoded_hash = 0, b"", hashlib.sha256(), hashlib.sha256()
    for ids, decoded in rendered(merges, memo, text or ""):
        n += ids.count(" ") + 1
        ids_hash.update(gap + ids.encode())
        decoded_hash.update(gap + decoded.encode())
        gap = b" "
    return n, ids_hash.hexdigest(), decoded_hash.hexdigest()


def encode_digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe", _machines.clear)
        merges, memo = machine(tokenizer_path(tokenizer))
        for b in batches:
            rows = [digest_text(merges, memo, t) for t in b.column(1).to_pylist()]
            n, ids, decoded = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
