"""Operator 8 against the tokenizers library."""

import random

import pytest
from tokenizers import Tokenizer

from sievework.llm import word_bpe
from sievework.llm.op8_bpe import digest_text, machine, tokenizer_path
from sievework.llm.word_bpe import Merges, StreamingDecoder, StreamingEncoder

PATH = tokenizer_path()
ALPHABET = "abcdefgh'sİßΣéñ你好́ \n\t\x1c\x85 ½²٣１!?*<|>_.,-A"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return Merges(PATH)


def texts(n):
    rng = random.Random(3)
    for _ in range(n):
        yield "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>x", " <|startoftext|>"])


def test_encodes_and_decodes_as_the_library(library, merges):
    for s in texts(1500):
        ids = library.encode(s, add_special_tokens=False).ids
        assert list(merges.encode(s)) == ids, s
        decoder = StreamingDecoder(merges)
        assert "".join(map(decoder.feed, ids)) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_folded_latin_texts_encode_as_the_library(library):
    import hashlib

    rng = random.Random(4)
    for _ in range(1500):
        s = "".join(rng.choice("abcdeABCDEéÉßÀàªºµ×÷'sS \n\xa0\x85½²3!?*<|>_.,;:$") for _ in range(rng.randint(0, 60)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert digest_text(*machine(PATH), s)[1] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), s


def test_long_pieces_are_emitted_before_they_end(library, merges):
    rng = random.Random(5)
    for s in ("a" * 3000, "ab" * 2000, "nessnessofhttp" * 300, "".join(rng.choice("etaoinshr") for _ in range(5000)), "!?" * 2500, "é" * 2000):
        assert list(merges.encode(s)) == library.encode(s, add_special_tokens=False).ids
    first = next(merges.encode_piece("etaoinshrdlu" * 400))
    assert first == library.encode("etaoinshrdlu" * 400, add_special_tokens=False).ids[0]
    assert merges.lookahead >= merges.max_len


def test_lookahead_comes_from_the_merge_list_and_is_enough(library, merges, monkeypatch):
    """No token that ends the lookahead before the text's end depends on what follows; windows of the least size give the library's ids."""
    assert merges.lookahead < 1000
    rng = random.Random(11)
    syllables = [s for s in merges.inner if 2 <= len(s) <= 9 and s.isascii() and s.isalpha()]
    for _ in range(60):
        piece = "".join(rng.choice(syllables) for _ in range(120))
        ids = list(merges.encode_piece(piece))
        assert ids == library.encode(piece, add_special_tokens=False).ids
        cut = rng.randrange(merges.lookahead + merges.max_len, len(piece))
        at = 0
        for t, u in zip(merges.window(piece[:cut], -1, False), ids, strict=False):
            at += merges.length(t)
            if at > cut - merges.lookahead:
                break
            assert t == u
    monkeypatch.setitem(merges.__dict__, "reach_of_window", merges.lookahead + merges.max_len + 1)
    for s in ("ab" * 700, "".join(rng.choice(syllables) for _ in range(300)), "a" * 1500, "é" * 900):
        assert list(merges.encode(s)) == library.encode(s, add_special_tokens=False).ids


def test_tokens_go_before_their_piece_ends(merges, monkeypatch):
    """A window never holds more than lookahead and two longest tokens, and what is stable goes before the next one is read."""
    read, real = [], Merges.window
    monkeypatch.setattr(Merges, "window", lambda self, symbols, before=-1, ends=True: read.append((len(symbols), ends)) or real(self, symbols, before, ends))
    size = merges.lookahead + 2 * merges.max_len
    for n in (1, size, size + 1, size + 50, 5 * size):
        read.clear()
        out = merges.encode_piece("etaoinshrdlu" * n)
        first = next(out)
        assert read[0][0] <= size and (len(read) == 1) and read[0][1] == (12 * n <= size)
        rest = list(out)
        assert max(k for k, _ in read) <= size and [e for _, e in read] == [False] * (len(read) - 1) + [True]
        assert sum(map(merges.length, [first, *rest])) == 12 * n
        if n > 1:
            assert len(read) > 12 * n // (2 * merges.max_len) // 2


def test_every_piece_goes_through_the_transducer(merges, monkeypatch):
    seen, real = [], Merges.encode_piece
    monkeypatch.setattr(Merges, "encode_piece", lambda self, piece: seen.append(piece) or real(self, piece))
    memo = word_bpe.Memo(lambda c: (" ".join(map(str, merges.encode_chunk(c))), ""))
    digest_text(merges, memo, "one two, three " + "x" * 9000)
    assert sorted(map(len, seen)) == [1, 3, 3, 5, 9000]


def test_long_texts_stream_in_parts(library):
    import hashlib

    for s in ("word and other words. " * 9000, "x1é" * 9000 + " y " + "ab" * 4000, "Ǆ Abc " * 20000):
        ids = library.encode(s, add_special_tokens=False).ids
        n, a, b = digest_text(*machine(PATH), s)
        assert (n, a) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert b == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_any_split_into_parts_gives_the_same_ids(merges):
    rng = random.Random(7)
    for s in texts(300):
        encoder, out, at = StreamingEncoder(merges), [], 0
        while at < len(s):
            step = rng.randint(1, 9)
            out += encoder.feed(s[at : at + step])
            at += step
        assert out + list(encoder.finish()) == list(merges.encode(s))


def test_byte_machine_gives_back_lower_case_words(merges):
    s = "héllo wörld 你好 ok"
    decoder = StreamingDecoder(merges, as_bytes=True)
    assert ("".join(map(decoder.feed, merges.encode(s))) + decoder.finish()).split() == s.split()


def test_digests(spark):
    import hashlib

    from sievework.llm.op8_bpe import encode_digests

    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", None), (1, "Hello world", "x"), (None, "é " * 5000, "y")]
    got = encode_digests(spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert encode_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert digest_text(*machine(PATH), "\x1c a")[0] == len(library.encode("\x1c a", add_special_tokens=False).ids)
