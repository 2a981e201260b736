"""Byte-level BPE with word ends as a bounded-lookahead streaming transducer.

A piece (a maximal match of the pre-tokenizer's pattern) has exactly one sequence of tokens of which each is its own
encoding and no merge ever crosses a boundary. The transducer reads a piece in windows, finds that sequence for the
window, and emits the tokens that are stable: those that end `Merges.lookahead` symbols before the window's end, which no
later symbol can change, and all of them where the piece ends. The next window begins after the last emitted token. So
memory is constant, however long a piece is. The sufficient lookahead is computed from the merge list (for the file
used here it is 199 symbols), not guessed; a window is that and twice the longest token.

White space separates pieces, and the normalizer (NFC, lower case by code point) never acts across it, so a text is
a stream of chunks between white space. Chunks repeat, hence the two-generation memo of bounded size.
"""

from __future__ import annotations

import codecs
import ctypes
import functools
import gc
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex

#: Code points with White_Space, as the normalizer's \s has them (str.split also splits at U+001C to U+001F).
SPACE = regex.compile(r"\p{White_Space}+")
ODD = "\x1c\x1d\x1e\x1f"
#: Entries of one generation of a memo.
MEMO = 250_000
#: Longest chunk that is kept in a memo, in characters.
MEMO_CHARS = 64


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else the next one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


class Memo(dict):
    """fn's results by key in two generations of at most `size`: `memo[key]` runs in C for keys of the young one."""

    def __init__(self, fn: Callable, size: int = MEMO):
        super().__init__()
        self.fn, self.size, self.old = fn, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
            if len(key) > MEMO_CHARS:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def release(self) -> None:
        """Forget everything, so that a worker process that lives on holds no memory of a task that is over."""
        self.old = {}
        self.clear()
        trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: The C library's option for the least block that is mapped by itself, and the size set for it.
M_MMAP_THRESHOLD, OWN_BLOCK = -3, 1 << 16

_owner, _others = "", {}


def frugal() -> None:
    """Arrow and numpy blocks of this worker process go back to the system as soon as they are free."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(M_MMAP_THRESHOLD, OWN_BLOCK)
    except (OSError, AttributeError):
        pass


def enter(operator: str, release: Callable[[], None] = lambda: None) -> None:
    """Called at the start of an operator's task: what another operator remembers in this worker process is dropped."""
    global _owner
    if not _owner:
        frugal()
    _others[operator] = release
    if _owner != operator:
        for name, drop in _others.items():
            if name != operator:
                drop()
        trim()
        _owner = operator


def folded(text: str) -> tuple[str, bool]:
    """The text in lower case and True, where that alone gives the same ids; else the text as it is and False.

    In Latin-1, characters are normal by themselves and turn to lower case one by one. An added token's string may not change.
    """
    if "<|" in text:
        return text, False
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text, False
    return text.lower(), True


def chunks(text: str) -> list[str]:
    """The parts of a text between white space."""
    if any(c in text for c in ODD):
        return [x for x in SPACE.split(text) if x]
    return text.split()


def slices(text: str, size: int = 1 << 16) -> Iterator[str]:
    """A text in parts of about `size` characters, cut at white space alone."""
    at, n = 0, len(text)
    while n - at > size:
        m = SPACE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class Merges:
    """The vocabulary and merge list of a tokenizer file, with what the transducer asks of them."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        v = self.vocab
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            made = v[a + b]
            self.rank[v[a], v[b]] = r
            self.parts.setdefault(made, (v[a], v[b], r))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).finditer
        self.added = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.inner = {s: i for s, i in v.items() if not s.endswith(self.end)} if self.end else v
        self.final = {s[: -len(self.end)]: i for s, i in v.items() if s.endswith(self.end)} if self.end else v
        self.max_len = max(map(len, [*self.inner, *self.final]))
        self.sound: dict[int, bool] = {}
        self.apart: dict[int, bool] = {}
        # Longest token that begins with each pair of symbols: no longer part is looked up.
        self.reach: dict[str, int] = {}
        for symbols in (*self.inner, *self.final):
            self.reach[symbols[:2]] = max(self.reach.get(symbols[:2], 0), len(symbols))

    @functools.cached_property
    def lookahead(self) -> int:
        """Symbols after a token that are enough to know it.

        Take two texts that go on differently after a common prefix. far[t] bounds how many symbols before the prefix's
        end a token t may begin that only one of them has. Merges act in the order of their ranks, so one pass over them
        in that order follows every chain of effects: if a right part differs, its left neighbour is merged in one text
        only; if a left part differs, the merged token does, and the right part may be left over.
        """
        far = {t: int(t not in self.parts) for t in self.strings}  # the prefix's last symbol may end the word or not
        size = {t: self.length(t) for t in self.strings}
        for (a, b), _ in sorted(self.rank.items(), key=lambda m: m[1]):
            made = self.vocab[self.strings[a] + self.strings[b]]
            begins = max(far[a], far[b] + size[a])
            far[b] = max(far[b], far[a] - size[a])
            far[a] = begins
            far[made] = max(far[made], begins)
        return max(far.values())

    @functools.cached_property
    def reach_of_window(self) -> int:
        """Symbols of a window: its first ones, up to two longest tokens, are stable."""
        return self.lookahead + 2 * self.max_len

    def keeps_apart(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the boundary when left's and right's symbols stand side by side.

        Walk back in time from the finished tokens along left's right edge and right's left edge. A crossing merge
        happens if its rank comes before the moment at which either neighbour was absorbed; of equal ranks the one
        further left goes first.
        """
        a, b = left, right
        until_a = until_b = len(self.rank) + 1  # when a, b are absorbed into what they become
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < until_a and r <= until_b:
                return False
            pa, pb = self.parts.get(a), self.parts.get(b)
            if pa is None and pb is None:
                return True
            if pb is None or pa is not None and pa[2] > pb[2]:
                a, until_a = pa[1], pa[2]
                until_b = min(until_b, until_a)
            else:
                b, until_b = pb[0], pb[2]
                until_a = min(until_a, until_b + 1)

    def is_sound(self, token: int) -> bool:
        """Whether a token's own symbols encode to it alone."""
        known = self.sound.get(token)
        if known is None:
            part = self.parts.get(token)
            known = part is None or (self.is_sound(part[0]) and self.is_sound(part[1]) and self.merges_to(token))
            self.sound[token] = known
        return known

    def merges_to(self, token: int) -> bool:
        s = self.strings[token]
        symbols = list(s[: -len(self.end)] if self.end and s.endswith(self.end) and s != self.end else s)
        if len(symbols) < len(s):
            symbols[-1] += self.end
        ids = [self.vocab[x] for x in symbols]
        while len(ids) > 1:
            r, k = min((self.rank.get(p, 1 << 30), k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if r == 1 << 30:
                return False
            ids[k : k + 2] = [self.vocab[self.strings[ids[k]] + self.strings[ids[k + 1]]]]
        return ids == [token]

    def length(self, token: int) -> int:
        s = self.strings[token]
        return len(s) - len(self.end) if self.end and s.endswith(self.end) and s != self.end else len(s)

    def window(self, symbols: str, before: int = -1, ends: bool = True) -> list[int]:
        """The tokens of a window that follows the token before (-1: the piece's begin); ends: whether the piece ends with it.

        Longest token first; a token goes when nothing that keeps apart from it can follow.
        """
        n = len(symbols)
        inner, apart, sound, reach = self.inner.get, self.apart, self.sound, self.reach.get
        final = self.final.get if ends else inner
        if before < 0:
            whole = final(symbols)
            if whole is not None and (sound[whole] if whole in sound else self.is_sound(whole)):
                return [whole]
        out, stops, dead, first = [], [], set(), before
        at, stop = 0, min(n, reach(symbols[:2], 1))
        while at < n:
            while stop > at:
                t = inner(symbols[at:stop]) if stop < n else final(symbols[at:])
                if t is not None:
                    if before >= 0:
                        key = before << 20 | t
                        ok = apart[key] if key in apart else self.fits(key)
                    else:
                        ok = sound[t] if t in sound else self.is_sound(t)
                    if ok and (not dead or (stop, t) not in dead):
                        break
                stop -= 1
            else:  # nothing fits after the last token: another one there
                if not out:
                    raise ValueError("a symbol isn't in the vocabulary")
                dead.add((at, before))
                out.pop()
                stop = stops.pop() - 1
                before, at = (out[-1], stops[-1]) if out else (first, 0)
                continue
            out.append(t)
            stops.append(stop)
            before, at = t, stop
            stop = min(n, at + reach(symbols[at : at + 2], 1))
        return out

    def fits(self, key: int) -> bool:
        """keeps_apart and is_sound of the token in the low 20 bits after the one in the others, remembered."""
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        t = key & 0xFFFFF
        ok = self.apart[key] = self.is_sound(t) and self.keeps_apart(key >> 20, t)
        return ok

    def encode_piece(self, symbols: str) -> Iterator[int]:
        """The tokens of one piece in the byte alphabet, each as soon as it is stable."""
        at, before, reach = 0, -1, self.reach_of_window
        while at + reach < len(symbols):
            stable = at + reach - self.lookahead
            for t in self.window(symbols[at : at + reach], before, False):
                stop = at + self.length(t)
                if stop > stable:
                    break
                yield t
                at, before = stop, t
        yield from self.window(symbols[at:] if at else symbols, before)

    def encode_plain(self, chunk: str) -> Iterator[int]:
        text = chunk if chunk.isascii() or unicodedata.is_normalized("NFC", chunk) else unicodedata.normalize("NFC", chunk)
        low = text.replace("Σ", "σ").lower()  # by code point: no final sigma
        plain = low.isascii()
        if plain and low.isalpha():
            yield from self.encode_piece(low)
            return
        for m in self.pieces(low):
            piece = m[0]
            if not plain:
                piece = piece.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet)
            elif not piece.isprintable():
                piece = piece.translate(self.alphabet)
            yield from self.encode_piece(piece)

    def encode_chunk(self, chunk: str) -> Iterator[int]:
        """The ids of a part between white space; the strings of added tokens stand for their ids."""
        at = 0
        if "<" in chunk and self.added is not None:
            for m in self.added.finditer(chunk):
                yield from self.encode_plain(chunk[at : m.start()])
                yield self.special[m[0]]
                at = m.end()
        yield from self.encode_plain(chunk[at:] if at else chunk)

    def encode(self, text: str) -> Iterator[int]:
        for c in chunks(text):
            yield from self.encode_chunk(c)


class StreamingEncoder:
    """Ids of a text that comes in parts; holds back the chunk that a part ends in."""

    def __init__(self, merges: Merges):
        self.merges, self.rest = merges, ""

    def feed(self, part: str) -> Iterator[int]:
        text = self.rest + part
        cut = max((m.end() for m in SPACE.finditer(text)), default=0)
        self.rest = text[cut:]
        for c in chunks(text[:cut]):
            yield from self.merges.encode_chunk(c)

    def finish(self) -> Iterator[int]:
        rest, self.rest = self.rest, ""
        for c in chunks(rest):
            yield from self.merges.encode_chunk(c)


class StreamingDecoder:
    """Text of ids that come one by one.

    as_bytes=False: as the library decodes where the file names no decoder, the token strings with a blank between.
    as_bytes=True: a byte-to-text machine; tokens become bytes, bytes become characters once complete, word ends blanks.
    """

    def __init__(self, merges: Merges, as_bytes: bool = False):
        self.merges, self.as_bytes, self.first = merges, as_bytes, True
        if as_bytes:
            self.machine = codecs.getincrementaldecoder("utf-8")("replace")
            self.bytes = {c: b for b, c in enumerate(byte_alphabet())}

    def feed(self, token: int) -> str:
        s = self.merges.strings[token]
        if not self.as_bytes:
            out, self.first = s if self.first else " " + s, False
            return out
        if token in self.merges.special.values():
            return self.machine.decode(b"", True) + s
        ends = self.merges.end and s.endswith(self.merges.end)
        body = s[: -len(self.merges.end)] if ends else s
        out = self.machine.decode(bytes(self.bytes[c] for c in body), bool(ends))
        return out + " " if ends else out

    def finish(self) -> str:
        return "" if not self.as_bytes else self.machine.decode(b"", True)
