"""Sub-word ids with the tokenizers library, each distinct piece of text once per worker.

Both encoders cut a text where no token can cross, look the piece up in a
bounded table of the Python worker and ask the library's BPE model only for
pieces not seen yet. The tables are emptied when full, so a worker's memory
does not grow with its input.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from functools import lru_cache

import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

# Entries of a worker's tables: byte-level workers also hold a large vocabulary.
MOST_CHUNKS, MOST_PIECES = 100_000, 200_000
MOST_WORD_CHUNKS, MOST_WORD_PIECES = 100_000, 500_000

# Unicode's White_Space, which is \s of the published pattern.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The published pattern with its three non-blank classes taken together: none of its matches crosses these cuts.
CHUNKS = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")


def byte_alphabet() -> list[str]:
    """A printable character for every byte: itself where Latin-1 prints it, else the next from 256 on."""
    printable = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    chars = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + len(chars) - len(printable))
    return [chars[b] for b in range(256)]


BYTE_TO_CHAR = dict(enumerate(byte_alphabet()))


def to_alphabet(piece: bytes) -> str:
    return piece.decode("latin-1").translate(BYTE_TO_CHAR)


class _Table(dict):
    """``table[key]`` makes what is missing; emptied when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = made = self.make(key)
        return made


class _Generations(_Table):
    """A table of two halves: what is asked for again outlives a full half, what is not goes with it."""

    def __init__(self, make, most: int):
        super().__init__(make, most // 2)
        self.old: dict = {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """All pairs whose join is a token, by that token's rank, so that the lowest rank is merged first wherever it arises."""
    written = {token: to_alphabet(token) for token in ranks}
    found = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for cut in range(1, len(token)):
            left, right = written.get(token[:cut]), written.get(token[cut:])
            if left is not None and right is not None:
                found.append((left, right))
    return found


def decode(bytes_of: dict[int, bytes], ids: bytes) -> bytes:
    """The bytes of the ids; a character split over tokens is whole again here, not in its tokens."""
    return b"".join(map(bytes_of.__getitem__, array("I", ids)))


class ByteLevel:
    """Byte-level BPE by ranks, matches of ``pattern`` encoded separately, no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = BPE(vocab={to_alphabet(t): r for t, r in ranks.items()}, merges=merges_of(ranks), cache_capacity=0)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pieces = _Table(self._piece, MOST_PIECES)
        self.chunks = _Table(self._chunk, MOST_CHUNKS)

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(to_alphabet(piece.encode("utf-8", "surrogatepass")))
        return array("I", [t.id for t in found]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, CHUNKS.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return decode(self.bytes_of, ids)

    def offsets(self, text: str, ids: bytes) -> tuple[list[int], list[int]]:
        """First and last-but-one code point of every token; tokens that share a character both cover it."""
        char_at = [i for i, c in enumerate(text) for _ in c.encode("utf-8", "surrogatepass")]
        starts, ends, at = [], [], 0
        for i in array("I", ids):
            starts.append(char_at[at])
            at += len(self.bytes_of[i])
            ends.append(char_at[at - 1] + 1)
        return starts, ends


def _latin_tables() -> tuple[bytes, bytes, bytes, re.Pattern]:
    """For Latin-1 bytes: lower case with all blanks as such; kinds; letters and blanks; signs, contractions and numbers."""
    lower, kinds, signs, numbers = bytearray(range(256)), bytearray(256), b"", b""
    for i in range(256):
        c, own = chr(i), bytes([i])
        if 9 <= i <= 13 or i in (0x20, 0x85, 0xA0):
            lower[i], kinds[i] = (i if i <= 13 else 32), ord(" ")
        elif c.isalpha():
            lower[i] = ord(c.lower()) if ord(c.lower()) < 256 else i
            kinds[i] = ord("a")
        elif c.isnumeric():
            kinds[i], numbers = ord("9"), numbers + own
        else:
            kinds[i], signs = ord("!"), signs + own
    plain = bytes(i for i in range(256) if kinds[i] in b"a ")
    cuts = re.compile(b"'(?:s|t|re|ve|m|ll|d)|[" + re.escape(signs) + b"]+|[" + re.escape(numbers) + b"]")
    return bytes(lower), bytes(kinds), plain, cuts


LOWER, KINDS, PLAIN, CUTS = _latin_tables()
FEW_SIGNS = 12


def latin_pieces(raw: bytes) -> list[bytes]:
    """The word file's own cuts of a Latin-1 text, in lower case: letters, contractions, single numbers, runs of signs.

    Where signs stand alone, as in most prose, blanks around each of them are enough.
    """
    low = raw.translate(LOWER)
    signs = set(low.translate(None, PLAIN))
    if len(signs) > FEW_SIGNS or 0x27 in signs or b"!!" in low.translate(KINDS):
        return CUTS.sub(rb" \g<0> ", low).split()
    for sign in signs:
        own = bytes([sign])
        low = low.replace(own, b" " + own + b" ")
    return low.split()


def _latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


class WordLevel:
    """A vocabulary file of the library whose pieces never cross blanks, special strings read as ordinary text."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.size = self.whole.get_vocab_size()
        split = self.whole.pre_tokenizer
        self.split = lambda chunk: [p for p, _ in split.pre_tokenize_str(chunk)]
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.simple = self._splits_alike()
        self.pieces = _Generations(self._piece, MOST_WORD_PIECES)
        self.chunks = _Generations(self._chunk, MOST_WORD_CHUNKS)

    def _splits_alike(self) -> bool:
        """True when the file cuts as the pattern above does; else every chunk goes through the whole library."""
        probe = "it's we'll x1y22 a.b!! \u00e9-\u00f6"
        return [to_alphabet(p.encode()) for p in self.pattern.findall(probe)] == self.split(probe)

    def _piece(self, piece: str | bytes) -> bytes:
        piece = piece.decode("latin-1") if isinstance(piece, bytes) else piece
        written = piece if piece.isascii() and piece.isprintable() else to_alphabet(piece.encode())
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        # Below U+0250 lower-casing and composing are the same everywhere, but for the dotted capital I.
        if self.simple and (chunk.isascii() or (max(chunk) < "\u0250" and "\u0130" not in chunk)):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(unicodedata.normalize("NFC", chunk).lower())))
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.simple and (raw := _latin(text)) is not None:
            return b"".join(map(self.pieces.__getitem__, latin_pieces(raw)))
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks for str.split(), not for Unicode
            return b"".join(map(self.chunks.__getitem__, re.findall(f"[^{BLANK}]+", text)))
        return b"".join(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=4)
def byte_level(path: str, pattern: str) -> ByteLevel:
    """One for each Python worker."""
    return ByteLevel(read_ranks(path), pattern)


@lru_cache(maxsize=4)
def byte_table(path: str) -> dict[int, bytes]:
    """All that decoding needs."""
    return {r: t for t, r in read_ranks(path).items()}


@lru_cache(maxsize=4)
def word_level(path: str) -> WordLevel:
    return WordLevel(path)
