"""Byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly if each pair of neighbours is: if
encoding the pair's own bytes gives the pair back. So each prefix of a piece has one last token,
found among the tokens that end there and are compatible with the last token of what precedes
them. A later token can only start where the bytes since then begin some token; a place that lies
on the paths back from all of these is settled. No merge ever goes over a settled place, so
the tokens before it are written and what follows is encoded as if it stood alone: the
transducer's state is nothing but the bytes that aren't settled yet. As tokens have bounded lengths,
so has the lookahead. States and transitions are made when first needed, and kept. Encodings of short strings are kept, too, as
texts repeat their words; what isn't kept goes through the transducer.
"""

from __future__ import annotations

import base64
import math
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode's white space beyond ASCII.
WIDE_SPACE = re.compile("[\x85\xa0  -     　\x1c-\x1f]")
NARROW_SPACE = ("\t", "\n", "\r", "\x0b", "\x0c")


#: Fixed value: a pattern in which each match that begins at a space has that one space, unless white space follows.
SPLITS_AT_SPACES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOUR_BYTES = next(t for t in "IL" if array(t).itemsize == 4)
MARKS = frozenset(".,;:!?")


class Transducer:
    """Encodes pieces of bytes by the merges that ``ranks`` (bytes to id) imply."""

    MOST_STATES = 300_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.prefixes = {b[:k] for b in ranks for k in range(1, len(b) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[bytes, bytes] | None] = {}
        self.sound: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, float]] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.states = [b""]
        self.number = {b"": 0}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}  # of state and byte, the state 8 bits up
        self.ends: dict[int, tuple[int, ...]] = {}
        self.lasts: dict[bytes, tuple[int, ...]] = {b"": ()}

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """The encoding by its definition: the pair of the least rank merges first, again and again (or until so few parts are left)."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > until:
            best = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _halves(self, token: int) -> tuple[bytes, bytes] | None:
        """What merges into a token at last, if its bytes do."""
        if token not in self.halves:
            parts = self.merged(self.bytes_of[token], 2)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _sound(self, token: int) -> bool:
        """Whether all that a token comes about from has lower ranks than what it merges into, down to single bytes."""
        if token not in self.sound:
            halves = self._halves(token) if self.size[token] > 1 else ()
            inner = [self.ranks.get(h, math.inf) for h in halves] if halves is not None else [math.inf]
            single = self.size[token] == 1
            self.sound[token] = single or all(r < token or self.size.get(r) == 1 for r in inner) and all(r < math.inf and self._sound(r) for r in inner)
        return self.sound[token]

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, float]] | None:
        """The parts that stand at one end of a token while it comes about, each with the rank at which it gives way to the next.

        None if parts don't come about in the order of ranks.
        """
        if (token, right) not in self.edges:
            parts = [(self.bytes_of[token], math.inf)]
            now = token
            while self._sound(token) and self.size[now] > 1:
                parts.append((self._halves(now)[right], now))
                now = self.ranks[self._halves(now)[right]]
            self.edges[token, right] = parts[::-1] if self._sound(token) else None
        return self.edges[token, right]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is these tokens.

        It is unless, at some time, the parts at either side of the border merge before one of them merges away from it;
        of equal ranks the left pair is first.
        """
        if (a, b) not in self.pairs:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            left, right = self._edge(a, True), self._edge(b, False)
            if left is None or right is None:
                good = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [self.bytes_of[a], self.bytes_of[b]]
            else:
                i = j = 0
                while True:
                    (x, until), (y, till) = left[i], right[j]
                    rank = self.ranks.get(x + y, math.inf)
                    if rank < until and rank <= till and rank < math.inf:
                        good = False
                        break
                    if until == till == math.inf:
                        good = True
                        break
                    if until <= till:
                        i += 1
                    else:
                        j += 1
            self.pairs[a, b] = good
        return self.pairs[a, b]

    def last_tokens(self, held: bytes) -> tuple[int, ...]:
        """The last token of the encoding of each prefix of ``held``."""
        if held not in self.lasts:
            lasts = self.last_tokens(held[:-1])
            for start in range(len(held)):
                token = self.ranks.get(held[start:])
                if token is not None and (not start or self.compatible(lasts[start - 1], token)):
                    break
            else:
                raise ValueError("the ranks do not cover all bytes")
            self.lasts[held] = (*lasts, token)
        return self.lasts[held]

    def _told(self, lasts: tuple[int, ...], end: int) -> tuple[int, ...]:
        """The tokens of the encoding of the first ``end`` bytes."""
        out = []
        while end:
            out.append(lasts[end - 1])
            end -= self.size[out[-1]]
        return tuple(out[::-1])

    def _grow(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        held = self.states[state >> 8] + bytes([byte])
        n, lasts, size = len(held), self.last_tokens(held), self.size
        cut = n
        for k in range(n - 1, -1, -1):
            if not cut:
                break
            if held[k:] in self.prefixes:
                while cut != k:  # the last place that the ways back from both have in common
                    if cut > k:
                        cut -= size[lasts[cut - 1]]
                    else:
                        k -= size[lasts[k - 1]]
        new = held[cut:]
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        self.next[state | byte] = out = (self.number[new] << 8, self._told(lasts, cut))
        return out

    def _end(self, state: int) -> tuple[int, ...]:
        held = self.states[state >> 8]
        self.ends[state] = out = self._told(self.last_tokens(held), len(held))
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.MOST_STATES:
            self.reset()
        out: list[int] = []
        state, step = 0, self.next.get
        for byte in piece:
            state, told = step(state | byte) or self._grow(state, byte)
            if told:
                out += told
        out += self.ends[state] if state in self.ends else self._end(state)
        return out


class _Cache(dict):
    """Encodings of short strings. When too many are held, only those used since the last time stay at hand."""

    MOST = 400_000

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 48:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


class ByteBpe:
    """Splits a text by a pattern and encodes each match; ids are little-endian unsigned 32-bit."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.spaced_words = pattern == SPLITS_AT_SPACES
        self.table = [self.transducer.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        #: What a token decodes to between characters; None where it doesn't end between characters again.
        self.texts = [_characters(b) for b in self.table]
        self.broken = np.array([t is None for t in self.texts])
        self.mended: dict[tuple[int, ...], tuple[str, bytes]] = {}
        self.pieces = _Cache(self._piece)
        self.first = _Cache(self._matches)
        self.later = _Cache(self._later)

    def _piece(self, piece: str) -> bytes:
        ids = array(FOUR_BYTES, self.transducer.encode(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _later(self, chunk: str) -> bytes:
        """A chunk after a space. Letters are one match along with the space, and a mark after them is another."""
        if chunk.isalpha():
            return self._piece(" " + chunk)
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return self.later[chunk[:-1]] + self.pieces[chunk[-1]]
        return self._matches(" " + chunk)

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text.

        Where a single space between characters that are no white space is known to begin a match of the pattern,
        texts are encoded space by space, from what is kept of earlier ones.
        """
        if not self.spaced_words or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in NARROW_SPACE) or WIDE_SPACE.search(text):
            return self._matches(text)
        chunks = text.split(" ")
        return self.first[chunks[0]] + b"".join(map(self.later.__getitem__, chunks[1:]))

    def _mended(self, tokens: tuple[int, ...]) -> tuple[str, bytes]:
        """The text of tokens that begin or end inside a character, and the bytes of one that isn't complete."""
        found = self.mended.get(tokens)
        if found is None:
            stream = Utf8Stream()
            found = stream.feed(b"".join(map(self.table.__getitem__, tokens))), stream.held
            if len(tokens) <= 8:
                if len(self.mended) >= Utf8Stream.MOST:
                    self.mended.clear()
                self.mended[tokens] = found
        return found

    def decode(self, ids: bytes, step: int = 1 << 16) -> Iterator[str]:
        """The text of ids, ``step`` ids at a time. A character may come in several tokens and steps."""
        numbers, stream = np.frombuffer(ids, "<u4"), Utf8Stream()
        for k in range(0, len(numbers), step):
            some = numbers[k : k + step]
            out, at, tokens = [], 0, some.tolist()
            bad = np.flatnonzero(self.broken[some])
            split = np.flatnonzero(np.diff(bad) > 1)
            ends = np.append(bad[split], bad[-1:]) + 1
            for a, b in zip([*bad[:1].tolist(), *bad[split + 1].tolist(), len(tokens)], [*ends.tolist(), len(tokens)], strict=True):
                if stream.held and at < len(tokens):
                    upto = b if at == a else at + 1
                    out.append(stream.feed(b"".join(map(self.table.__getitem__, tokens[at:upto]))))
                    at = upto
                if at < a:
                    out.append("".join(map(self.texts.__getitem__, tokens[at:a])))
                if max(at, a) < b:
                    text, stream.held = self._mended(tuple(tokens[max(at, a) : b]))
                    out.append(text)
                at = b
            yield "".join(out)
        yield stream.close()


def _utf8_table() -> dict[tuple[int, int], int]:
    """Transitions of the UTF-8 automaton: 0 is between characters, 1-3 await so many bytes, 4-7 await a restricted one."""
    move = {(0, b): 0 for b in range(0x80)}
    ranges = [(0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEC, 2), (0, 0xED, 0xED, 5), (0, 0xEE, 0xEF, 2), (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)]
    for state, lo, hi, to in ranges:
        move |= {(state, b): to for b in range(lo, hi + 1)}
    return move


UTF8 = _utf8_table()
WIDE_BYTES = re.compile(rb"[\x80-\xff]+")


class Utf8Stream:
    """Text from bytes that come in any pieces; an incomplete character waits for its other bytes.

    Bytes that can't go on a character give U+FFFD, one for each longest beginning of a character. ASCII bytes leave
    the automaton between characters, so they are passed over together; what it makes of a run of others is kept.
    """

    MOST = 100_000
    runs: dict[bytes, tuple[str, bytes]] = {}

    def __init__(self):
        self.held = b""

    def _run(self, data: bytes) -> tuple[str, bytes]:
        """The characters of a run of bytes over 0x7F, and the bytes of one that isn't complete."""
        found = self.runs.get(data)
        if found is None:
            out, state, begun = [], 0, 0
            for k, byte in enumerate(data):
                to = UTF8.get((state, byte))
                if to is None and state:
                    out.append("\ufffd")
                    state, begun = 0, k
                    to = UTF8.get((0, byte))
                if to is None:
                    out.append("\ufffd")
                    begun = k + 1
                elif to:
                    state = to
                else:
                    lead, *rest = data[begun : k + 1]
                    point = lead & (0x7F >> len(rest) + 1)
                    for more in rest:
                        point = point << 6 | more & 0x3F
                    out.append(chr(point))
                    state, begun = 0, k + 1
            found = "".join(out), data[begun:]
            if len(data) <= 24:
                if len(self.runs) >= self.MOST:
                    self.runs.clear()
                self.runs[data] = found
        return found

    def feed(self, data: bytes) -> str:
        if self.held:
            data, self.held = self.held + data, b""
        if data.isascii():
            return data.decode("ascii")
        out, at = [], 0
        for m in WIDE_BYTES.finditer(data):
            text, rest = self._run(m.group())
            out += (data[at : m.start()].decode("ascii"), text)
            at = m.end()
            if rest and at < len(data):
                out.append("\ufffd")
            elif rest:
                self.held = rest
        out.append(data[at:].decode("ascii"))
        return "".join(out)

    def close(self) -> str:
        out, self.held = "\ufffd" if self.held else "", b""
        return out


def _characters(data: bytes) -> str | None:
    stream = Utf8Stream()
    text = stream.feed(data)
    return None if stream.held or "\ufffd" in text else text


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a vocabulary file: base64 of the bytes, and the rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


_loaded: dict[tuple[str, str], ByteBpe] = {}


def _coded(ranks, digest: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded.get((digest, pattern))
        if bpe is None:
            bpe = _loaded[digest, pattern] = ByteBpe(read_ranks(ranks.value), pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, decoded = [], []
                for text in pc.fill_null(part.column(1), "").to_pylist():
                    coded = bpe.encode(text)
                    back = sha256()
                    for piece in bpe.decode(coded):
                        back.update(piece.encode())
                    ids.append(coded)
                    decoded.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded)], ["doc_id", "ids", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded_sha256) of each row: ids as little-endian unsigned 32-bit integers in binary.

    ``ranks_path`` is a file on the driver (lines of base64 bytes and rank) whose content is broadcast; a vocabulary has a megabyte
    or so. Each match of ``pattern`` is encoded by itself, without special tokens; then the ids are
    decoded again as a stream, and decoded_sha256 is the digest of that text's UTF-8 bytes. Null
    and empty texts have no ids. Null and repeated ids are kept; other columns are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    with open(ranks_path, "rb") as f:
        data = f.read()
    run = _coded(spark.sparkContext.broadcast(data), sha256(data).hexdigest(), pattern)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded_sha256 string")
