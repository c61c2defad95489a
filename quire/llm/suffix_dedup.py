"""Long repeated byte strings, by a logarithmic family of suffix arrays.

A string of L bytes repeats if it starts at two places of the corpus. To find all of them without
holding all suffixes of the corpus, each window of L bytes is filed under an anchor: the place in
it of the least hash of 64 bytes (the leftmost of equal ones). Equal windows have equal anchors at
equal offsets, and neighbouring windows mostly share theirs, so a row stands for the run of
windows (p1..p2) of one anchor, with a digest of that segment. Then

1. anchors whose 64 bytes occur once hold no repeat; they end here (nearly all do);
2. segments that are wholly equal repeat wholly; copies and common passages are counted here, before any shuffle of bytes,
   and one of each kind goes on. They are equal by two hashes of 64 bits (anchor and segment);
3. the bytes of one segment of each remaining kind go to the shard of its anchor's hash. There batches of
   suffixes are turned into suffix arrays, ordered by their bytes, merge-scanned against the existing
   levels for matches of L bytes, and added as a new level; levels of equal size merge. A suffix
   that matches isn't added, so an index holds a string once however often it occurs. Bytes are compared, no hashes.

A shard is sorted by anchor and no match goes from one anchor to another, so a task holds the family of one anchor
at a time. Anchors with very many kinds are split by the least of other hashes in each window, which equal windows share.

``SuffixIndex`` keeps texts and anchors as tables whose sizes grow geometrically, and takes batch after batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import textbuf
from quire.llm.scratch import Scratch

GRAM = 64
PIECE = 1 << 19
BATCH = 1 << 16
SHARD_BYTES = 1 << 24
KINDS = 1024  # an anchor of more kinds of segments is split
MOST_SPLITS = 8
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 64 bytes from each position on (as long as there are 64)."""
    h, k, level = textbuf.BYTE64[buf], 1, 0
    while k < GRAM:
        h = h[:-k] * _MULTIPLIERS[level] + h[k:]
        h ^= h >> np.uint64(29)
        k, level = 2 * k, level + 1
    return h


def window_hashes(grams: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit digest of the ``length`` bytes from each place in ``at`` on."""
    steps = [*range(0, length - GRAM, GRAM), length - GRAM]
    out = grams[at].copy()
    for step in steps[1:]:
        out = textbuf.mix(out * _MULTIPLIERS[8] + grams[at + step])
    return textbuf.mix(out ^ _MULTIPLIERS[9])


def anchor_runs(grams: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of the runs of valid windows that share an anchor.

    ``valid`` tells, for each place, if a window starts there. A run doesn't go past an invalid place.
    """
    width = length - GRAM + 1
    low = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
    k = 1
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if width > k:
        low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
    at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    p = np.flatnonzero(valid[: len(at)])
    if not len(p):
        return p, p, p
    cut = np.flatnonzero((at[p[1:]] != at[p[:-1]]) | (p[1:] != p[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(p)]]) - 1
    return p[first], p[last], at[p[first]]


ANCHORS = "doc_id long, twin long, gram long, seg long, p1 array<int>, p2 array<int>"


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in textbuf.slices(batch.column("text"), 1 << 17):
                for base in range(0, len(buf), PIECE):
                    part = buf[base : base + PIECE + length - 1]
                    if len(part) < length:
                        continue
                    grams = gram_hashes(part)
                    valid = np.zeros(len(part), bool)
                    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                        if b - a >= length:
                            valid[max(0, a - base) : max(0, b - length + 1 - base)] = True
                    valid[PIECE:] = False
                    p1, p2, at = anchor_runs(grams, valid, length)
                    if not len(p1):
                        continue
                    row = np.searchsorted(offsets, p1 + base, "right") - 1
                    seg = textbuf.mix(window_hashes(grams, p1, length) * _MULTIPLIERS[10] + window_hashes(grams, p2, length) + (p2 - p1).astype(np.uint64))
                    # places of one document with equal segments are one row
                    gram = grams[at]
                    order = np.lexsort((p1, seg, gram, row))
                    row, p1, p2, gram, seg = row[order], p1[order], p2[order], gram[order], seg[order]
                    first = np.ones(len(row), bool)
                    first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (seg[1:] != seg[:-1])
                    head = np.flatnonzero(first)
                    sizes = np.diff(np.append(head, len(row)))
                    start = offsets[row] - base
                    take = pa.array(row[head] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(take), batch.column("twin").take(take), pa.array(gram[head].view(np.int64)), pa.array(seg[head].view(np.int64)), textbuf.lists((p1 - start).astype(np.int32), sizes), textbuf.lists((p2 - start).astype(np.int32), sizes)],
                        ["doc_id", "twin", "gram", "seg", "p1", "p2"],
                    )

    return run


def split_runs(piece: np.ndarray, length: int, gram: int, splits: int) -> Iterator[tuple[int, int, int]]:
    """(first window, last window, key) of the runs of a piece's windows that agree on the least of ``splits`` other hashes."""
    grams = gram_hashes(piece)
    key = np.full(len(piece) - length + 1, np.uint64(gram & (2**64 - 1)))
    for k in range(splits):
        other = textbuf.mix(grams * np.uint64(2 * k + 3) + _MULTIPLIERS[11])
        key = textbuf.mix(key * _MULTIPLIERS[12] + np.lib.stride_tricks.sliding_window_view(other, length - GRAM + 1)[: len(key)].min(1))
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield a, b - 1, int(key[a : a + 1].view(np.int64)[0])


PIECES = "doc_id long, twin long, p1 int, key long, known boolean, bytes binary"


def _segments(length: int):
    """The bytes of each wanted segment of a document, under the key by which it meets others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want")
            for lo, hi, buf, offsets in textbuf.slices(batch.column("text"), 1 << 20):
                own = want.slice(lo, hi - lo)
                sizes = pc.list_value_length(own).to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(lo, hi), sizes)
                flat = own.flatten()
                p1, p2, gram = (flat.field(c).to_numpy() for c in ("p1", "p2", "gram"))
                known, splits = flat.field("known").to_numpy(zero_copy_only=False), flat.field("splits").to_numpy()
                start, end = p1 + offsets[rows - lo], p2 + offsets[rows - lo] + length
                for a, b in textbuf.runs_of(end - start, 1 << 22):
                    out: list[list] = [[], [], [], [], []]
                    for k in range(a, b):
                        piece = buf[start[k] : end[k]]
                        parts = split_runs(piece, length, int(gram[k]), int(splits[k])) if splits[k] else ((0, p2[k] - p1[k], gram[k]),)
                        for first, last, key in parts:
                            for c, v in zip(out, (rows[k], p1[k] + first, key, known[k], piece[first : last + length].tobytes()), strict=True):
                                c.append(v)
                    take = pa.array(out[0], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("twin").take(take), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.binary())], [c.split()[0] for c in PIECES.split(", ")])

    return run


class Pieces:
    """Byte strings one after another, with the text and place that each is from."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, doc: np.ndarray, twin: np.ndarray, place: np.ndarray):
        self.buf, self.start, self.doc, self.twin, self.place = buf, start, doc, twin, place

    def owners(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc_id, twin, place) of positions in ``buf``."""
        k = np.searchsorted(self.start, at, "right") - 1
        return self.doc[k], self.twin[k], self.place[k] + at - self.start[k]

    def __add__(self, other: Pieces) -> Pieces:
        join = lambda name: np.concatenate([getattr(self, name), getattr(other, name)])
        return Pieces(join("buf"), np.concatenate([self.start, other.start + len(self.buf)]), join("doc"), join("twin"), join("place"))

    def used(self, at: np.ndarray, length: int) -> tuple[Pieces, np.ndarray]:
        """The pieces that hold a string at one of ``at``, and these positions in them."""
        k = np.searchsorted(self.start, at, "right") - 1
        keep = np.unique(k)
        end = np.append(self.start[1:], len(self.buf))
        size = (end - self.start)[keep]
        moved = np.cumsum(size) - size
        buf = np.concatenate([self.buf[a:b] for a, b in zip(self.start[keep], end[keep], strict=True)]) if len(keep) else self.buf[:0]
        to = np.searchsorted(keep, k)
        return Pieces(buf, moved, self.doc[keep], self.twin[keep], self.place[keep]), at - self.start[k] + moved[to]


def _lead(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes as numbers that order as the bytes do."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, 8)[at]).view(">u8").reshape(-1).astype(np.uint64)


def _dense(keys: np.ndarray) -> np.ndarray:
    """Each key's rank among the distinct ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])).astype(np.uint64)
    return rank


class SuffixArray:
    """Suffixes of pieces in the order of their first ``length`` bytes; equal ones in the order of their positions."""

    def __init__(self, pieces: Pieces, at: np.ndarray, known: np.ndarray, length: int):
        self.pieces, self.at, self.known, self.length = pieces, at, known, length

    @classmethod
    def build(cls, pieces: Pieces, at: np.ndarray, known: np.ndarray, length: int) -> tuple[SuffixArray, np.ndarray]:
        """The array of the suffixes at ``at``, and whether each differs from the one before it in ``length`` bytes.

        By doubling: ranks of 8 bytes give ranks of 16, and so on; the last two strings overlap.
        """
        buf, width = pieces.buf, 8
        rank = _dense(_lead(np.concatenate([buf, np.zeros(7, np.uint8)]), np.arange(len(buf))))
        while 2 * width <= length:
            after = np.zeros(len(rank), np.uint64)
            after[: len(rank) - width] = rank[width:]
            rank = _dense(rank << np.uint64(32) | after)
            width *= 2
        key = rank[at] << np.uint64(32) | rank[at + length - width]
        order = np.argsort(key, kind="stable")
        key = key[order]
        return cls(pieces, at[order], known[order], length), np.concatenate([[True], key[1:] != key[:-1]])

    def _compare(self, other: SuffixArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix i of this array is below, equal to or above suffix j of the other."""
        out = np.empty(len(i), np.int8)
        mine, theirs = (np.lib.stride_tricks.sliding_window_view(x.pieces.buf, self.length) for x in (self, other))
        for k in range(0, len(i), 8192):
            a, b = mine[self.at[i[k : k + 8192]]], theirs[other.at[j[k : k + 8192]]]
            first = (a != b).argmax(1)  # the end of the common prefix, or 0 if there is no end
            row = np.arange(len(first))
            out[k : k + 8192] = np.sign(a[row, first].astype(np.int16) - b[row, first])
        return out

    def scan(self, other: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each suffix of ``other`` stands in this array, and whether the one there is equal to it."""
        lead, wanted = _lead(self.pieces.buf, self.at), _lead(other.pieces.buf, other.at)
        lo, hi = np.searchsorted(lead, wanted, "left"), np.searchsorted(lead, wanted, "right")
        equal = np.zeros(len(lo), bool)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) // 2
            sign = self._compare(other, middle, open_)
            equal[open_] |= sign == 0
            lo[open_] = np.where(sign < 0, middle + 1, lo[open_])
            hi[open_] = np.where(sign < 0, hi[open_], middle)
            open_ = open_[lo[open_] < hi[open_]]
        return lo, equal

    def merged(self, other: SuffixArray) -> SuffixArray:
        """One array of both, which have no suffix in common."""
        place, _ = self.scan(other)
        return SuffixArray(self.pieces + other.pieces, np.insert(self.at, place, other.at + len(self.pieces.buf)), np.insert(self.known, place, other.known), self.length)

    def only(self, keep: np.ndarray) -> SuffixArray:
        """The array of some suffixes, with the pieces that these need."""
        pieces, at = self.pieces.used(self.at[keep], self.length)
        return SuffixArray(pieces, at, self.known[keep], self.length)


class SuffixFamily:
    """Suffix arrays of geometrically growing sizes over the distinct suffixes seen so far.

    With ``first``, the place at which a string was seen first is not a repeat and all others are; without, all are.
    """

    def __init__(self, length: int, first: bool = False):
        self.length, self.first = length, first
        self.levels: list[SuffixArray] = []

    def add(self, pieces: Pieces, at: np.ndarray, known: np.ndarray, stays: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Adds a batch; owners (doc_id, twin, place) of suffixes that are now known to repeat.

        ``known`` marks suffixes that are told as repeats elsewhere; those not marked in ``stays`` meet no later batch.
        """
        array, new = SuffixArray.build(pieces, at, known, self.length)
        kind = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        held = np.zeros(len(heads), bool)  # kinds that a level has
        out = []
        for level in self.levels:
            where, equal = level.scan(SuffixArray(pieces, array.at[heads], array.known[heads], self.length))
            held |= equal
            if not self.first:
                old = where[equal]
                old = old[~level.known[old]]
                level.known[old] = True
                out.append(level.pieces.owners(level.at[old]))
        if self.first:
            tell = ~new | held[kind]
        else:
            hit = held | (np.bincount(kind) > 1) | np.logical_or.reduceat(array.known, heads)
            tell = hit[kind] & ~array.known
            array.known = hit[kind]
        out.append(pieces.owners(array.at[tell]))
        keep = new & ~held[kind]
        if stays is not None:
            keep &= stays[np.searchsorted(at, array.at)]
        if keep.any():
            level = array.only(keep)
            while self.levels and len(self.levels[-1].at) <= 2 * len(level.at):
                level = self.levels.pop().merged(level)
            self.levels.append(level)
        return out


def merged_spans(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins spans of one document that touch or overlap."""
    order = np.lexsort((start, twin, doc))
    doc, twin, start, end = doc[order], twin[order], start[order], end[order]
    if not len(doc):
        return doc, twin, start, end
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])
    group = np.cumsum(other) - 1
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    fresh = other.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return doc[at], twin[at], start[at], np.maximum.reduceat(end, at)


def _matches(length: int, first: bool):
    """Repeated spans among pieces that come sorted by key, text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, last_key, last_row, held, size = SuffixFamily(length, first), None, None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal family, last_key, last_row
            table = pa.Table.from_batches(held).combine_chunks()
            key, doc, twin, place = (table.column(c).to_numpy() for c in ("key", "doc_id", "twin", "p1"))
            row = np.stack([key, doc, twin, place], 1)
            again = np.concatenate([[last_row is not None and bool((row[0] == last_row).all())], (row[1:] == row[:-1]).all(1)])
            last_row = row[-1]
            if again.any():  # rows that agree on id and text are one text
                table = table.filter(pa.array(~again)).combine_chunks()
                key, doc, twin, place = (x[~again] for x in (key, doc, twin, place))
                if not len(key):
                    return
            if key[0] != last_key:
                family = SuffixFamily(length, first)
            data = table.column("bytes").chunk(0)
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            buf = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            start = offsets[:-1] - offsets[0]
            count = np.diff(offsets) - length + 1
            at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            known = table.column("known").to_numpy()
            if key[0] == last_key and key[-1] != last_key:  # the rest of the key that went on, by itself
                cut = int(np.searchsorted(key != last_key, True))
            else:
                cut = 0
            last_key = key[-1]
            for a, b in ((0, cut), (cut, len(key))):
                if a == b:
                    continue
                if a:
                    family = SuffixFamily(length, first)
                lo, hi = start[a], start[b] if b < len(key) else len(buf)
                own = slice(int(count[:a].sum()), int(count[:b].sum()))
                part = Pieces(buf[lo:hi], start[a:b] - lo, doc[a:b], twin[a:b], place[a:b])
                stays = np.repeat(key[a:b] == last_key, count[a:b])
                for doc_id, twins, where in family.add(part, at[own] - lo, np.repeat(known[a:b], count[a:b]), stays):
                    if len(doc_id):
                        out = merged_spans(doc_id, twins, where, where + length)
                        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int32))], ["doc_id", "twin", "start", "end"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("bytes"))).as_py() - (length - 1) * part.num_rows
                if size >= BATCH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def anchors_of(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, twin, gram, seg, p1, p2): the anchors of ``docs`` (doc_id, twin, text), with the runs of windows filed under each."""
    return docs.mapInArrow(_anchors(length), ANCHORS)


def _spans(p1: Column, p2: Column, length: int) -> Column:
    return F.transform(F.arrays_zip(p1.alias("a"), p2.alias("b")), lambda s: F.struct(s["a"].alias("start"), (s["b"] + length).alias("end")))


def repeated_spans(scratch: Scratch, docs: DataFrame, length: int = 400, first: bool = False, anchors: DataFrame | None = None) -> DataFrame:
    """(doc_id, twin, spans) of ``docs`` (doc_id, twin, text): spans of bytes covered by repeated strings.

    A document may have many rows, and its spans may overlap. What repeats in a text depends on nothing but the texts, so
    rows that agree on id and text (``twin`` is the text's hash) share their spans. With ``first``, of each string the place
    that comes first by (doc_id, twin, place) is no repeat, and rows that agree on id and text are one text.
    ``anchors`` are those of ``docs``, if they are at hand. Spark jobs run when this is called.
    """
    if not GRAM < length <= GRAM * 16:
        raise ValueError(f"a length of {GRAM + 1} to {GRAM * 16} bytes is supported")
    own = anchors if anchors is not None else scratch.keep(anchors_of(docs, length), "anchors")
    places = F.sum(F.size("p1")).alias("n")
    grams = scratch.keep(own.groupBy("gram").agg(places, F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("n > 1").select("gram", (F.col("lo") == F.col("hi")).alias("alike")), "grams")
    shared = scratch.keep(own.join(grams, "gram"), "shared")
    scratch.drop(grams)
    if anchors is None:
        scratch.drop(own)
    owner = F.struct("doc_id", "twin", F.element_at("p1", 1).alias("p1"), F.element_at("p2", 1).alias("p2"))
    kinds = shared if first else shared.where("not alike")
    kinds = scratch.keep(kinds.groupBy("gram", "seg", "alike").agg(places, F.min(owner).alias("owner")), "kinds")
    many = kinds.where("n > 1")
    p1, p2 = F.col("p1"), F.col("p2")
    if first:
        known = shared.join(many.select("gram", "seg", "owner"), ["gram", "seg"])
        least = (F.col("owner.doc_id") == F.col("doc_id")) & (F.col("owner.twin") == F.col("twin"))
        rest = lambda p: F.when(least, F.slice(p, 2, F.size(p))).otherwise(p)
        known = known.select("doc_id", "twin", _spans(rest(p1), rest(p2), length).alias("spans")).where(F.size("spans") > 0)
    else:
        known = shared.where("alike").select("doc_id", "twin", _spans(p1, p2, length).alias("spans"))
        known = known.union(shared.where("not alike").join(many.select("gram", "seg"), ["gram", "seg"], "left_semi").select("doc_id", "twin", _spans(p1, p2, length).alias("spans")))
    open_ = kinds.where("not alike")
    crowds = open_.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum(F.col("owner.p2") - F.col("owner.p1") + length).alias("bytes"))
    crowds = scratch.keep(crowds, "crowds")
    total = crowds.agg(F.sum("bytes")).first()[0] or 0
    crowded = crowds.where(F.col("kinds") > KINDS).select("gram", F.least(F.lit(MOST_SPLITS), F.floor(F.log2(F.col("kinds") / KINDS)).cast("int") + 1).alias("splits"))
    want = open_.join(crowded, "gram", "left").select("owner.*", "gram", (F.col("n") > 1).alias("known"), F.coalesce("splits", F.lit(0)).alias("splits"))
    want = want.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("p1", "p2", "gram", "known", "splits")).alias("want"))
    pieces = docs.join(want.withColumnsRenamed({"doc_id": "d", "twin": "t"}), (F.col("doc_id") == F.col("d")) & (F.col("twin") == F.col("t"))).select("doc_id", "twin", "text", "want")
    pieces = pieces.mapInArrow(_segments(length), PIECES)
    shards = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHARD_BYTES))
    pieces = pieces.repartition(shards, "key").sortWithinPartitions("key", "doc_id", "twin", "p1")
    found = pieces.mapInArrow(_matches(length, first), "doc_id long, twin long, start int, end int")
    out = scratch.keep(known.union(found.select("doc_id", "twin", F.array(F.struct("start", "end")))), "spans")
    scratch.drop(shared, kinds, crowds)
    return out


class SuffixIndex:
    """A family of levels on shared storage: each has texts and their anchors, sorted by anchor.

    ``add`` scans a new batch against all levels and appends it as a level; of two neighbouring levels of like sizes one
    is made, so there are logarithmically many and a text is written again that often. The tables stay in ``folder``,
    and an index opened there goes on where the last one ended.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = 400):
        self.spark, self.folder, self.length = spark, folder.rstrip("/"), length

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def levels(self) -> list[tuple[str, int, int, int]]:
        """(folder, first and last batch, rows) of the levels that are complete and in no other one, the oldest first."""
        path, fs = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        whole = [n for n in names if fs.exists(path(f"{self.folder}/{n}/anchors/_SUCCESS"))]
        found = [(f"{self.folder}/{n}", *map(int, n.split("-"))) for n in whole]
        return sorted((x for x in found if not any(y is not x and y[1] <= x[1] and x[2] <= y[2] for y in found)), key=lambda x: x[1])

    def _write(self, docs: DataFrame, anchors: DataFrame, first: int, last: int, rows: int) -> None:
        to = f"{self.folder}/{first:08d}-{last:08d}-{rows}"
        docs.write.mode("overwrite").parquet(f"{to}/texts")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        anchors.repartitionByRange(parts, "gram", "seg").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{to}/anchors")  # complete once this is

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, twin, spans) of the batch's texts and of earlier ones: what repeats within the batch or with a level.

        Spans of earlier texts may have been told before. ``twin`` is ``xxhash64`` of the text; null texts count as empty. Spark
        jobs run when this is called. A batch that was added in part is added again as a whole.
        """
        scratch = Scratch(self.spark, "index")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        new = scratch.keep(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("twin"), text.alias("text")), "batch")
        own = scratch.keep(anchors_of(new, self.length), "anchors")
        levels = self.levels()
        read = lambda folder, name, like: self.spark.read.schema(like.schema).parquet(f"{folder}/{name}")
        texts, anchors, kept = new, own, [new, own]
        for folder, *_ in levels:
            met = scratch.keep(read(folder, "anchors", own).join(own.select("gram").distinct(), "gram", "left_semi").select(own.columns), "met")
            texts = texts.union(read(folder, "texts", new).join(met.select("doc_id", "twin").distinct(), ["doc_id", "twin"], "left_semi").select(new.columns))
            anchors = anchors.union(met)
            kept.append(met)
        found = repeated_spans(scratch, texts, self.length, anchors=anchors)
        rows = new.count()
        if rows:
            number = 1 + max((last for _, _, last, _ in levels), default=0)
            least, gone = number, []
            while levels and levels[-1][3] <= 2 * rows:
                folder, least, _, n = levels.pop()
                gone.append(folder)
                new, own, rows = new.union(read(folder, "texts", new)), own.union(read(folder, "anchors", own)), rows + n
            self._write(new, own, least, number, rows)
            path, fs = self._fs()
            for folder in gone:
                fs.delete(path(folder), True)
        scratch.drop(*kept)
        return found


def _cut(n_columns: int, characters: bool):
    """Adds n_bytes, the merged spans and the kept bytes to rows of columns, text and raw spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, raw = batch.column(n_columns), batch.column(n_columns + 1)
            for lo, hi, buf, offsets in textbuf.slices(text, 1 << 22):
                own = raw.slice(lo, hi - lo)
                sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                flat = own.flatten()
                row = np.repeat(np.arange(hi - lo), sizes)
                row, _, start, end = merged_spans(row, np.zeros_like(row), flat.field("start").to_numpy().astype(np.int64), flat.field("end").to_numpy().astype(np.int64))
                mark = np.zeros(len(buf) + 1, np.int8)
                mark[offsets[row] + start] += 1
                mark[offsets[row] + end] -= 1
                keep = np.cumsum(mark[:-1], dtype=np.int8) == 0
                if characters and len(buf):
                    begins = np.flatnonzero((buf & 0xC0) != 0x80)
                    keep = np.repeat(np.logical_or.reduceat(keep, begins), np.diff(np.append(begins, len(buf))))
                left = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(left), pa.py_buffer(buf[keep].tobytes())])
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(at), spans)
                n_bytes = pa.array(np.diff(offsets))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(n_columns)), n_bytes, spans, kept], [str(k) for k in range(n_columns + 3)])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, characters: bool = False, first: bool = False) -> DataFrame:
    """The rows of ``docs``, without the text, with ``n_bytes``, ``repeat_spans`` and ``kept`` (the bytes outside the spans).

    A byte goes if a string of ``length`` bytes that covers it starts at another place too, in the
    same text or another, overlapping or not; all places go, and what repeats is judged on the given texts. With
    ``first``, of each string the place of the least (id, text's hash, place) stays, unless other strings take it, too: of
    each byte that goes, an equal one stays in an equal string. Rows that agree on id and text are then one text.
    With ``characters``, a character of which a byte stays is kept whole. Null
    texts count as empty and shorter texts than ``length`` stay whole. All other columns are
    kept; one that is named like a new one is replaced. Rows with null or repeated ids are rows like others. Spark jobs run when
    this is called.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    new = ("n_bytes", "repeat_spans", "kept")
    names = [c for c in docs.columns if c not in new]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("twin"), text.alias("text"))
    spans = repeated_spans(scratch, rows.select("doc_id", "twin", "text"), length, first)
    spans = spans.distinct().groupBy("doc_id", "twin").agg(F.flatten(F.collect_list("spans")).alias("raw"))
    plain = [f"c{k}" for k, c in enumerate(names) if c != text_col]
    out = rows.select(*plain, "doc_id", "twin", "text").join(spans, ["doc_id", "twin"], "left").select(*plain, "text", "raw")
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[c]}" for k, c in enumerate(c for c in names if c != text_col)), f"`{len(plain)}` long", f"`{len(plain) + 1}` array<struct<start:long,end:long>>", f"`{len(plain) + 2}` binary"])
    cut = out.mapInArrow(_cut(len(plain), characters), schema)
    order = [c for c in names if c != text_col] + list(new)
    return cut.toDF(*order)
