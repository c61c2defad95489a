"""Components of a similarity join on sets, of nodes that meet under shared keys.

The caller gives keys under which each pair that it wants to find meets. Of the pairs that meet, only those
that the components need are made and confirmed on the full sets:

1. within each key, neighbours in a random order are compared and confirmed, and give components;
2. only keys that hold more than one component are compared in full, in blocks of bounded size,
   and of those pairs only the ones between components are confirmed.

So a group of n near copies makes about n pairs and not n * n, yet no link between different
components is passed over. Before sets are fetched, a pair is tried on two sketches: a set's size, and
for each of ``BITS`` buckets whether an odd number of its members fall there. Buckets in which
two sketches differ hold a member that only one set has, so their number bounds what the sets can
share from above, and pairs are dropped only where that bound proves them to be below the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbuf
from quire.llm.scratch import Scratch, connected_components

BITS, BLOCK, PAIRS = 1984, 1024, 1 << 14
SKETCH = 8 + BITS // 8

#: Tells of two matrices of signatures (one row a pair) which pairs are candidates.
Test = Callable[[np.ndarray, np.ndarray], np.ndarray]


def sketch(members: np.ndarray) -> bytes:
    """Size and parities of a set, given as distinct 64-bit numbers."""
    odd = np.bincount((members % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return len(members).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def may_reach(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches (rows of bytes) may belong to sets with 100 * shared >= percent * united."""
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    both = (a[:, 0] + b[:, 0]).astype(np.int64)
    shared = (both - np.bitwise_count(a[:, 1:] ^ b[:, 1:]).sum(1, dtype=np.int64)) // 2
    return 100 * shared >= percent * (both - shared)


def _neighbours(test: Test, width: int):
    """Candidates among rows that follow each other within a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sig = textbuf.binary_rows(batch.column(2), np.uint8, width)
            if last:
                key, node, sig = np.concatenate([last[0], key]), np.concatenate([last[1], node]), np.concatenate([last[2], sig])
            at = np.flatnonzero(key[1:] == key[:-1])
            at = at[test(sig[at], sig[at + 1])]
            pairs = np.unique(np.stack([np.minimum(node[at], node[at + 1]), np.maximum(node[at], node[at + 1])], 1), axis=0)
            last = (key[-1:], node[-1:], sig[-1:].copy())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _across(test: Test, width: int, first: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None):
    """Candidates of different components of each pair of blocks; with ``first``, each at its first shared key only.

    Pairs of many cells are tried at once, ``PAIRS`` at a time (or those of one row), so that small cells don't cost a step each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in textbuf.grouped(batches, lambda x: x.column("cell").to_numpy()):
            cell, node, part = (table.column(k).to_numpy() for k in ("cell", "node", "component"))
            one, two, own, slot = (table.column(k).to_numpy() for k in ("one", "two", "own", "slot"))
            sig = textbuf.binary_rows(table.column("sig"), np.uint8, width)
            cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            at, rows = cuts[:-1], np.diff(cuts)
            mixed = np.repeat(np.minimum.reduceat(part, at) < np.maximum.reduceat(part, at), rows)
            # a row of a cell's first block meets those of the second one, which follow, or the rows after it where both are one block
            begin = np.where(one == two, np.arange(len(cell)) + 1, np.repeat(at + np.add.reduceat((own != two).astype(np.int64), at), rows))
            count = np.where(mixed & (own == one), np.repeat(cuts[1:], rows) - begin, 0)
            found = []
            for lo, hi in textbuf.runs_of(count, PAIRS):
                n = count[lo:hi]
                i = np.repeat(np.arange(lo, hi), n)
                j = begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                apart = part[i] != part[j]
                i, j = i[apart], j[apart]
                near = test(sig[i], sig[j])
                i, j = i[near], j[near]
                if first:
                    good = np.zeros(len(i), bool)
                    for k in np.unique(slot[i]):
                        of = np.flatnonzero(slot[i] == k)
                        good[of] = first(sig[i[of]], sig[j[of]], int(k))
                    i, j = i[good], j[good]
                found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another row has, of partitions sorted by key (column 0)."""
    held, before = None, None  # the last row so far, and the key of the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        key = table.column(0).to_numpy()
        same = np.empty(len(key) + 1, bool)
        same[0], same[-1], same[1:-1] = before is not None and before == key[0], False, key[1:] == key[:-1]
        keep = (same[:-1] | same[1:])[:-1]
        yield from table.slice(0, len(key) - 1).filter(pa.array(keep)).to_batches()
        before = key[-2] if len(key) > 1 else before
        held = table.slice(len(key) - 1).to_batches()[0]
    if held is not None and before == held.column(0)[0].as_py():
        yield held


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, slot, node) whose key another row has, streamed; a hot key's rows are in one task, one held at a time."""
    return keys.select("key", "slot", "node").repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "key long, slot int, node long")


def _confirmed(scratch: Scratch, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return scratch.keep(both.select("a", "b", (100 * shared >= percent * (F.size("x") + F.size("y") - shared)).alias("linked")).where("linked").select("a", "b"), "links")


def components(scratch: Scratch, shared: DataFrame, sets: DataFrame, percent: int, test: Test, width: int, first=None) -> DataFrame:
    """(node, component) of the nodes that link with another.

    ``shared`` has key, slot, node and sig (``width`` bytes, what ``test`` compares), ``sets`` has node and members
    (distinct numbers). Both are read several times, so they should be kept tables. A mixed key of n rows is compared
    in n / BLOCK blocks against each other, so its rows are sent as many times; that is the cost of an exact answer for a
    key under which many sets are near each other and not linked.
    """
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared.select("key", "node", "sig").withColumn("r", F.xxhash64("key", "node")).repartitionByRange(n, "key", "r").sortWithinPartitions("key", "r")
    pairs = scratch.keep(ordered.select("key", "node", "sig").mapInArrow(_neighbours(test, width), "a long, b long").distinct(), "pairs")
    links = _confirmed(scratch, sets, pairs, percent)
    parts = scratch.keep(connected_components(scratch, links), "parts")
    named = shared.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo < hi").select("key", "blocks")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks").cast("long")).cast("int")
    blocks = named.join(mixed, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).withColumn("cell", F.xxhash64("key", "one", "two"))
    blocks = blocks.select("cell", "slot", "node", "component", "one", "two", "own", "sig").repartition("cell").sortWithinPartitions("cell", "own", "node")
    rest = blocks.mapInArrow(_across(test, width, first), "a long, b long").distinct()
    rest = scratch.keep(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    more = _confirmed(scratch, sets, rest, percent)
    out = scratch.keep(connected_components(scratch, links.union(more)), "parts")
    scratch.drop(pairs, links, parts, rest, more)
    return out
