"""Variable-capacity best-fit packing of documents into training sequences.

Pieces go in falling length into the fullest open bin that holds them. If none does, a bin is
opened: of the permitted lengths that hold the piece, the one with the least cost for each token
that it would hold once the pieces still to come have filled it, in falling length; pieces that open
bins are expected to take are not counted again. At the end each bin shrinks to the shortest
permitted length that holds its contents. A sequence of n tokens costs n * (1 + n / ATTENTION)
plus a fixed part, so long bins are opened only for long pieces or if they'll be filled better.

Documents longer than the longest permitted length are cut into pieces of that length. Rows are packed in groups of bounded
size by a hash of their piece, so any group can be packed again on another machine with
the same outcome; what grouping costs is a few bins a group that stay unfilled.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (1024, 2048, 4096, 8192)
ATTENTION, FIXED = 32768.0, 16.0
#: What ends a document in a sequence of bytes; no UTF-8 text has it.
END = b"\xff"
PACKED = "doc_id long, piece int, start long, length long, bin_id string, capacity long, offset long, bin_used long"


def cost(capacity: float) -> float:
    return capacity * (1 + capacity / ATTENTION) + FIXED


def _filling(free: int, alive: list[int], spare: Counter[int]) -> tuple[list[tuple[int, int]], int]:
    """(length, count) of the spare pieces that fill ``free`` tokens in falling length, and the tokens left free.

    ``alive`` has the lengths of which there are spare pieces, sorted.
    """
    taken = []
    at = len(alive)
    while free and (at := bisect_right(alive, free, 0, at)):
        at -= 1
        n = alive[at]
        if not n:
            break
        m = min(spare[n], free // n)
        taken.append((n, m))
        free -= n * m
    return taken, free


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length and (capacity, used) of each bin; no length exceeds the largest capacity."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (free, bin) of open bins, sorted
    size: list[int] = []
    used: list[int] = []
    # pieces to come, by length: those that open bins are expected to take, and the others
    planned: Counter[int] = Counter()
    spare = Counter(lengths.tolist())
    alive = sorted(spare)

    def take(n: int, m: int) -> None:
        spare[n] -= m
        if not spare[n]:
            del alive[bisect_left(alive, n)]

    for k in order:
        n = int(lengths[k])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
            if planned[n]:
                planned[n] -= 1
            else:
                take(n, 1)
        else:
            # no open bin takes this length, so none of it is expected in one
            if not spare[n]:
                insort(alive, n)
            spare[n] += planned.pop(n, 0)
            take(n, 1)
            choices = []
            for c in (c for c in capacities if c >= n):
                fill, left = _filling(c - n, alive, spare)
                held = c - left
                choices.append((cost(min(x for x in capacities if x >= held)) / max(1, held), c, fill))
            _, free, fill = min(choices)
            for length, m in fill:
                take(length, m)
                planned[length] += m
            b = len(size)
            size.append(free)
            used.append(0)
        bin_of[k], offset[k] = b, used[b]
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    downsized = [min(c for c in capacities if c >= u) for u in used]
    return bin_of, offset, np.array(downsized, np.int64), np.array(used, np.int64)


def _packed(capacities: tuple[int, ...]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bin_of, offset, size, used = pack(rows["length"].to_numpy(), capacities)
        names = np.array([f"{rows['group'].iat[0]}-{b}" for b in range(len(size))], object)
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "piece": rows["piece"], "start": rows["start"], "length": rows["length"], "bin_id": names[bin_of], "capacity": size[bin_of], "offset": offset, "bin_used": used[bin_of]})

    return run


def pack_documents(docs: DataFrame, length, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, group_rows: int = 20000) -> DataFrame:
    """One row of each piece: doc_id, piece (from 0), start and length in tokens, bin_id, the bin's capacity
    (after downsizing), the piece's offset in it and the tokens it holds.

    ``length`` is a column of token counts; null or less counts as 0, and such documents are one piece of length 0.
    Null and repeated ids are packed as rows of their own. Other columns are not looked at.
    """
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    count = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / top))).alias("k")).first()["k"] or 0
    groups = max(1, math.ceil(count / group_rows))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / top) - 1).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("piece").cast("long") * top)
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.lit(top), F.col("n") - F.col("start")).alias("length"))
    # pieces that are alike, as those of null or repeated ids, are counted and numbered, so that they spread over the groups, too
    alike = pieces.groupBy("doc_id", "piece", "start", "length").agg(F.count("*").cast("int").alias("n"))
    pieces = alike.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length", "k"), F.lit(groups)))
    pieces = pieces.select("doc_id", "piece", "start", "length", "group")
    return pieces.groupBy("group").applyInPandas(_packed(capacities), PACKED)


def sequences(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training sequences of ``packed`` (see ``pack_documents``, with a text's bytes and one mark as its length): bin_id, capacity, used, tokens
    (the bytes of its pieces in order, an ``END`` byte after each document), and doc_ids and starts, one of each piece.

    Ids of ``docs`` have to be unique; the places of pieces without an id, whose text can't be looked up, are filled with zeros. A
    sequence has no more than the largest capacity, so it is put together in one row.
    """
    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.concat(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8"), F.lit(END)).alias("bytes"))
    own = F.substring(F.col("bytes"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    own = F.coalesce(own, F.encode(F.repeat(F.lit("\0"), F.col("length").cast("int")), "UTF-8"))
    rows = packed.join(whole, "doc_id", "left").select("bin_id", "capacity", "bin_used", F.struct("offset", "doc_id", own.alias("own")).alias("p"))
    bins = rows.groupBy("bin_id").agg(F.any_value("capacity").alias("capacity"), F.any_value("bin_used").alias("used"), F.array_sort(F.collect_list("p")).alias("p"))
    tokens = F.reduce("p", F.lit(b""), lambda done, p: F.concat(done, p["own"]))
    return bins.select("bin_id", "capacity", "used", tokens.alias("tokens"), F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("p", lambda p: p["offset"]).alias("starts"))
