"""SpotSigs fingerprints: chains of content words that follow common words.

At each antecedent (a very common word) the next content words, ``CHAIN`` of them, form a spot
signature; common words in between are passed over. The start of a text counts as an antecedent. A
text without common words takes each of its words as one, so that other text is fingerprinted too. A
fingerprint is the set of its signatures, written as sorted 8-digit hexadecimal numbers.

Sets are compared by Jaccard similarity. A pair can only reach a threshold t if the smaller set has
t times the members of the larger one at least; so sets are partitioned by length, and each meets
its own and the next partition only, by its rarest signatures, of which a match must share one: signatures that few sets have
bring few sets together that are not alike. Of these pairs, those that sizes and bucket parities rule out are not compared (``quire.llm.clusters``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import clusters, textbuf
from quire.llm.scratch import Scratch

CHAIN = 2
#: Antecedents and further common words that chains pass over.
ANTECEDENTS = "the is was of to an that and there said der die das und ist war von zu den le la les des est et que dans el los las del es y en que una un"
COMMON = ANTECEDENTS + " a in for on with as at by be it this are or from not he she they we you i his her its have has had will would can ein eine einer nicht mit auf im dem ich sie wir für als auch une du de pour pas au aux ce il elle nous vous par sur se con por para su lo al o sus más"
SEPARATOR = textbuf.SPACE.copy()
SEPARATOR[[33, 34, 39, 40, 41, 44, 46, 58, 59, 63, 91, 93]] = True


def _hashes(words: str) -> np.ndarray:
    raw = words.encode().split()
    buf = np.frombuffer(b" ".join(raw), np.uint8)
    starts, ends, _ = textbuf.words(buf, np.array([0, len(buf)]), SEPARATOR)
    return np.unique(textbuf.word_hashes(buf, starts, ends))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


SPOTS, PASSED = _hashes(ANTECEDENTS), _hashes(COMMON)


def fingerprints(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text."""
    low = textbuf.LOWER[buf]
    starts, ends, doc = textbuf.words(low, offsets, SEPARATOR)
    n = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, np.uint32)] * n
    h = textbuf.word_hashes(low, starts, ends)
    spot, content = _among(h, SPOTS), ~_among(h, PASSED)
    plain = np.bincount(doc[spot], minlength=n) == 0
    content |= plain[doc]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    spot |= plain[doc]
    words = np.flatnonzero(content)
    rank = np.concatenate([[0], np.cumsum(content)])
    # an antecedent's chain begins after it; a text's own start is one before its first word
    at = np.concatenate([np.flatnonzero(spot) + 1, np.flatnonzero(first)])
    own = np.concatenate([doc[spot], doc[first]])
    sig = np.concatenate([np.where(plain[doc[spot]], np.uint64(1), h[spot]), np.ones(first.sum(), np.uint64)])
    for k in range(CHAIN):
        r = rank[at] + k
        w = words[np.minimum(r, len(words) - 1)] if len(words) else np.zeros(len(r), np.int64)
        there = (r < len(words)) & (doc[w] == own)
        sig = textbuf.mix(sig * np.uint64(0xD6E8FEB86659FD93) + np.where(there, h[w], np.uint64(k + 7)))
    sig = (sig >> np.uint64(32)).astype(np.uint32)
    both = np.unique((own.astype(np.uint64) << np.uint64(32)) | sig)
    cuts = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    return [both[a:b].astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def written(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity, or 0 as soon as the lengths rule out ``least``; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in textbuf.slices(batch.column(1)):
            sigs = fingerprints(buf, offsets)
            flat = np.concatenate(sigs).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([written(s) for s in sigs], pa.string()), textbuf.lists(flat, np.array([len(s) for s in sigs]))], ["doc_id", "fingerprint", "spots"])


def spot_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, spots) of each row; null and empty texts have an empty fingerprint."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprinted, "doc_id long, fingerprint string, spots array<long>")


def _near(percent: int):
    return lambda a, b: clusters.may_reach(a, b, percent)


def _often(scratch: Scratch, reps: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures that the most sets have, sorted, and how many have each: all with at least 2, 4, 8, ... sets, ``most`` at the most."""
    counted = scratch.keep(reps.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("n")).where("n > 1"), "counted")
    least, room = 0, most
    for bits, n in sorted(counted.groupBy(F.length(F.bin("n"))).count().collect(), reverse=True):  # a row a power of two
        room -= n
        if room < 0:
            break
        least = 2 ** (bits - 1)
    found = counted.where(F.col("n") >= least).toArrow() if least else None
    scratch.drop(counted)
    spots, n = (found.column(c).to_numpy().astype(np.uint64) if found else np.zeros(0, np.uint64) for c in ("spot", "n"))
    order = np.argsort(spots)
    return spots[order], n[order]


def _keyed(percent: int, often):
    """The keys of sets of signatures, and their sketches.

    Signatures have one order for all sets: first those that are not among the broadcast ``often``, then these from the fewest sets to the most, ties by
    hash. The prefix of a set of n is its first n - ceil(t n) + 1 members: sets of likeness t share one of their
    prefixes' members. That holds in any order; this one leaves few sets that share a member and are not alike. A key is such a
    member with a partition of lengths; a set has keys in its own partition and in the next
    one, where the longer sets that it may be like have theirs.
    """
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets = often.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column("spots")).to_numpy().astype(np.int64)
            for lo, hi in textbuf.runs_of(sizes, 1 << 18):
                n = sizes[lo:hi]
                own = batch.column("spots").slice(lo, hi - lo).flatten().to_numpy().astype(np.uint64)
                ends = np.cumsum(n)
                sketches = [clusters.sketch(own[a:b]) for a, b in zip(ends - n, ends, strict=True)]
                h, times = textbuf.mix(own * np.uint64(0x9E3779B97F4A7C15)), np.zeros(len(own), np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    times = np.where(known[at] == own, sets[at], np.uint64(0))
                h = h[np.lexsort((h, times, np.repeat(np.arange(len(n)), n)))]
                size = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
                prefix = h[np.arange(len(h)) - np.repeat(ends - n, n) < np.repeat(size, n)]
                part = np.repeat(np.floor(np.log(n) / math.log(1 / t) + 1e-9).astype(np.uint64), size)
                keys = np.stack([textbuf.mix(prefix + part), textbuf.mix(prefix + part + np.uint64(1))], 1).reshape(-1)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array(sketches, pa.binary()), textbuf.lists(keys.view(np.int64), 2 * size)], ["node", "sig", "keys"])

    return run


def similar_classes(fingerprinted: DataFrame, percent: int = 80, most_often: int = 1 << 19) -> DataFrame:
    """(doc_id, class_id) of rows (doc_id, spots): class_id is the smallest doc_id that links reach, the row's own included.

    Fingerprints link from a likeness of ``percent`` on. Equal ones are one node; empty ones link with nothing, and rows with a
    null id have a null class. Sets meet by partitions of lengths under the rarest members, of which a match has to share one;
    the pairs that classes need are compared as in ``quire.llm.clusters``, so that a hot signature gives
    no pair for each two of its sets. All signatures are counted; the counts of the ``most_often`` most frequent (8 MB) go through the driver
    to the tasks, and the others count as equally rare. Their number bears on time only, not on results. Spark jobs run when this is called.
    """
    spark = fingerprinted.sparkSession
    scratch = Scratch(spark, "spots")
    known = fingerprinted.where("doc_id is not null and size(spots) > 0")
    # two hashes of 64 bits stand for a set of signatures
    node, same = F.xxhash64("spots"), F.xxhash64(F.lit(7), F.col("spots"))
    reps = scratch.keep(known.groupBy(node.alias("node"), same.alias("same")).agg(F.min("doc_id").alias("own"), F.any_value("spots").alias("spots")), "reps")
    often = spark.sparkContext.broadcast(_often(scratch, reps, most_often))
    keyed = scratch.keep(reps.select("node", "spots").mapInArrow(_keyed(percent, often), "node long, sig binary, keys array<long>"), "keyed")
    keys = keyed.select("node", F.explode(F.array_distinct("keys")).alias("key")).withColumn("slot", F.lit(0))
    shared = scratch.keep(clusters.shared_keys(keys).join(keyed.select("node", "sig"), "node").select("key", "slot", "node", "sig"), "shared")
    sets = scratch.keep(reps.join(shared.select("node").distinct().hint("merge"), "node", "left_semi").select("node", F.col("spots").alias("members")), "sets")
    parts = clusters.components(scratch, shared, sets, percent, _near(percent), clusters.SKETCH)
    least = parts.join(reps.select("node", "own"), "node").groupBy("component").agg(F.min("own").alias("least"))
    members = reps.select("node", "same", "own").join(parts.join(least, "component").select("node", "least"), "node", "left").select("node", "same", F.coalesce("least", "own").alias("class_id"))
    out = scratch.keep(fingerprinted.select("doc_id", node.alias("node"), same.alias("same")).join(members, ["node", "same"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "classes")
    scratch.drop(reps, keyed, shared, sets, parts)
    return out


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order, each compared with the row after it; rows marked ``tail`` only follow."""
    held = None  # the last row: id, text, signatures, tail, range
    for batch in batches:
        for lo, hi, buf, offsets in textbuf.slices(batch.column("text")):
            ids, tails, ranges = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("doc_id", "tail", "range"))
            texts = batch.column("text").slice(lo, hi - lo).to_pylist()
            rows = list(zip(ids, texts, fingerprints(buf, offsets), tails, ranges, strict=True))
            rows = [held, *rows] if held else rows
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[3] and a[4] == b[4]]
            if not pairs:
                continue
            edited = []
            for (_, text, *_), (_, after, *_) in pairs:
                k = len(text) // 4
                edited.append((text[: len(text) - k] + after[:k]).encode())
            raw = np.frombuffer(b"".join(edited), np.uint8)
            sigs = fingerprints(raw, np.concatenate([[0], np.cumsum([len(e) for e in edited])]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()), pa.array([sha256(e).hexdigest() for e in edited], pa.string()),
                    pa.array([written(a[2]) for a, _ in pairs], pa.string()), pa.array([written(s) for s in sigs], pa.string()),
                    pa.array([likeness(a[2], s) for (a, _), s in zip(pairs, sigs, strict=True)], pa.float64()), pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def _begins(rows_per_range: int, bytes_per_range: int):
    """The first rows of ranges, of partitions (key, h, size) sorted by key and h: where a grid over rows or bytes is crossed.

    Rows alike in key and h stay in one range, so it then begins with the next other row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, size, due = None, 0, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            key, h, sizes = (batch.column(c).to_numpy() for c in range(3))
            other = np.ones(len(key), bool)
            other[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            other[0] = (key[0], h[0]) != last
            place = n + np.arange(-1, len(key))
            ends = size + np.concatenate([[0], np.cumsum(sizes)])
            wanted = (place[1:] // rows_per_range != place[:-1] // rows_per_range) | (ends[1:] // bytes_per_range != ends[:-1] // bytes_per_range)
            wanted[0] |= due
            may = np.flatnonzero(other)
            at = np.searchsorted(may, np.flatnonzero(wanted))
            due = bool(len(at)) and at[-1] == len(may)
            at = may[np.unique(at[at < len(may)])]
            last, n, size = (key[-1], h[-1]), n + len(key), int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(h[at])], ["key", "h"])

    return run


def _ranges(scratch: Scratch, rows: DataFrame, rows_per_range: int, bytes_per_range: int, most: int) -> np.ndarray:
    """The first row (key, h) of each range, in order; about ``most`` at the most, and one more a shuffle partition."""
    light = scratch.keep(rows.select("key", "h", (F.octet_length("text") + 16).cast("long").alias("size")), "places")
    n, size = light.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return np.zeros((0, 2), np.int64)
    rows_per_range, bytes_per_range = max(rows_per_range, 2 * n // most), max(bytes_per_range, 2 * size // most)
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    found = light.repartitionByRange(parts, "key", "h").sortWithinPartitions("key", "h").mapInArrow(_begins(rows_per_range, bytes_per_range), "key long, h long").toArrow()
    scratch.drop(light)
    cuts = np.stack([found.column(c).to_numpy() for c in ("key", "h")], 1)
    return cuts[np.lexsort((cuts[:, 1], cuts[:, 0]))]


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 4096, bytes_per_range: int = 12 << 20, most_ranges: int = 100_000) -> DataFrame:
    """Each text's fingerprint against those of its edited text and of the next document.

    The edited text has its last n // 4 characters replaced by the first as many (or all) of the next
    document, in the order of id (null first) and text; the first follows the last. A single row
    follows itself. Null texts count as empty. Other columns are not looked at.

    Rows of one id follow each other in the order of their texts' hashes. Ids and hashes, without texts, are sorted to find where
    ranges of ``rows_per_range`` rows or ``bytes_per_range`` bytes begin, whatever id they have; then each text goes to
    the partition of its range, and a range's first row to the end of the range before, too. The driver gets a pair of numbers a range,
    as for a shuffle of as many partitions; beyond ``most_ranges`` ranges become longer instead, and tasks hold a row
    at a time. Only rows alike in id and text are never cut apart. Spark jobs run when this is called.
    """
    scratch = Scratch(docs.sparkSession, "next")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text")})
    cuts = _ranges(scratch, rows, rows_per_range, bytes_per_range, most_ranges)
    if not len(cuts):
        return docs.sparkSession.createDataFrame([], COMPARED)
    placed = rows.withColumn("range", _range_number(F.col("key"), F.col("h"), cuts))
    key, h = (F.element_at(F.lit(cuts[:, c].copy()), F.col("range") + 1) for c in (0, 1))
    before = F.when(F.col("range") == 0, len(cuts) - 1).otherwise(F.col("range") - 1)
    own = F.struct(F.col("range"), F.lit(False).alias("tail"))
    to = F.when((F.col("key") == key) & (F.col("h") == h), F.array(own, F.struct(before.alias("range"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    dealt = placed.withColumn("to", F.explode(to)).select("doc_id", "text", "key", "h", "to.range", "to.tail")
    dealt = dealt.repartitionById(len(cuts), "range").sortWithinPartitions("range", "tail", "key", "h").select("doc_id", "text", "tail", "range")
    return dealt.mapInArrow(_with_next, COMPARED)


def _range_number(key: Column, h: Column, cuts: np.ndarray) -> Column:
    """How many of the sorted ``cuts`` (key, h) but the first are not above a row: a search in two levels."""
    width = math.isqrt(len(cuts) - 1) + 1
    pairs = lambda c: F.arrays_zip(F.lit(c[:, 0].copy()).alias("key"), F.lit(c[:, 1].copy()).alias("h"))
    below = lambda c: (c["key"] < key) | ((c["key"] == key) & (c["h"] <= h))
    rough = F.greatest(F.lit(1), F.size(F.filter(pairs(cuts[::width]), below)))
    fine = F.array(*(pairs(cuts[k : k + width]) for k in range(0, len(cuts), width)))
    return F.greatest(F.lit(0), (rough - 1) * width + F.size(F.filter(F.element_at(fine, rough), below)) - 1).cast("int")
