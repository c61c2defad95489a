"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles becomes a signature of K values of b bits. Two sets of Jaccard
similarity J differ in each value with a probability of about 1 - J, so the pairs looked for lie
within a Hamming distance of R values. The signature is split into chunks, chunk i is allowed e_i
errors, and as the sum of (e_i + 1) exceeds R, each pair within R agrees on some chunk but for its
allowed errors (pigeonhole). Errors are enumerated by leaving out one value at a time: a chunk of
w values gives the keys of its w subsets of w - 1. Of the pairs that share a key and lie within R, those that
components need are confirmed on the full shingle sets (``quire.llm.clusters``). No other test than a
bound that holds for the full sets drops a pair within R. Documents of equal sets are one document to all this.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import clusters, textbuf
from quire.llm.scratch import Scratch

VALUES, DISTANCE, ERROR_CHUNK = 64, 20, 6
WIDTH = VALUES + clusters.SKETCH
SEEDS = np.random.default_rng(7).integers(1, 2**32, (2, VALUES), dtype=np.uint64).astype(np.uint32)
SEEDS[1] |= 1


def chunk_plan(values: int = VALUES, distance: int = DISTANCE, size: int = ERROR_CHUNK) -> list[tuple[int, int, int]]:
    """(start, end, allowed errors) of chunks whose allowances guarantee all pairs within ``distance``.

    Chunks of ``size`` values may err once; if the values run short, the rest are split into
    chunks without errors. >>> sum(e + 1 for _, _, e in chunk_plan()) > DISTANCE
    """
    once = min(values // size, (distance + 1) // 2)
    exact = distance + 1 - 2 * once
    if exact < 0 or exact and values - once * size < exact:
        raise ValueError("too few values for this distance")
    plan = [(k * size, (k + 1) * size, 1) for k in range(once)]
    edges = np.linspace(once * size, values, exact + 1).astype(int) if exact else []
    return plan + [(int(a), int(b), 0) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-word shingles of each document, and where each document's begin.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a document of
    fewer words than ``n`` has its whole sequence as one shingle.
    """
    low = textbuf.LOWER[buf]
    starts, ends, doc = textbuf.words(low, offsets, textbuf.SPACE)
    h = textbuf.word_hashes(low, starts, ends)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    first = np.concatenate([[0], np.cumsum(count)])
    own = np.repeat(np.arange(len(made)), made)
    word = first[own] + np.arange(at[-1]) - at[own]
    out = np.zeros(len(word), np.uint64)
    length = np.minimum(count, n)[own]
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        out = textbuf.mix(out + np.where(k < length, padded[word + k], np.uint64(k + 1))) if len(out) else out
    return out, at


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """8-bit MinHash signatures of the runs of hashes that begin at ``starts`` (none is empty)."""
    x = (hashes >> np.uint64(16)).astype(np.uint32)
    sig = np.empty((len(starts), VALUES), np.uint8)
    for k in range(VALUES):
        low = np.minimum.reduceat((x ^ SEEDS[0, k]) * SEEDS[1, k], starts)
        sig[:, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return sig


def chunk_keys(sig: np.ndarray, plan: list[tuple[int, int, int]]) -> np.ndarray:
    """A 64-bit key for each chunk and each allowed error: the chunk's values but the one left out."""
    out = []
    for c, (a, b, errors) in enumerate(plan):
        weights = [np.uint64(int(w) | 1) for w in np.random.default_rng(c).integers(1, 2**63, b - a)]
        terms = [(sig[:, a + i].astype(np.uint64) + np.uint64(1)) * weights[i] for i in range(b - a)]
        total = sum(terms[1:], terms[0])
        for left in range(b - a) if errors else [-1]:
            tag = np.uint64((c * 64 + left + 2) * 0x9E3779B97F4A7C15 % 2**64)
            out.append(textbuf.mix((total - terms[left] if left >= 0 else total) ^ tag))
    return np.stack(out, 1).view(np.int64)


SKETCH = "doc_id long, digest long, n_shingles long, same binary, sig binary"


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in textbuf.slices(batch.column(1)):
                h, at = shingle_hashes(buf, offsets, words)
                sizes, same = np.zeros(hi - lo, np.int64), [None] * (hi - lo)
                sig = np.zeros((hi - lo, WIDTH), np.uint8)
                for i in np.flatnonzero(np.diff(at)):
                    own = np.unique(h[at[i] : at[i + 1]])
                    sizes[i], same[i] = len(own), blake2b(own.tobytes(), digest_size=16).digest()
                    sig[i, VALUES:] = np.frombuffer(clusters.sketch(own), np.uint8)
                full = np.flatnonzero(sizes)
                if len(full):
                    sig[full, :VALUES] = signatures(h, at[:-1][full])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(sizes), pa.array(same, pa.binary()), textbuf.pack_rows(sig)], ["doc_id", "digest", "n_shingles", "same", "sig"])

    return run


def _keys(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(textbuf.binary_rows(batch.column(1), np.uint8, WIDTH)[:, :VALUES], plan)
                yield pa.RecordBatch.from_arrays([batch.column(0), textbuf.lists(keys.reshape(-1), np.full(len(keys), keys.shape[1]))], ["node", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in textbuf.slices(batch.column(1)):
                h, at = shingle_hashes(buf, offsets, words)
                own = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), textbuf.lists(flat, np.array([len(x) for x in own], np.int64))], ["node", "members"])

    return run


def first_shared(differ: np.ndarray, plan, which: int, left: int) -> np.ndarray:
    """Of pairs (rows of where their values differ), those whose first shared key is (chunk, left out)."""
    good = np.ones(len(differ), bool)
    for c, (a, b, errors) in enumerate(plan[: which + 1]):
        wrong = differ[:, a:b].sum(1)
        if c < which:
            good &= wrong > errors
        elif errors:
            good &= (wrong == 1) & differ[:, a + left] | (wrong == 0) & (left == 0)
    return good


def candidates(distance: int, percent: int) -> clusters.Test:
    """Pairs within the distance whose sets may reach the threshold."""

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = (a[:, :VALUES] != b[:, :VALUES]).sum(1) <= distance
        good[good] = clusters.may_reach(a[good, VALUES:], b[good, VALUES:], percent)
        return good

    return test


def at_first_key(plan):
    """Of pairs that share the key of a slot, those that share none of an earlier slot."""
    slots = [(c, i) for c, (a, b, e) in enumerate(plan) for i in (range(b - a) if e else [0])]
    return lambda a, b, slot: first_shared(a[:, :VALUES] != b[:, :VALUES], plan, *slots[slot])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, distance: int = DISTANCE, chunk: int = ERROR_CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Documents link if 100 * |intersection| >= percent * |union| of their word shingle sets; a
    component's id is the smallest doc_id that links reach. Null and empty texts have no shingles and
    link with nothing; rows with a null id are returned with their own null component; repeated
    rows of one id are returned each, with the component of their own text. Other columns are not looked at.
    A pair at the threshold is missed only if its signatures differ in more than ``distance`` of 64
    values, which by the binomial model has a probability of 0.00027 at 85 percent. Spark jobs run when this is called.
    """
    return _clustered(docs, id_col, text_col, words, percent, distance, chunk).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))


def first_of_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, distance: int = DISTANCE, chunk: int = ERROR_CHUNK) -> DataFrame:
    """The rows of ``docs`` with an id, less those whose text is a near duplicate of another row's.

    Of each component the row of the smallest id stays (of several texts under that id, the one of the smallest digest;
    of equal rows one). All columns stay as they are, whatever their names. Texts without shingles are duplicates only of the same text under the same id.
    """
    found = _clustered(docs, id_col, text_col, words, percent, distance, chunk)
    kept = found.where((F.col("doc_id") == F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).select("doc_id", "digest")
    # rows go whole, so that no column of theirs meets one of these names
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), _digest(F.col(text_col)).alias("digest"))
    return rows.join(kept, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select("row.*")


def _digest(text):
    return F.xxhash64(text.cast("string"))


def _clustered(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, distance: int, chunk: int) -> DataFrame:
    """(doc_id, digest of the text, n_shingles, first) of each row; first has the smallest (doc_id, digest) of its component.

    A node of the join is a shingle set, whatever ids have it, so texts that share an id are apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    plan = chunk_plan(VALUES, distance, chunk)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", _digest(F.col("text")))
    sketch = scratch.keep(docs.select("doc_id", "text", "digest").mapInArrow(_sketches(words), SKETCH), "sketch")
    linked = sketch.where("same is not null and doc_id is not null")
    reps = scratch.keep(linked.groupBy("same").agg(F.min(F.struct("doc_id", "digest")).alias("own"), F.any_value("sig").alias("sig")).select("same", F.xxhash64("same").alias("node"), "own", "sig"), "reps")
    keys = reps.select("node", "sig").mapInArrow(_keys(plan), "node long, keys array<long>").select("node", F.posexplode("keys").alias("slot", "key"))
    shared = scratch.keep(clusters.shared_keys(keys).join(reps.select("node", "sig"), "node").select("key", "slot", "node", "sig"), "shared")
    near = reps.join(shared.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "own.doc_id", "own.digest")
    near = docs.join(near.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])  # alike at any size: no set of ids is broadcast
    sets = scratch.keep(near.select("node", "text").mapInArrow(_sets(words), "node long, members array<long>"), "sets")
    parts = clusters.components(scratch, shared, sets, percent, candidates(distance, percent), WIDTH, at_first_key(plan))
    scratch.drop(shared, sets)
    least = parts.join(reps.select("node", "own"), "node").groupBy("component").agg(F.min("own").alias("least"))
    parts = parts.join(least, "component").select("node", "least")
    members = reps.join(parts, "node", "left").select("same", F.coalesce("least", "own").alias("first"))
    out = sketch.join(members, "same", "left")
    own = F.struct("doc_id", "digest")
    return out.select("doc_id", "digest", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", own)).alias("first"))
