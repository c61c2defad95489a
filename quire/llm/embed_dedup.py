"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of one label (and one length) are rotated to their principal axes, so that the leading
coordinates carry most of each dot product. They are sorted by the first coordinate and cut into
tiles of bounded size; only tiles whose ranges of that coordinate come near enough for the cosine
are compared, each pair of tiles as one group of bounded size. Within a group, blocks accumulate
the leading coordinates first; the rest of a dot product is at most the product of both suffix
norms, and pairs (or whole blocks) stop as soon as that bound falls short of the threshold. What
is left is decided by the cosine of the given components in double precision.

A group returns one row per linked vector (its number of links and the smallest vector of its
local component), never the pairs. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbuf
from quire.llm.scratch import Scratch, connected_components

TILE, BLOCK = 2048, 512
SLACK = 1e-9
VECTORS = "vec_id long, label long, dim int, same binary, x binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as doubles in binary; ``same`` is null where a vector can't link."""
    for batch in batches:
        lists = pc.if_else(pc.is_valid(batch.column(1)), batch.column(2), None)
        dim = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        flat = pc.fill_null(pc.list_flatten(lists), np.nan).to_numpy() + 0.0  # no negative zeros
        start = np.cumsum(dim) - dim
        some = np.flatnonzero(dim)
        good = np.zeros(len(dim), bool)
        if len(some):
            good[some] = np.logical_and.reduceat(np.isfinite(flat), start[some]) & np.logical_or.reduceat(flat != 0, start[some])
        raw = flat.tobytes()
        x = [raw[8 * a : 8 * (a + n)] if ok else None for a, n, ok in zip(start.tolist(), dim.tolist(), good.tolist(), strict=True)]
        same = [blake2b(v, digest_size=16).digest() if v is not None else None for v in x]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dim, pa.int32()), pa.array(same, pa.binary()), pa.array(x, pa.binary())], ["vec_id", "label", "dim", "same", "x"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, row of the second-moment matrix, that row's sums) of a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims):
            u = _unit(textbuf.binary_rows(batch.column(1).filter(pa.array(dims == d)), float, int(d)))
            total[int(d)] = total.get(int(d), 0) + u.T @ u
    for d, m in total.items():
        at = np.arange(d * d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(at.astype(np.int32)), pa.array(m.reshape(-1))], ["dim", "at", "v"])


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, its axes by falling second moment (d x d numbers reach the driver)."""
    rows = reps.select("dim", "x").mapInArrow(_moments, "dim int, at int, v double").groupBy("dim", "at").agg(F.sum("v").alias("v")).toPandas()
    return {int(d): np.linalg.eigh(g.sort_values("at").v.to_numpy().reshape(d, d))[1][:, ::-1].copy() for d, g in rows.groupby("dim")}


def _leading(axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lead = batch.column("dim").to_numpy(), np.zeros(batch.num_rows)
            for d in np.unique(dims):
                lead[dims == d] = _unit(textbuf.binary_rows(batch.column("x").filter(pa.array(dims == d)), float, int(d))) @ axes[int(d)][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], [*batch.schema.names, "lead"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the tiles of a partition sorted by (label, dim, lead)."""
    last, seen, tile = None, 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
        new = np.ones(batch.num_rows, bool)
        new[0] = (label[0], dim[0]) != last
        new[1:] = (label[1:] != label[:-1]) | (dim[1:] != dim[:-1])
        row = np.arange(batch.num_rows)
        begun = np.maximum.accumulate(np.where(new, row, -seen))  # where each row's group began, before the batch if it goes on
        place = row - begun
        out = tile + np.cumsum(place % TILE == 0)
        last, seen, tile = (label[-1], dim[-1]), int(place[-1]) + 1, int(out[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.astype(np.int64))], [*batch.schema.names, "tile"])


def linked_blocks(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of x and y with a cosine of ``threshold`` at least; i < j if both are one set."""
    u, v = _unit(x), _unit(y)
    p, q = u @ axes, v @ axes
    d = p.shape[1]
    steps = sorted({min(d, s) for s in (8, 16, 32, d)})
    rest = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], 1)[:, ::-1]))
    rp, rq = (np.concatenate([rest(m), np.zeros((len(m), 1))], 1) for m in (p, q))
    one, two = [], []
    for a in range(0, len(p), BLOCK):
        for b in range(a if same else 0, len(q), BLOCK):
            left, right = slice(a, a + BLOCK), slice(b, b + BLOCK)
            s = steps[0]
            alive = p[left, :s] @ q[right, :s].T + np.outer(rp[left, s], rq[right, s]) >= threshold - SLACK
            i, j = np.nonzero(alive)
            if len(i) > alive.size // 16:
                i, j = np.nonzero(u[left] @ v[right].T >= threshold - SLACK)
                i, j = i + a, j + b
            else:
                i, j = i + a, j + b
                dots = np.einsum("ij,ij->i", p[i, :s], q[j, :s])
                for s, t in zip(steps[:-1], steps[1:], strict=True):
                    dots = dots + np.einsum("ij,ij->i", p[i, s:t], q[j, s:t])
                    keep = dots + rp[i, t] * rq[j, t] >= threshold - SLACK
                    i, j, dots = i[keep], j[keep], dots[keep]
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                m, n = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                good = np.einsum("ij,ij->i", x[m], y[n]) / np.sqrt(np.einsum("ij,ij->i", x[m], x[m]) * np.einsum("ij,ij->i", y[n], y[n])) >= threshold
                one.append(m[good])
                two.append(n[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *two])


def local_roots(n: int, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n nodes, the node of the least rank that links (i, j) reach."""
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    low, a, b = np.arange(n), place[i], place[j]
    while True:
        after = low.copy()
        np.minimum.at(after, a, low[b])
        np.minimum.at(after, b, low[a])
        after = after[after]
        if (after == low).all():
            return order[low[place]]
        low = after


def _links(axes: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in textbuf.grouped(batches, lambda b: b.column("cell").to_numpy()):
            cell, ids, side, weight = (table.column(k).to_numpy() for k in ("cell", "vec_id", "side", "weight"))
            cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(lo, hi - lo)
                d = part.column("dim")[0].as_py()
                x = textbuf.binary_rows(part.column("x"), float, d)
                left, right = np.flatnonzero(side[lo:hi] < 2), np.flatnonzero(side[lo:hi] > 0)
                same = bool((side[lo:hi] == 1).any())
                i, j = linked_blocks(x[left], x[right], axes[d], threshold, same)
                i, j = left[i], right[j]
                n, own, w = hi - lo, ids[lo:hi], weight[lo:hi]
                links = np.bincount(i, w[j], n) + np.bincount(j, w[i], n)
                root = local_roots(n, i, j, own)
                hit = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array(np.rint(links[hit]).astype(np.int64)), pa.array(own[root[hit]])], ["vec_id", "links", "hub"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``.

    Two vectors link if their labels are equal and not null, their lengths are equal and their
    cosine in double precision is ``threshold`` or more. Null or zero vectors, and those with null
    or non-finite components, link with nothing. Rows with equal ids count as vectors of their
    own. component_id is the smallest id that links reach, the row's own included; a null id has
    a null component and is not kept. Other columns are not looked at. Spark jobs run when this is called.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = scratch.keep(given.mapInArrow(_vectors, VECTORS), "vectors")
    usable = rows.where("same is not null and vec_id is not null")
    reps = scratch.keep(usable.groupBy("label", "dim", "same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.any_value("x").alias("x")), "reps")
    axes = principal_axes(reps)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    led = reps.select("vec_id", "label", "dim", "weight", "x")
    led = led.mapInArrow(_leading(axes), "vec_id long, label long, dim int, weight long, x binary, lead double")
    led = led.repartitionByRange(n, "label", "dim", "lead", "vec_id").sortWithinPartitions("label", "dim", "lead", "vec_id")
    tiled = led.withColumn("part", F.spark_partition_id()).mapInArrow(_tiles, "vec_id long, label long, dim int, weight long, x binary, lead double, part int, tile long")
    tiled = scratch.keep(tiled.withColumn("tile", F.col("part") * F.lit(1 << 32) + F.col("tile")).drop("part"), "tiled")
    ranges = tiled.groupBy("label", "dim", "tile").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    other = ranges.select("label", "dim", F.col("tile").alias("two"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    cells = ranges.withColumnRenamed("tile", "one").join(other, ["label", "dim"]).where((F.col("one") <= F.col("two")) & (F.col("lo2") <= F.col("hi") + reach) & (F.col("lo") <= F.col("hi2") + reach))
    cells = cells.select("one", "two").withColumn("side", F.explode(F.when(F.col("one") == F.col("two"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))))
    cells = cells.select(F.when(F.col("side") == 2, F.col("two")).otherwise(F.col("one")).alias("tile"), "side", F.xxhash64("one", "two").alias("cell"))
    dealt = tiled.select("vec_id", "dim", "weight", "x", "tile").join(cells, "tile").select("cell", "side", "vec_id", "dim", "weight", "x")
    dealt = dealt.repartition(n, "cell").sortWithinPartitions("cell", "side", "vec_id")
    found = scratch.keep(dealt.mapInArrow(_links(axes, threshold), "vec_id long, links long, hub long"), "found")
    scratch.drop(tiled)
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = connected_components(scratch, found.select(F.col("vec_id").alias("a"), F.col("hub").alias("b")))
    known = reps.select("label", "dim", "same", "vec_id", "weight").join(counts, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    known = known.select("label", "dim", "same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = rows.select("vec_id", "label", "dim", F.when(F.col("vec_id").isNotNull(), F.col("same")).alias("same")).join(known, ["label", "dim", "same"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
