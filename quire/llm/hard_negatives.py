"""Hard negatives of anchor vectors, by exact search over a pivot table.

Components are scaled and floored to whole numbers, so scores (inner products) are exact. With M the largest norm, a vector x
is augmented to (x, sqrt(M^2 - |x|^2)) and an anchor q to (q, 0): then |q - x|^2 = |q|^2 + M^2 - 2 score, and the larger the
inner product, the smaller the Euclidean distance. The pivot table holds each augmented vector's distances to a few pivots.
By the triangle inequality they bracket a distance, and so a score:

    |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p)

Rows are sorted by label, nearest pivot and the distance to it, and cut into tiles, anchors into blocks. A block meets a
tile only if the brackets of their smallest and largest distances allow a score that some anchor still needs; within
it, pairs whose own brackets rule them out are left out, and the survivors' scores are computed. A block's tiles are dealt
to groups of some ``RUN`` tiles, the nearest first, which stream with the best rows so far and return only these.

Positives are searched for first (same label); each of them gives a range of scores in which the negatives (other labels) lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import embed_dedup, textbuf
from quire.llm.scratch import Scratch

PIVOTS, SAMPLE, RUN, STRIP = 12, 1024, 16, 256
LARGEST = 2.0**52  # of squared norms: below it, sums of products are exact in double precision
FOUND = "a long, slot int, id long, score long"
TABLE = [f"d{k}" for k in range(PIVOTS)]
VECTORS = ["vec_id", "label", "dim", "x", "norm"]
PLACED = "vec_id long, label long, dim int, x binary, norm double, " + ", ".join(f"{c} double" for c in TABLE) + ", home int, near double"


def _scaled(scale: float):
    """Vectors as whole numbers; those with null or non-finite components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dim = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(pc.fill_null(pc.list_flatten(lists), np.nan).to_numpy() * scale) + 0.0
                sums = np.concatenate([[0], np.cumsum(dim)])
                norm = np.array([x @ x for x in (flat[a:b] for a, b in zip(sums[:-1], sums[1:], strict=True))])
            good = np.flatnonzero(np.isfinite(norm) & (norm <= LARGEST) & (dim > 0)) if len(dim) else []
            raw = flat.tobytes()
            x = pa.array([raw[8 * sums[k] : 8 * sums[k + 1]] for k in good], pa.binary())
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(dim, pa.int32()).take(at), x, pa.array(norm, pa.float64()).take(at)], ["vec_id", "label", "dim", "x", "norm"])

    return run


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))[:, None]], 1)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of x, each the farthest from those before; rows repeat if x has fewer."""
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def fit_pivots(rows: DataFrame, top: float) -> dict[int, np.ndarray]:
    """For each length of vectors in a sample of ``SAMPLE`` rows (the least by hash), its pivots."""
    sample = rows.select("dim", "x").orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(bytes(r.x))
    return {d: farthest_first(augmented(np.stack([np.frombuffer(x) for x in xs]), top), PIVOTS) for d, xs in by_dim.items()}


def _table(pivots: dict[int, np.ndarray], top: float, asked: bool = False):
    """Rows with their distances to the pivots (of anchors, if ``asked``), the nearest pivot and its distance. A length that no
    sampled row has takes points of the axes: any pivots give true brackets."""

    def of(d: int) -> np.ndarray:
        if d not in pivots:
            pivots[d] = np.eye(d + 1)[np.arange(PIVOTS) % (d + 1)] * np.sqrt(top)
        return pivots[d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(), np.zeros((batch.num_rows, PIVOTS))
            for d in np.unique(dims):
                x = textbuf.binary_rows(batch.column("x").filter(pa.array(dims == d)), float, int(d))
                out[dims == d] = distances(np.pad(x, ((0, 0), (0, 1))) if asked else augmented(x, top), of(int(d)))
            near = out.min(1) if len(out) else np.zeros(0)
            home = out.argmin(1).astype(np.int32) if len(out) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in VECTORS), *(pa.array(out[:, k]) for k in range(PIVOTS)), pa.array(home), pa.array(near)], [*VECTORS, *TABLE, "home", "near"])

    return run


class Best:
    """The ``k`` best rows so far of each request: an anchor and a range of scores."""

    def __init__(self, part: pa.Table, k: int, top: float, others: bool):
        self.k, self.top, self.others = k, top, others
        self.a, self.ids = part.column("a").to_numpy(), part.column("id").to_numpy()
        self.x = textbuf.binary_rows(part.column("x"), float, part.column("dim")[0].as_py())
        self.table = np.stack([part.column(c).to_numpy() for c in TABLE], 1)
        self.norm = (self.x * self.x).sum(1)
        self.label = part.column("label")[0].as_py()
        lo, hi = (part.column(c).combine_chunks() for c in ("lo", "hi"))
        self.anchor = np.repeat(np.arange(len(self.a)), pc.list_value_length(lo).to_numpy())
        self.slot = np.arange(len(self.anchor)) - np.searchsorted(self.anchor, self.anchor)
        self.lo, self.hi = (pc.list_flatten(c).to_numpy() for c in (lo, hi))
        self.least = self.lo.copy()  # what a row has to score, for each request
        none = np.zeros(0, np.int64)
        self.rows = (none, none, none)  # request, score, id

    def meet(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        for at in range(0, len(self.a), STRIP):
            strip = np.arange(at, min(at + STRIP, len(self.a)))
            requests = np.flatnonzero((self.anchor >= at) & (self.anchor < at + STRIP))
            need, most = np.full(len(strip), np.inf), np.full(len(strip), -np.inf)
            np.minimum.at(need, self.anchor[requests] - at, self.least[requests])
            np.maximum.at(most, self.anchor[requests] - at, self.hi[requests])
            i, j = self._survivors(strip, need, most, table)
            if not len(i):
                continue
            if len(i) * 16 > len(strip) * len(x):
                score = np.full((len(strip), len(x)), np.iinfo(np.int64).min)
                score[i, j] = (self.x[strip] @ x.T)[i, j].astype(np.int64)
            else:
                score = np.full((len(strip), len(x)), np.iinfo(np.int64).min)
                for lo in range(0, len(i), 1 << 16):
                    m, n = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                    score[m, n] = np.einsum("ij,ij->i", self.x[strip[m]], x[n]).astype(np.int64)
            if self.others:
                score[self.ids[strip][:, None] == ids] = np.iinfo(np.int64).min
            self._add(requests, score, self.anchor[requests] - at, ids)

    def _survivors(self, strip: np.ndarray, need: np.ndarray, most: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose brackets reach from ``need`` to ``most``."""
        both, slack = self.norm[strip] + self.top, 1e-6 * (1 + self.top) ** 0.5
        reach = np.sqrt(np.maximum(0, both - 2 * need)) + slack
        inside = np.sqrt(np.maximum(0, both - 2 * most)) - slack
        alive = np.ones((len(strip), len(table)), bool)
        for k in range(PIVOTS):
            q, d = self.table[strip, k][:, None], table[:, k]
            alive &= np.abs(q - d) <= reach[:, None]
            if k in (0, PIVOTS - 1) and not alive.any():
                break
            alive &= q + d >= inside[:, None]
        return np.nonzero(alive)

    def _add(self, requests: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        s = score[row]
        good = (s >= self.least[requests][:, None]) & (s <= self.hi[requests][:, None]) & (s > np.iinfo(np.int64).min)
        many = np.flatnonzero(good.sum(1) > self.k)
        if len(many):
            low = np.where(good[many], s[many], np.iinfo(np.int64).min)
            good[many] &= s[many] >= np.partition(low, -self.k, axis=1)[:, -self.k][:, None]
        r, j = np.nonzero(good)
        if not len(r):
            return
        req, sc, own = (np.concatenate(both) for both in zip(self.rows, (requests[r], s[r, j], ids[j]), strict=True))
        order = np.lexsort((own, -sc, req))
        req, sc, own = req[order], sc[order], own[order]
        place = np.arange(len(req)) - np.searchsorted(req, req)
        self.rows = tuple(c[place < self.k] for c in (req, sc, own))
        full = place == self.k - 1
        self.least[req[full]] = np.maximum(self.lo[req[full]], sc[full])

    def batch(self) -> pa.RecordBatch:
        req, sc, own = self.rows
        return pa.RecordBatch.from_arrays([pa.array(self.a[self.anchor[req]]), pa.array(self.slot[req].astype(np.int32)), pa.array(own), pa.array(sc)], ["a", "slot", "id", "score"])


def _search(k: int, top: float, others: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, None
        for table in textbuf.grouped(batches, lambda b: b.column("cell").to_numpy()):
            cell, grp, side = (table.column(c).to_numpy() for c in ("cell", "grp", "side"))
            cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(lo, hi - lo)
                if grp[lo] != now and best is not None:
                    yield best.batch()
                    best = None
                now = grp[lo]
                if side[lo] == 0:
                    best = Best(part, k, top, others)
                elif best is not None:
                    best.meet(part.column("id").to_numpy(), textbuf.binary_rows(part.column("x"), float, part.column("dim")[0].as_py()), np.stack([part.column(c).to_numpy() for c in TABLE], 1))
        if best is not None:
            yield best.batch()

    return run


def _found(anchors: DataFrame, rows: DataFrame, cells: DataFrame, k: int, top: float, others: bool) -> DataFrame:
    """The ``k`` best rows of each request of the anchors, of the tiles that ``cells`` (block, tile, grp, bound) name.

    A group is a block's anchors and then its tiles, the nearest first.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = F.array().cast("array<long>")
    columns = ["grp", "side", "bound", "tile", "a", "id", "label", "dim", "x", *TABLE, "lo", "hi"]
    given = anchors.join(cells.select("block", "grp").distinct(), "block").withColumns({"side": F.lit(0), "bound": F.lit(-1.0), "tile": F.lit(-1).cast("long")}).select(columns)
    met = rows.join(cells.select("tile", "grp", "bound"), "tile").withColumns({"side": F.lit(1), "a": F.lit(-1).cast("long"), "lo": empty, "hi": empty, "id": F.col("vec_id")}).select(columns)
    dealt = given.union(met).withColumn("cell", F.xxhash64("grp", "side", "tile")).repartition(n, "grp").sortWithinPartitions("grp", "side", "bound", "tile")
    mine = W.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    return dealt.mapInArrow(_search(k, top, others), FOUND).withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)


def _cells(anchors: DataFrame, rows: DataFrame, top: float, same: bool, parts: int, tiles: int) -> DataFrame:
    """(block, tile, grp, bound) of the blocks and tiles whose brackets allow a score that an anchor of the block needs.

    ``same``: of one label, or else of two. Tiles are dealt to buckets and blocks go to each bucket, so that no key of the join is hot.
    """
    ends = [f(c).alias(f"{c}_{w}") for c in TABLE for w, f in (("lo", F.min), ("hi", F.max))]
    need = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + top - 2 * F.array_min("lo").cast("double")))
    blocks = anchors.groupBy("block", F.col("label").alias("own"), "dim").agg(F.max(need).alias("reach"), *(f(c).alias(f"q_{c}_{w}") for c in TABLE for w, f in (("lo", F.min), ("hi", F.max))))
    blocks = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    bucket = F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int")
    summary = rows.groupBy("tile", "label", "dim").agg(*ends).withColumn("bucket", bucket)
    bound = F.greatest(F.lit(0.0), *(F.greatest(F.col(f"{c}_lo") - F.col(f"q_{c}_hi"), F.col(f"q_{c}_lo") - F.col(f"{c}_hi")) for c in TABLE))
    if same:
        met = blocks.withColumn("label", F.col("own")).join(summary, ["label", "dim", "bucket"])
    else:
        met = blocks.join(summary, ["dim", "bucket"]).where(F.col("own") != F.col("label"))
    met = met.withColumn("bound", bound).where(F.col("bound") <= F.col("reach") + 1e-6 * (1 + top) ** 0.5)
    salt = F.pmod(F.xxhash64("tile", F.lit(1)), F.lit(-(-tiles // RUN)))
    return met.select("block", "tile", F.xxhash64("block", salt).alias("grp"), "bound")


def mine_negatives(
    vectors: DataFrame, anchor: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which ``anchor`` (over ``vec_id``) is true.

    A vector's components become floor(``scale`` * x); a score is the inner product with the anchor, the higher scores
    come first, ties by the smaller id. An anchor's positives are its first rows of the same label, and for each of them
    the first rows of other labels follow that satisfy percent[0] * p <= 100 * s <= percent[1] * p, p being the positive's score.

    Rows with a null id, label or vector, without components, or with null or non-finite ones take no part, and none of which the
    squared norm exceeds 2^52 after scaling (its scores would not be exact). Vectors of different lengths have no score.
    Rows of the anchor's own id are not its positives or negatives; other rows that repeat count each; anchors that are alike in id,
    label and vector are one. Other columns are not looked at. Spark jobs run when this is called.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and label is not null and v is not null")
    rows = scratch.keep(given.mapInArrow(_scaled(scale), "vec_id long, label long, dim int, x binary, norm double"), "vectors")
    top = rows.agg(F.max("norm")).first()[0] or 0.0
    pivots = fit_pivots(rows, top)
    table = rows.mapInArrow(_table(pivots, top), PLACED)
    place = ["label", "dim", "home", "near", "vec_id"]
    tiled = _numbered(scratch, table.repartitionByRange(n, *place).sortWithinPartitions(*place), "tile")
    scratch.drop(rows)
    tiles = max(1, tiled.select("tile").distinct().count())

    chosen = F.expr(anchor) if isinstance(anchor, str) else anchor
    own_tile = tiled.where(chosen).groupBy(*VECTORS).agg(F.min("tile").alias("own_tile"))
    first = own_tile.select(VECTORS).mapInArrow(_table(pivots, top, True), PLACED)
    blocked = _numbered(scratch, first.repartitionByRange(max(1, n // 4), *place).sortWithinPartitions(*place), "block")
    blocked = blocked.join(own_tile, VECTORS)
    least, most = -(1 << 53), 1 << 53
    whole = {"lo": F.array(F.lit(least).cast("long")), "hi": F.array(F.lit(most).cast("long"))}
    anchors = scratch.keep(blocked.withColumnRenamed("vec_id", "id").withColumn("a", F.monotonically_increasing_id()).withColumns(whole), "anchors")

    # what an anchor's own tile holds bounds the scores of its positives from below
    own = anchors.select(F.col("own_tile").alias("block")).distinct().select("block", F.col("block").alias("tile"), F.col("block").alias("grp"), F.lit(0.0).alias("bound"))
    seeds = _found(anchors.withColumn("block", F.col("own_tile")), tiled, own, positives, top, True)
    seeds = seeds.where(F.col("rank") == positives).select("a", F.array("score").alias("seed"))
    seeded = scratch.keep(anchors.join(seeds, "a", "left").withColumn("lo", F.coalesce("seed", "lo")).drop("seed"), "seeded")
    near = _found(seeded, tiled, _cells(seeded, tiled, top, True, n, tiles), positives, top, True)
    near = scratch.keep(near.select("a", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # the whole numbers s with percent[0] * p <= 100 * s <= percent[1] * p
    p = F.col("positive_score")
    ranges = near.withColumns({"low": F.expr(f"-((-{percent[0]} * positive_score - pmod(-{percent[0]} * positive_score, 100)) div 100)"), "high": F.expr(f"({percent[1]} * positive_score - pmod({percent[1]} * positive_score, 100)) div 100")})
    ranges = ranges.where(F.col("low") <= F.col("high")).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", p, "low", "high"))).alias("asked"))
    asked = anchors.drop("lo", "hi").join(ranges, "a").withColumns({"lo": F.col("asked.low"), "hi": F.col("asked.high")})
    asked = scratch.keep(asked, "asked")
    far = _found(asked.drop("asked"), tiled, _cells(asked, tiled, top, False, n, tiles), negatives, top, True)
    named = far.join(asked.select("a", F.col("id").alias("anchor_id"), "asked"), "a").withColumn("to", F.get("asked", F.col("slot")))
    return named.select("anchor_id", "to.positive_id", "rank", F.col("id").alias("negative_id"), "to.positive_score", F.col("score").alias("negative_score"))


def _numbered(scratch: Scratch, ordered: DataFrame, name: str) -> DataFrame:
    """A kept table of sorted partitions, cut into numbered runs of bounded size of one label and length."""
    schema = ", ".join(f"{c} {kind}" for c, kind in ordered.dtypes) + ", part int, tile long"
    out = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(embed_dedup._tiles, schema)
    return scratch.keep(out.withColumn(name, F.col("part") * F.lit(1 << 32) + F.col("tile")).select(*ordered.columns, name), name)
