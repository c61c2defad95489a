"""Quality classifier: a generalised additive model with pairwise interactions.

A text has a few features. Each is cut into bins at its quantiles; boosting goes round the features,
and each time a shallow tree on one feature's bins is fitted to the gradient and added to that
feature's lookup table. Then the pairs of features that still explain most get tables of their
own, by trees that cut both. A score is the sum of the looked-up values, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbuf
from quire.llm.langid import held_out

FEATURES = ("n_words", "word_mean", "word_sd", "upper", "digit", "stop_mark", "odd_mark", "bang_mark", "space", "newline", "wide", "distinct", "top_share", "same_as_before", "pair_repeat", "line_repeat", "upper_words", "odd_words", "bang_words", "line_words")
BINS, COARSE = 32, 8
_CLASS = np.zeros(256, np.uint8)  # 1 upper case, 2 digit, 3 stop mark, 4 odd mark, 5 shout, 6 space, 7 newline, 8 beyond ASCII
_CLASS[33:127] = 4
for _bytes, _number in ((range(65, 91), 1), (range(97, 123), 0), (range(48, 58), 2), (b".,;:'\"()-", 3), (b"!?", 5), (b" \t", 6), (b"\n\r", 7), (range(128, 256), 8)):
    _CLASS[list(_bytes)] = _number
_LINE_END = np.zeros(256, bool)
_LINE_END[[10, 13]] = True


def _per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n) if len(doc) else np.zeros(n)


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each text has, and how often its most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    a, b = h[order], doc[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(n)
    np.maximum.at(most, b[at], np.diff(np.append(at, len(a))))
    return np.bincount(b[at], minlength=n).astype(float), most


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text; shares are 0 where there is nothing to share."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[buf]
    counts = np.bincount(doc_of * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
    bytes_ = np.maximum(size, 1)
    starts, ends, doc = textbuf.words(buf, offsets, textbuf.SPACE)
    length = (ends - starts).astype(float)
    words = _per_text(np.ones(len(doc)), doc, n)
    some = np.maximum(words, 1)
    mean = _per_text(length, doc, n) / some
    sd = np.sqrt(np.maximum(0, _per_text(length * length, doc, n) / some - mean * mean))
    h = textbuf.word_hashes(textbuf.LOWER[buf], starts, ends)
    distinct, top = _distinct(h, doc, n)
    together = np.zeros(len(h), bool)
    together[1:] = doc[1:] == doc[:-1]
    same = together.copy()
    same[1:] &= h[1:] == h[:-1]
    pair = textbuf.mix(h[1:] * np.uint64(3) + h[:-1])[together[1:]]
    pair_doc = doc[1:][together[1:]]
    pairs, _ = _distinct(pair, pair_doc, n)
    beside = _per_text(np.ones(len(pair_doc)), pair_doc, n)
    line_start, line_end, line_doc = textbuf.words(buf, offsets, _LINE_END)
    lines = _per_text(np.ones(len(line_doc)), line_doc, n)
    distinct_lines, _ = _distinct(textbuf.word_hashes(buf, line_start, line_end), line_doc, n)
    last = kind[ends - 1] if len(ends) else kind[:0]
    big = (kind[starts] == 1) & (length > 1) if len(starts) else np.zeros(0, bool)
    second = kind[np.minimum(starts + 1, max(0, len(kind) - 1))] if len(starts) else kind[:0]
    columns = (
        np.log1p(words), mean, sd, *(counts[:, k] / bytes_ for k in (1, 2, 3, 4, 5, 6, 7, 8)),
        distinct / np.sqrt(some), top / some, _per_text(same, doc, n) / some, np.where(beside > 0, 1 - pairs / np.maximum(1, beside), 0),
        np.where(lines > 0, 1 - distinct_lines / np.maximum(lines, 1), 0), _per_text(big & (second == 1), doc, n) / some, _per_text(last == 4, doc, n) / some, _per_text(last == 5, doc, n) / some, words / np.maximum(lines, 1),
    )
    return np.stack(columns, 1)


def _tree(g: np.ndarray, c: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Leaf values of a small tree on ordered bins, from their sums of gradients and of curvatures."""
    cuts = [0, len(g)]
    gs, cs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(c)])
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (cs[b] - cs[a] + 1.0)
    for _ in range(leaves - 1):
        best = max(((worth(a, m) + worth(m, b) - worth(a, b), m) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for m in range(a + 1, b) if cs[m] - cs[a] >= least and cs[b] - cs[m] >= least), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (gs[b] - gs[a]) / (cs[b] - cs[a] + 1.0)
    return out


def _pair_tree(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that cuts a pair's table once each way: four leaves, and what it gains."""
    gs, cs = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, c))
    best = (0.0, None)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            corner = lambda t, i=i, j=j: np.array([[t[i, j], t[i, -1] - t[i, j]], [t[-1, j] - t[i, j], t[-1, -1] - t[i, -1] - t[-1, j] + t[i, j]]])
            a, b = corner(gs), corner(cs)
            gain = float((a * a / (b + 1)).sum())
            if gain > best[0]:
                best = (gain, (i, j, a / (b + 1)))
    out = np.zeros_like(g)
    if best[1]:
        i, j, v = best[1]
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v[0, 0], v[0, 1], v[1, 0], v[1, 1]
    return out, best[0]


class Model:
    """Cut points and lookup tables of features and of pairs of features."""

    def __init__(self, cuts: list[np.ndarray], base: float):
        self.cuts, self.base = cuts, base
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1)

    def coarse(self, bins: np.ndarray, k: int) -> np.ndarray:
        return bins[:, k] * COARSE // (len(self.cuts[k]) + 1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k, table in enumerate(self.tables):
            out += table[bins[:, k]]
        for (a, b), table in self.pairs.items():
            out += table[self.coarse(bins, a), self.coarse(bins, b)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, n_pairs: int = 6, pair_rounds: int = 40) -> Model:
        """Without rows of both labels, each text scores the one label's share (0.5 without rows)."""
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        if not len(y) or y.min() == y.max():
            return cls([np.zeros(0)] * x.shape[1], float(np.log(share / (1 - share))))
        model = cls([np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])], float(np.log(share / (1 - share))))
        bins, least = model.bins(x), max(2.0, 0.0002 * len(y))
        raw = model.raw(bins)
        slopes = lambda: (y - (p := 1 / (1 + np.exp(-raw))), p * (1 - p))
        for _ in range(rounds):
            for k, table in enumerate(model.tables):
                g, c = slopes()
                step = rate * _tree(np.bincount(bins[:, k], g, len(table)), np.bincount(bins[:, k], c, len(table)), 3, least)
                table += step
                raw += step[bins[:, k]]
        small = [model.coarse(bins, k) for k in range(x.shape[1])]
        cell = lambda a, b, v: np.bincount(small[a] * COARSE + small[b], v, COARSE * COARSE).reshape(COARSE, COARSE)
        g, c = slopes()
        gains = sorted(((_pair_tree(cell(a, b, g), cell(a, b, c))[1], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
        for _, a, b in gains[:n_pairs]:
            model.pairs[a, b] = np.zeros((COARSE, COARSE))
        for _ in range(pair_rounds):
            for (a, b), table in model.pairs.items():
                g, c = slopes()
                step = rate * _pair_tree(cell(a, b, g), cell(a, b, c))[0]
                table += step
                raw += step[small[a], small[b]]
        return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *given, text = batch.columns
        for lo, hi, buf, offsets in textbuf.slices(text):
            yield textbuf.batch(*(c.slice(lo, hi - lo) for c in given), textbuf.pack_rows(features(buf, offsets)))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *given, text = batch.columns
            for lo, hi, buf, offsets in textbuf.slices(text):
                yield textbuf.batch(*(c.slice(lo, hi - lo) for c in given), pa.array(shared.value.score(features(buf, offsets))))

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20000) -> Model:
    """A model learnt from the whole texts of at most ``sample`` labelled rows that are not held out.

    They are the labels with the least id hashes; only those ids are broadcast, and what reaches the
    driver is ``sample`` times the features. Labels other than 0 and 1 and null ids are passed over.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("id", "y", "text")
    rows = textbuf.with_columns(rows, "text", _measured, {"x": "binary"}).select("id", "y", "x").limit(sample).collect()
    rows.sort(key=lambda r: (r["id"], r["y"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), float).reshape(len(rows), len(FEATURES))
    return Model.fit(x, np.array([r["y"] for r in rows], float))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1, higher: label 1 likelier), by vectorised bin additions.

    Empty and null texts are scored like others; null and repeated ids are kept; a column named score is replaced.
    """
    return textbuf.with_columns(docs, text_col, _scored(docs.sparkSession.sparkContext.broadcast(model)), {"score": "double"})
