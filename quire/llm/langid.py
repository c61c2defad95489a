"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a binary classifier over hashed byte n-grams
learns whether a text's language has it. Decoding weighs each bit by its classifier's loss and takes the
language whose codeword loses least; the shares of exp(-loss) are the score, and a text whose best
share is low is marked as ambiguous. Up to five languages take the exhaustive code, in which all
codewords differ in half of the bits; more languages take the best of many random codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textbuf

SIZE = 1 << 13
LETTER = regex.compile(r"\p{L}")


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of bits as -1 and 1; no two rows are equal, and no bit is the same for all rows (if k > 1)."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        bits = np.arange(2 ** (k - 1) - 1)
        return np.array([[1 if r == 0 or (b >> (r - 1)) & 1 else -1 for b in bits] for r in range(k)], float)
    rng, width = np.random.default_rng(seed), max(15, 4 * int(np.ceil(np.log2(k))))
    best, least = None, -1
    for _ in range(2000):
        code = rng.choice([-1.0, 1.0], (k, width))
        near = min((code[a] != code[b]).sum() for a in range(k) for b in range(a))
        if near > least and (np.abs(code.sum(0)) < k).all():
            best, least = code, near
    return best


def ngrams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (below SIZE) of the bytes' 2-grams and 3-grams from each place on; A-Z are lower-cased, digits are alike."""
    low = textbuf.LOWER[buf].astype(np.uint32)
    low[(low >= 48) & (low < 58)] = 48
    two = low[:-1] * np.uint32(257) + low[1:]
    three = two[:-1] * np.uint32(65599) + low[2:]
    fold = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int32)
    return fold(two), fold(three + np.uint32(77))


def features(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    if len(buf) < 3:
        buf = np.frombuffer((text + "   ").encode(), np.uint8)
    two, three = ngrams(buf)
    return np.bincount(np.concatenate([two, three]), minlength=SIZE) / (len(two) + len(three))


class Model:
    """Languages, their codewords, and for each n-gram and bit a weight."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.code, self.weights, self.bias = langs, code, weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], steps: int = 250, rate: float = 0.05, decay: float = 1e-4) -> Model:
        """Logistic regressions, one a bit, by Adam on the texts' n-gram shares (one row of ``x`` each)."""
        names = sorted(set(langs))
        code = codewords(len(names))
        if len(names) < 2:
            return cls(names, code, np.zeros((SIZE, code.shape[1]), np.float32), np.zeros(code.shape[1]))
        x = np.multiply(x, 100, dtype=np.float32)
        which = np.array([names.index(v) for v in langs])
        share = np.bincount(which, minlength=len(names))
        y, weight = code[which].astype(np.float32), (len(which) / len(names) / share[which]).astype(np.float32)[:, None]
        w, b = np.zeros((SIZE, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        for t in range(1, steps + 1):
            g = -weight * y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
            gw, gb = x.T @ g + decay * w, g.sum(0)
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            step = rate / (1 - 0.9**t)
            w -= step * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= step * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        return cls(names, code, (w * 100).astype(np.float32), b.astype(float))

    def bits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's margin for each bit."""
        n, total = len(offsets) - 1, np.diff(offsets)
        out = np.zeros((n, self.code.shape[1]))
        full = np.flatnonzero(total >= 3)
        if len(full) and len(buf) >= 3:
            two, three = ngrams(buf)
            for grams, width in ((two, 2), (three, 3)):
                sums = self._sums(grams, offsets[full], offsets[full + 1] - width + 1)
                out[full] += sums
            out[full] /= (2 * total[full] - 3)[:, None]
        for k in np.flatnonzero(total < 3):
            out[k] = features(buf[offsets[k] : offsets[k + 1]].tobytes().decode()) @ self.weights
        return out + self.bias

    def _sums(self, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), self.weights.shape[1]))
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            out[k] = np.bincount(grams[a:b], minlength=SIZE) @ self.weights if b - a > 4096 else self.weights[grams[a:b]].sum(0, dtype=np.float64)
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language (its number) that loses least, and its share; 0 and no share without languages."""
        if not self.langs:
            return np.zeros(len(margins), np.int64), np.zeros(len(margins))
        loss = np.log1p(np.exp(np.clip(-margins[:, None, :] * self.code[None], -50, 50))).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        return best, share[np.arange(len(best)), best]


def _predicted(shared, ambiguous: float):
    """Adds predictions to the columns before the last, which is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            *given, text = batch.columns
            for lo, hi, buf, offsets in textbuf.slices(text):
                best, share = model.decode(model.bits(buf, offsets))
                lettered = [bool(t and LETTER.search(t)) for t in text.slice(lo, hi - lo).to_pylist()]
                lang = [model.langs[b] if ok and model.langs else "und" for b, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, share, 0.0)
                yield textbuf.batch(*(c.slice(lo, hi - lo) for c in given), pa.array(lang, pa.string()), pa.array(score), pa.array(score < ambiguous))

    return run


def held_out(id_col: str = "doc_id"):
    """True for a fifth of the ids, by checksum; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of the last column's texts that occur, and their shares."""
    for batch in batches:
        *given, text = batch.columns
        for lo in range(batch.num_rows):
            share = features(text[lo].as_py() or "")
            at = np.flatnonzero(share)
            yield textbuf.batch(*(c.slice(lo, 1) for c in given), textbuf.pack_rows(at.astype(np.int16)[None]), textbuf.pack_rows(share[at].astype(np.float32)[None]))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 2000) -> Model:
    """A model learnt from at most ``sample`` whole texts: those with the least id hashes among rows that
    have a text and a language and are not held out. Only as many ids are broadcast, and what reaches the driver is at
    most SIZE numbers for each text, however long it is. Spark jobs run when this is called."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ids = rows.select("h").distinct().orderBy("h").limit(sample)
    picked = textbuf.with_columns(rows.join(F.broadcast(ids), "h", "left_semi"), "text", _shares, {"at": "binary", "share": "binary"}).select("h", "lang", "at", "share").limit(sample).collect()
    picked.sort(key=lambda r: (r["h"], r["lang"], bytes(r["at"]), bytes(r["share"])))
    x = np.zeros((len(picked), SIZE), np.float32)
    for row, r in zip(x, picked, strict=True):  # bytes and no lists of numbers, which take ten times the memory
        row[np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["share"], np.float32)
    return Model.fit(x, [r["lang"] for r in picked])


def identify(docs: DataFrame, model: Model, text_col: str = "text", ambiguous: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and ambiguous.

    Null texts and those without a letter are ``und`` with score 0 (so is each text if the model has no
    language); ``ambiguous`` marks scores below the given one. Rows with null or repeated ids are rows like
    others; a column that is named like a new one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE rows of one number a bit
    return textbuf.with_columns(docs, text_col, _predicted(shared, ambiguous), {"lang_pred": "string", "score": "double", "ambiguous": "boolean"})
