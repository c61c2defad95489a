"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where both agree.

A huge text is encoded in chunks that overlap, with the offsets of their tokens. Two neighbours are
spliced at a place inside the overlap that is a token boundary in both and is proven to be one in
the whole text: a space after a character that is none. For no piece of the vocabulary has a space
after another character (checked when it is loaded), so no merge can ever go over such a place.
If an overlap has no such place, it is widened, and at last the chunks are encoded as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
DIRECT, CHUNK, OVERLAP = 16384, 8192, 256


class Counter:
    def __init__(self, model: bytes, direct: int = DIRECT, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.direct, self.chunk, self.overlap = direct, chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splices = not any(MARK in piece.lstrip(MARK) for piece in pieces)

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The byte offset at which each token begins, and the offsets that are proven boundaries."""
        begins = np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        raw = np.frombuffer(text.replace(MARK, "   ").encode(), np.uint8)  # as many bytes; a literal mark counts as space
        return begins, np.flatnonzero((raw[1:] == 32) & (raw[:-1] != 32)) + 1

    def huge(self, text: str) -> int:
        """The number of tokens of a text, chunk by chunk."""
        lo, hi, total, taken = 0, min(len(text), self.chunk), 0, 0  # chunk text[lo:hi]; its first ``taken`` tokens are counted
        begins, proven = self._encoded(text[lo:hi])
        while hi < len(text):
            overlap = self.overlap
            while True:
                if overlap >= hi - lo:  # no splice anywhere: the chunk grows instead
                    hi = min(len(text), hi + (hi - lo))
                    kept = begins[taken] if taken < len(begins) else None
                    begins, proven = self._encoded(text[lo:hi])
                    taken = int(np.searchsorted(begins, kept)) if kept is not None and taken else 0
                    break
                start = hi - overlap
                end = min(len(text), start + max(self.chunk, 2 * overlap))
                after, sure = self._encoded(text[start:end])
                shift = len(text[lo:start].encode())
                common = np.intersect1d(np.intersect1d(begins, proven), np.intersect1d(after, sure) + shift)
                common = common[common >= (begins[taken] if taken < len(begins) else 0)]
                if len(common):
                    cut = common[len(common) // 2]
                    total += int(np.searchsorted(begins, cut)) - taken
                    lo, hi, begins, proven, taken = start, end, after, sure, int(np.searchsorted(after, cut - shift))
                    break
                overlap *= 2
        return total + len(begins) - taken

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= self.direct or not self.splices]
        for k, ids in zip(short, self.model.encode([texts[k] for k in short], num_threads=1), strict=True):
            out[k] = len(ids)
        for k in set(range(len(texts))).difference(short):
            out[k] = self.huge(texts[k])
        return out


_loaded: dict[str, Counter] = {}


def _counts(model, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded.get(digest) or _loaded.setdefault(digest, Counter(model.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = pc.fill_null(part.column(1), "").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row, as the model counts the whole text without added tokens.

    ``model_path`` is a file on the driver whose content is broadcast; a model has a megabyte or so. Null texts count as empty and
    have no tokens; null and repeated ids are kept; other columns are not looked at.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counts(docs.sparkSession.sparkContext.broadcast(data), sha256(data).hexdigest()), "doc_id long, n_bytes long, n_tokens long")
