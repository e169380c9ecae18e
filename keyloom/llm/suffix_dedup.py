"""Suffix-array dedup by bucket-pointer refinement.

Places of the corpus are put into buckets by a q-gram of bytes; a bucket in one
document alone is settled. The others are refined: places are sorted by the
number of their bucket and that of the bucket at a later offset, the numbers
that come of it are the input of the next round (8, 16, 32, 50 bytes), and what
lies in one document alone leaves. The array is sparse: of the q-grams of a
window only that of the smallest name opens a bucket across the corpus, with
the text around it, and the rounds run within such a bucket (repeats.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import _BYTE, BLOCK_BYTES, mix64, powers
from .repeats import Stream, Units, remove

#: Bytes of the q-grams that open a bucket across the corpus.
BASE = 20


class Bytes(Units):
    """Bytes as units; the first symbols are 8 bytes as a number."""

    start = 8

    def stream(self, raw: np.ndarray, offsets: np.ndarray, named: bool = True) -> Stream:
        grams = np.full(len(raw) if named else 0, np.uint64(1))
        n = max(0, len(grams) - self.base + 1)
        if n:
            up, down = powers(len(raw) + 1)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
            grams[:n] = mix64((sums[self.base :] - sums[:n]) * down[:n])
        return Stream(offsets - offsets[0], grams, raw, None, 0, (raw, offsets - offsets[0]))

    def symbols(self, s: Stream) -> np.ndarray:
        padded = np.concatenate([s.line, np.zeros(16, np.uint8)])
        out = np.zeros(len(s.line) + 8, np.uint64)
        for k in range(8):
            n = (len(padded) - k) // 8
            out[k : k + 8 * n : 8] = padded[k : k + 8 * n].view(">u8")[: len(out[k : k + 8 * n : 8])]
        return out[: len(s.line)] >> np.uint64(8 * (8 - self.start))

    def pieces(self, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for a in range(0, len(raw), self.block):
            yield a, min(len(raw), a + self.block + self.window - 1), a

    def whole(self, raw: np.ndarray, offsets: np.ndarray) -> object:
        return raw, offsets

    def write(self, own: object, gone: np.ndarray, null: np.ndarray) -> list[pa.Array]:
        """Kept bytes, bytes, bytes removed, runs removed."""
        raw, first = own
        total = np.concatenate([[0], np.cumsum(gone)])
        n_bytes = np.diff(first)
        removed = total[first[1:]] - total[first[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = first[:-1][n_bytes > 0]
        begins[heads] = gone[heads]  # a run ends with its row
        spans = np.concatenate([[0], np.cumsum(begins)])
        offsets = np.concatenate([[0], np.cumsum(n_bytes - removed)]).astype(np.int32)
        kept = pa.BinaryArray.from_buffers(pa.binary(), len(n_bytes), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gone])])
        return [kept, pa.array(n_bytes), pa.array(removed), pa.array(spans[first[1:]] - spans[first[:-1]])]


def suffix_dedup(docs: DataFrame, length: int = 50, text: str = "text", columns: list[str] | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """Remove bytes that stand in a string of `length` bytes which also starts in a document of smaller doc_id.

    Texts are taken as UTF-8 bytes; matches never cross documents; overlaps
    count; strings are judged on the input. Adds kept (binary: what stays,
    which may cut a character), n_bytes, n_removed and n_spans (long: maximal
    removed runs) to the given columns of docs (None:
    all); existing columns of these names are replaced.

    Null texts count as empty. Rows with a null doc_id lose nothing and make no
    other lose bytes. Rows of the same doc_id aren't compared with each other.
    Of copies, the smallest doc_id alone keeps the text. Long texts are worked
    on in pieces of `block` bytes, with the same result. An empty table gives an empty table.
    """
    if length < 2:
        raise ValueError("a string has two bytes or more")
    long = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    return remove(docs, Bytes(length, BASE, block), [T.StructField("kept", T.BinaryType()), *long], text, columns)
