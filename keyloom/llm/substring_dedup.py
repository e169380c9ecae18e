"""Substring dedup by level-wise doubling.

Windows of words that repeat at one length alone are extended to (up to) twice
that length, until the wanted length is reached or no candidate is left. The
first level across the corpus are grams of 7 words, of which each window is
followed through one; those that two documents have bring the text around them
together, and there the levels are 1, 2, 4, 8 and 13 words (repeats.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BLOCK_BYTES, NOT_SPACE, Words, windows_hash, word_pieces
from .repeats import Stream, Units, remove

#: Words of the grams that are looked up across the corpus.
BASE = 7


class WordUnits(Units):
    """Words as units; the first symbols are the words' numbers in a dictionary."""

    start = 1

    def stream(self, raw: np.ndarray, offsets: np.ndarray, named: bool = True) -> Stream:
        words = Words(raw, offsets, NOT_SPACE)
        grams = np.full(len(words), np.uint64(1))
        if named:
            made = windows_hash(words.hash, self.base)
            grams[: len(made)] = made
        begin = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
        return Stream(words.first, grams, words.line(), begin, 1, words)

    def symbols(self, s: Stream) -> np.ndarray:
        if not len(s.begin) - 1:
            return np.zeros(0, np.uint64)
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s.begin) - 1, [None, pa.py_buffer(np.ascontiguousarray(s.begin, np.int64)), pa.py_buffer(s.line)])
        return each.dictionary_encode().indices.to_numpy().astype(np.uint64)

    def pieces(self, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        return word_pieces(raw, NOT_SPACE, self.window - 1, self.block)

    def whole(self, raw: np.ndarray, offsets: np.ndarray) -> object:
        return Words(raw, offsets, NOT_SPACE)

    def write(self, own: object, gone: np.ndarray, null: np.ndarray) -> list[pa.Array]:
        """Kept words joined by one space, words, words removed."""
        words: Words = own
        keep = np.flatnonzero(~gone[: len(words)])
        text, mark = words.text.copy(), np.zeros(len(words.text) + 2, np.int8)
        text[words.end[keep]] = 0x20  # after each word is a byte that isn't one's
        mark[words.start[keep]] += 1
        mark[words.end[keep] + 1] -= 1
        mask = np.cumsum(mark, dtype=np.int8)[: len(text)] > 0
        row = np.searchsorted(words.first, keep, side="right") - 1
        last = np.flatnonzero(np.diff(np.append(row, -1)))  # the last kept word of each row
        mask[words.end[keep[last]]] = False
        sizes = np.zeros(len(words.first) - 1, np.int64)
        np.add.at(sizes, row, words.end[keep] - words.start[keep] + 1)
        sizes[row[last]] -= 1
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        kept = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(text[mask]))
        n_words = np.diff(words.first)
        total = np.concatenate([[0], np.cumsum(gone[: len(words)])])
        return [kept, pa.array(n_words), pa.array(total[words.first[1:]] - total[words.first[:-1]])]


def substring_dedup(docs: DataFrame, window: int = 13, text: str = "text", columns: list[str] | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """Remove words that stand in a window of `window` words which also starts in a document of smaller doc_id.

    Words are runs of bytes other than space and 09-0D. Windows are judged on
    the input. Adds kept (string: the words that stay, joined by one space),
    n_words and n_removed (long) to the given columns of docs (None: all);
    existing columns of these names are replaced.

    Null or empty texts have no words and an empty kept. Rows with a null
    doc_id lose nothing and make no other lose words. Rows of the same doc_id
    aren't compared with each other. Of copies, the smallest doc_id alone keeps
    the words. Long texts are worked on in pieces of `block` bytes, with the same result, but a
    word is never cut. An empty table gives an empty table.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    outputs = [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return remove(docs, WordUnits(window, BASE, block), outputs, text, columns)
