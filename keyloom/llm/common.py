"""Helpers shared by the operators: staged tables, Arrow text blocks, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are worked on at once; bounds the memory of numpy steps.
BLOCK_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder for staged tables: spark.checkpoint.dir, or a new temporary one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts lineage: later work doesn't depend on executors that held shuffle
    files. Shuffle files of the job are released and the table is deleted when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, parts: int, of) -> F.Column:
    """crc32 of a column's text, modulo parts, compared with `of`."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == of, F.lit(False))


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is null) of a string or binary Arrow array, without copies of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string()).cast(wide) if pa.types.is_string(column.type) else column.cast(wide)
    n = len(column)
    null = column.is_null().to_numpy(zero_copy_only=False)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if null.any():  # a null may have bytes beneath
        sizes = np.where(null, 0, np.diff(offsets))
        if sizes.sum() != offsets[-1] - offsets[0]:
            keep = [raw[a : a + s] for a, s in zip(offsets[:-1], sizes, strict=True)]
            return np.concatenate(keep), np.concatenate([[0], np.cumsum(sizes)]), null
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], null


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to `limit` bytes; a longer row is a range by itself."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def pair64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of 64-bit names."""
    return mix64((a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(29)) | (b >> np.uint64(35))))


_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2**61, 2**63)) * 2 + 1
_POWERS = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers modulo 2^64 of an odd number, and of its inverse."""
    if _POWERS["n"] < n:
        n = max(n, BLOCK_BYTES + BLOCK_BYTES // 8)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, np.uint64(base % 2**64))
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words of a block of texts: maximal runs of bytes for which `is_word` is true.

    `text` holds the texts with one separator byte after each. Word i is
    text[start[i]:end[i]]; those of row r are first[r]..first[r+1]-1. `hash`
    has a 64-bit name of each word, to select candidates by: other words may have it too.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold_case: bool = False):
        sizes = np.diff(offsets)
        n = int(sizes.sum()) + len(sizes)
        inside = np.ones(n, bool)
        ends = np.cumsum(sizes + 1) - 1
        inside[ends] = False
        text = np.full(n, 0x20, np.uint8)
        text[inside] = raw[offsets[0] : offsets[-1]]
        if fold_case:
            text = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
        self.text = text
        mask = is_word[text]
        mask[ends] = False
        flips = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
        self.start, self.end = flips[0::2], flips[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)

    @cached_property
    def hash(self) -> np.ndarray:
        n = len(self.text)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.text] * up[:n], dtype=np.uint64, out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def line(self) -> np.ndarray:
        """The words, with one space after each."""
        mark = np.zeros(len(self.text) + 2, np.int8)
        mark[self.start] += 1
        mark[self.end + 1] -= 1
        text = self.text.copy()
        text[self.end] = 0x20
        return text[np.cumsum(mark, dtype=np.int8)[: len(text)] > 0]

    def __len__(self) -> int:
        return len(self.start)


def byte_class(allowed) -> np.ndarray:
    """A table of 256 truth values."""
    table = np.zeros(256, bool)
    table[list(allowed)] = True
    return table


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, both of which hold for bytes as for code points.
NOT_SPACE = byte_class(set(range(256)) - {0x20, 9, 10, 11, 12, 13})
ALNUM = byte_class({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})


def _word_ends(raw: np.ndarray, is_word: np.ndarray, at: int, n: int) -> tuple[int, int]:
    """(where the n-th word that ends after `at` ends, or the end of the text; how many ended)."""
    found, step = 0, 1 << 16
    while at < len(raw):
        part = is_word[raw[at : at + step + 1]]
        ends = np.flatnonzero(part[:-1] & ~part[1:]) + 1
        if found + len(ends) >= n:
            return at + int(ends[n - found - 1]), n
        found += len(ends)
        if at + step >= len(raw) - 1:
            return len(raw), found + int(is_word[raw[-1]])
        at += step
    return len(raw), found


def word_pieces(raw: np.ndarray, is_word: np.ndarray, shared: int, limit: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, words before it) of pieces of a text of about `limit` bytes, each with the first `shared` words of what follows. No word is cut."""
    a, before = 0, 0
    while a < len(raw):
        end, _ = _word_ends(raw, is_word, min(len(raw), a + limit), 1)
        stop, _ = _word_ends(raw, is_word, end, shared) if shared else (end, 0)
        yield a, stop, before
        before += _word_ends(raw[:end], is_word, a, len(raw))[1]
        a = end


def windows_hash(names: np.ndarray, length: int) -> np.ndarray:
    """Names of all runs of `length` consecutive names, by doubling: a run is named by its two (overlapping) halves."""
    size, out = 1, names
    while size < length:
        step = min(size, length - size)
        if len(out) <= step:
            return np.zeros(0, np.uint64)
        out = pair64(out[: len(out) - step], out[step:])
        size += step
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    size, out = 1, values
    while size < width:
        step = min(size, width - size)
        if len(out) <= step:
            return values[:0]
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


def slices(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes raw[a[i]:b[i]] end to end, and their offsets."""
    size = b - a
    offsets = np.concatenate([[0], np.cumsum(size)])
    return raw[np.arange(int(offsets[-1])) + np.repeat(a - offsets[:-1], size)], offsets


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of consecutive slices of values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list array; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def discard(df: DataFrame) -> None:
    """Delete a table that stage() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
