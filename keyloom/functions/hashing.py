"""32-bit string hashes and what is derived from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of the stores whose data are read.
SALT_HASH = 194965049  # string_hash("salt_thread_safe")
SKETCH_CELLS = 1 << 24

_MASK = 0xFFFFFFFF


def signed(word: Column) -> Column:
    """A 32-bit word as a signed number."""
    return F.when(word >= 1 << 31, word - F.lit(1 << 32)).otherwise(word)


def string_hash(text: Column) -> Column:
    """s[0]*31^(n-1) + ... + s[n-1] over UTF-16 units, as a signed 32-bit number in a bigint; null for null."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))  # of the characters; 0 for the empty text

    def step(a: Column, c: Column) -> Column:
        high, low = F.shiftright(c - 0x10000, 10) + 0xD800, (c - 0x10000).bitwiseAND(0x3FF) + 0xDC00  # two units beyond the basic plane
        return F.when(c < 0x10000, a * 31 + c).otherwise((a * 31 + high).bitwiseAND(_MASK) * 31 + low).bitwiseAND(_MASK)

    word = F.aggregate(points, F.lit(0).cast("long"), step)
    return F.when(text.isNotNull(), signed(word))


def salted_hash(h: Column) -> Column:
    """The second hash: that of the pair of a string (of hash h) and the salt."""
    return signed((F.lit(961) + h * 31 + SALT_HASH).bitwiseAND(_MASK))


def bloom_positions(h: Column, m: Column, k: Column) -> Column:
    """The k bit positions of a string of hash h in a filter of m bits."""
    h2 = salted_hash(h)
    return F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: (h + i * h2).bitwiseAND(0x7FFFFFFFFFFFFFFF) % m)


def segment_id(h: Column, segments: int) -> Column:
    """The segment of a string of hash h among a power of two."""
    word = h.bitwiseAND(_MASK)
    return word.bitwiseXOR(F.shiftright(word, 16)).bitwiseAND(segments - 1)


def sketch_cells(h: Column, cells: int = SKETCH_CELLS) -> Column:
    """The two cells of the frequency sketch; the same cell may come twice."""
    word = h.bitwiseAND(_MASK)
    return F.array(word.bitwiseAND(cells - 1), F.shiftright(word, 16).bitwiseAND(cells - 1))
