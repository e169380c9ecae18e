"""Windows of L units that also start in a document with a smaller id.

The engine of the two repeat removers. A unit is a word or a byte; `Units`
says how texts are cut into them, all else is shared:

1. Buckets. A window is followed through one of its grams of `base` units, the
   one of the smallest name. Equal windows have equal grams, so a window whose
   bucket of grams lies in one document alone is settled. Neighbouring windows
   mostly share their gram: about 2/(L-base+2) rows a unit are sent, not one.
2. Stretches. Neighbouring windows of one live bucket (up to 63) form a
   stretch, which carries its text to the bucket's group.
3. Refinement (refine()). In a group, places are put into buckets by their
   first symbols, and each round sorts pairs of buckets, that of a place and
   that of a later offset, so the length doubles until it is L. Whatever lies in
   one document alone is left out of the next round. Nothing is hashed here.

A bucket of over GROUP stretches isn't gathered: its stretches are first
reduced to one for each text, then their windows meet in a pre-aggregated
min() by 128-bit names (XXH3). Both ways give the same result.

Names of grams only select candidates. No positions are shuffled: what is found
returns by doc_id with the stretch's name, and places are found again from the
text. Texts of over a block's bytes are worked on in overlapping pieces. The way
back is an equi-join, of which a hot key's partition can be split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, blocks, discard, list_parts, pair64, slices, sliding_min, stage, text_parts

#: Stretches of a bucket that meet in one group, at most; windows of a stretch, at most (bits of a mask); stretches that are refined at once.
GROUP, STRETCH, AT_ONCE = 4096, 63, 1 << 13


@dataclass
class Stream:
    """The units of a block of rows, end to end. Those of row r are first[r]..first[r+1]-1.

    grams: names of the base-size grams at each place (those across rows mean
    nothing). line: the units' text; a unit starts at begin[i] and the run
    a..b-1 ends at begin[b] - gap, or at its own number where begin is None. own:
    what the caller needs for its output.
    """

    first: np.ndarray
    grams: np.ndarray
    line: np.ndarray
    begin: np.ndarray | None
    gap: int
    own: object

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the line the runs a..b-1 lie."""
        return (a, b) if self.begin is None else (self.begin[a], self.begin[b] - self.gap)

    def names(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """128-bit names of the texts of the runs a..b-1, as rows of two numbers."""
        text, digest = self.line.tobytes(), xxhash.xxh3_128_digest
        lo, hi = self.span(a, b)
        return np.frombuffer(b"".join([digest(text[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]), np.int64).reshape(-1, 2)

    def rows(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


class Units:
    """How texts are cut into units, for windows of `window` and grams of `base` units."""

    #: Units of a first symbol of the refinement.
    start = 1

    def __init__(self, window: int, base: int, block: int = BLOCK_BYTES):
        self.window, self.base, self.block = window, min(base, window), block
        self.start = min(self.start, window)

    def stream(self, raw: np.ndarray, offsets: np.ndarray, named: bool = True) -> Stream:
        """The units of rows; without names of grams if not `named`."""
        raise NotImplementedError

    def symbols(self, s: Stream) -> np.ndarray:
        """The first `start` units from each place, as numbers that are equal for equal units and for no others."""
        raise NotImplementedError

    def pieces(self, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, units before it) of pieces of a text, that share window - 1 units: each window is in one piece."""
        raise NotImplementedError

    def whole(self, raw: np.ndarray, offsets: np.ndarray) -> object:
        """`own` of rows of any size."""
        raise NotImplementedError

    def write(self, own: object, gone: np.ndarray, null: np.ndarray) -> list[pa.Array]:
        """Output columns, given which units are removed."""
        raise NotImplementedError


def doubled(start: int, window: int) -> list[int]:
    """Lengths of the rounds, each at most twice the one before: 1, 2, 4, 8, 13 or 8, 16, 32, 50."""
    sizes = [min(start, window)]
    while sizes[-1] < window:
        sizes.append(min(2 * sizes[-1], window))
    return sizes


def _offsets(sizes: list[int]) -> list[np.ndarray]:
    """For each round, the offsets in a window whose buckets are needed: those of a round are made of two of the one before."""
    need = [np.zeros(1, np.int64)]
    for size, to in zip(sizes[-2::-1], sizes[:0:-1], strict=True):
        need.append(np.unique(np.concatenate([need[-1], need[-1] + to - size])))
    return need[::-1]


def _changes(sorted_: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return new


def refine(symbols: np.ndarray, sizes: list[int], places: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which of the places start a window that several documents have, the smallest of them).

    symbols: exact numbers of the first sizes[0] units at each place; lo, hi:
    the smallest and largest document that has what is at a place. In a round,
    a place's bucket is that of its own bucket and of the one at a later
    offset, both of the round before; buckets are numbered in order by sorting.
    A window with a bucket that one document alone has is left out of later
    rounds; there are none once no window is left. `rounds` gets (length,
    windows left) of each.
    """
    live, lowest, bucket = np.arange(len(places)), lo[:0], symbols
    for k, offsets in enumerate(_offsets(sizes)):
        if not len(live):
            break
        start, wanted = places[live], np.zeros(len(symbols), bool)
        for o in offsets:
            wanted[start + o] = True
        at = np.flatnonzero(wanted)
        value = (bucket[at].astype(np.uint64) << np.uint64(32)) | bucket[at + (sizes[k] - sizes[k - 1])] if k else bucket[at]
        order = np.argsort(value)
        heads, at = np.flatnonzero(_changes(value[order])), at[order]
        lowest = np.minimum.reduceat(lo[at], heads)
        # numbers from 1 in order; 0 is what one document alone has
        number = np.where(lowest < np.maximum.reduceat(hi[at], heads), np.arange(1, len(heads) + 1), 0).astype(np.uint32)
        bucket = np.zeros(len(symbols), np.uint32)
        bucket[at] = np.repeat(number, np.diff(np.append(heads, len(at))))
        shared = np.ones(len(live), bool)
        for o in offsets:
            shared &= bucket[start + o] > 0
        live = live[shared]
        if rounds is not None:
            rounds.append((sizes[k], len(live)))
    return live, lowest[bucket[places[live]].astype(np.int64) - 1] if len(live) else lo[:0]


def _valid(s: Stream, window: int) -> np.ndarray:
    """Whether a window starts at each place."""
    out = np.ones(int(s.first[-1]), bool)
    for k in range(min(window - 1, len(out))):
        ends = s.first[1:] - 1 - k
        out[ends[ends >= s.first[:-1]]] = False
    return out


def _stretches(units: Units, s: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, start, end, row) of the stretches: neighbouring windows of one smallest gram; the end is that of the last window."""
    live = _valid(s, units.window)
    gram = np.zeros(len(live), np.uint64)
    low = sliding_min(s.grams, units.window - units.base + 1)[: len(gram)]
    gram[: len(low)] = low
    new = live.copy()
    new[1:] &= ~(live[:-1] & (gram[1:] == gram[:-1]))
    stop = live & np.append(new[1:] | ~live[1:], True)[: len(live)]
    start, last = np.flatnonzero(new), np.flatnonzero(stop)
    parts = (last - start) // STRETCH + 1
    if len(parts) and parts.max() > 1:
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start, last = np.repeat(start, parts) + k * STRETCH, np.repeat(last, parts)
        last = np.minimum(last, start + STRETCH - 1)
    return gram[start], start, last + units.window, s.rows(start)


def _among(names: np.ndarray, rows: np.ndarray, listed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each name is in its row's list."""
    if not len(listed) or not len(names):
        return np.zeros(len(names), bool)
    pool = np.unique(pair64(listed.view(np.uint64), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.uint64)))
    own = pair64(names.view(np.uint64), rows.astype(np.uint64))
    at = np.minimum(np.searchsorted(pool, own), len(pool) - 1)
    return pool[at] == own


def _parts_of(units: Units, batch: pa.RecordBatch, lists: list[str]) -> Iterator:
    """For each block of rows, or piece of a long row, of a batch: rows a..b-1, units before it, its stream, the lists' parts."""
    raw, offsets, _ = text_parts(batch.column("__text"))
    parts = [list_parts(batch.column(x)) for x in lists]
    for a, b in blocks(offsets, units.block):
        cut = [(v[o[a] : o[b]], o[a : b + 1] - o[a]) for v, o in parts]
        text = raw[offsets[a] : offsets[b]]
        if len(text) <= units.block:
            yield a, b, 0, units.stream(text, offsets[a : b + 1] - offsets[a]), cut
        else:
            for lo, hi, before in units.pieces(text):
                yield a, b, before, units.stream(text[lo:hi], np.array([0, hi - lo])), cut


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in columns.values()], names=list(columns))


def _gram_rows(units: Units):
    """Rows (gram, doc_id, n): the grams that a block has windows of, with the number of its stretches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, _, _, s, _ in _parts_of(units, batch, []):
                gram, _, _, row = _stretches(units, s)
                pairs = pair64(gram, row.astype(np.uint64))
                order = np.argsort(pairs)
                heads = np.flatnonzero(_changes(pairs[order]))
                one = order[heads]
                yield _batch({"gram": gram[one], "doc_id": ids[a + row[one]].astype(np.int64), "n": np.diff(np.append(heads, len(order)))})

    return rows


def _stretch_rows(units: Units, column: str, named: bool):
    """The stretches of the grams listed in a column, each text once a block: (gram, doc_id, part), and the names h1, h2 if `named`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, _, _, s, cuts in _parts_of(units, batch, [column]):
                gram, start, end, row = _stretches(units, s)
                live = _among(gram, row, *cuts[0])
                gram, start, end, row = gram[live], start[live], end[live], row[live]
                h1, h2 = s.names(start, end).T
                _, one = np.unique(pair64(h1.view(np.uint64), row.astype(np.uint64)), return_index=True)
                raw, offsets = slices(s.line, *s.span(start[one], end[one]))
                part = pa.BinaryArray.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
                made = _batch({"gram": gram[one], "doc_id": ids[a + row[one]].astype(np.int64)} | ({"h1": h1[one], "h2": h2[one]} if named else {}))
                yield pa.RecordBatch.from_arrays([*made.columns, part], names=[*made.schema.names, "part"])

    return rows


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups, some at a time, of rows that come sorted by gram."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < AT_ONCE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.flatnonzero(_changes(table.column("gram").to_numpy()))
        last = int(new[-1])  # the last group may go on
        if last:
            yield table.slice(0, last)
        held, size = table.slice(last).to_batches(), size - last
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _refined(units: Units):
    """Rows (doc_id, gram, h1, mask) of stretches with windows that a smaller document has."""
    sizes = doubled(units.start, units.window)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            doc = chunk.column("doc_id").to_numpy()
            ids, number = np.unique(doc, return_inverse=True)
            number = number.astype(np.int32)
            each = chunk.column("part").combine_chunks().dictionary_encode()  # each text once, with its first and last document
            of = each.indices.to_numpy()
            lo, hi = np.full(len(each.dictionary), len(ids), np.int32), np.full(len(each.dictionary), -1, np.int32)
            np.minimum.at(lo, of, number)
            np.maximum.at(hi, of, number)
            raw, offsets, _ = text_parts(each.dictionary)
            s = units.stream(raw, offsets, named=False)
            places, sized = np.flatnonzero(_valid(s, units.window)), np.diff(s.first)
            live, lowest = refine(units.symbols(s), sizes, places, np.repeat(lo, sized), np.repeat(hi, sized))
            part = s.rows(places[live])
            hit = lo[part] > lowest
            part, k = part[hit], (places[live] - s.first[part])[hit]
            mask = np.zeros(len(lo), np.int64)
            np.bitwise_or.at(mask, part, np.int64(1) << k)
            name = s.names(s.first[:-1], s.first[1:])[:, 0]
            mask = np.where(number > lo[of], np.int64(2**63 - 1), mask[of])  # a later document has all windows of the text from the first one
            some = np.flatnonzero(mask)
            yield _batch({"doc_id": doc[some], "gram": chunk.column("gram").to_numpy()[some], "h1": name[of[some]], "mask": mask[some]})

    return rows


def _window_rows(units: Units):
    """Rows (name, doc_id, stretch, number) of the windows of stretches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(a, AT_ONCE)
                raw, offsets, _ = text_parts(some.column("part"))
                s = units.stream(raw, offsets, named=False)
                places = np.flatnonzero(_valid(s, units.window))
                part = s.rows(places)
                names = s.names(places, places + units.window)
                yield _batch({"w1": names[:, 0].copy(), "w2": names[:, 1].copy()} | {n: some.column(n).to_numpy()[part] for n in ("gram", "doc_id", "h1")} | {"k": places - s.first[part]})

    return rows


def _among_many(units: Units, rows: DataFrame) -> DataFrame:
    """As _refined, for buckets of any number of stretches."""
    names = ["gram", "h1", "h2"]
    firsts = rows.groupBy(*names).agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("hi"), F.first("part").alias("part"))
    firsts = stage(firsts, "firsts")
    # joins are with staged tables, not with aggregates, so that a hot key's partition can be split
    again = rows.select(*names, "doc_id").join(firsts.where("doc_id < hi").select(*names, F.col("doc_id").alias("lo")), names)
    again = again.where("doc_id > lo").select("doc_id", "gram", "h1", F.lit(2**63 - 1).alias("mask"))
    windows = firsts.select("gram", "h1", "doc_id", "part").mapInArrow(_window_rows(units), "w1 long, w2 long, gram long, doc_id long, h1 long, k long")
    windows = stage(windows, "windows")
    lowest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    hits = windows.join(stage(lowest, "lowest"), ["w1", "w2"]).where("doc_id > lo")
    hits = hits.groupBy("doc_id", "gram", "h1").agg(F.expr("bit_or(shiftleft(1L, cast(k as int)))").alias("mask"))
    return again.union(hits)


def find(docs: DataFrame, units: Units, text: str = "text") -> DataFrame:
    """Staged lists by doc_id (grams, names, masks) of the stretches with windows that a smaller document has."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("__text")).where("doc_id is not null and __text is not null")
    grams = stage(texts.mapInArrow(_gram_rows(units), "gram long, doc_id long, n long"), "grams")
    shared = grams.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.sum("n") > GROUP).alias("many")).where("lo < hi").drop("hi")
    # a join with a staged table, so that a hot gram's partition can be split
    shared = stage(shared, "shared")
    live = grams.join(shared, "gram")
    live = stage(live.groupBy("doc_id").agg(*[F.collect_set(F.when(c, F.col("gram"))).alias(n) for n, c in (("few", ~F.col("many")), ("many", F.col("many")))]), "live")
    for table in (grams, shared):
        discard(table)

    def stretches(column: str, named: bool) -> DataFrame:
        kind = "gram long, doc_id long, h1 long, h2 long, part binary" if named else "gram long, doc_id long, part binary"
        return texts.join(live.select("doc_id", column).where(F.size(column) > 0), "doc_id").mapInArrow(_stretch_rows(units, column, named), kind)

    # each text of a stretch is shuffled once and isn't staged
    found = "doc_id long, gram long, h1 long, mask long"
    few = stage(stretches("few", False).repartition("gram").sortWithinPartitions("gram").mapInArrow(_refined(units), found), "few")
    rows = stage(stretches("many", True), "stretches")
    hits = few.union(_among_many(units, rows))
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "h1", "mask")).alias("x"))
    hits = stage(hits.select("doc_id", F.col("x.gram").alias("grams"), F.col("x.h1").alias("names"), F.col("x.mask").alias("masks")), "hits")
    for table in (few, rows, live):
        discard(table)
    return hits


def _inside(n: int, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Places p < n with a <= p < e for one of the runs."""
    return np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(e, minlength=n + 1))[:n] > 0


def _marked(units: Units, s: Stream, cuts) -> np.ndarray:
    """Whether each unit is removed."""
    gone = np.zeros(int(s.first[-1]), bool)
    (grams, offsets), (names, _), (masks, _) = cuts
    if not len(grams):
        return gone
    gram, start, end, row = _stretches(units, s)
    some = _among(gram, row, grams, offsets)
    start, end, row = start[some], end[some], row[some]
    pool = pair64(names.view(np.uint64), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.uint64))
    order = np.argsort(pool)
    pool, masks = pool[order], masks[order]
    new = np.flatnonzero(_changes(pool))
    pool, masks = pool[new], np.bitwise_or.reduceat(masks, new)
    own = pair64(s.names(start, end)[:, 0].copy().view(np.uint64), row.astype(np.uint64))
    at = np.minimum(np.searchsorted(pool, own), len(pool) - 1)
    hit = pool[at] == own
    start, size, mask = start[hit], (end - units.window + 1 - start)[hit], masks[at[hit]]
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    places = (np.repeat(start, size) + k)[(np.repeat(mask, size) >> k) & 1 == 1]
    return _inside(len(gone), places, places + units.window) if len(places) else gone


def remove(docs: DataFrame, units: Units, outputs: list[T.StructField], text: str, columns: list[str] | None) -> DataFrame:
    """The given columns of docs (None: all) with the columns `outputs`, which units.write() makes.

    Where names clash, the outputs win. Rows with
    a null doc_id neither lose text nor make others lose it. Rows of one doc_id
    aren't compared with each other.
    """
    hits = find(docs, units, text)
    kept = [f for f in docs.schema.fields if f.name not in {o.name for o in outputs} and (columns is None or f.name in columns)]
    names = ["__text" if f.name == text else f"c{i}" for i, f in enumerate(kept)]
    own = docs.select(*[F.col(f.name).alias(n) for n, f in zip(names, kept, strict=True) if n != "__text"], F.col(text).alias("__text"), F.col("doc_id").cast("long").alias("__id"))
    listed = ["__grams", "__names", "__masks"]
    own = own.join(hits.toDF("__id", *listed), "__id", "left")
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kept, strict=True)] + [T.StructField(f"o{i}", o.dataType) for i, o in enumerate(outputs)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column("__text").is_null().to_numpy(zero_copy_only=False)
            raw, offsets, _ = text_parts(batch.column("__text"))
            long: list[tuple[int, np.ndarray]] = []  # marks of the pieces of a long text
            parts = _parts_of(units, batch, listed)
            part = next(parts, None)
            while part is not None:
                a, b, before, s, cuts = part
                gone, part = _marked(units, s, cuts), next(parts, None)
                if offsets[b] - offsets[a] > units.block:
                    long.append((before, gone))
                    if part is not None and part[0] == a:
                        continue
                    whole = np.zeros(max(at + len(g) for at, g in long), bool)
                    for at, g in long:
                        whole[at : at + len(g)] |= g
                    long, made = [], units.write(units.whole(raw[offsets[a] : offsets[b]], np.array([0, offsets[b] - offsets[a]])), whole, null[a:b])
                else:
                    made = units.write(s.own, gone, null[a:b])
                arrays = [batch.column(n).slice(a, b - a) for n in names] + made
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(f"o{i}" for i in range(len(outputs)))])

    out = own.mapInArrow(rows, schema)
    back = [F.col(n).alias(f.name) for n, f in zip(names, kept, strict=True)] + [F.col(f"o{i}").alias(o.name) for i, o in enumerate(outputs)]
    return out.select(*back)
