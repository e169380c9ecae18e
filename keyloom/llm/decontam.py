"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Where the benchmark's texts are within `broadcast_bytes`, their windows are
broadcast and the training texts are scanned once, without a shuffle. Beyond
it, a bitmap of fixed size of the windows' names is broadcast instead, and only
windows of texts that it lets through meet those of the benchmark, in an
equi-join on their words. Names select candidates; words decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ALNUM, BLOCK_BYTES, Words, blocks, list_parts, slices, stage, text_parts, windows_hash, word_pieces

#: Bits of the bitmap (a power of two), 16 MB.
BITS = 1 << 27
_ANY_CASE = ALNUM | np.isin(np.arange(256), np.arange(65, 91))


class _Runs:
    """The words of a block, and its runs."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.words = Words(raw, offsets, ALNUM, fold_case=True)
        self.line = self.words.line()
        self.begin = np.concatenate([[0], np.cumsum(self.words.end - self.words.start + 1)])

    def names(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, names) of all runs of `length` words within a row."""
        w = self.words
        last = np.repeat(w.first[1:], np.diff(w.first))
        places = np.flatnonzero(np.arange(len(w)) + length <= last)
        return places, windows_hash(w.hash, length)[places]

    def rows(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.first, places, side="right") - 1

    def run(self, place: int, length: int) -> bytes:
        """The words of a run, with a space after each."""
        return self.line[self.begin[place] : self.begin[place + length]].tobytes()

    def runs(self, places: np.ndarray, length: int) -> pa.Array:
        raw, offsets = slices(self.line, self.begin[places], self.begin[places + length])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def _item_windows(runs: _Runs, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places, names, rows) of the windows of items, for each length."""
    sizes = np.diff(runs.words.first)
    for length in sorted({min(window, int(n)) for n in sizes if n}):
        places, names = runs.names(length)
        rows = runs.rows(places)
        own = np.minimum(sizes[rows], window) == length
        yield length, places[own], names[own], rows[own]


class _Lookup:
    """The windows of a bounded benchmark: its words once, and for each length the windows' names in order, with places and items."""

    def __init__(self, ids: list, texts: list[str], window: int):
        raw, offsets, _ = text_parts(pa.array(texts, pa.string()))
        self.ids, self.runs = ids, _Runs(raw, offsets)
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, places, names, rows in _item_windows(self.runs, window):
            order = np.argsort(names, kind="stable")
            self.of[length] = names[order], places[order], rows[order]
        self.known: dict[tuple[int, int], dict[bytes, set]] = {}

    def candidates(self, names: np.ndarray, length: int) -> np.ndarray:
        pool = self.of[length][0]
        return np.flatnonzero(pool[np.minimum(np.searchsorted(pool, names), len(pool) - 1)] == names)

    def items(self, name: int, length: int) -> dict[bytes, set]:
        """Items by the words of the windows of a name."""
        if (length, name) not in self.known:
            pool, places, rows = self.of[length]
            a, b = np.searchsorted(pool, np.uint64(name)), np.searchsorted(pool, np.uint64(name), side="right")
            found = self.known[length, name] = {}
            for p, r in zip(places[a:b].tolist(), rows[a:b].tolist(), strict=True):
                found.setdefault(self.runs.run(p, length), set()).add(self.ids[r])
        return self.known[length, name]


def _parts_of(batch: pa.RecordBatch, window: int, block: int) -> Iterator[tuple[int, int, int, _Runs]]:
    """Rows a..b-1 of a block, words before it, and its runs. A long row is several blocks that share window - 1 words."""
    raw, offsets, _ = text_parts(batch.column("__text"))
    for a, b in blocks(offsets, block):
        text = raw[offsets[a] : offsets[b]]
        if len(text) <= block:
            yield a, b, 0, _Runs(text, offsets[a : b + 1] - offsets[a])
        else:
            for lo, hi, before in word_pieces(text, _ANY_CASE, window - 1, block):
                yield a, b, before, _Runs(text[lo:hi], np.array([0, hi - lo]))


def _columns(docs: DataFrame, text: str, columns: list[str] | None, outputs: list[T.StructField]):
    kept = [f for f in docs.schema.fields if f.name not in {o.name for o in outputs} and (columns is None or f.name in columns)]
    return kept, ["__text" if f.name == text else f"c{i}" for i, f in enumerate(kept)]


def _outputs(item_type: T.DataType) -> list[T.StructField]:
    return [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(item_type)),
        T.StructField("cleaned", T.StringType()),
    ]


def _made(w: Words, hit: np.ndarray, items: list[list], text: np.ndarray, offsets: np.ndarray, null: np.ndarray, item_type: pa.DataType, spans: bool) -> list[pa.Array]:
    hit = hit[: len(w)]
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[w.first[1:]] - total[w.first[:-1]]
    cleaned: list = [None] * len(n_hit)
    if spans:
        for r in range(len(n_hit)):
            own = text[offsets[r] : offsets[r + 1]].tobytes()
            if n_hit[r]:
                base, out, at = int(offsets[r] - offsets[0]) + r, [], 0
                k, end = int(w.first[r]), int(w.first[r + 1])
                while k < end:
                    if hit[k]:
                        out.append(own[at : int(w.start[k]) - base])
                        while k + 1 < end and hit[k + 1]:
                            k += 1
                        at = int(w.end[k]) - base
                    k += 1
                own = b"".join(out) + own[at:]
            cleaned[r] = None if null[r] else own.decode()
    return [pa.array(np.diff(w.first)), pa.array(n_hit), pa.array(items, pa.list_(item_type)), pa.array(cleaned, pa.string())]


def _written(batch: pa.RecordBatch, window: int, block: int, judge, names: list[str], schema: list[str], item_type: pa.DataType, spans: bool) -> Iterator[pa.RecordBatch]:
    """Output of a batch; judge(runs, rows a..b-1, words before) gives which words of a part are hit, and the items of its rows."""
    raw, offsets, null = text_parts(batch.column("__text"))
    parts, long = _parts_of(batch, window, block), []
    part = next(parts, None)
    while part is not None:
        a, b, before, runs = part
        hit, items = judge(runs, a, b, before)
        part, w, cut = next(parts, None), runs.words, offsets[a : b + 1] - offsets[a]
        if cut[-1] > block:
            long.append((before, hit, items[0]))
            if part is not None and part[0] == a:
                continue
            w = Words(raw[offsets[a] : offsets[b]], cut, ALNUM, fold_case=True)
            hit, items, parts_ = np.zeros(len(w), bool), [set().union(*(x for _, _, x in long))], long
            for at, h, _ in parts_:
                hit[at : at + len(h)] |= h
            long = []
        made = _made(w, hit, [sorted(x) for x in items], raw[offsets[a] : offsets[b]], cut, null[a:b], item_type, spans)
        yield pa.RecordBatch.from_arrays([batch.column(n).slice(a, b - a) for n in names] + made, names=schema)


def _mark(hit: np.ndarray, places: np.ndarray, length: int) -> None:
    steps = np.zeros(len(hit) + 1, np.int32)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + length, -1)
    hit |= np.cumsum(steps)[:-1] > 0


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    threshold: int = 20,
    action: str = "flag",
    text: str = "text",
    columns: list[str] | None = None,
    broadcast_bytes: int = 1 << 22,
    block: int = BLOCK_BYTES,
) -> DataFrame:
    """Find words of docs that stand in a window of a benchmark item.

    A-Z are lower-cased; words are runs of digits, letters a-z and characters
    from U+0080. A window is `window` consecutive words of an item; an item of
    fewer, but not none, is one window. To the given columns of docs (None:
    all) it adds n_words, n_hit (long: words in any occurrence of a window),
    items (array: ids of items that occur, distinct, in order), contaminated
    (n_hit > 0 and threshold * n_hit >= n_words) and, for action "spans",
    cleaned: the text without its runs of hit words. "documents" drops
    contaminated rows; "flag" only adds columns. Existing columns of these
    names are replaced.

    Texts of over `block` bytes are worked on in pieces, with the same result.
    Null and empty texts have no words. Items with a null id or text are
    ignored; items of the same id count once. Rows of docs are judged one by
    one, so null or repeated doc_ids change nothing. Empty tables are allowed.
    """
    if action not in ("flag", "spans", "documents"):
        raise ValueError(f"action is flag, spans or documents, not {action}")
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    # a lookup takes up to 13 bytes a byte of the texts: a window a word, of two bytes or more, and 24 bytes a window
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    item_type = benchmark.schema["item_id"].dataType
    outputs = _outputs(item_type)
    kept, names = _columns(docs, text, columns, outputs)
    own = docs.select(*[F.col(f.name).alias(n) for n, f in zip(names, kept, strict=True) if n != "__text"], F.col(text).alias("__text"))
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kept, strict=True)] + outputs)
    arrow_item = to_arrow_type(item_type)
    spans = action == "spans"
    find = _by_broadcast if size <= broadcast_bytes else _by_join
    out = find(own, items, window, schema, names, arrow_item, spans, block)
    out = out.select(*[F.col(n).alias(f.name) for n, f in zip(names, kept, strict=True)], *[o.name for o in outputs])
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * threshold >= F.col("n_words")))
    if not spans:
        out = out.drop("cleaned")
    return out.where("not contaminated") if action == "documents" else out


def _by_broadcast(own: DataFrame, items: DataFrame, window: int, schema: T.StructType, names: list[str], arrow_item: pa.DataType, spans: bool, block: int) -> DataFrame:
    rows = items.collect()  # bounded by broadcast_bytes
    shared = own.sparkSession.sparkContext.broadcast(_Lookup([r["item_id"] for r in rows], [r["text"] for r in rows], window))

    def judge(runs: _Runs, a: int, b: int, before: int) -> tuple[np.ndarray, list[set]]:
        lookup, hit, found = shared.value, np.zeros(len(runs.words), bool), [set() for _ in range(b - a)]
        for length in lookup.of:
            places, name = runs.names(length)
            may = lookup.candidates(name, length)
            places, name, sure = places[may], name[may], np.zeros(len(may), bool)
            for k, (p, h, r) in enumerate(zip(places.tolist(), name.tolist(), runs.rows(places).tolist(), strict=True)):
                ids = lookup.items(h, length).get(runs.run(p, length))
                if ids:
                    sure[k] = True
                    found[r] |= ids
            _mark(hit, places[sure], length)
        return hit, found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _written(batch, window, block, judge, names, schema.names, arrow_item, spans)

    return own.mapInArrow(scan, schema)


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, bits) of the names' bitmap."""
    bits = np.zeros(BITS // 64, np.uint64)
    for batch in batches:
        at = batch.column("name").to_numpy().view(np.uint64) % np.uint64(BITS)
        np.bitwise_or.at(bits, (at // np.uint64(64)).astype(np.int64), np.uint64(1) << at % np.uint64(64))
    some = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bits[some].view(np.int64))], names=["slot", "bits"])


def _by_join(own: DataFrame, items: DataFrame, window: int, schema: T.StructType, names: list[str], arrow_item: pa.DataType, spans: bool, block: int) -> DataFrame:
    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets, _ = text_parts(batch.column("text"))
            for a, b in blocks(offsets):
                runs = _Runs(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for length, places, name, rows in _item_windows(runs, window):
                    item = batch.column("item_id").take(pa.array(a + rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), length, np.int32)), pa.array(name.view(np.int64)), runs.runs(places, length), item], names=["length", "name", "run", "item"])

    item_type = items.schema["item_id"].dataType.simpleString()
    wanted = stage(items.mapInArrow(item_rows, f"length int, name long, run binary, item {item_type}").distinct(), "wanted")
    lengths = [r["length"] for r in wanted.select("length").distinct().collect()]  # at most `window` values
    table = wanted.select("name").mapInArrow(_bitmap, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most BITS / 64 rows
    bits = np.zeros(BITS // 64, np.int64)
    bits[table.column("slot").to_numpy()] = table.column("bits").to_numpy()
    shared = own.sparkSession.sparkContext.broadcast(bits.view(np.uint64))
    own = stage(own.withColumn("__row", F.monotonically_increasing_id()), "texts")  # fixes the row numbers

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__row").to_numpy()
            for a, _, before, runs in _parts_of(batch, window, block):
                for length in lengths:
                    places, name = runs.names(length)
                    at = name % np.uint64(BITS)
                    may = (shared.value[(at // np.uint64(64)).astype(np.int64)] >> (at % np.uint64(64))) & np.uint64(1) == 1
                    places = places[may]
                    row = runs.rows(places)
                    word = before + places - runs.words.first[row]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), length, np.int32)), runs.runs(places, length), pa.array(ids[a + row]), pa.array(word)], names=["length", "run", "__row", "word"])

    windows = stage(own.select("__row", "__text").mapInArrow(doc_rows, "length int, run binary, __row long, word long"), "candidates")
    known = stage(wanted.select("length", "run").distinct(), "known")
    hits = windows.join(known, ["length", "run"])
    hits = hits.groupBy("__row").agg(F.collect_list("length").alias("__lengths"), F.collect_list("word").alias("__words"))
    # a window counts once a row before it meets its items
    found = windows.select("length", "run", "__row").distinct().join(wanted.select("length", "run", "item"), ["length", "run"])
    found = found.groupBy("__row").agg(F.collect_set("item").alias("__items"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (sizes, ends), (words, _) = list_parts(batch.column("__lengths")), list_parts(batch.column("__words"))
            items = [x or [] for x in batch.column("__items").to_pylist()]

            def judge(runs: _Runs, a: int, b: int, before: int, sizes=sizes, ends=ends, words=words, items=items) -> tuple[np.ndarray, list[set]]:
                hit = np.zeros(len(runs.words), bool)
                size, word = sizes[ends[a] : ends[b]], words[ends[a] : ends[b]]
                place = word - before + runs.words.first[np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))]
                for length in lengths:
                    some = place[(size == length) & (place >= 0) & (place + length <= len(hit))]
                    _mark(hit, some, length)
                return hit, [set(x) for x in items[a:b]]

            yield from _written(batch, window, block, judge, names, schema.names, arrow_item, spans)

    return own.join(hits, "__row", "left").join(found, "__row", "left").mapInArrow(mark, schema)
