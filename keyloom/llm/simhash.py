"""SimHash near-dedup by covering locality-sensitive hashing.

Each bit of a fingerprint gets a non-zero vector of r+1 bits; each non-zero
vector v of r+1 bits is a table, whose mask keeps the bits with an odd inner
product with v. The vectors of up to r differing bits lie in a space of r
dimensions, so some v is orthogonal to all of them and its mask drops all of
them: every pair within the radius collides in some of the 2^(r+1)-1 tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, blocks, stage, text_parts
from .components import components
from .groups import by_group, forest

#: A bucket of more fingerprints than this is compared in pairs of blocks of about so many, each a task's group.
BLOCK = 1024


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each table; as signed 64-bit numbers."""
    size = 2 ** (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[a : a + (1 << 16)]).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words_a_shingle: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64 = xxhash.xxh64_intdigest
        for batch in batches:
            raw, offsets, _ = text_parts(batch.column("text"))
            out = np.zeros(batch.num_rows, np.uint64)
            for a, b in blocks(offsets):
                w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_SPACE, fold_case=True)
                if not len(w):
                    continue
                line = w.line().tobytes()
                begin = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
                for r in range(b - a):
                    i, j = int(w.first[r]), int(w.first[r + 1])
                    if i == j:
                        continue
                    k = min(words_a_shingle, j - i)
                    ats, tos = begin[i : j - k + 1].tolist(), (begin[i + k : j + 1] - 1).tolist()
                    out[a + r] = fingerprint(np.fromiter((h64(line[s:e], seed) for s, e in zip(ats, tos, strict=True)), np.uint64, len(ats)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return rows


def _near(radius: int):
    """Edges that span what is near in each group (t, key, i, j)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_a, made_b, n = [], [], 0
        for group in by_group(batches, ["t", "key", "i", "j"]):
            fp, ids = group.column("fp").to_numpy().view(np.uint64), group.column("rep").to_numpy()
            step = max(1, (1 << 20) // len(fp))

            def linked(fp=fp, step=step):
                for s in range(0, len(fp), step):
                    x, y = np.nonzero(np.bitwise_count(fp[s : s + step, None] ^ fp[None, :]) <= radius)
                    yield x[x + s < y] + s, y[x + s < y]

            a, b = forest(ids, linked())
            made_a.append(a)
            made_b.append(b)
            n += len(a)
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made_a)), pa.array(np.concatenate(made_b))], names=["a", "b"])
                made_a, made_b, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made_a)), pa.array(np.concatenate(made_b))], names=["a", "b"])

    return rows


def near_links(points: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) between reps of points (fp: long, distinct; rep: long) that connect all pairs within the radius.

    Buckets of two are decided from their min and max. The members of larger
    ones meet in groups (bucket, block, block) of bounded size, and a group
    gives a spanning forest, not its pairs.
    """
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("mask")) for t, m in enumerate(covering_masks(radius))])
    # dealt out before they are multiplied by the tables; a number keeps the parts from being joined again
    points = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    slots = points.select("fp", "rep", F.explode(masks).alias("s")).select(F.col("s.t").alias("t"), F.col("fp").bitwiseAND(F.col("s.mask")).alias("key"), "fp", "rep")
    me = F.struct("fp", "rep")
    sizes = stage(slots.groupBy("t", "key").agg(F.count("*").alias("n"), F.min(me).alias("x"), F.max(me).alias("y")).where("n > 1"), "buckets")
    two = sizes.where("n = 2").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    more = slots.join(sizes.where("n > 2").select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("g")), ["t", "key"])
    more = more.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
    more = more.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep")
    near = more.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(_near(radius), "a long, b long")
    return two.union(near)


def simhash_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """(doc_id, fp: long, fingerprint: 16 hex digits, component_id) of every row of docs.

    A-Z are lower-cased; words are runs of bytes other than space and 09-0D;
    shingles of `shingle` words, repeats included, joined by one space, are
    hashed by XXH64. Fewer words make one shingle of all of them; no words, an
    empty or a null text, the fingerprint zero, which links like any other. A
    bit is 1 if set in over half of the hashes. Documents link at up to
    `radius` differing bits; component_id is the smallest doc_id reachable.

    Rows with a null doc_id get a fingerprint, but no component and no links.
    Rows that repeat a doc_id are one document for linking, through each of
    their fingerprints. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = stage(rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long"), "fingerprints")
    points = stage(marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    links = near_links(points, radius)
    # a repeated doc_id with several fingerprints links them
    twice = marks.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    same = marks.join(twice, "doc_id").join(points, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    of = components(links.union(same))
    named = points.join(of, points.rep == of.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = marks.join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
