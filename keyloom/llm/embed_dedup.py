"""Embedding near-dedup: spherical k-means cells, blocked cosines, one kept of each group.

Equal vectors of a label collapse first, with a count. Centroids are fitted on
a bounded sample; they decide only how work is cut, never what is found: a
vector visits, besides its own cell, every cell whose members could be within
the threshold of it. For unit vectors x (at home in c) and y (at home in d)
with x.y >= t, x.(c - d) >= 0 gives

    t * y.(d - c) <= sqrt(1 - t^2) * |(c - d) without its part along y|,

so y visits c wherever this holds. Within a cell, blocks of home vectors meet
blocks of all its vectors, some rows at a time; a pair of blocks gives counts of
links and a spanning forest, never its pairs. Blocks are large, so that a vector
is sent to few of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_parts, stage
from .components import components
from .groups import by_group, forest

#: Vectors that k-means is fitted on, at most; wanted vectors of a label in a cell; centroids, at most; vectors in a block; and that are compared at once.
SAMPLE, CELL, CENTROIDS, BLOCK, ROWS = 8192, 16384, 256, 8192, 256


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids (k or fewer) of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes with a 128-bit name; rows that can't link have none."""
    for batch in batches:
        values, offsets = list_parts(batch.column("embedding"))
        flat = batch.column("embedding").flatten()
        holes = flat.is_null().to_numpy(zero_copy_only=False)
        values = np.asarray(flat.fill_null(0).to_numpy(zero_copy_only=False), np.float64)
        labels = batch.column("label").to_pylist()
        keys, units, dims = [], [], []
        for r, label in enumerate(labels):
            v = values[offsets[r] : offsets[r + 1]] + 0.0  # -0.0 as 0.0
            ok = label is not None and len(v) > 0 and np.isfinite(v).all() and not holes[offsets[r] : offsets[r + 1]].any()
            top = np.abs(v).max() if ok else 0.0
            if not top:
                keys.append(None), units.append(None), dims.append(0)
                continue
            v = v / top  # else squares may overflow
            v = v / math.sqrt(float(v @ v))
            keys.append(hashlib.blake2b(v.tobytes() + b"|" + str(label).encode(), digest_size=16).digest())
            units.append(v.tobytes())
            dims.append(len(v))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array([None if x is None else str(x) for x in labels], pa.string()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
            names=["vec_id", "label", "dim", "key", "unit"],
        )


def _unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _assign(centroids: dict[int, np.ndarray], t: float):
    """Rows (cell, home) of the cells that a vector visits."""
    slope = math.sqrt(max(0.0, 1 - t * t))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                y, c = _unit_rows(part.column("unit"), dim), centroids.get(dim)
                if c is None:  # a dimension that the sample hasn't
                    where, cell, home = np.arange(len(y)), np.zeros(len(y), np.int64), np.ones(len(y), bool)
                else:
                    dots = y @ c.T
                    own = np.argmax(dots, axis=1)
                    along = dots[np.arange(len(y)), own][:, None] - dots  # y.(d - c)
                    apart = np.maximum(0, 2 - 2 * (c[own] @ c.T))  # |d - c|^2
                    visits = t * along <= slope * np.sqrt(np.maximum(0, apart - along * along)) + 1e-9
                    visits[np.arange(len(y)), own] = True
                    where, cell = np.nonzero(visits)
                    home = cell == own[where]
                some = part.select(["rep", "w", "label", "dim", "unit"]).take(pa.array(where))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32)), pa.array(home)], names=[*some.schema.names, "cell", "home"])

    return rows


def _compare(t: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["label", "dim", "cell", "i", "j"]):
            dim = group.column("dim")[0].as_py()
            side = group.column("side").to_numpy()
            ids, w = group.column("rep").to_numpy(), group.column("w").to_numpy()
            unit = _unit_rows(group.column("unit"), dim)
            home, every = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(home) or not len(every):
                continue
            both, place = np.unique(ids, return_inverse=True)
            links, others, weights = np.zeros(len(home), np.int64), np.ascontiguousarray(unit[every].T), w[every]

            def linked(home=home, every=every, ids=ids, unit=unit, place=place, links=links, others=others, weights=weights):
                for s in range(0, len(home), ROWS):
                    own = home[s : s + ROWS]
                    near = (unit[own] @ others >= t) & (ids[own][:, None] != ids[every][None, :])
                    links[s : s + ROWS] = near @ weights
                    x, y = np.nonzero(near)
                    yield place[own][x], place[every][y]

            a, b = forest(both, linked())
            some = links > 0
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[home][some], a])), pa.array(np.concatenate([np.full(n, -1), b])), pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]))], names=["a", "b", "n"]
            )

    return rows


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label). threshold: over 0, up to 1.

    Rows link when their labels are equal and their cosine, in double
    precision, is at least `threshold`. n_links: other rows linked directly;
    component_id: smallest vec_id reachable, itself included; kept: it is that
    one. k-means is fitted on `sample` vectors at most (those of the smallest
    hashes); every row is assigned, and no pair is lost.

    A null label, a null, empty or zero vector, or a null or non-finite
    component links with nothing, nor do vectors of different dimensions. A
    null vec_id has no component, no links and is kept. Rows that repeat a
    vec_id are rows like others, in the component of their vec_id. Other columns
    are ignored; an empty table gives an empty table.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and up to 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    ready = stage(rows.mapInArrow(_prepare, "vec_id long, label string, dim int, key binary, unit binary"), "vectors")
    able = ready.where("vec_id is not null and key is not null")
    points = stage(able.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit")), "points")
    most = points.groupBy("label", "dim").count().agg(F.max("count").alias("n")).first()["n"] or 0
    centroids: dict[int, np.ndarray] = {}
    taken = points.select("dim", "unit", F.xxhash64("key").alias("h")).orderBy("h").limit(sample).collect()
    for dim in {r["dim"] for r in taken}:
        x = np.frombuffer(b"".join(r["unit"] for r in taken if r["dim"] == dim), np.float64).reshape(-1, dim)
        centroids[dim] = spherical_kmeans(x, min(CENTROIDS, max(2, math.ceil(most / CELL))))
    cells = stage(points.mapInArrow(_assign(centroids, threshold), "rep long, w long, label string, dim int, unit binary, cell int, home boolean"), "cells")
    place = ["label", "dim", "cell"]
    sizes = cells.groupBy(*place).agg(F.sum(F.col("home").cast("int")).alias("nh"), F.count("*").alias("na"))
    sizes = sizes.select(*place, F.ceil(F.col("nh") / BLOCK).cast("int").alias("gh"), F.ceil(F.col("na") / BLOCK).cast("int").alias("ga")).where("gh > 0")
    cut = cells.join(sizes, place).withColumn("h", F.xxhash64("rep"))
    homes = cut.where("home").select(*place, F.pmod("h", "gh").cast("int").alias("i"), F.explode(F.expr("sequence(0, ga - 1)")).alias("j"), F.lit(0).alias("side"), "rep", "w", "unit")
    every = cut.select(*place, F.explode(F.expr("sequence(0, gh - 1)")).alias("i"), F.pmod("h", "ga").cast("int").alias("j"), F.lit(1).alias("side"), "rep", "w", "unit")
    group = [*place, "i", "j"]
    met = stage(homes.union(every).repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(threshold), "a long, b long, n long"), "met")
    counts = met.where("b = -1").groupBy("a").agg(F.sum("n").alias("n"))
    twice = able.groupBy("vec_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("vec_id")
    same = able.join(twice, "vec_id").join(points.select("key", "rep"), "key").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    of = components(met.where("b <> -1").select("a", "b").union(same))
    named = points.select("key", "rep", "w").join(counts, F.col("rep") == F.col("a"), "left").join(of, F.col("rep") == F.col("id"), "left")
    named = named.select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = ready.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
