"""Rows of a sorted stream of Arrow batches by group, and spanning forests of small graphs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def by_group(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the runs of rows with equal keys. The stream is sorted by them; a group is held as a whole."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != table.column(k)[0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
        for i in range(len(cuts) - 1):
            part = table.slice(cuts[i], cuts[i + 1] - cuts[i])
            if i < len(cuts) - 2:
                yield pa.concat_tables([*held, part])
                held = []
            else:
                held.append(part)
    if held:
        yield pa.concat_tables(held)


def forest(ids: np.ndarray, linked: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its tree) that span the graph on `ids`; linked yields arrays of places (from, to)."""
    root = np.arange(len(ids))
    for a, b in linked:
        while len(a):
            ra, rb = root[a], root[b]
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = lo != hi
            a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
            if not len(a):
                break
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    to = least[root]
    apart = to != ids
    return ids[apart], to[apart]
