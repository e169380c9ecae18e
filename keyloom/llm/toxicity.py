"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are an embedding of the word and the mean of embeddings of
its character 3-grams (both hashed), projected once for each different word of
a block of texts. The network runs over a text in segments, which begin and end
CONTEXT words early and late, so each word's state knows that many words on both
sides, or all up to the text's end. All overlapping windows of a text, one from
each word, are pooled and scored from these states by sliding sums; the text's
score is that of its most toxic window, both when learning (the gradient goes
through that window and its context) and when scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, blocks, mix64, stage, text_parts

#: Words of a window (a power of two); of a segment; and that the network reads before and after a segment or window.
WINDOW, SEGMENT, CONTEXT = 32, 192, 16
#: Labelled rows that are learnt from, and bytes of such a text, at most; segments that are worked on at once.
SAMPLE, SAMPLE_BYTES, AT_ONCE = 3000, 1 << 15, 512
#: Slots of words and of 3-grams, size of an embedding, of a direction's state, of the attention.
WORDS, GRAMS, EMBED, STATE, ATTEND = 1 << 15, 1 << 13, 6, 8, 6
_EDGE = 0x20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Block:
    """Different words of a block: slots, 3-gram slots (gram_at[offsets[i]:offsets[i+1]]); the words of each row by number."""

    slots: np.ndarray
    gram_at: np.ndarray
    offsets: np.ndarray
    words: np.ndarray
    first: np.ndarray


def block_of(raw: np.ndarray, offsets: np.ndarray) -> Block:
    w = Words(raw, offsets, ALNUM, fold_case=True)
    names, at, words = np.unique(w.hash, return_index=True, return_inverse=True)
    start, end = w.start[at], w.end[at]
    # the bytes of the different words, with an edge on both sides of each
    size = end - start
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    line = np.full(int(begin[-1]), _EDGE, np.uint64)
    if len(size):
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        line[np.repeat(begin[:-1] + 1, size) + inner] = w.text[np.repeat(start, size) + inner]
    grams = mix64(line[:-2] | (line[1:-1] << np.uint64(8)) | (line[2:] << np.uint64(16))) % np.uint64(GRAMS) if len(line) > 2 else np.zeros(0, np.uint64)
    inside = np.ones(len(grams), bool)
    inside[begin[1:-1] - 1] = inside[begin[1:-1] - 2] = False  # across words
    return Block((names % np.uint64(WORDS)).astype(np.int64), grams[inside].astype(np.int64), np.concatenate([[0], np.cumsum(size)]), words, w.first)


class Network:
    """Parameters by name; float32."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)

        def some(*shape, scale=0.3):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {"ew": some(WORDS, EMBED, scale=0.05), "eg": some(GRAMS, EMBED, scale=0.05)}
        for d in "fb":
            self.p |= {f"w{d}": some(2 * EMBED, 3 * STATE), f"u{d}": some(STATE, 3 * STATE), f"c{d}": np.zeros(3 * STATE, np.float32)}
        self.p |= {"wa": some(2 * STATE, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": some(ATTEND), "wo": some(2 * STATE), "bo": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0  # of the logit, fitted after training

    def inputs(self, b: Block) -> np.ndarray:
        """Inputs of the different words."""
        size = np.maximum(np.diff(b.offsets), 1)[:, None]
        if len(b.slots):
            sums = np.add.reduceat(self.p["eg"][b.gram_at], np.minimum(b.offsets[:-1], max(0, len(b.gram_at) - 1)), axis=0)
        else:
            sums = np.zeros((0, EMBED), np.float32)
        return np.concatenate([self.p["ew"][b.slots], sums / size], axis=1).astype(np.float32)

    def _direction(self, d: str, xs: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, windows, STATE) for projected inputs; padded words leave the state as it is."""
        u, h = self.p[f"u{d}"], np.zeros((xs.shape[1], STATE), np.float32)
        out = np.empty((*xs.shape[:2], STATE), np.float32)
        full = mask.all(axis=1)
        for t in range(len(xs)) if d == "f" else range(len(xs) - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(xs[t, :, : 2 * STATE] + hu[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(xs[t, :, 2 * STATE :] + r * hu[:, 2 * STATE :])
            new = n + z * (h - n)
            if not full[t]:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * STATE :]))
            out[t] = h = new
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, pool: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; at, mask, pool: (time, windows) numbers of words, whether there is one, and whether it is in the window or its context."""
        p, hs = self.p, []
        for d in "fb":
            steps = None if keep is None else keep.setdefault(d, [])
            hs.append(self._direction(d, (x @ p[f"w{d}"] + p[f"c{d}"])[at], mask, steps))
        h = np.concatenate(hs, axis=2)
        a = np.tanh(h @ p["wa"] + p["ba"])
        e = np.where(pool, np.exp(a @ p["va"]), 0)
        e /= e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", e, h)
        if keep is not None:
            keep |= {"h": h, "a": a, "e": e, "pooled": pooled}
        return pooled @ p["wo"] + p["bo"][0]

    def states(self, x: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The states (2 * STATE, words) of the words of rows, run over segments side by side in memory."""
        p, out = self.p, np.empty((2 * STATE, len(words)), np.float32)
        # sigmoid(v) is (tanh(v / 2) + 1) / 2; the halves of r's are in those of u that it is multiplied with
        half = np.concatenate([np.full(2 * STATE, 0.5, np.float32), np.ones(STATE, np.float32)])
        lines = [np.ascontiguousarray(((x @ p[f"w{d}"] + p[f"c{d}"]) * half).T) for d in "fb"]
        us = [np.ascontiguousarray((p[f"u{d}"] * np.float32(0.5)).T) for d in "fb"]
        n = -(-np.diff(first) // SEGMENT)
        row = np.repeat(np.arange(len(n)), n)
        start = first[row] + SEGMENT * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(start + SEGMENT, first[row + 1])
        reads = (np.maximum(start - CONTEXT, first[row]), np.minimum(stop + CONTEXT, first[row + 1]))
        # a direction begins where all its segments do, so none waits for words; shorter ones end earlier
        for d, (line, u) in enumerate(zip(lines, us, strict=True)):
            size = (stop - reads[0]) if d == 0 else (reads[1] - start)
            order = np.argsort(-size, kind="stable")
            for s in range(0, len(order), AT_ONCE):
                some = order[s : s + AT_ONCE]
                left, go = size[some], 1 if d == 0 else -1
                begin = reads[0][some] if d == 0 else reads[1][some] - 1
                own = (start[some] - begin) if d == 0 else (begin - stop[some] + 1)  # steps before its own words
                now = np.zeros((STATE, len(some)), np.float32)
                for t in range(int(left[0])):
                    k = int(np.searchsorted(-left, -t, side="left"))  # those of over t words
                    now = now[:, :k]
                    at = begin[:k] + go * t
                    v = line[:, words[at]]
                    hu = u @ now
                    zr = np.tanh(hu[: 2 * STATE] + v[: 2 * STATE])
                    new = np.tanh(hu[2 * STATE :] * (zr[STATE:] + 1) + v[2 * STATE :])
                    now = new + (now - new) * (0.5 * (zr[:STATE] + 1))
                    mine = own[:k] <= t
                    if t >= CONTEXT or mine.all():
                        out[d * STATE : (d + 1) * STATE, at] = now
                    elif mine.any():
                        out[d * STATE : (d + 1) * STATE, at[mine]] = now[:, mine]
        return out

    def windows(self, x: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logits of the windows from each word of rows; -inf where it would pass the row's end, but for the first of a short row, which ends with it."""
        p, out = self.p, np.full(len(words), -np.inf)
        if not len(words):
            return out
        h = self.states(x, words, first)
        weight = np.exp((p["va"] @ np.tanh(p["wa"].T @ h + p["ba"][:, None])).astype(np.float64))
        both = np.stack([weight, weight * (p["wo"] @ h)])
        size = np.diff(first)
        short = np.flatnonzero((size > 0) & (size < WINDOW))
        if len(short):
            sums = np.add.reduceat(both, np.stack([first[short], first[short + 1]], axis=1).ravel()[: None if first[short[-1] + 1] < len(words) else -1], axis=1)[:, ::2]
            out[first[short]] = sums[1] / sums[0]
        step = 1
        while step < WINDOW and both.shape[1] > step:
            both = both[:, :-step] + both[:, step:]
            step *= 2
        fits = np.arange(len(words)) + WINDOW <= np.repeat(first[1:], size)
        at = np.flatnonzero(fits)
        out[at] = both[1, at] / both[0, at]
        return out + p["bo"][0]

    def backward(self, b: Block, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        h, a, e = keep["h"], keep["a"], keep["e"]
        g["wo"], g["bo"] = keep["pooled"].T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpool = dlogit[:, None] * p["wo"]
        dh = e[:, :, None] * dpool[None]
        de = np.einsum("bh,tbh->tb", dpool, h)
        ds = e * (de - (e * de).sum(axis=0))
        g["va"] = np.einsum("tb,tba->a", ds, a)
        dpre = ds[:, :, None] * p["va"] * (1 - a * a)
        g["wa"], g["ba"] = np.einsum("tbh,tba->ha", h, dpre), dpre.sum(axis=(0, 1))
        dh += dpre @ p["wa"].T
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))):
            u, dxs = p[f"u{d}"], np.zeros((*at.shape, 3 * STATE), np.float32)
            g[f"u{d}"], back = np.zeros_like(u), np.zeros((at.shape[1], STATE), np.float32)
            for t, h0, z, r, n, hn in reversed(keep[d]):
                own = dh[t, :, part] + back
                m = mask[t][:, None]
                dn = np.where(m, own * (1 - z) * (1 - n * n), 0)
                dz = np.where(m, own * (h0 - n) * z * (1 - z), 0)
                dr = dn * hn * r * (1 - r)
                dxs[t] = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"u{d}"] += h0.T @ du
                back = np.where(m, own * z, own) + du @ u.T
            flat = np.zeros((len(x), 3 * STATE), np.float32)
            np.add.at(flat, at[mask], dxs[mask])
            g[f"w{d}"], g[f"c{d}"] = x.T @ flat, flat.sum(axis=0)
            dx += flat @ p[f"w{d}"].T
        g["ew"] = (b.slots, dx[:, :EMBED])
        size = np.diff(b.offsets)
        g["eg"] = (b.gram_at, np.repeat(dx[:, EMBED:] / np.maximum(size, 1)[:, None], size, axis=0))
        return g


def _places(b: Block, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of windows with their context, and which there are, and which are in the window."""
    lo = np.maximum(start - CONTEXT, b.first[row])
    place = lo[None, :] + np.arange(WINDOW + 2 * CONTEXT)[:, None]
    mask = place < np.minimum(start + WINDOW + CONTEXT, b.first[row + 1])[None, :]
    pool = mask & (place >= start[None, :]) & (place < start[None, :] + WINDOW)
    return b.words[np.where(mask, place, start[None, :])], mask, pool


def _highest(first: np.ndarray, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, logit) of the highest window of each row that has words; of equal ones the first."""
    rows = np.flatnonzero(np.diff(first))
    best = np.maximum.reduceat(logits, first[rows]) if len(rows) else logits[:0]
    places = np.flatnonzero(logits == np.repeat(best, np.diff(first)[rows]))
    _, one = np.unique(np.searchsorted(first, places, side="right") - 1, return_index=True)
    return rows, places[one], best


def block_logits(net: Network, b: Block) -> np.ndarray:
    """The logit of each row of a block; -inf for rows without words."""
    out = np.full(len(b.first) - 1, -np.inf)
    rows, _, best = _highest(b.first, net.windows(net.inputs(b), b.words, b.first))
    out[rows] = best
    return out


def fit(texts: list[bytes], labels: list[int], rounds: int = 6, batch: int = 48, seed: int = 5) -> Network | None:
    """Train on texts by Adam; a fifth is kept back to fit the scale and shift of the logit. None without both labels."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net = Network(seed)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    learn = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    kept = np.flatnonzero(np.arange(len(y)) % 5 == 4)

    def block(rows: np.ndarray) -> Block:
        part = np.concatenate([raw[offsets[r] : offsets[r + 1]] for r in rows] or [raw[:0]])
        return block_of(part, np.concatenate([[0], np.cumsum(offsets[rows + 1] - offsets[rows])]))

    # embeddings start from how much oftener a word or 3-gram is in toxic texts
    counts = {"ew": np.zeros((2, WORDS)), "eg": np.zeros((2, GRAMS))}
    for r in learn:
        b = block(np.array([r]))
        for name, slots in (("ew", b.slots), ("eg", b.gram_at)):
            counts[name][int(y[r]), np.unique(slots)] += 1
    for name, seen in counts.items():
        totals = np.array([(y[learn] == 0).sum(), (y[learn] == 1).sum()])[:, None]
        odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
        # slots seen hardly ever, or in most texts, say little
        net.p[name][:, 0] = np.where(seen.sum(axis=0) >= 2, odds / 3, 0).clip(-1.5, 1.5)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    rng, step = np.random.default_rng(seed), 0
    for turn in range(rounds):
        order = rng.permutation(learn)
        rate = 0.02 * (1 - turn / rounds) + 0.002
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            b = block(rows)
            x = net.inputs(b)
            row, start, _ = _highest(b.first, net.windows(x, b.words, b.first))
            if not len(row):
                continue
            at, mask, pool = _places(b, start, row)
            keep: dict = {}
            out = net.forward(x, at, mask, pool, keep)
            dlogit = ((_sigmoid(out) - y[rows[row]]) / len(row)).astype(np.float32)
            grads = net.backward(b, x, at, mask, keep, dlogit)
            step += 1
            fix = math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                if isinstance(g, tuple):
                    rows_, inverse = np.unique(g[0], return_inverse=True)
                    sums = np.zeros((len(rows_), EMBED), np.float32)
                    np.add.at(sums, inverse, g[1])
                    at_, g = rows_, sums
                else:
                    at_ = slice(None)
                m[k][at_] = 0.9 * m[k][at_] + 0.1 * g
                v2[k][at_] = 0.999 * v2[k][at_] + 0.001 * g * g
                net.p[k][at_] -= rate * fix * m[k][at_] / (np.sqrt(v2[k][at_]) + 1e-7)
    some = kept if len(kept) and y[kept].min() != y[kept].max() else learn
    logits = np.concatenate([block_logits(net, block(some[i : i + 64])) for i in range(0, len(some), 64)])
    net.scale, net.shift = _calibrated(np.where(np.isfinite(logits), logits, -20), y[some])
    return net


def _calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The cut with the greatest F1 (the middle of ties) becomes the score 0.5; the scale has the least log loss."""
    cuts = np.unique(logits)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    f1 = np.array([2 * (y * (logits > c)).sum() / (y.sum() + (logits > c).sum()) for c in cuts])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    cut = float(cuts[best[len(best) // 2]])

    def loss(a):
        return float(np.logaddexp(0, -(2 * y - 1) * a * (logits - cut)).mean())

    scale = min(np.geomspace(0.1, 10, 41), key=loss)
    return float(scale), -cut


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> Network | None:
    """Learn from docs (doc_id, text) with a label (doc_id, toxic 0 or 1). None unless both labels occur.

    Of each label up to half of `sample` rows, taken by hashes of doc_id, with
    texts of up to SAMPLE_BYTES bytes. A doc_id with several labels is toxic if
    one says so. Null ids, texts and labels are left out.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__y"))
    sizes = {r["__y"]: r["count"] for r in marked.groupBy("__y").count().collect()}
    rate = F.when(F.col("__y") == 1, min(1.0, 0.7 * sample / max(1, sizes.get(1, 0)))).otherwise(min(1.0, 0.7 * sample / max(1, sizes.get(0, 0))))
    u = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # at most 2 * sample rows, so it may be broadcast and no text is shuffled
    chosen = F.broadcast(stage(marked.withColumn("__u", u).where(F.col("__u") < rate).orderBy("__u", "doc_id").limit(2 * sample), "chosen"))
    rows = docs.select("doc_id", F.col(text).alias("__text")).where(F.col("__text").isNotNull() & (F.octet_length("__text") <= SAMPLE_BYTES)).join(chosen, "doc_id")
    got: dict[int, list] = {0: [], 1: []}
    for r in rows.orderBy("__u", "doc_id").limit(2 * sample).collect():
        if len(got[r["__y"]]) < sample // 2:
            got[r["__y"]].append((r["__u"], r["doc_id"], r["__text"].encode(), r["__y"]))
    every = sorted(got[0] + got[1])
    return fit([r[2] for r in every], [r[3] for r in every])


def score(docs: DataFrame, net: Network | None, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """The given columns of docs (None: all) with score (double, 0 to 1) and predicted (int: 1 if score >= 0.5).

    Null and empty texts, and texts without words, score 0, as all do without a
    network. Existing columns of these names are replaced. Rows are independent
    of each other. The network, of fixed size, is broadcast.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted") and (columns is None or f.name in columns)]
    names = ["__text" if f.name == text else f"c{i}" for i, f in enumerate(kept)]
    own = docs.select(*[F.col(f.name).alias(n) for n, f in zip(names, kept, strict=True) if n != "__text"], F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join([f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, kept, strict=True)] + ["score double"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            raw, offsets, _ = text_parts(batch.column("__text"))
            out = np.zeros(batch.num_rows)
            for a, b in blocks(offsets):
                if net is not None:
                    z = net.scale * (block_logits(net, block_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) + net.shift)
                    out[a:b] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    out[a:b][~np.isfinite(z)] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(out)], names=[*names, "score"])

    out = own.mapInArrow(rows, schema)
    out = out.select(*[F.col(f"`{n}`").alias(f.name) for n, f in zip(names, kept, strict=True)], "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
