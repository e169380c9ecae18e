"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased and all but letters count as one space; 1- to
3-grams are hashed into a fixed number of slots. Document frequencies are
counted over all learning rows on the executors. The weights are trained by
follow-the-regularised-leader (per-coordinate rates, elastic net) on a bounded,
stratified sample of labelled rows, and a temperature is fitted to a part of
the sample that was kept back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix64, text_parts

#: Slots of the hashed n-grams (a power of two); weights, at most (with more languages there are fewer slots); labelled rows that are learnt from, at most.
SLOTS, WEIGHTS, SAMPLE, ORDERS = 1 << 14, 1 << 24, 6000, (1, 2, 3)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    chars = [chr(i) for i in range(0x10000)]
    letter = np.array([c.isalpha() for c in chars])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    return letter, lower


_TABLES: list = []


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lower-cased, all but letters as a space; whether a letter)."""
    if not _TABLES:
        _TABLES.extend(_tables())
    letter, lower = _TABLES
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 0xFFFF)
    is_letter = letter[low]
    high = points > 0xFFFF
    if high.any():
        for p in np.unique(points[high]).tolist():
            is_letter[points == p] = chr(p).isalpha()
    return np.where(is_letter, np.where(high, points, lower[low]), np.uint32(32)), is_letter


def slots_for(langs: int) -> int:
    """SLOTS, or the greatest power of two, 64 at least, that keeps slots x languages within WEIGHTS."""
    return min(SLOTS, max(64, 1 << max(0, (WEIGHTS // max(1, langs)).bit_length() - 1)))


def counts(points: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """How often each slot occurs among the n-grams of a text; runs of spaces count as one."""
    padded = np.concatenate([[32], points, [32]]).astype(np.uint64)
    padded = padded[np.concatenate([[True], (padded[1:] != 32) | (padded[:-1] != 32)])]
    out = np.zeros(slots, np.float64)
    gram = np.zeros(len(padded), np.uint64)
    for n in ORDERS:
        if len(padded) < n:
            break
        gram = gram[: len(padded) - n + 1] * np.uint64(0x200000) + padded[n - 1 :] if n > 1 else padded.copy()
        slot = mix64(gram + np.uint64(n << 60)) & np.uint64(slots - 1)
        out += np.bincount(slot.astype(np.int64), minlength=slots)
    return out


def _count_rows(texts: pa.Array, slots: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, counts) of each text; None if it has no letter."""
    raw, offsets, _ = text_parts(texts)
    for a, b in blocks(offsets):
        for r in range(a, b):
            points, is_letter = folded(raw[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
            yield r, counts(points, slots) if is_letter.any() else None


@dataclass
class Model:
    """langs in order; idf of the slots; weights (slots x langs), bias; temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf
        return x / (math.sqrt(float(x @ x)) or 1.0)

    def probabilities(self, n: np.ndarray) -> np.ndarray:
        logits = (self.vector(n) @ self.weights + self.bias) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], slots: int, k: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, rounds=4, seed=3):
    """Follow-the-regularised-leader (proximal) on sparse rows (slots, values); returns (weights, bias)."""
    z, n = np.zeros((slots + 1, k)), np.zeros((slots + 1, k))

    def solved(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for r in rng.permutation(len(xs)):
            at = np.append(xs[r][0], slots)  # the last one is the bias
            v = np.append(xs[r][1], 1.0)
            w = solved(at)
            logits = v @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[ys[r]] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solved(np.arange(slots + 1))
    return w[:-1], w[-1]


def train(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from all rows (key, text, lang); rows with a null text or lang are left out. None if no row is left.

    The counts of languages and the document frequencies come from all rows.
    The weights come from up to `sample` rows, shared out evenly among the
    languages and taken by hashes of `key`: of each language the first with
    letters, whatever the sizes of the others.
    """
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    slots = slots_for(len(langs))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(slots, np.int64)
        for batch in batches:
            for _, n in _count_rows(batch.column("text"), slots):
                if n is not None:
                    total += 1
                    seen += n > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, slots, dtype=np.int32)), pa.array(np.concatenate([[total], seen]))], names=["slot", "n"])

    found = {r["slot"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    total = found.get(-1, 0)
    idf = np.array([math.log((1 + total) / (1 + found.get(i, 0))) + 1 for i in range(slots)])

    each = max(2, sample // len(langs))
    # somewhat over `each` rows of a language pass, by a margin for chance, so their number doesn't grow with the table
    some = 1.2 * each + 6 * math.sqrt(each) + 20
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, some / sizes[lang]))])[F.col("lang")]
    u = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = rows.withColumn("u", u).where(F.col("u") < rate)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"lang": [], "u": [], "slots": [], "values": []}
            langs_, us = batch.column("lang").to_pylist(), batch.column("u").to_pylist()
            for r, n in _count_rows(batch.column("text"), slots):
                if n is not None:
                    at = np.flatnonzero(n)
                    x = np.log1p(n[at]) * idf[at]
                    x /= math.sqrt(float(x @ x)) or 1.0
                    for k, v in zip(out, (langs_[r], us[r], at.astype(np.int16).tobytes(), x.astype(np.float32).tobytes()), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["u"], pa.float64()), pa.array(out["slots"], pa.binary()), pa.array(out["values"], pa.binary())], names=list(out))

    made = taken.select("lang", "u", "text").mapInArrow(features, "lang string, u double, slots binary, values binary")
    first = made.withColumn("r", F.expr("row_number() over (partition by lang order by u, slots, values)")).where(F.col("r") <= each)
    got: dict[str, list] = {lang: [] for lang in langs}
    for r in sorted(first.collect(), key=lambda r: r["r"]):
        got[r["lang"]].append((np.frombuffer(r["slots"], np.int16).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(np.float64)))
    learn, check = [], []
    for y, lang in enumerate(langs):
        for i, x in enumerate(got[lang]):
            (check if i % 5 == 4 else learn).append((x, y))
    if not learn:
        return None
    weights, bias = ftrl([x for x, _ in learn], [y for _, y in learn], slots, len(langs))
    model = Model(langs, idf, weights, bias)
    if check:
        logits = np.array([v @ weights[at] + bias for (at, v), _ in check])
        ys = np.array([y for _, y in check])

        def loss(t):
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(ys)), ys]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    return model


def predict(docs: DataFrame, model: Model | None, columns: list[str], text: str = "text") -> DataFrame:
    """docs' `columns` with lang_pred and score. `und` and 0 for a null text, one without a letter, or without a model.

    Ties go to the first language in order. Existing columns of these names are
    replaced. The model, whose size is bounded, is broadcast.
    """
    columns = [c for c in columns if c not in ("lang_pred", "score")]
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)] + ["lang_pred string, score double"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            if m is not None:
                for r, n in _count_rows(batch.column("__text"), len(m.idf)):
                    if n is not None:
                        p = m.probabilities(n)
                        best = int(np.argmax(p))
                        langs[r], scores[r] = m.langs[best], float(p[best])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(langs), pa.array(scores)], names=[*batch.schema.names[: len(columns)], "lang_pred", "score"])

    out = own.mapInArrow(rows, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "lang_pred", "score")
