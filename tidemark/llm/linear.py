"""Hashed n-gram features and a logistic model for short fits on a bounded sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import LOWER, Words, code_points, mix, rolling, runs, slices

U = np.uint64
#: Features that a step of the fit looks at together.
AT_ONCE = 1 << 19


@dataclass(frozen=True)
class Grams:
    """Orders of character and word n-grams and the width of the hashed space (a power of two)."""

    chars: tuple[int, ...] = (3, 4, 5)
    words: tuple[int, ...] = ()
    lower: bool = True
    bits: int = 18

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Distinct feature ids of each row."""
        data = LOWER[data] if self.lower else data
        points, place = code_points(data, offsets)
        shift, parts = U(64 - self.bits), []
        for n in self.chars:
            parts.append(((rolling(points.astype(U) + U(1), n) * U(2 * n + 0x9E3779B97F4A7C01)) >> shift, place, n))
        if self.words:
            words = Words(data, offsets)
            for n in self.words:
                parts.append((mix(runs(words.code, n) + U(n)) >> shift, words.first, n))
        parts = [(ids.astype(np.int32), first, n) for ids, first, n in parts]
        seen = np.zeros(1 << self.bits, np.int32)
        for i in range(len(offsets) - 1):
            ids = np.concatenate([x[first[i] : max(first[i], first[i + 1] - n + 1)] for x, first, n in parts])
            order = np.arange(len(ids), dtype=np.int32)
            seen[ids] = order
            yield ids[seen[ids] == order]


@dataclass(frozen=True)
class Model:
    """p = sigmoid(slope * (bias + sum of weights of the row's features / norm) + shift)."""

    grams: Grams
    weights: np.ndarray
    bias: float
    unit: bool
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = np.empty(len(offsets) - 1)
        for i, ids in enumerate(self.grams.rows(data, offsets)):
            raw[i] = self.weights[ids].sum(dtype=np.float64) / (max(1.0, len(ids)) ** 0.5 if self.unit else 1.0)
        return sigmoid(self.slope * (raw + self.bias) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 4) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (s @ y)
            way -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            way += (a - (y @ way) / (s @ y)) * s
        size, drop = 1.0 if past else 1.0 / max(1.0, float(np.abs(slope).sum())), float(slope @ way)
        for _ in range(25):
            new, new_slope = f(x - size * way)
            if new <= value - 1e-4 * size * drop:
                break
            size /= 2
        else:
            return x
        s, y = -size * way, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        x, done, value, slope = x + s, value - new < 1e-7 * max(1.0, value), new, new_slope
        if done:
            break
    return x


def fit(rows: list[np.ndarray], y: np.ndarray, grams: Grams, unit: bool, bayes: bool, l2: float, steps: int = 25) -> Model:
    """Logistic regression on presence features, all of those that the rows have; with bayes, each feature is scaled by
    its naive Bayes log-count ratio. Memory goes with the features of the rows, whose number sample() bounds."""
    size, y = 1 << grams.bits, np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(grams, np.zeros(size, np.float32), float(np.log((share + 0.01) / (1.01 - share))), unit)
    hit, miss = np.zeros(size), np.zeros(size)
    for r, label in zip(rows, y, strict=True):
        (hit if label == 1 else miss)[r] += 1
    used = np.flatnonzero(hit + miss)
    ratio = (np.log((hit + 1) / (y.sum() + 2)) - np.log((miss + 1) / ((1 - y).sum() + 2)))[used]
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    n = np.array([len(r) for r in rows])
    norm = np.maximum(n, 1) ** -0.5 if unit else np.ones(len(n))
    scale, blocks = ratio if bayes else np.ones(len(used)), []
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(n) // AT_ONCE)) + 1):
        part = part[n[part] > 0]
        if len(part):
            blocks.append((part, np.concatenate([place[rows[i]] for i in part]), np.cumsum(n[part]) - n[part]))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z, weights, slope = np.full(len(y), v[-1]), (v[:-1] * scale).astype(np.float32), np.zeros(len(used))
        for part, ids, begin in blocks:
            z[part] += np.add.reduceat(weights[ids], begin, dtype=np.float64) * norm[part]
        off = (sigmoid(z) - y) / len(y)
        value = float(np.mean(np.logaddexp(0, z) - y * z)) + l2 / 2 * float(v[:-1] @ v[:-1])
        for part, ids, _ in blocks:
            slope += np.bincount(ids, weights=np.repeat((off * norm)[part], n[part]), minlength=len(used))
        return value, np.append(slope * scale + l2 * v[:-1], off.sum())

    v = minimise(loss, np.zeros(len(used) + 1), steps)
    weights = np.zeros(size, np.float32)
    weights[used] = v[:-1] * scale
    return Model(grams, weights, float(v[-1]), unit)


def calibrated(rows: list[np.ndarray], y: np.ndarray, grams: Grams, unit: bool, bayes: bool, l2: float, prior: float, folds: int = 3) -> Model:
    """A fit on all rows whose probabilities come from a sigmoid on out-of-fold margins; there the
    labels are weighted so that label 1 has the share `prior`."""
    model = fit(rows, y, grams, unit, bayes, l2)
    part, raw = np.arange(len(y)) % folds, np.zeros(len(y))
    if len(y) < 10 * folds or any(y[part != k].min() == y[part != k].max() for k in range(folds)):
        return model
    for k in range(folds):
        out = np.flatnonzero(part == k)
        own = fit([rows[i] for i in np.flatnonzero(part != k)], y[part != k], grams, unit, bayes, l2)
        raw[out] = [own.weights[rows[i]].sum(dtype=float) / (max(1, len(rows[i])) ** 0.5 if unit else 1) + own.bias for i in out]
    ones, zeros = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, 1 - 1 / (ones + 2), 1 / (zeros + 2))
    weight = np.where(y == 1, prior / ones, (1 - prior) / zeros)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = v[0] * raw + v[1]
        off = (sigmoid(z) - goal) * weight
        return float(weight @ (np.logaddexp(0, z) - goal * z)) + 1e-6 * float(v @ v), np.array([off @ raw, off.sum()]) + 2e-6 * v

    slope, shift = minimise(loss, np.array([0.5, 0.0]), 100)
    return Model(grams, model.weights, model.bias, unit, float(slope), float(shift))


def share(labels: DataFrame, label: str) -> float:
    """Share of label 1 among the rows that are not held out, kept off 0 and 1."""
    got = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg(label)).first()[0]
    return min(max(float(0.5 if got is None else got), 1e-3), 1 - 1e-3)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as empty text, so it is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, most: int = 1 << 16) -> DataFrame:
    """(doc_id, text, label): up to `each` labelled documents of either label that are not held out, the first by a hash of
    the id, of at most `most` bytes; a longer or missing text teaches nothing. A doc_id that repeats counts once, with its
    first text. The bound lets the ids be broadcast."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("label = 1").orderBy(*order).limit(each).unionAll(known.where("label = 0").orderBy(*order).limit(each))
    short = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= most)
    return short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def features(rows: DataFrame, grams: Grams) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature ids (made on the executors, at most as many a row as sample() allows bytes) and labels, ordered by id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            ids = pa.array([x.astype(np.int32).tobytes() for x in grams.rows(data, offsets)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), ids, part.column(1)], ["doc_id", "ids", "label"])

    got = rows.select("doc_id", "label", "text").mapInArrow(make, "doc_id bigint, ids binary, label int").toArrow()
    got = got.take(pc.sort_indices(got, [("doc_id", "ascending")]))
    return [np.frombuffer(x.as_buffer(), np.int32) for x in got["ids"]], got["label"].to_numpy()
