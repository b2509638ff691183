"""Quality by logistic regression on hashed word and character n-grams, calibrated, and fixed thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrowtext as at
from .gam import labelled
from .shared import has

#: Labelled rows that the model is fitted on at most; the bound doesn't follow the corpus.
TRAIN_ROWS = 2000
#: Each kind of n-gram has 2 ** HASH_BITS weights.
HASH_BITS = 17
WORD_ORDERS, CHAR_ORDERS = (1, 2), (2, 4)
#: Every HELD_OUT-th row calibrates.
HELD_OUT = 4
STEPS, RATE, RIDGE = 60, 0.5, 1e-6
#: Below LOW a document is bad, from HIGH on it is good; it is kept from KEEP on.
LOW, KEEP, HIGH = 0.3, 0.5, 0.7

GROUPS = len(WORD_ORDERS) + len(CHAR_ORDERS)
_MULTIPLY, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - HASH_BITS)


def hashed(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram (slots, first of each row, past the last of each row). n-grams that would cross rows lie between those."""
    norm = at.SPACES[data]
    starts, ends, rows = at.tokens(norm, offsets)
    h = at.span_hash(at.prefix_sums(norm), starts, ends)
    for group, order in enumerate(WORD_ORDERS):
        g = h[: max(0, len(h) - order + 1)].copy()
        for j in range(1, order):
            g = g * _MULTIPLY + h[j : len(h) - order + 1 + j]
        yield ((g * _MULTIPLY) >> _SHIFT).astype(np.int64) + (group << HASH_BITS), *_ranges(rows, order, len(g))
    points, rows = at.code_points(data, offsets)
    c = at.mix(points.astype(np.uint64))
    for group, order in enumerate(CHAR_ORDERS, len(WORD_ORDERS)):
        g = c[: max(0, len(c) - order + 1)].copy()
        for j in range(1, order):
            g = g * _MULTIPLY + c[j : len(c) - order + 1 + j]
        yield ((g * _MULTIPLY) >> _SHIFT).astype(np.int64) + (group << HASH_BITS), *_ranges(rows, order, len(g))


def _ranges(rows: np.ndarray, order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.minimum(rows[:-1], n)
    return begin, np.maximum(begin, np.minimum(rows[1:] - order + 1, n))


class Rules:
    """Weights of the slots, and the line that calibrates their sum."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> None:
        held = np.arange(len(y)) % HELD_OUT == HELD_OUT - 1
        if held.sum() < 2:
            held[:] = False
        self.weights, self.bias, self.a, self.b = np.zeros(GROUPS << HASH_BITS), 0.0, 1.0, 0.0
        train = np.flatnonzero(~held)
        idx, val = np.concatenate([slots[i] for i in train]), np.concatenate([values[i] for i in train])
        sizes = np.array([len(slots[i]) for i in train])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        row = np.repeat(np.arange(len(train)), sizes)
        good = np.clip(y[train].mean(), 0.02, 0.98)
        importance = np.where(y[train] > 0, 0.5 / good, 0.5 / (1 - good))  # both classes weigh alike; calibration takes that back
        squares, bias_squares = np.full(len(self.weights), 1e-12), 1e-12
        for _ in range(STEPS):
            z = at.row_sums(self.weights[idx] * val, offsets) + self.bias
            off = importance * (1 / (1 + np.exp(-z)) - y[train]) / len(train)
            g = np.bincount(idx, val * off[row], len(self.weights)) + RIDGE * self.weights
            squares += g * g
            bias_squares += off.sum() ** 2
            self.weights -= RATE * g / np.sqrt(squares)
            self.bias -= RATE * off.sum() / np.sqrt(bias_squares)
        cal = np.flatnonzero(held) if held.any() else train
        z = np.array([self.weights[slots[i]] @ values[i] for i in cal]) + self.bias
        # targets drawn in from 0 and 1, so that a line exists where the classes are apart
        n1, n0 = y[cal].sum(), (1 - y[cal]).sum()
        target = np.where(y[cal] > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        loss = lambda a, b: float((np.logaddexp(0, a * z + b) - target * (a * z + b)).sum())
        now = loss(self.a, self.b)
        for _ in range(50):  # Newton's steps, halved until they help: whole ones run past the least loss where the sums are far from a line
            p = 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([(p - target) @ z, (p - target).sum()])
            hess = np.array([[(w * z) @ z + 1e-3, w @ z], [w @ z, w.sum() + 1e-3]])
            da, db = np.clip(np.linalg.solve(hess, g), -2, 2)
            while max(abs(da), abs(db)) > 1e-9 and loss(self.a - da, self.b - db) > now:
                da, db = da / 2, db / 2
            if max(abs(da), abs(db)) <= 1e-9:
                break
            self.a, self.b = self.a - da, self.b - db
            now = loss(self.a, self.b)
        self.weights = self.weights.astype(np.float32)

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        for slots, begin, end in hashed(data, offsets):
            total = np.zeros(len(slots) + 1)
            np.cumsum(self.weights[slots], out=total[1:], dtype=np.float64)
            z += (total[end] - total[begin]) / np.maximum(end - begin, 1)
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -50, 50)))


def _bag(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One text's slots and their shares among the n-grams of their kind."""
    slots, values = [], []
    for s, begin, end in hashed(data, offsets):
        u, c = np.unique(s[begin[0] : end[0]], return_counts=True)
        slots.append(u)
        values.append(c / max(1, end[0] - begin[0]))
    return np.concatenate(slots), np.concatenate(values)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Rules | None:
    """The model; none where no document is labelled."""

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y = batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist()
            for lo, hi, data, offsets in at.chunks(batch.column("text")):
                bags = [_bag(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(y[lo:hi], pa.int32()), pa.array([s.astype(np.int32).tobytes() for s, _ in bags], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in bags], pa.binary())], ["doc_id", "quality", "slots", "shares"])

    table = labelled(docs, labels, bound).mapInArrow(run, "doc_id long, quality int, slots binary, shares binary").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by("doc_id")
    slots = [np.frombuffer(x.as_buffer(), np.int32) for c in table.column("slots").chunks for x in c]
    shares = [np.frombuffer(x.as_buffer(), np.float32) for c in table.column("shares").chunks for x in c]
    return Rules(slots, shares, table.column("quality").to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, probability, verdict, keep) for every row of docs: verdict is bad, unsure or good by LOW and HIGH, keep goes by KEEP.

    A null or empty text has no n-grams and scores the bias alone; a very long one is read whole. Without any labelled document probability and verdict are
    null and every row is kept. Labels without a document, and nulls in them, count for nothing; of labels of one doc_id that differ the greater counts, and
    rows that share the id are examples each. A probability that equals a threshold reaches it. A null doc_id is carried along; repeated rows score
    alike; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Rules | None = model.value
        for batch in batches:
            for lo, hi, data, offsets in at.chunks(batch.column("text")):
                p = own.probability(data, offsets) if own else np.full(hi - lo, np.nan)
                none = np.isnan(p)
                verdict = np.where(p < LOW, "bad", np.where(p < HIGH, "unsure", "good")).astype(object)
                verdict[none] = None
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(p, mask=none), pa.array(verdict, pa.string()), pa.array(~(p < KEEP))], ["doc_id", "probability", "verdict", "keep"])

    return has(docs, "doc_id", "text").mapInArrow(run, "doc_id long, probability double, verdict string, keep boolean")
