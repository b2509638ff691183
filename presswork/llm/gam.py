"""Quality by a generalised additive model with pairwise interactions.

Features are binned. Boosting goes round the features in turn, again and again; each turn fits a shallow tree on one
feature's bins to the gradient and adds a small part of it to that feature's lookup table. Then the pairs whose grids
would still gain most are boosted in the same way. A score is the sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import has

FEATURES = ["log_bytes", "upper", "digit", "stop", "sign", "space", "line_ends", "word_bytes", "beyond_ascii", "distinct_words", "words_a_line", "wordless", "distinct_lines", "sign_ended", "longest_word", "capitals"]
#: Labelled rows that the model is fitted on at most; the bound doesn't follow the corpus.
TRAIN_ROWS = 8000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 40, 0.15, 3
#: A document is kept from this probability of good quality on.
KEEP = 0.5

_UPPER, _LOWER, _DIGIT, _STOP, _SIGN, _SPACE, _HIGH = range(7)


def _classes() -> np.ndarray:
    table = np.full(256, _SIGN, np.uint8)
    table[65:91], table[97:123], table[48:58], table[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
    table[[ord(c) for c in ".,;:?'"]] = _STOP
    table[np.flatnonzero(at.SPACES == 0)] = _SPACE
    return table


_CLASS = _classes()
_LINES = np.arange(256, dtype=np.uint8)
_LINES[[0, 10]] = 1, 0


def _distinct(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct hashes in each row."""
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows))
    key = np.sort((row << np.uint64(48)) | (h >> np.uint64(16)))
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
    return np.bincount((key[new] >> np.uint64(48)).astype(np.int64), minlength=len(rows) - 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x FEATURES of UTF-8 rows; all 0 for an empty one."""
    kind = _CLASS[data]
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    of = {}
    for c in range(7):
        of[c] = np.diff(np.searchsorted(np.flatnonzero(kind == c), offsets))
    norm = at.SPACES[data]
    starts, ends, rows = at.tokens(norm, offsets)
    words = np.diff(rows)
    many = np.maximum(words, 1)
    length = ends - starts
    h = at.span_hash(at.prefix_sums(norm), starts, ends)
    lines = _LINES[data]
    ls, le, lrows = at.tokens(lines, offsets)
    nlines = np.diff(lrows)
    lh = at.span_hash(at.prefix_sums(lines), ls, le)
    letter = np.concatenate(([0], np.cumsum((kind == _UPPER) | (kind == _LOWER) | (kind == _HIGH))))
    upper = np.concatenate(([0], np.cumsum(kind == _UPPER)))
    letters = letter[ends] - letter[starts]
    last = kind[ends - 1] if len(ends) else kind[:0]
    longest = np.zeros(len(words))
    full = np.flatnonzero(words)
    if len(full):
        longest[full] = np.maximum.reduceat(length, rows[:-1][full])
    share = lambda hit: at.row_sums(hit.astype(np.int64), rows) / many
    return np.stack(
        [np.log1p(size), of[_UPPER] / some, of[_DIGIT] / some, of[_STOP] / some, of[_SIGN] / some, of[_SPACE] / some, np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets)) / some,
         at.row_sums(length, rows) / many, of[_HIGH] / some, _distinct(h, rows) / many, words / np.maximum(nlines, 1), share(letters == 0), _distinct(lh, lrows) / np.maximum(nlines, 1),
         share(last == _SIGN), np.log1p(longest), share((upper[ends] - upper[starts] == letters) & (letters > 1))], axis=1)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """The values on the bins of a tree with so many leaves, each cut where it gains most (Newton steps)."""
    cuts = [0, len(grad)]
    g, h = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(hess)))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(cuts) <= leaves:
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:]):
            c = np.arange(a + 1, b)
            if len(c):
                won = gain(a, c) + gain(c, b) - gain(a, b)
                k = int(won.argmax())
                best = max(best, (float(won[k]), int(c[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _grid(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """(values, gain) of the best tree of depth two on a grid: one cut along an axis, one along the other on either side."""
    best = (np.zeros_like(grad), 0.0)
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        for cut in range(1, g.shape[0]):
            out, gain = np.zeros_like(g), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = g[part].sum(0), h[part].sum(0)
                values = _tree(gs, hs, 2)
                out[part] = values
                gain += float((2 * values * gs - values**2 * (hs + 0.0)).sum())
            if gain > best[1] + 1e-9:
                best = (out.T.copy() if flip else out, gain)
    return best


class Gam:
    """Cut points, a lookup table for each feature, and grids for pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        edge = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
        self.cuts, self.coarse = edge(BINS), edge(PAIR_BINS)
        bins = [np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)]
        rough = [np.searchsorted(c, v, "right") for c, v in zip(self.coarse, x.T)]
        rate = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        score = np.full(len(y), self.base)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                g, h = slope()
                n = len(self.tables[j])
                step = RATE * np.clip(_tree(np.bincount(b, g, n), np.bincount(b, h, n), LEAVES), -4, 4)
                self.tables[j] += step
                score += step[b]
        g, h = slope()
        gains = []
        for i, j in combinations(range(len(bins)), 2):
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            flat = rough[i] * shape[1] + rough[j]
            gains.append((_grid(np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape))[1], (i, j), shape, flat))
        chosen = sorted(gains, key=lambda z: (-z[0], z[1]))[:PAIRS]
        self.pairs, self.grids = [z[1] for z in chosen], [np.zeros(z[2]) for z in chosen]
        for _ in range(PAIR_ROUNDS):
            for k, (_, _, shape, flat) in enumerate(chosen):
                g, h = slope()
                step = RATE * np.clip(_grid(np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape))[0], -4, 4)
                self.grids[k] += step
                score += step.ravel()[flat]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for c, t, v in zip(self.cuts, self.tables, x.T):
            score += t[np.searchsorted(c, v, "right")]
        for (i, j), grid in zip(self.pairs, self.grids):
            score += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-score))


def labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, text, quality) of at most about bound labelled documents, chosen by the ids' hashes; a doc_id whose labels differ has the greater."""
    own = has(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    share = min(1.0, bound / max(1, own.count()))
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).withColumnRenamed("doc_id", "_labelled")
    few = has(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    return few.join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "quality")  # bounded by `bound`


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Gam | None:
    """The model; none where no document is labelled."""

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in at.chunks(batch.column("text")):
                rows = features(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), batch.column("quality").slice(lo, hi - lo).cast(pa.int32()), flat], ["doc_id", "quality", "x"])

    table = labelled(docs, labels, bound).mapInArrow(run, "doc_id long, quality int, x array<double>").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by("doc_id")
    x = np.array(table.column("x").combine_chunks().flatten()).reshape(table.num_rows, len(FEATURES))
    return Gam(x, table.column("quality").to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """(doc_id, quality, keep) for every row of docs: the probability of good quality, and whether it reaches keep.

    A null or empty text scores as an empty one; a very long one is measured whole. Without any labelled document quality is null and every row is kept.
    Labels without a document, and nulls in them, count for nothing; of labels of one doc_id that differ the greater counts, and rows that share the id are
    examples each. Of cuts or pairs that gain the same the last cut and the first pair is taken, values on a cut belong above it, and a probability
    that equals keep is kept. A null doc_id is carried along; repeated rows score alike; an empty table gives an empty result; other columns, whatever
    their names, are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Gam | None = model.value
        for batch in batches:
            for lo, hi, data, offsets in at.chunks(batch.column("text")):
                p = own.probability(features(data, offsets)) if own else np.full(hi - lo, np.nan)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(p, mask=np.isnan(p)), pa.array(~(p < keep))], ["doc_id", "quality", "keep"])

    return has(docs, "doc_id", "text").mapInArrow(run, "doc_id long, quality double, keep boolean")
