"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import filter_texts, has

#: Characters of the longest n-gram, and the discount of every order.
ORDER, DISCOUNT = 4, 0.75
#: Labelled documents that a language's model is fitted on and calibrated with; the bound doesn't follow the corpus.
TRAIN_DOCS = 400
#: Every HELD_OUT-th of them calibrates the rejection.
HELD_OUT = 4
#: A text is rejected beyond LIMIT spreads of its language, or more where the held-out scores' TAIL quantile lies beyond a normal one's (TAIL_NORMAL).
#: Centre, spread and quantile bear wrong labels on nearly a tenth of the held-out documents.
LIMIT, TAIL, TAIL_NORMAL = 12.0, 0.9, 1.2816
#: Median of absolute deviations to standard deviation.
_MAD = 1.4826

_SPACE, _DIGIT, _OTHER = 1, 2, 3


#: Code points from here on are private, tags or unassigned: signs.
_BEYOND = 0x32400


def _fold_table() -> np.ndarray:
    """Letters and marks of all planes in lower case; white space, digits and all else (signs) as one symbol each."""
    table = np.full(0x110000, _OTHER, np.uint32)
    for c in range(_BEYOND):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if ch.isspace() or kind[0] in "ZC":
            table[c] = _SPACE
        elif kind[0] in "LM":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
        elif kind[0] == "N":
            table[c] = _DIGIT
    return table


_FOLD: list[np.ndarray] = []


def fold(points: np.ndarray) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    return _FOLD[0][points]


class HashArray:
    """Sorted 64-bit hashes of n-grams; a probe is a binary search that a table of leading bits has narrowed to a few places."""

    def __init__(self, keys: np.ndarray) -> None:
        hashes = at.mix(keys)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(len(keys) + 1))) + 2))
        self.begin = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in the order of the hashes, -1 where one is absent."""
        hashes = at.mix(keys)
        lead = (hashes >> self.shift).astype(np.int64)
        place, end = self.begin[lead], self.begin[lead + 1]
        out = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(place < end)
        place, end, hashes = place[left], end[left], hashes[left]
        while len(left):
            hit = self.hashes[place] == hashes
            out[left[hit]] = place[hit]
            place = place + 1
            go = ~hit & (place < end)
            left, place, end, hashes = left[go], place[go], end[go], hashes[go]
        return out


_STEP = np.uint64(at.BASE)


def rolling(stream: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 to order the 64-bit hashes of the k characters that end at each place, whatever their code points; the first k - 1 places mean nothing."""
    one = at.mix(stream.astype(np.uint64))
    out = [one]
    for _ in range(1, order):
        longer = one.copy()
        longer[1:] += out[-1][:-1] * _STEP
        out.append(longer)
    return out


class Models:
    """For each order the n-grams of all languages in one hash array, with every language's log probabilities beside them."""

    def __init__(self, streams: dict[str, list[np.ndarray]], order: int = ORDER, discount: float = DISCOUNT) -> None:
        self.order, self.langs = order, sorted(streams)
        n, size = len(self.langs), len(np.unique(np.concatenate([np.concatenate(s) for s in streams.values()]))) + 2
        # of each language and order: n-grams, their counts, and the hashes of what stands before their last character and after their first
        grams: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for lang in self.langs:
            hashes = rolling(np.concatenate(streams[lang]), order)
            sizes = np.array([len(s) for s in streams[lang]])
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            grams[lang] = []
            for k in range(1, order + 1):
                place = np.flatnonzero(within >= min(k, order - 1))
                if k < order:  # below the highest order an n-gram counts the characters seen before it
                    place = place[np.unique(hashes[k][place], return_index=True)[1]]
                keys, first, c = np.unique(hashes[k - 1][place], return_index=True, return_counts=True)
                place, none = place[first], np.zeros(len(keys), np.uint64)
                grams[lang].append((keys, c, hashes[k - 2][place - 1] if k > 1 else none, hashes[k - 2][place] if k > 1 else none))
        self.arrays: list[HashArray] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[HashArray] = []
        self.backoff: list[np.ndarray] = []
        below_keys, below = np.zeros(1, np.uint64), np.full((1, n), 1.0 / size)
        for k in range(1, order + 1):
            keys, first = np.unique(np.concatenate([grams[lang][k - 1][0] for lang in self.langs]), return_index=True)
            heads_of, tails_of = (np.concatenate([grams[lang][k - 1][x] for lang in self.langs])[first] for x in (2, 3))
            heads = np.unique(heads_of)
            p, gamma = np.zeros((len(keys), n)), np.ones((len(heads), n))
            for i, lang in enumerate(self.langs):
                own, c, own_heads, _ = grams[lang][k - 1]
                head = np.searchsorted(heads, own_heads)
                total, kinds = np.bincount(head, c, len(heads)), np.bincount(head, minlength=len(heads))
                seen = total > 0
                gamma[seen, i] = discount * kinds[seen] / total[seen]
                p[np.searchsorted(keys, own), i] = np.maximum(c - discount, 0) / total[head]
            p += gamma[np.searchsorted(heads, heads_of)] * below[np.searchsorted(below_keys, tails_of)]
            array, context = HashArray(keys), HashArray(heads)
            self.arrays.append(array)
            self.logs.append(np.log2(p[array.order]).astype(np.float32))
            self.contexts.append(context)
            self.backoff.append(np.log2(gamma[context.order]).astype(np.float32))
            below_keys, below = keys, p
        self.unseen = np.float32(np.log2(1.0 / size))

    def log_probability(self, stream: np.ndarray) -> np.ndarray:
        """log2 of each character after the order - 1 before it, from the first that has so many, characters x languages."""
        lead = self.order - 1
        n = max(0, len(stream) - lead)
        out = np.zeros((n, len(self.langs)), np.float32)
        if not n:
            return out
        hashes = rolling(stream, self.order)
        left = np.arange(n)
        for k in range(self.order, 0, -1):
            place = self.arrays[k - 1].find(hashes[k - 1][left + lead])
            hit = place >= 0
            if hit.all() and len(left) == n:
                return self.logs[k - 1][place]
            out[left[hit]] += self.logs[k - 1][place[hit]]
            left = left[~hit]
            if not len(left):
                return out
            head = self.contexts[k - 1].find(hashes[k - 2][left + lead - 1] if k > 1 else np.zeros(len(left), np.uint64))
            known = head >= 0
            out[left[known]] += self.backoff[k - 1][head[known]]
        out[left] += self.unseen
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits a character for each row and language, characters, letters) of UTF-8 rows; white space runs count as one character."""
        points, rows = at.code_points(data, offsets)
        stream, rows, letters = squeeze(points, rows)
        lead = self.order - 1
        # each row's first characters have the padding that squeeze puts before a row as their context
        logs = self.log_probability(stream)
        begin, end = rows[:-1], np.maximum(rows[1:] - lead, rows[:-1])
        total = np.zeros((len(begin), len(self.langs)))
        some = np.flatnonzero(end > begin)
        if len(some):
            cuts = np.stack([begin[some], end[some]], axis=1).ravel()
            if cuts[-1] >= len(logs):
                cuts = cuts[:-1]
            total[some] = np.add.reduceat(logs, cuts, axis=0, dtype=np.float64)[::2]
        n = end - begin
        return -total / np.maximum(n, 1)[:, None], n, letters


def squeeze(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of the rows, each row led by ORDER - 1 spaces, runs of white space as one; rows' offsets in them; letters of each row."""
    folded = fold(points)
    space = folded == _SPACE
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    lead = ORDER - 1
    before = np.concatenate(([0], np.cumsum(keep)))[rows]
    sizes = np.diff(before)
    out_rows = np.concatenate(([0], np.cumsum(sizes + lead)))
    out = np.full(out_rows[-1], _SPACE, np.uint32)
    kept = folded[keep]
    out[np.arange(len(kept)) + np.repeat(lead * np.arange(1, len(rows)), sizes)] = kept
    letters = np.concatenate(([0], np.cumsum(folded > _OTHER)))[rows]
    return out, out_rows, np.diff(letters)


class Identifier:
    """Models and, for each language, the centre, spread and limit by which an entropy is judged."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        fit: dict[str, list[np.ndarray]] = {}
        held: list[tuple[str, str]] = []
        for lang, texts in sorted(samples.items()):
            own = []
            for i, text in enumerate(texts):
                if i % HELD_OUT == HELD_OUT - 1:
                    held.append((lang, text))
                else:
                    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                    own.append(squeeze(*at.code_points(raw, np.array([0, len(raw)])))[0])
            fit[lang] = own
        self.models = Models(fit)
        langs = self.models.langs
        data = np.frombuffer("".join(t for _, t in held).encode("utf-8", "replace"), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t.encode("utf-8", "replace")) for _, t in held]))).astype(np.int64)
        h, n, _ = self.models.entropies(data, offsets) if held else (np.zeros((0, len(langs))), np.zeros(0), None)
        self.mean, self.a, self.b = np.full(len(langs), 0.5 * np.log2(len(langs) + 256)), np.ones(len(langs)), np.full(len(langs), 16.0)
        self.limit = np.full(len(langs), LIMIT)
        calibrated = np.zeros(len(langs), bool)
        for i, lang in enumerate(langs):
            own = np.array([k for k, (x, _) in enumerate(held) if x == lang and n[k] > 0], np.int64)
            if len(own) < 4:
                continue
            e, size = h[own, i], n[own]
            self.mean[i] = np.median(e)
            off = (_MAD * (e - self.mean[i])) ** 2
            self.b[i] = max(1.0, np.median(off * size))  # the spread of a text of n characters has variance a + b / n
            self.a[i] = max(0.01, np.median(off))
            tail = float(np.quantile((e - self.mean[i]) / np.sqrt(self.a[i] + self.b[i] / size), TAIL))
            self.limit[i], calibrated[i] = LIMIT * max(1.0, tail / TAIL_NORMAL), True
        if calibrated.any():
            self.limit[~calibrated] = self.limit[calibrated].max()

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best language's place, its bits a character, bits to the next language, accepted, whether there are letters) of the rows."""
        h, n, letters = self.models.entropies(data, offsets)
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        margin = np.sort(h, axis=1)[:, 1] - least if h.shape[1] > 1 else np.zeros(len(h))
        score = (least - self.mean[best]) / np.sqrt(self.a[best] + self.b[best] / np.maximum(n, 1))
        return best, least, margin, (letters > 0) & (score <= self.limit[best]), letters > 0


def samples(docs: DataFrame, bound: int = TRAIN_DOCS) -> dict[str, list[str]]:
    """At most about bound texts of each language, whole, chosen by the ids' hashes alone; a language has none where all that would be fitted on is blank."""
    labelled = has(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in has(docs, "doc_id", "lang").where("lang is not null and doc_id is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (place < int((1 << 30) * min(1.0, bound / n))))
    out: dict[str, list[str]] = {}
    for r in labelled.where(wanted).select("doc_id", "text", "lang").orderBy("doc_id", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: v for k, v in out.items() if any(not t.isspace() and t for i, t in enumerate(v) if i % HELD_OUT != HELD_OUT - 1)}


def identify(docs: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, language, bits_per_char, margin, accepted) for every row of docs.

    The models are fitted on at most about bound documents of each value of lang. Null, empty and letterless texts have language null
    and aren't accepted; so has every row where no language can be fitted. Characters are those of any plane. A very long
    text is judged whole, as a run of its own. A null doc_id is carried along; rows that repeat are judged alike; ties of entropy go to the language
    that sorts first. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    return has(docs, "doc_id", "text").mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(fitted(docs, bound))), "doc_id long, language string, bits_per_char double, margin double, accepted boolean")


def fitted(docs: DataFrame, bound: int = TRAIN_DOCS) -> Identifier | None:
    found = samples(docs, bound)
    return Identifier(found) if found else None


def _scorer(shared):
    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Identifier | None = shared.value
        for batch in batches:
            for lo, hi, data, offsets in at.chunks(batch.column("text")):
                n = hi - lo
                if own is None:
                    best, bits, margin, good, lettered = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
                    langs = np.array([""], object)
                else:
                    best, bits, margin, good, lettered = own.judge(data, offsets)
                    langs = np.array(own.models.langs, object)
                name = langs[best]
                name[~lettered] = None
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n).cast(pa.int64()), pa.array(name, pa.string()), pa.array(bits, mask=~lettered), pa.array(margin, mask=~lettered), pa.array(good)], ["doc_id", "language", "bits_per_char", "margin", "accepted"])

    return run


def accept(docs: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """docs, all columns as they are, without the rows that identify doesn't accept: null, empty and letterless texts go, and all rows where none is labelled.

    Each row is judged by its own text: rows that repeat or share a doc_id, and null ids, as any others. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, bound))

    def judge(texts: pa.Array) -> np.ndarray:
        good = np.zeros(len(texts), bool)
        if shared.value is not None:
            for lo, hi, data, offsets in at.chunks(texts):
                good[lo:hi] = shared.value.judge(data, offsets)[3]
        return good

    return filter_texts(docs, judge)
