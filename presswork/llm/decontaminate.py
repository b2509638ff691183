"""Benchmark passages in documents, by one Aho-Corasick automaton over the normalised questions and answers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import filter_texts, has

#: Words of a benchmark text that count as a leak when they stand together; a shorter text counts as a whole.
WINDOW = 8
#: A text of fewer words than this counts only where it is all that a document says.
LEAST_WORDS = 3
#: Characters of patterns that one automaton holds (about 50 bytes each in a worker); beyond it, the benchmark's items are spread over several,
#: each with a scan of its own. An item of more has an automaton to itself.
MAX_PATTERN_CHARS = 16_000_000

_SPACE, _EDGE = 32, 10
#: Code points from here on are private, tags or unassigned: signs.
_BEYOND = 0x32400


def folded(text: str) -> str:
    """text in compatibility composition and without case: ligatures, widths, decomposed accents and sharp s as what they stand for."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def _is_word(char: str) -> bool:
    return unicodedata.category(char)[0] in "LMN"


class _Folds:
    """Tables by code point: the character it folds to alone (a space for what isn't a letter, mark or number), whether it may join the one before, and whether it folds to several."""

    def __init__(self) -> None:
        self.alone = np.full(0x110000, _SPACE, np.uint32)
        self.joins, self.several = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        self.joins[0x1160:0x1200] = True  # Hangul vowels and finals
        for c in range(_BEYOND):
            ch = chr(c)
            if unicodedata.combining(ch):
                self.joins[c] = True
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<":
                self.joins[int(parts[1], 16)] = True
            if _is_word(ch):
                to = folded(ch)
                self.several[c] = len(to) != 1
                self.alone[c] = ord(to) if len(to) == 1 else c
        self.strings: dict[str, np.ndarray] = {}

    def cluster(self, text: str) -> np.ndarray:
        """The characters that a letter and what joins it fold to."""
        if text not in self.strings:
            if len(self.strings) > 1 << 16:
                self.strings.clear()
            to = folded(text) if _is_word(text[0]) else " " + text[1:]
            self.strings[text] = np.array([ord(c) if _is_word(c) else _SPACE for c in to] or [_SPACE], np.uint32)
        return self.strings[text]


_FOLDS: list[_Folds] = []


def fold(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded characters, for each the first and past the last of the points it comes from, offsets of the rows in these)."""
    if not _FOLDS:
        _FOLDS.append(_Folds())
    own = _FOLDS[0]
    n = len(points)
    joins = own.joins[points]
    joins[rows[:-1][rows[:-1] < n]] = False
    odd = joins | own.several[points]
    if not odd.any():
        return own.alone[points], np.arange(n), np.arange(1, n + 1), rows
    start = np.flatnonzero(~joins)
    end = np.append(start[1:], n)
    slow = np.flatnonzero(np.add.reduceat(odd, start))
    size = np.ones(len(start), np.int64)
    made = [own.cluster(points[start[k] : end[k]].tobytes().decode("utf-32-le", "replace")) for k in slow]
    size[slow] = [len(x) for x in made]
    before = np.concatenate(([0], np.cumsum(size)))
    out = np.repeat(own.alone[points[start]], size)
    if len(slow):
        out[np.repeat(before[slow], size[slow]) + np.arange(size[slow].sum()) - np.repeat(np.cumsum(size[slow]) - size[slow], size[slow])] = np.concatenate(made)
    return out, np.repeat(start, size), np.repeat(end, size), before[np.searchsorted(start, rows)]


def normalise(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, first and past the last of the points each comes from). Runs of what isn't a letter or number are one space; each row is " words ", between line ends, which
    nothing else in a row is.

    A row's own edges take the place of its first or last point.
    """
    whole, edges = len(points), rows
    points, begin, end, rows = fold(points, rows)
    n, count = len(points), len(rows) - 1
    shift = 3 * np.arange(count)  # a line end and a space before each row, and a space after it
    out = np.full(n + 3 * count + 1, _SPACE, np.uint32)
    place, past = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
    sizes = np.diff(rows)
    to = np.arange(n) + np.repeat(shift, sizes) + 2
    out[to], place[to], past[to] = points, begin, end
    begins = rows[:-1] + shift
    out[begins] = _EDGE
    out[-1] = _EDGE
    place[begins] = place[begins + 1] = edges[:-1]
    place[rows[1:] + shift + 2] = edges[1:]
    place[-1] = whole
    keep = np.ones(len(out), bool)
    keep[1:] = ~((out[1:] == _SPACE) & (out[:-1] == _SPACE))
    return out[keep], place[keep], past[keep]


def normalised(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    chars, _, _ = normalise(points, np.array([0, len(points)]))
    return chars[1:-1].tobytes().decode("utf-32-le").strip()


def patterns(items: list[tuple[int, str]], window: int = WINDOW, least: int = LEAST_WORDS) -> dict[str, list[int]]:
    """The items of each pattern. Every pattern begins and ends at a word's edge."""
    out: dict[str, set[int]] = {}
    for item, text in items:
        words = normalised(text).split()
        if not words:
            continue
        if len(words) < least:
            out.setdefault(f"\n {' '.join(words)} \n", set()).add(item)
        for i in range(max(1, len(words) - window + 1)) if len(words) >= least else ():
            out.setdefault(f" {' '.join(words[i : i + window])} ", set()).add(item)
    return {k: sorted(v) for k, v in out.items()}


def parts(items: Iterator[tuple[int, str]], window: int = WINDOW, least: int = LEAST_WORDS) -> Iterator[dict[str, list[int]]]:
    """The patterns of items, sorted by item, in dictionaries of MAX_PATTERN_CHARS; an item's patterns stay together."""
    part: dict[str, list[int]] = {}
    chars = 0
    for _, same in groupby(items, lambda x: x[0]):
        own = patterns(list(same), window, least)
        more = sum(len(k) for k in own if k not in part)
        if part and chars + more > MAX_PATTERN_CHARS:
            yield part
            part, chars, more = {}, 0, sum(map(len, own))
        for k, v in own.items():
            part.setdefault(k, []).extend(v)
        chars += more
    if part:
        yield part


_BUILT: dict[int, ahocorasick.Automaton] = {}


def _automaton(shared) -> ahocorasick.Automaton:
    """One for each worker process and benchmark."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        machine = ahocorasick.Automaton()
        for pattern, items in shared.value.items():
            machine.add_word(pattern, (len(pattern), items))
        machine.make_automaton()
        _BUILT[shared.id] = machine
    return _BUILT[shared.id]


class _Shared:
    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, start, end): stretches of documents, in characters of the original text, end excluded, that hold window or more
    words running of a benchmark text, or all of a text of least to window - 1 words; case, signs, spacing and the way a letter is encoded (composed or not,
    ligature, width) don't count.

    Windows of an item that overlap or touch are one stretch. A text of fewer than least words leaks only where a document says nothing else.
    Null and empty texts and items, and a null item_id, have no leaks; a null doc_id is carried along; repeated rows give the same rows
    again; passages that several items share are stretches of each. A very long text is scanned whole. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    found = [_leaks_of(docs, shared) for shared in _shared(docs, benchmark, window, least)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _LEAK)


_LEAK = "doc_id long, item_id long, start long, end long"


def _shared(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST_WORDS) -> list[_Shared]:
    items = ((r["item_id"], r["text"]) for r in has(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id").toLocalIterator())
    return [_Shared(docs.sparkSession.sparkContext.broadcast(part)) for part in parts(items, window, least)]


def _leaks_of(docs: DataFrame, shared: _Shared) -> DataFrame:
    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for lo, _hi, data, offsets in at.chunks(batch.column("text")):
                row, item, start, end = _scan(_automaton(shared), data, offsets)
                if len(row):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + row)), pa.array(item), pa.array(start), pa.array(end)], ["doc_id", "item_id", "start", "end"])

    return has(docs, "doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, _LEAK)


_NONE = (np.empty(0, np.int64),) * 4


def _scan(machine: ahocorasick.Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, start, end) of the rows' stretches."""
    if not len(machine):
        return _NONE
    points, rows = at.code_points(data, offsets)
    chars, place, past_of = normalise(points, rows)
    hits = [(end, size, item) for end, (size, items) in machine.iter(chars.tobytes().decode("utf-32-le")) for item in items]
    if not hits:
        return _NONE
    end, size, item = np.array(hits, np.int64).T
    # a pattern's own edges aren't part of the stretch: its first letter to its last
    lead = np.where(chars[end - size + 1] == _EDGE, 2, 1)
    trail = np.where(chars[end] == _EDGE, 2, 1)
    a, b = place[end - size + 1 + lead], past_of[end - trail]
    row = np.searchsorted(rows, a, "right") - 1
    order = np.lexsort((b, a, item, row))
    row, item, a, b = row[order], item[order], a[order], b[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    group = np.cumsum(new) - 1
    base = int(points.size) + 2
    far = np.maximum.accumulate(b + group * base) - group * base  # the furthest end so far within the row and item
    new[1:] |= a[1:] > far[:-1]
    cut = np.flatnonzero(new)
    past = np.append(cut[1:], len(row)) - 1
    return row[cut], item[cut], a[cut] - rows[row[cut]], far[past] - rows[row[cut]]


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text leaks finds something in.

    Each row is judged by its own text, whatever rows share its doc_id; null and empty texts stay, as do all rows where the benchmark is empty. An empty table
    gives an empty one; other columns, whatever their names, stay as they are.
    """
    for x in _shared(docs, benchmark):
        docs = _free_of(docs, x)
    return docs


def _free_of(docs: DataFrame, shared: _Shared) -> DataFrame:
    def judge(texts: pa.Array) -> np.ndarray:
        keep = np.ones(len(texts), bool)
        for lo, _hi, data, offsets in at.chunks(texts):
            keep[lo + _scan(_automaton(shared), data, offsets)[0]] = False
        return keep

    return filter_texts(docs, judge)


_WORD = r"[\p{L}\p{M}\p{N}]+"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w, string_split_regex(text, '{_WORD}') AS g FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(w) AS word, unnest(g[:len(w)]) AS gap, unnest(range(1, len(w) + 1)) AS i FROM d),
pos AS (SELECT doc_id, i, len(word) AS n, sum(len(gap) + len(word)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k : k + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM b WHERE len(w) >= {LEAST_WORDS})
),
grams AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))
),
hits AS (
  SELECT doc_id, item_id, k, k + n - 1 AS l FROM grams JOIN p USING (n, gram)
  UNION ALL SELECT doc_id, item_id, 1, len(d.w) FROM d JOIN b ON d.w = b.w WHERE len(b.w) BETWEEN 1 AND {LEAST_WORDS} - 1
),
spans AS (SELECT h.doc_id, item_id, CAST(a.e - a.n AS BIGINT) AS s, CAST(z.e AS BIGINT) AS e FROM hits h JOIN pos a ON a.doc_id = h.doc_id AND a.i = h.k JOIN pos z ON z.doc_id = h.doc_id AND z.i = h.l),
cut AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id, item_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spans),
island AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM cut)
SELECT doc_id, item_id, min(s) AS "start", max(e) AS "end" FROM island GROUP BY doc_id, item_id, k
"""
