"""Repeated passages by prefix-free parsing.

A passage of MIN_WORDS words is repeated if the same words stand earlier in the corpus, by (doc_id, position). Two
rolling hashes are at work. The first spreads the corpus: each window of MIN_WORDS words is anchored at its
m-gram of least rolling hash, so equal windows have equal anchors, and only anchors that occur twice go on. What
goes on is highly repetitive: all stretches with the same anchor come to one task. There the second hash ends a
phrase wherever it is 0 modulo TRIGGER, phrases overlap by the trigger's words, and the suffix arrays of the
dictionary of distinct phrases and of the parse combine into the order of all suffixes: a suffix is ordered by the
rest of its phrase, then by the rank of the parse that follows. Neighbours in that order that agree in MIN_WORDS
words are the repeats. An anchor of very many stretches, as a licence line is, is extended to the whole window instead, of which the first place
is an aggregate: no task holds all of them.

A text is known by its doc_id and a hash of itself (text_key), so that rows that share a doc_id are texts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import has, stage

#: Words of a passage that must not stand twice.
MIN_WORDS = 50
#: Words of an anchor; a window has MIN_WORDS - GRAM + 1 of these.
GRAM = 16
#: Stretches of one anchor that a task orders; an anchor with more is thinned out by several tasks and then extended.
HOT = 4096
#: A phrase ends where the rolling hash of CONTEXT words is 0 modulo this.
TRIGGER, CONTEXT = 7, 2


def _doc_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of the rows, hashes) of the words: runs without ASCII white space, as they are written."""
    norm = at.SPACES[data]
    starts, ends, rows = at.tokens(norm, offsets)
    return starts, ends, rows, at.span_hash(at.prefix_sums(norm), starts, ends)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """At i the rightmost place of the least of values[i : i + width]."""
    place = np.arange(len(values))
    best, done = values, 1
    while done < width:
        step = min(done, width - done)
        n = len(best) - step
        right = best[step:] <= best[:n]
        place = np.where(right, place[step:], place[:n])
        best = np.where(right, best[step:], best[:n])
        done += step
    return place


def windows(h: np.ndarray, rows: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, anchors' words, anchors' hashes) of the windows of size words, none across two rows."""
    n = len(h)
    if n < size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = at.sequence_sums(h)
    at_gram = np.arange(n - gram + 1)
    grams = at.span_hash(sums, at_gram, at_gram + gram)
    anchor = _least(grams, size - gram + 1)
    end = np.repeat(rows[1:], np.diff(rows))
    first = np.flatnonzero(np.arange(len(anchor)) + size <= end[: len(anchor)])
    return first, anchor[first], grams[anchor[first]]


def _runs(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past the last) of the runs of equal values."""
    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.empty(0, np.int64)
    return cut, np.append(cut[1:], len(anchor))[: len(cut)]


def _anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = np.asarray(batch.column("doc_id")), np.asarray(batch.column("text_key"))
            for lo, _hi, data, offsets in at.chunks(batch.column("text")):
                _, _, rows, h = _doc_words(data, offsets)
                first, anchor, key = windows(h, rows, size, gram)
                cut, _ = _runs(anchor)
                row = np.searchsorted(rows, first[cut], "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(ids[lo + row]), pa.array(texts[lo + row]), pa.array((anchor[cut] - rows[row]).astype(np.int32))], ["key", "doc_id", "text_key", "at"])

    return docs.mapInArrow(run, "key long, doc_id long, text_key long, at int")


def _stretches(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """(key, doc_id, text_key, at, n, parts, words): for each wanted anchor the first word and the number of its windows, the tasks that thin it out, and the words of all its windows."""

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, wanted = np.asarray(batch.column("doc_id")), np.asarray(batch.column("text_key")), batch.column("wanted")
            for lo, hi, data, offsets in at.chunks(batch.column("text")):
                starts, ends, rows, h = _doc_words(data, offsets)
                first, anchor, key = windows(h, rows, size, gram)
                cut, past = _runs(anchor)
                row = np.searchsorted(rows, first[cut], "right") - 1
                some = wanted.slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), np.diff(np.asarray(some.offsets)))
                flat = some.flatten()
                places = rows[of] + np.asarray(flat.field("at"))
                sort = np.argsort(places)
                keep = np.flatnonzero(np.isin(anchor[cut], places))
                parts = np.asarray(flat.field("parts"))[sort[np.searchsorted(places, anchor[cut][keep], sorter=sort)]] if len(keep) else np.empty(0, np.int32)
                cut, past, row = cut[keep], past[keep], row[keep]
                a, b = first[cut], first[past - 1] + size
                lo_byte, hi_byte = starts[a], ends[b - 1]
                size_b = hi_byte - lo_byte
                out = np.concatenate(([0], np.cumsum(size_b)))
                take = np.repeat(lo_byte - out[:-1], size_b) + np.arange(out[-1])
                words = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(out.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(ids[lo + row]), pa.array(texts[lo + row]), pa.array((a - rows[row]).astype(np.int32)), pa.array((past - cut).astype(np.int32)), pa.array(parts), words], ["key", "doc_id", "text_key", "at", "n", "parts", "words"])

    return texts.mapInArrow(run, "key long, doc_id long, text_key long, at int, n int, parts int, words binary")


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks."""
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1]))) if len(key) else 0
    return out


def _pair(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One sortable word of two ranks."""
    return (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def suffix_ranks(values: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of values[i : end[i]], or of their first reach values, by prefix doubling: equal ones share a rank, a prefix comes before what it begins."""
    rank = _ranks(values)
    span = 1
    i = np.arange(len(values))
    while span < reach and len(values) and (end - i).max() > span:
        follow = np.where(i + span < end, rank[np.minimum(i + span, len(values) - 1)] + 1, 0)
        rank = _ranks(_pair(rank, follow))
        span *= 2
    return rank


def corpus_order(h: np.ndarray, rows: np.ndarray, size: int, modulus: int = TRIGGER, context: int = CONTEXT) -> np.ndarray:
    """The words of the rows in the order of the suffixes that begin there, by at least their first size words, from the suffix arrays of
    the dictionary and of the parse. Words are ordered by their hashes, a row's end before any word."""
    n = len(h)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    end = rows[1:][row]
    sums = at.sequence_sums(h)
    i = np.arange(n)
    hit = np.zeros(n, bool)
    if n >= context:
        rolling = at.span_hash(sums, i[: n - context + 1], i[: n - context + 1] + context)
        hit[: n - context + 1] = rolling % np.uint64(modulus) == 0
    hit &= i + context <= end
    hit[rows[:-1][rows[:-1] < rows[1:]]] = True
    start = np.flatnonzero(hit)  # phrases begin at a row's begin and at triggers, and end with the next trigger's words or the row
    past = np.append(start[1:], n)
    tail = np.where(past < end[start], past + context, end[start])
    tail = np.minimum(tail, end[start])
    name = at.mix(at.span_hash(sums, start, tail) + (tail - start).astype(np.uint64))
    _, pick, phrase = np.unique(name, return_index=True, return_inverse=True)
    # dictionary: distinct phrases one after another; ranks of all their suffixes
    length = (tail - start)[pick]
    base = np.concatenate(([0], np.cumsum(length)))
    inside = np.arange(base[-1]) - np.repeat(base[:-1], length)
    words = h[np.repeat(start[pick], length) + inside]
    dict_rank = suffix_ranks(words, np.repeat(base[1:], length), size)
    # parse: phrases by the rank of their whole text; ranks of its suffixes up to each row's end
    whole = dict_rank[base[:-1]][phrase]
    last = np.searchsorted(start, rows[1:])[row[start]]
    parse_rank = suffix_ranks(whole, last, size)
    # a word's suffix: the rest of its phrase, then the parse from the next phrase on
    of = np.searchsorted(start, i, "right") - 1
    alpha = dict_rank[base[phrase[of]] + (i - start[of])]
    follow = np.where(of + 1 < last[of], parse_rank[np.minimum(of + 1, len(start) - 1)] + 1, 0)
    return np.argsort(_pair(alpha, follow))


def _text_ranks(doc: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row's text by doc_id and text_key, a row of each rank)."""
    order = np.lexsort((text, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def _repeats(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, first occurrence's text and word) of the repeated windows among stretches with one anchor or several, texts by rank; a row of each rank."""
    data, offsets = _bytes_of(table)
    _, _, rows, h = _doc_words(data, offsets)
    doc, texts, begin, count = (np.asarray(table.column(c)).astype(np.int64) for c in ("doc_id", "text_key", "at", "n"))
    doc, a_row = _text_ranks(doc, texts)
    order = corpus_order(h, rows, size)
    row = np.searchsorted(rows, order, "right") - 1
    at_word = order - rows[row]
    is_window = at_word < count[row]
    order, row, at_word = order[is_window], row[is_window], at_word[is_window]
    sums = at.sequence_sums(h)
    same = at.span_hash(sums, order, order + size)
    group = np.cumsum(np.concatenate(([False], same[1:] != same[:-1]))) if len(same) else np.empty(0, np.int64)
    by_place = np.lexsort((begin, doc))
    base = np.empty(len(doc), np.int64)
    base[by_place] = np.concatenate(([0], np.cumsum(count[by_place])))[:-1]
    by = np.argsort(_pair(group, base[row] + at_word))
    group, d, p = group[by], doc[row][by], (begin[row] + at_word)[by]
    head = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(head) else np.empty(0, np.int64)
    again = (d != d[first]) | (p != p[first])
    return d[again], p[again], d[first][again], p[first][again], a_row


def _bytes_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("words").cast(pa.large_binary()).combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(doc: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows as the least number of spans: (doc, first word, past the last, place of the first window)."""
    order = np.lexsort((word, doc))
    d, p = doc[order], word[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + size))) if len(d) else np.empty(0, bool)
    cut = np.flatnonzero(new)
    past = np.append(cut[1:], len(d))[: len(cut)]
    return d[cut], p[cut], p[past - 1] + size, order[cut]


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) of the rows that have both."""
    few = has(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return few.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


def repeated_words(docs: DataFrame, size: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, begin, end, of_doc_id, of_begin): word spans, end excluded, that repeat earlier words; spans of one text may touch or overlap.

    of_doc_id and of_begin are an earlier place of the span's first window.
    """
    few = texts_of(docs)
    anchors = stage(_anchors(few, size, gram), "anchors")
    # counted by an aggregate, whose parts are combined before the shuffle, and joined: the commonest anchor isn't one task's work
    counts = stage(anchors.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    parts = F.ceil(F.col("c") / HOT).cast("int").alias("parts")
    wanted = anchors.join(counts, "key").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", parts)).alias("wanted"))
    stretches = _stretches(few.join(wanted, ["doc_id", "text_key"]), size, gram)

    def solve(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held)
        doc, word, of_doc, of_word, a_row = _repeats(table, size)
        d, a, b, w = _spans(doc, word, size)
        ids, texts = table.column("doc_id").to_numpy(), table.column("text_key").to_numpy()
        return _found(ids[a_row[d]], texts[a_row[d]], a, b, ids[a_row[of_doc[w]]], of_word[w])

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        bytes_held, key = 0, None
        for batch in batches:  # sorted by key: a key's stretches are solved together, whatever batches they come in
            doc, text, begin, n, of_doc, of_text, of_at = (np.asarray(batch.column(c)) for c in ("doc_id", "text_key", "at", "n", "of_doc_id", "of_text_key", "of_at"))
            copy = (doc != of_doc) | (text != of_text) | (begin != of_at)
            if copy.any():
                yield _found(*[x[copy] for x in (doc, text, begin, begin + n + np.int32(size - 1), of_doc, of_at)])
            table = pa.Table.from_batches([batch]).filter(pa.array(~copy))
            later = table.column("parts").to_numpy() > 1
            if later.any():  # the first of equal stretches in this part; the parts' firsts meet by their windows
                for left in table.filter(pa.array(later)).to_batches():
                    yield _left(left)
                table = table.filter(pa.array(~later))
            step = max(1, table.num_rows * _SOLVE_BYTES // max(1, table.nbytes))
            for piece in (table.slice(i, step) for i in range(0, table.num_rows, step)):
                keys = piece.column("key").to_numpy()
                lo = 0
                if held and bytes_held > _SOLVE_BYTES:
                    cut = int(np.searchsorted(keys, key, "right"))
                    held.append(piece.slice(0, cut))
                    lo = cut
                    if cut < len(keys):
                        yield solve(held)
                        held, bytes_held = [], 0
                if lo < len(keys):
                    held.append(piece.slice(lo))
                    bytes_held += held[-1].nbytes
                    key = keys[-1]
        if held:
            yield solve(held)

    # of stretches that are equal word for word all but the first are copies, and need no order
    equal = W.partitionBy("key", "part", "n", F.xxhash64("words")).orderBy("doc_id", "text_key", "at")
    parted = stretches.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("long"))).repartition("key", "part")
    firsts = parted.withColumns({f"of_{c}": F.first(c).over(equal) for c in ("doc_id", "text_key", "at")})
    found = stage(firsts.sortWithinPartitions("key", "part").mapInArrow(run, _ROUND), "spans")
    spans = found.where("words is null").select(*_SPAN)
    hottest = counts.agg(F.max("c")).first()[0] or 0
    return spans.unionByName(_extended(found.where("words is not null"), size)) if hottest > HOT else spans


_SPAN = ["doc_id", "text_key", "begin", "end", "of_doc_id", "of_begin"]
#: Spans, with words null; or stretches of hot anchors, whose windows are counted in "end".
_ROUND = "doc_id long, text_key long, begin int, end int, of_doc_id long, of_begin int, words binary"
_ROUND_NAMES = [*_SPAN, "words"]


def _extended(stretches: DataFrame, size: int) -> DataFrame:
    """Spans of hot anchors' stretches, by each window's hash: the windows but for the first of each, which an aggregate gives."""

    @at.tidy
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(pa.Table.from_batches([batch]))
            _, _, rows, h = _doc_words(data, offsets)
            n, begin = np.asarray(batch.column("end")).astype(np.int64), np.asarray(batch.column("begin"))
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = rows[row] + within
            key = at.span_hash(at.sequence_sums(h), first, first + size)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)), pa.array((begin[row] + within).astype(np.int32))], ["window", "doc_id", "text_key", "at"])

    own = stage(stretches.mapInArrow(each, "window long, doc_id long, text_key long, at int"), "windows")
    place = F.struct("doc_id", "text_key", "at")
    first = stage(own.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "firsts")
    again = own.join(first, "window").where(place != F.col("first"))
    return again.select("doc_id", "text_key", F.col("at").alias("begin"), (F.col("at") + size).alias("end"), F.col("first.doc_id").alias("of_doc_id"), F.col("first.at").alias("of_begin"))


def _found(doc: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, of_doc: np.ndarray, of_begin: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(doc), pa.array(text), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(of_doc), pa.array(of_begin.astype(np.int32)), pa.nulls(len(doc), pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, _ROUND_NAMES)


def _left(rows: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(rows.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), rows.column("at"), rows.column("n"), none, none.cast(pa.int32()), rows.column("words").cast(pa.binary())], _ROUND_NAMES)


#: Stretches of so many bytes, and the rest of their last key, are solved at once.
_SOLVE_BYTES = 1 << 20


def _merged(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(doc_id, text_key, begin_word, end_word, of_doc_id, of_begin_word): spans that touch or overlap as one."""
    place = W.partitionBy("doc_id", "text_key").orderBy("begin", "end")
    before = place.rowsBetween(W.unboundedPreceding, -1)
    spans = repeated_words(docs, size, gram)
    marked = spans.withColumn("new", F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(place))
    first = lambda c: F.min_by(c, F.struct("begin", "of_doc_id", "of_begin"))
    return marked.groupBy("doc_id", "text_key", "span").agg(F.min("begin").alias("begin_word"), F.max("end").alias("end_word"), first("of_doc_id").alias("of_doc_id"), first("of_begin").alias("of_begin_word")).drop("span")


def repeats(docs: DataFrame, size: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, begin_word, end_word, of_doc_id, of_begin_word): the maximal word spans, end excluded, of which every window of size
    words stands earlier in the corpus, and an earlier place of the first window.

    Words are what ASCII white space parts, and compare as they are written. Null ids and texts, and texts of fewer than size words, empty ones among
    them, have no spans. Rows of one doc_id and different texts are texts of their own, in the order of a hash of the text, each with its spans; equal rows
    of one doc_id count as one text. Of equal passages the one of the least doc_id and place stays. A very long text is worked on whole. An empty table
    gives an empty result; other columns, whatever their names, are ignored.
    """
    return _merged(docs, size, gram).drop("text_key")


def _cut(data: np.ndarray, offsets: np.ndarray, spans: pa.Array) -> list[str | None]:
    starts, ends, rows, _ = _doc_words(data, offsets)
    out: list[str | None] = []
    for r in range(len(offsets) - 1):
        text = data[offsets[r] : offsets[r + 1]].tobytes()
        kept, done = [], 0
        for s in sorted((x["begin_word"], x["end_word"]) for x in spans[r].as_py()):
            lo = starts[rows[r] + s[0]] - offsets[r]
            kept.append(text[done:lo])
            done = starts[rows[r] + s[1]] - offsets[r] if rows[r] + s[1] < rows[r + 1] else len(text)
        left = b"".join([*kept, text[done:]])
        out.append(left.decode("utf-8") if left.strip() else None)
    return out


def dedup(docs: DataFrame, size: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """docs with each repeated passage cut out but for where it stands first; n_chars, if there is one, follows. A text of which nothing is left goes.

    Rows without a repeat, null ids and null and empty texts stay as they are. Each row is cut by its own text's spans, whatever other rows share its doc_id;
    equal rows of one doc_id are cut alike. An empty table gives an empty one; other columns, whatever their names, stay as they are.
    """
    found = _merged(docs, size, gram).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin_word", "end_word")).alias("spans"))
    names, schema = docs.columns, docs.schema
    text, doc = (f"c{names.index(c)}" for c in ("text", "doc_id"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of theirs is of any matter here
    side = found.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), "spans")
    joined = plain.join(side, (F.col(doc).cast("long") == F.col("of_doc")) & (F.xxhash64(text) == F.col("of_text")), "left").select(*plain.columns, "spans")

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            some = np.flatnonzero(np.asarray(spans.is_valid()))
            here = pa.RecordBatch.from_arrays(batch.columns[:-1], plain_names)
            rest = here.filter(spans.is_null())
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays(rest.columns, names)
            if not len(some):
                continue
            cut = here.take(pa.array(some))
            of = spans.take(pa.array(some))
            texts: list[str | None] = []
            for lo, hi, data, offsets in at.chunks(cut.column(text)):
                texts += _cut(data, offsets, of.slice(lo, hi - lo))
            new = {text: pa.array(texts, cut.column(text).type)}
            if "n_chars" in names:
                count = f"c{names.index('n_chars')}"
                new[count] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cut.column(count).type)
            yield pa.RecordBatch.from_arrays([new.get(c, cut.column(c)) for c in plain_names], names).filter(pa.array([t is not None for t in texts]))

    plain_names = plain.columns
    return joined.mapInArrow(run, schema)


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x00\t\n\x0b\x0c\r\x1c-\x1f ]+') AS w FROM documents WHERE doc_id IS NOT NULL),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {MIN_WORDS}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - {MIN_WORDS} + 1)) AS i FROM d WHERE len(w) >= {MIN_WORDS})),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
cut AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MIN_WORDS} THEN 0 ELSE 1 END AS new FROM again),
island AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM cut)
SELECT doc_id, CAST(min(i) AS INTEGER) AS begin_word, CAST(max(i) + {MIN_WORDS} AS INTEGER) AS end_word FROM island GROUP BY doc_id, s
"""
