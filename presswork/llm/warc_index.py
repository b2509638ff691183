"""A capture index in global order, by external merging.

Each task sorts the captures that it reads into runs of bounded size and cuts them where key ranges end. For each range a task then merges
its pieces of all runs with a loser tree, by URL key and time, block by block, and numbers the captures of each URL. Ranges follow one another, so the
positions are those of one merge of everything. A URL key of more captures than a range is cut by time too; what goes on over such a cut is carried on
afterwards from the ranges' ends.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import bounded_batches, stage

#: Captures of a run, and about as many of a range.
RUN_ROWS, RANGE_ROWS = 200_000, 1_000_000
#: Captures of a run that a merge has in memory at a time, and of what it gives.
BLOCK_ROWS, OUT_ROWS = 8192, 65_536
#: Keys drawn for each range to place the borders, which the driver holds: 40 MB of them for 10 thousand million captures.
DRAWN = 40

_FIELDS = ["urlkey", "captured", "page_id", "url", "digest", "length"]
_ORIGIN, _REST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW][wW][wW][0-9]*\.)?([^/?#:]*)", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)"


def url_key(url: Column) -> Column:
    """The host's labels from the last on, joined by commas, then ")" and path and query in lower case: no scheme, "www", port, fragment or last slash. Empty where there is no host."""
    host = F.lower(F.regexp_extract(url, _ORIGIN, 1))
    rest = F.regexp_replace(F.lower(F.regexp_extract(url, _REST, 1)), "/+$", "")
    return F.when(F.coalesce(host, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), rest))


def captured_at(page_id: Column) -> Column:
    """Seconds at which the synthetic pages count as captured: they carry no time of their own."""
    return (F.lit(1704067200) + F.pmod(F.pmod(page_id, F.lit(31536000)) * 7919, F.lit(31536000))).cast("long")


def captures(pages: DataFrame, captured: Column) -> DataFrame:
    return pages.select(url_key(F.col("url")).alias("urlkey"), captured.cast("long").alias("captured"), F.col("page_id").cast("long").alias("page_id"), "url", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("length"))


class LoserTree:
    """k sorted lists of keys; pop() gives the list that holds the least key, of equal ones the first list's, and how many of its keys come before any other's.

    more gives what follows a list that is used up, an empty one where nothing does; it is asked at the next pop.
    """

    def __init__(self, lists: list[list], more: Callable[[int], list] | None = None) -> None:
        self.lists, self.at, self.more, self.moved = lists, [0] * len(lists), more, -1
        self.k = max(1, len(lists))
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _less(self, a: int, b: int) -> bool:
        """Whether list a's next key comes before list b's; a list that is done comes last."""
        if a < 0 or a >= len(self.lists) or self.at[a] >= len(self.lists[a]):
            return False
        if b < 0 or b >= len(self.lists) or self.at[b] >= len(self.lists[b]):
            return True
        x, y = self.lists[a][self.at[a]], self.lists[b][self.at[b]]
        return x < y or x == y and a < b

    def _play(self, node: int) -> int:
        """The winner below node, whose losers are noted on the way; leaves are k to 2k - 1."""
        order, stack, won = [], [node], {}
        while stack:
            n = stack.pop()
            if n < self.k:
                order.append(n)
                stack += [2 * n, 2 * n + 1]
        for n in reversed(order):
            a, b = (won.get(c, c - self.k) if c < self.k else c - self.k for c in (2 * n, 2 * n + 1))
            won[n], self.losers[n] = (b, a) if self._less(b, a) else (a, b)
        return won.get(node, 0)

    def pop(self) -> tuple[int, int, int] | None:
        """(list, first, past the last) of the next keys."""
        if self.moved >= 0:
            self._replay(self.moved)
        w = self.winner
        if not self.lists or self.at[w] >= len(self.lists[w]):
            return None
        # the runner-up lost to the winner somewhere on its way up
        second, node = -1, (w + self.k) // 2
        while node:
            if self._less(self.losers[node], second):
                second = self.losers[node]
            node //= 2
        own, begin = self.lists[w], self.at[w]
        if second < 0:
            past = len(own)
        else:
            key = self.lists[second][self.at[second]]
            past = bisect_right(own, key, begin) if w < second else begin + 1
            if w > second:
                while past < len(own) and own[past] < key:
                    past += 1
            past = max(past, begin + 1)
        self.at[w], self.moved = past, w
        return w, begin, past

    def _replay(self, w: int) -> None:
        if self.more and self.at[w] >= len(self.lists[w]):
            self.lists[w], self.at[w] = self.more(w), 0
        best, node, self.moved = w, (w + self.k) // 2, -1
        while node:
            if self._less(self.losers[node], best):
                best, self.losers[node] = self.losers[node], best
            node //= 2
        self.winner = best


def merge_order(runs: list[list]) -> list[tuple[int, int, int]]:
    tree, out = LoserTree(runs), []
    while piece := tree.pop():
        out.append(piece)
    return out


_LOW, _HIGH = -(2**63), 2**63 - 1


def _keys(table: pa.Table) -> list[tuple]:
    null_first = lambda c: pc.fill_null(table.column(c), _LOW).to_pylist()
    text = lambda c: [(x is not None, x.encode() if x else b"") for x in table.column(c).to_pylist()]
    return list(zip([x.encode() for x in table.column("urlkey").to_pylist()], null_first("captured"), null_first("page_id"), text("url"), text("digest")))


def _sorted(table: pa.Table) -> tuple[pa.Table, list[tuple]]:
    keys = _keys(table)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return table.take(pa.array(order, pa.int64())), [keys[i] for i in order]


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.combine_chunks(), max_chunksize=BLOCK_ROWS)
    return sink.getvalue().to_pybytes()


def _blocks(runs: list[pa.Buffer]) -> Iterator[pa.Table]:
    """Slices of the runs in the order of their merge. Of each run one block is in memory."""
    readers = [pa.ipc.open_stream(x) for x in runs]
    blocks: list[pa.Table | None] = [None] * len(runs)

    def more(k: int) -> list[tuple]:
        for batch in readers[k]:
            blocks[k] = pa.Table.from_batches([batch])
            return _keys(blocks[k])
        return []

    tree = LoserTree([more(k) for k in range(len(runs))], more)
    while piece := tree.pop():
        k, a, b = piece
        yield blocks[k].slice(a, b - a)


def _in_batches(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
    held: list[pa.Table] = []
    count = 0
    for x in slices:
        held.append(x)
        count += x.num_rows
        if count >= OUT_ROWS:
            yield pa.concat_tables(held).combine_chunks()
            held, count = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


_HISTORY = "position long, urlkey string, captured long, page_id long, url string, digest string, length long, capture_no long, since_previous long, changed boolean"


def borders_of(drawn: list[tuple], ranges: int) -> tuple[list[tuple], set[bytes]]:
    """(borders, keys that are cut): quantiles of (urlkey, captured, page_id); a border lies behind its whole urlkey, unless that has several."""
    if not drawn or ranges < 2:
        return [], set()
    at_rank = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)]
    hot = {a[0] for a, b in zip(at_rank, at_rank[1:]) if a[0] == b[0]}
    return sorted({k if k[0] in hot else (k[0], _HIGH, _HIGH) for k in at_rank}), hot


def history(pages: DataFrame, captured: Column) -> DataFrame:
    """(position, urlkey, captured, page_id, url, digest, length, capture_no, since_previous, changed): all captures by urlkey, captured and page_id.

    position counts from 1 through all captures, capture_no within a urlkey; since_previous is in seconds, null for the first; changed says that the
    digest isn't the previous capture's. A null or hostless url has the urlkey ""; a null time or page_id comes before any other; a null html has a null
    digest, which equals a null digest; an empty one has the digest of nothing. Ties go by url and digest; repeated rows are captures each. Very long texts
    count by digest and length alone. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    rows = captures(pages, captured)
    n = pages.count()
    ranges = max(1, -(-n // RANGE_ROWS), min(n // 1000, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounded_batches(pages.sparkSession)
    few = pages.select(url_key(F.col("url")).alias("k"), F.coalesce(captured.cast("long"), F.lit(_LOW)).alias("c"), F.coalesce(F.col("page_id").cast("long"), F.lit(_LOW)).alias("p"))
    drawn = few.where(F.pmod(F.xxhash64("k", "c", "p"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, DRAWN * ranges / max(n, 1))))
    borders, cut_keys = borders_of(sorted((r["k"].encode(), r["c"], r["p"]) for r in drawn.collect()) if ranges > 1 else [], ranges)  # about DRAWN keys for each range

    @at.tidy
    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run() -> pa.RecordBatch:
            table, keys = _sorted(pa.Table.from_batches(held))
            cuts = [0, *(bisect_right(keys, b, key=lambda k: k[:3]) for b in borders), len(keys)]
            some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in some], pa.int32()), pa.array([b - a for _, a, b in some], pa.int64()), pa.array([_pack(table.slice(a, b - a)) for _, a, b in some], pa.binary())], ["range", "n", "run"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= RUN_ROWS:
                yield run()
                held = []
        if held:
            yield run()

    runs = stage(rows.mapInArrow(sort_runs, "range int, n long, run binary"), "runs")
    sizes = {r["range"]: r["n"] for r in runs.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one number for each range
    base, before = {}, 0
    for i in sorted(sizes):
        base[i], before = before, before + sizes[i]

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for part in parts:
            number = part.column("range")[0].as_py()
            held += [x.as_buffer() for x in part.column("run")]
        place, last = base[number], None
        for merged in _in_batches(_blocks(held)):
            m = merged.num_rows
            key, digest, time = merged.column("urlkey"), pc.fill_null(merged.column("digest"), ""), merged.column("captured")
            same = np.zeros(m, bool)
            same[1:] = pc.equal(key.slice(1), key.slice(0, m - 1)).to_numpy(zero_copy_only=False)
            changed = ~same
            changed[1:] |= pc.not_equal(digest.slice(1), digest.slice(0, m - 1)).to_numpy(zero_copy_only=False)
            order = np.arange(m)
            first = np.maximum.accumulate(np.where(same, 0, order))
            number_of = order - first + 1
            before = pc.if_else(pa.array(same), time.take(pa.array(np.maximum(order - 1, 0))), pa.scalar(None, pa.int64())).combine_chunks()
            if last is not None and key[0].as_py() == last[0]:  # the batch before ended within this key
                number_of[: int(np.searchsorted(first, 0, "right"))] += last[3]
                changed[0] = digest[0].as_py() != last[2]
                before = pa.concat_arrays([pa.array([last[1]], pa.int64()), before.slice(1)])
            last = (key[m - 1].as_py(), time[m - 1].as_py(), digest[m - 1].as_py(), int(number_of[-1]))
            columns = {"position": pa.array(place + order + 1), **{c: merged.column(c) for c in _FIELDS}, "capture_no": pa.array(number_of), "since_previous": pc.subtract(time, before), "changed": pa.array(changed)}
            place += m
            yield from pa.table(columns).combine_chunks().to_batches()
        at.release()

    merged = runs.groupBy("range").applyInArrow(merge, _HISTORY)
    return _carried(stage(merged, "merged"), base) if cut_keys else merged


def _carried(merged: DataFrame, base: dict[int, int]) -> DataFrame:
    """merged, whose captures of a urlkey that was cut count on from the ranges before."""
    starts = sorted(base.values())
    at_ends = F.col("position").isin([x for a in starts for x in (a, a + 1)])
    by = {r["position"]: r for r in merged.where(at_ends).select("position", "urlkey", "captured", "digest", "capture_no").collect()}  # two rows for each range
    fixes, carried, begun = [], 0, None
    for a, b in zip(starts, [*starts[1:], _HIGH]):
        first, last = by[a + 1], by.get(a)
        goes_on = last is not None and last["urlkey"] == first["urlkey"]
        carried = (last["capture_no"] + (carried if last["urlkey"] == begun else 0)) if goes_on else 0
        begun = first["urlkey"]
        if goes_on:
            fixes.append((a + 1, b, first["urlkey"], carried, last["captured"], last["digest"]))
    if not fixes:
        return merged
    fix = merged.sparkSession.createDataFrame(fixes, "_begin long, _end long, _key string, _carried long, _time long, _digest string")
    joined = merged.join(fix, (F.col("urlkey") == F.col("_key")) & F.col("position").between(F.col("_begin"), F.col("_end")), "left")
    first = F.col("position") == F.col("_begin")
    return joined.select(
        *["position", *_FIELDS], (F.col("capture_no") + F.coalesce("_carried", F.lit(0))).alias("capture_no"),
        F.when(first, F.col("captured") - F.col("_time")).otherwise(F.col("since_previous")).alias("since_previous"),
        F.when(first, ~F.col("digest").eqNullSafe(F.col("_digest"))).otherwise(F.col("changed")).alias("changed"),
    )


SQL = f"""
WITH c AS (
  SELECT CASE WHEN coalesce(regexp_extract(url, '{_ORIGIN}', 1), '') = '' THEN ''
    ELSE array_to_string(list_reverse(string_split(lower(regexp_extract(url, '{_ORIGIN}', 1)), '.')), ',') || ')'
      || regexp_replace(lower(regexp_extract(url, '{_REST}', 1)), '/+$', '') END AS urlkey,
    1704067200 + ((page_id * 7919) % 31536000 + 31536000) % 31536000 AS captured, page_id, url, sha1(html) AS digest, CAST(strlen(html) AS BIGINT) AS length
  FROM pages
), o AS (
  SELECT *, row_number() OVER all_of AS position, row_number() OVER k AS capture_no, lag(captured) OVER k AS p, lag(digest) OVER k AS pd
  FROM c WINDOW all_of AS (ORDER BY urlkey, captured NULLS FIRST, page_id NULLS FIRST), k AS (PARTITION BY urlkey ORDER BY captured NULLS FIRST, page_id NULLS FIRST)
)
SELECT position, urlkey, captured, page_id, url, digest, length, capture_no, captured - p AS since_previous, capture_no = 1 OR digest IS DISTINCT FROM pd AS changed FROM o
"""
