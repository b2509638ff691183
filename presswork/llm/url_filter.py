"""URLs against a block list that is kept as sorted digest arrays.

Each entry's 64-bit xxHash stands in a sorted array, with the entry's full string beside it. The arrays are files in the shared folder; tasks map them into
memory, probe them by vectorised binary search and compare the stored string wherever a digest is found, so that a collision blocks nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import has, new_path, stage

#: Entries of one array.
SHARD_ENTRIES = 1_000_000
#: Up to so many bytes of arrays every task maps all of them and URLs stay where they are; of more, the URLs' keys are shuffled by array, and a task maps the arrays of its own keys.
MAP_BYTES = 4 << 30
#: Arrays that a worker keeps mapped.
OPEN_ARRAYS = 64

_HOST, _REST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)"


def _parts(url: Column) -> tuple[Column, Column, Column]:
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    rest = F.regexp_extract(url, _REST, 1)
    slashless = lambda c: F.regexp_replace(c, "/+$", "")
    return host, slashless(rest), slashless(F.regexp_extract(rest, r"^([^?]*)", 1))


def entry_key(entry: Column) -> Column:
    """An entry (URL, host with path, or host alone) as it is stored: host in lower case, then path and query, no scheme, user, port, fragment or last slash."""
    host, rest, _ = _parts(F.when(entry.contains("//"), entry).otherwise(F.concat(F.lit("//"), entry)))
    return F.when(host == "", F.lit(None)).otherwise(F.concat(host, rest))


def probe_keys(url: Column) -> Column:
    """The keys that block a URL, the most exact first: all of it, without its query, its host, and each parent domain of two labels or more."""
    host, rest, path = _parts(url)
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(F.concat(host, rest), F.concat(host, path)), domains)))


def _write(path: str, body: bytes) -> None:
    """A whole file or none, whichever attempt of a task writes it."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    name = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(name) as out:
        out.write(body)
    fs.move(name, at)


class DigestArray:
    """One file: the number of entries, their digests in order, the offsets of their strings, and the strings."""

    def __init__(self, path: str) -> None:
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            body = np.memmap(unquote(urlsplit(path).path), np.uint8, "r")
        else:  # a store without files to map: read once for each worker
            with fs.open_input_file(at) as f:
                body = np.frombuffer(f.read(), np.uint8)
        n = int(body[:8].view(np.int64)[0])
        self.digests = body[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = body[8 + 8 * n : 16 + 16 * n].view(np.int64)
        self.strings = body[16 + 16 * n :]

    @staticmethod
    def pack(digests: np.ndarray, strings: list[bytes]) -> bytes:
        order = sorted(range(len(strings)), key=lambda i: (int(digests[i]), strings[i]))
        sizes = np.array([len(strings[i]) for i in order], np.int64)
        return b"".join([np.int64(len(order)).tobytes(), digests[order].tobytes(), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64).tobytes(), *[strings[i] for i in order]])

    def find(self, digests: np.ndarray, strings: list[bytes | None]) -> np.ndarray:
        """Whether each string is stored. Strings are looked at only where their digest is."""
        left, right = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        out = np.zeros(len(digests), bool)
        for i in np.flatnonzero(right > left):
            out[i] = any(self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == strings[i] for k in range(left[i], right[i]))
        return out


_OPEN: dict[str, DigestArray] = {}


def _opened(path: str, keep: int = OPEN_ARRAYS) -> DigestArray:
    if path not in _OPEN:
        while len(_OPEN) >= keep:
            del _OPEN[next(iter(_OPEN))]
        _OPEN[path] = DigestArray(path)
    return _OPEN[path]


def build(entries: DataFrame) -> tuple[dict[int, str], int, int]:
    """(path of each shard's array, bits of a digest that choose the shard, bytes of all arrays)."""
    spark = entries.sparkSession
    keys = stage(entries.select(entry_key(F.col("entry")).alias("key")).where("key is not null").distinct().withColumn("digest", F.xxhash64("key")), "entries")
    bits = max(0, int(np.ceil(np.log2(max(1, keys.count()) / SHARD_ENTRIES))))
    shard = F.shiftrightunsigned("digest", 64 - bits).cast("int") if bits else F.lit(0)
    folder = new_path(spark, "digests")

    def write(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        path = f"{folder}/{number}"
        body = DigestArray.pack(table.column("digest").to_numpy().view(np.uint64), [x.encode() for x in table.column("key").to_pylist()])
        _write(path, body)
        return pa.table({"shard": pa.array([number], pa.int32()), "path": [path], "bytes": pa.array([len(body)], pa.int64())})

    written = keys.withColumn("shard", shard).groupBy("shard").applyInArrow(write, "shard int, path string, bytes long").collect()  # one row for each array
    return {r["shard"]: r["path"] for r in written}, bits, sum(r["bytes"] for r in written)


def blocked(pages: DataFrame, entries: DataFrame, map_bytes: int = MAP_BYTES) -> DataFrame:
    """(page_id, url, blocked_by, keep) for every row of pages: the most exact entry (column entry) that blocks the URL, or null, and whether there is none.

    A null, empty or hostless URL has no key and is kept. Null, empty and repeated entries count for nothing more. Of several entries that block a URL the most
    exact one is named. Repeated rows are judged alike; very long URLs are compared whole; an empty table gives an empty result, an empty list keeps
    everything; other columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    few = has(pages, "page_id", "url")
    paths, bits, size = build(has(entries, "entry"))
    if size > map_bytes:
        return _by_array(few, paths, bits)
    shards = spark.sparkContext.broadcast(paths)  # names of files, one for each SHARD_ENTRIES entries

    @at.tidy
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            n = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(lists)), n)
            strings = [None if x is None else x.encode() for x in lists.flatten().to_pylist()]
            digests = np.asarray(batch.column("digests").flatten()).view(np.uint64)
            at = (digests >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(digests), np.int64)
            hit = np.zeros(len(digests), bool)
            for number in np.unique(at):
                if int(number) in shards.value:
                    own = np.flatnonzero(at == number)
                    hit[own] = _opened(shards.value[int(number)]).find(digests[own], [strings[i] for i in own])
            found = np.flatnonzero(hit)
            by = np.full(len(lists), None, object)
            for i in found[::-1]:  # the first hit of a row is written last
                by[row[i]] = strings[i].decode()
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(by, pa.string()), pa.array([x is None for x in by])], ["page_id", "url", "blocked_by", "keep"])

    hashed = few.withColumn("keys", probe_keys(F.col("url"))).withColumn("digests", F.transform("keys", lambda k: F.xxhash64(k)))
    return hashed.mapInArrow(probe, "page_id long, url string, blocked_by string, keep boolean")


def _by_array(pages: DataFrame, paths: dict[int, str], bits: int) -> DataFrame:
    """The same for lists that no task should map whole: the keys of distinct URLs go to the task of their array, which probes it in the same way."""
    shards = pages.sparkSession.sparkContext.broadcast(paths)
    urls = pages.select("url").where("url is not null").distinct()
    probes = urls.select("url", F.posexplode(probe_keys(F.col("url"))).alias("pos", "key")).withColumn("digest", F.xxhash64("key"))
    probes = probes.withColumn("shard", F.shiftrightunsigned("digest", 64 - bits).cast("int") if bits else F.lit(0))

    @at.tidy
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_shard, digests = np.asarray(batch.column("shard")), np.asarray(batch.column("digest")).view(np.uint64)
            for number in np.unique(at_shard):
                if int(number) in shards.value:
                    own = np.flatnonzero(at_shard == number)
                    strings = [x.encode() for x in batch.column("key").take(pa.array(own)).to_pylist()]
                    hit = own[_opened(shards.value[int(number)], 1).find(digests[own], strings)]
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hit)) for c in ("url", "pos", "key")], ["url", "pos", "key"])

    hits = probes.repartition("shard").sortWithinPartitions("shard").mapInArrow(probe, "url string, pos int, key string")
    by = hits.groupBy("url").agg(F.min_by("key", "pos").alias("blocked_by")).withColumnRenamed("url", "_url")
    return pages.join(by, F.col("url") == F.col("_url"), "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "blocked_by", F.col("blocked_by").isNull().alias("keep"))


def sample_list(pages: DataFrame) -> DataFrame:
    """A block list for the synthetic pages, which come without one: whole URLs, URLs without their query, and hosts of some of them."""
    p, url = F.col("page_id"), F.col("url")
    host, _, path = _parts(url)
    entry = F.when(F.pmod(p, F.lit(20)) == 3, url).when(F.pmod(p, F.lit(20)) == 11, F.concat(host, path)).when(F.pmod(p, F.lit(50)) == 7, host)
    return pages.select(entry.alias("entry")).where("entry is not null")


_H = f"lower(regexp_extract(url, '{_HOST}', 1))"
_R = f"regexp_replace(regexp_extract(url, '{_REST}', 1), '/+$', '')"
_P = f"regexp_replace(regexp_extract(regexp_extract(url, '{_REST}', 1), '^([^?]*)', 1), '/+$', '')"
SQL = f"""
WITH p AS (SELECT page_id, url, {_H} AS host, {_R} AS rest, {_P} AS path FROM pages),
list AS (
  SELECT DISTINCT host || rest AS key FROM p WHERE page_id % 20 = 3 AND host <> ''
  UNION SELECT DISTINCT host || path FROM p WHERE page_id % 20 = 11 AND host <> ''
  UNION SELECT DISTINCT host FROM p WHERE page_id % 20 NOT IN (3, 11) AND page_id % 50 = 7 AND host <> ''
),
probes AS (
  SELECT page_id, url, 0 AS pos, host || rest AS key FROM p WHERE host <> ''
  UNION ALL SELECT page_id, url, 1, host || path FROM p WHERE host <> ''
  UNION ALL SELECT page_id, url, 1 + i, array_to_string(string_split(host, '.')[i:], '.')
    FROM (SELECT page_id, url, host, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM p WHERE host <> '')
),
hits AS (SELECT page_id, arg_min(key, pos) AS blocked_by FROM probes JOIN list USING (key) GROUP BY page_id)
SELECT p.page_id, p.url, hits.blocked_by, hits.blocked_by IS NULL AS keep FROM p LEFT JOIN hits ON p.page_id = hits.page_id
"""
