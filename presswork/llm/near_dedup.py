"""SimHash near-duplicates by an LSH forest.

A document's 256-bit SimHash is the weighted majority of its distinct words' hash bits. Several tries hold the
fingerprints under random permutations of the bits. A document climbs in each trie from deep prefixes to shorter
ones until its subtree is as full as LEAF, or the prefix is the shortest with which, over all tries, a pair at the
furthest distance still meets with probability RECALL; that depth follows the corpus' size, and the number of
tries follows from depth and recall. What meets in a leaf is compared on all 256 bits, all pairs, with no cap.

Fingerprints only find candidates: a few long words outvote all others, and long texts share their words without
being copies. Texts are copies by their word pairs alone: of any two in a group of candidates these are compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import BROADCAST_IDS, has, stage, without_ids

BITS, WORDS64 = 256, 4
#: Bits in which two candidates differ at most: a cosine of 0.83 between their word sets.
DISTANCE = 48
#: Least Jaccard similarity of two copies' sets of word pairs (runs of two words; the word itself where there is but one).
SHARE = 0.5
#: Expected share of the pairs at DISTANCE that meet; closer pairs meet more surely.
RECALL = 0.95
#: Fingerprints of a leaf below the deepest level, and of a shuffled subtree.
LEAF, SUBTREE = 256, 4096
#: Fingerprints of a subtree beyond which its leaves of the deepest level are shuffled each for itself. The driver holds such subtrees' numbers: at most one for so many planted fingerprints.
DENSE = 1 << 16
#: Words of the candidates that one task compares; a group of more is cut in blocks, any two of which meet in a task.
TASK_WORDS = 1 << 22
#: Words of the groups of candidates that a task indexes at a time; a larger group is indexed whole.
STEP_WORDS = 1 << 18

FP = [f"f{i}" for i in range(WORDS64)]
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64) for i in range(WORDS64)]
_BLOCK = 80


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words of lower-case UTF-8 rows, their bytes, the rows' offsets in these)."""
    norm, starts, ends, rows = at.words_of(data, offsets)
    return at.span_hash(at.prefix_sums(norm), starts, ends), ends - starts, rows


def simhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints, rows x 4 words, of lower-case UTF-8 rows; all 0 for a row without words. Words of 6 bytes or more weigh 3."""
    return _votes(*word_hashes(data, offsets))


def _votes(h: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = len(rows) - 1
    out = np.zeros((n, WORDS64), np.uint64)
    if not len(h):
        return out
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(rows))
    key = (row << np.uint64(48)) | (h >> np.uint64(17) << np.uint64(1)) | (sizes >= 6).astype(np.uint64)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    row = (key >> np.uint64(48)).astype(np.int64)
    weight = np.where(key & np.uint64(1), np.uint64(3), np.uint64(1))
    word = key & np.uint64((1 << 48) - 1)
    counts = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    blocks = -(-counts // _BLOCK)
    total = int(blocks.sum())
    before = np.concatenate(([0], np.cumsum(blocks)))[:-1]
    at_block = np.repeat(first, blocks) + _BLOCK * (np.arange(total) - np.repeat(before, blocks))
    full = np.flatnonzero(counts)
    weights = np.add.reduceat(weight, first[full]).astype(np.int64)
    votes = np.zeros((len(full), BITS), np.int64)
    for q in range(WORDS64):
        octets = at.mix(word + _SALT[q]).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, j]] * weight, at_block).view(np.uint8).reshape(-1, 8)
            votes[:, 64 * q + 8 * j : 64 * q + 8 * j + 8] = np.add.reduceat(lanes, before[full], axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > weights[:, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(bits).view(np.uint64)
    return out


def sequence_hash(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A hash of each row's words in their order."""
    return at.span_hash(at.sequence_sums(h), rows[:-1], rows[1:])


def word_pairs(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of each row's runs of two words, or of its one word; the rows' offsets in these)."""
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    pair = h.copy()
    pair[:-1] = at.mix(h[:-1] * np.uint64(at.BASE) + h[1:])
    single = n[row] == 1
    pair[single] = h[single]
    keep = np.ones(len(h), bool)
    keep[rows[1:][n > 1] - 1] = False  # a row's last word begins no pair
    pair, row = pair[keep], row[keep]
    order = np.lexsort((pair, row))
    pair, row = pair[order], row[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
    return pair[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(n)))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f0..f3, seq (hash of the words in order), words. A null doc_id or a text without words (null and empty too) has no row: it is nobody's copy."""

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in at.chunks(batch.column("text"), lower=True):
                h, sizes, rows = word_hashes(data, offsets)
                fp = _votes(h, sizes, rows)
                some = np.flatnonzero(np.diff(rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(some)), *[pa.array(fp[some, k].view(np.int64)) for k in range(WORDS64)], pa.array(sequence_hash(h, rows)[some].view(np.int64)), pa.array(np.diff(rows)[some])],
                    ["doc_id", *FP, "seq", "words"],
                )

    few = has(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return few.mapInArrow(run, "doc_id long, f0 long, f1 long, f2 long, f3 long, seq long, words long")


def forest_shape(n: int, distance: int = DISTANCE, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits that the shuffle goes by, deepest level, tries) for n fingerprints: a pair at distance shares a random prefix of depth d with
    probability C(BITS - distance, d) / C(BITS, d)."""
    short = max(0, math.ceil(math.log2(max(n, 1) / SUBTREE)))
    deep = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    p = math.prod((BITS - distance - i) / (BITS - i) for i in range(deep))
    return short, deep, 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _permuted(fp: np.ndarray, trie: int) -> np.ndarray:
    """The first 64 bits of the trie's permutation of the bits, first bit highest."""
    order = np.random.default_rng(7919 * trie + 17).permutation(BITS)[:64]
    key = np.zeros(len(fp), np.uint64)
    for b in order:
        key = (key << np.uint64(1)) | ((fp[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1))
    return key


def _prefix(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits in which each of a differs from each of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(WORDS64):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def _linked(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each row the first row of its component, where rows within distance are linked.

    Exact: a row is held against all rows that come after it but those that are known to be in its component. Once one component has most of what is left, its
    rows are held against the others alone, so that a dense family of rows costs the family times the few others, not its square.
    """
    label, left = np.arange(len(fp)), np.arange(len(fp))
    while len(left) > 1:
        own = label[left]
        counts = np.bincount(own)
        most = int(counts.argmax())
        if 2 * counts[most] > len(left):
            others = left[own != most]
            if not len(others):
                break
            block, columns = left[own == most][: max(1, (1 << 19) // len(others))], others
        else:
            block, columns = left[: max(1, (1 << 19) // len(left))], left
        near = _apart(fp[block], fp[columns]) <= distance
        if columns is left:
            near &= np.arange(len(left))[None, :] > np.arange(len(block))[:, None]
        for i in np.flatnonzero(near.any(axis=1)):
            met = np.unique(label[np.append(columns[near[i]], block[i])])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        left = left[len(block) :] if columns is left else left[~np.isin(left, block)]
    return label


def _leaves(key: np.ndarray, lo: int, hi: int, depth: int, deep: int) -> Iterator[tuple[int, int]]:
    """Ranges of sorted keys: the shortest prefixes with LEAF keys or fewer, or of the deepest level."""
    stack = [(lo, hi, depth)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= LEAF or depth >= deep:
            yield lo, hi
            continue
        bit = np.uint64(63 - depth)
        cut = lo + int(np.searchsorted((key[lo:hi] >> bit) & np.uint64(1), 1))
        stack += [(lo, cut, depth + 1), (cut, hi, depth + 1)]


def links(reps: DataFrame, n: int, distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """Pairs (v, u), u < v, of distinct fingerprints' ids that lie within distance, enough to connect whatever met in a leaf."""
    short, deep, tries = forest_shape(n, distance, recall)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(batch, keys, numbers of the subtrees) for each trie."""
        for batch in batches:
            if batch.num_rows:
                fp = np.stack([np.asarray(batch.column(c)).view(np.uint64) for c in FP], axis=1)
                for t in range(tries):
                    key = _permuted(fp, t)
                    yield batch, key, _prefix(key, short) * tries + t

    @at.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, node in nodes(batches):
            number, n = np.unique(node, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(n)], ["node", "n"])

    own = has(reps, "id", *FP)
    dense = np.empty(0, np.int64)
    if n > DENSE and deep > short:
        found = own.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > DENSE)
        dense = np.sort(found.select("node").toPandas()["node"].to_numpy(np.int64))
    shared = reps.sparkSession.sparkContext.broadcast(dense)

    @at.tidy
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, key, node in nodes(batches):
            split = np.isin(node, shared.value)
            node[split] = -1 - (_prefix(key[split], deep) * tries + node[split] % tries)
            yield pa.RecordBatch.from_arrays([pa.array(node), *batch.columns], ["node", "id", *FP])

    @at.tidy_groups
    def climb(table: pa.Table) -> pa.Table:
        fp = np.stack([table.column(c).to_numpy().view(np.uint64) for c in FP], axis=1)
        ids = table.column("id").to_numpy()
        node = int(table.column("node")[0].as_py())
        key = _permuted(fp, (node if node >= 0 else -1 - node) % tries)
        order = np.lexsort((ids, key))
        fp, ids, key = fp[order], ids[order], key[order]
        below, above = [], []
        for lo, hi in _leaves(key, 0, len(key), short if node >= 0 else deep, deep):
            label = _linked(fp[lo:hi], distance)
            joined = np.flatnonzero(label != np.arange(hi - lo))
            if len(joined):
                a, b = ids[lo:hi][joined], ids[lo:hi][label[joined]]
                below.append(np.minimum(a, b))
                above.append(np.maximum(a, b))
        return pa.table({"v": np.concatenate(above) if above else np.empty(0, np.int64), "u": np.concatenate(below) if below else np.empty(0, np.int64)})

    planted = own.mapInArrow(plant, "node long, id long, f0 long, f1 long, f2 long, f3 long")
    return planted.groupBy("node").applyInArrow(climb, "v long, u long").distinct()


def _least_of(edges: DataFrame) -> DataFrame:
    """(v, u, m): the edges with v's least neighbour. An aggregate, whose parts are combined before the shuffle, and a join: no task holds all edges of a hub."""
    least = edges.groupBy(F.col("v").alias("_v")).agg(F.min("u").alias("m"))
    return edges.join(least, F.col("v") == F.col("_v")).select("v", "u", "m")


def components(pairs: DataFrame) -> DataFrame:
    """(v, root): each id but a component's least one with that least id, by alternating large and small stars until nothing changes."""
    edges = stage(pairs.select("v", "u").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _least_of(both).where("u > v").select(F.col("u").alias("v"), F.least("v", "m").alias("u")).where("v <> u").distinct()
        small = _least_of(large)
        edges = stage(small.select("v", F.col("m").alias("u")).unionByName(small.select(F.col("u").alias("v"), F.col("m").alias("u"))).where("v <> u").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return edges.select("v", F.col("u").alias("root"))
        seen = tuple(now)


def alike(root: np.ndarray, offsets: np.ndarray, pairs: np.ndarray, share: float = SHARE) -> np.ndarray:
    """For each row the first row of its component, where rows of one root that share enough of their word pairs are linked.

    Exact: a row is held against all rows of its root that no component has yet, by an index of these rows' pairs.
    """
    n, size = len(root), np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    key = at.mix(pairs ^ at.mix(root.view(np.uint64))[row])
    order = np.argsort(key, kind="stable")
    keys, rows = key[order], row[order]
    label, free, left, indexed = np.arange(n), np.ones(n, bool), n, n
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed], left, todo = False, left - 1, [seed]
        while todo and left:
            i = todo.pop()
            own = key[offsets[i] : offsets[i + 1]]
            lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
            many = hi - lo
            met, shared = np.unique(rows[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())], return_counts=True)
            new = met[free[met] & (shared >= share * (size[i] + size[met] - shared))]
            label[new], free[new] = seed, False
            left -= len(new)
            todo += new.tolist()
            if 2 * left < indexed:
                still = free[rows]
                keys, rows, indexed = keys[still], rows[still], left
    return label


def _runs_of(cuts: np.ndarray, before: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that begin and end at cuts, of STEP_WORDS words or fewer unless what lies between two cuts has more."""
    lo = 0
    while lo < n:
        k = int(np.searchsorted(cuts, np.searchsorted(before, before[lo] + STEP_WORDS, "right"), "left")) - 1
        hi = int(cuts[k]) if k >= 0 and cuts[k] > lo else int(next((c for c in cuts[np.searchsorted(cuts, lo, "right") :][:1]), n))
        if before[n] - before[lo] <= STEP_WORDS:
            hi = n
        yield lo, hi
        lo = hi


def verified(docs: DataFrame, texts: DataFrame, share: float = SHARE) -> DataFrame:
    """(v, root) as components gives them: of texts (text, a doc_id; seq; words; root, of its group of candidates) each that has a lesser copy, with its component's least one."""
    group = texts.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("n"), F.sum("words").alias("all")).where("n > 1").drop("n")
    few = stage(texts.join(group, F.col("root") == F.col("_root")).drop("_root"), "candidates")
    count, words, most = few.agg(F.count("*"), F.sum("words"), F.max("all")).first()
    large = F.col("all") > TASK_WORDS
    few = few.select(
        F.col("text").alias("id"), "seq", "root",
        F.when(large, F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(-(-(words or 0) // TASK_WORDS) or 1))).alias("node"),
        F.when(large, F.ceil(2 * F.col("all") / TASK_WORDS)).otherwise(1).cast("long").alias("blocks"),
    )

    @at.tidy
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in at.chunks(batch.column("text"), lower=True):
                part = batch.slice(lo, hi - lo)
                h, _, rows = word_hashes(data, offsets)
                found, begins = word_pairs(h, rows)
                column = pa.LargeListArray.from_arrays(pa.array(begins), pa.array(found.view(np.int64)))
                own = pa.array(sequence_hash(h, rows).view(np.int64) == part.column("seq").to_numpy())  # a doc_id may stand for several texts
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "root", "node", "blocks")], column.cast(pa.list_(pa.int64()))], ["id", "root", "node", "blocks", "pairs"]).filter(own)

    @at.tidy_groups
    def compare(table: pa.Table) -> pa.Table:
        ids, root = table.column("id").to_numpy(), table.column("root").to_numpy()
        order = np.lexsort((ids, root))
        size = np.asarray(pc.list_value_length(table.column("pairs"))).astype(np.int64)[order]
        ids, root = ids[order], root[order]
        below, above = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        cuts = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
        for lo, hi in _runs_of(cuts, np.concatenate(([0], np.cumsum(size))), len(ids)):  # a few groups at a time, each whole
            lists = table.column("pairs").take(pa.array(order[lo:hi])).combine_chunks()
            label = alike(root[lo:hi], np.concatenate(([0], np.cumsum(size[lo:hi]))), lists.flatten().to_numpy().view(np.uint64), share)
            joined = np.flatnonzero(label != np.arange(hi - lo))
            above.append(ids[lo:hi][joined])
            below.append(ids[lo:hi][label[joined]])
        return pa.table({"v": np.concatenate(above), "u": np.concatenate(below)})

    side = F.broadcast(few) if count <= BROADCAST_IDS else few
    own = has(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(side, F.col("doc_id").cast("long") == F.col("id")).select("id", "seq", "root", "node", "blocks", "text")
    sets = own.mapInArrow(pairs, "id long, root long, node long, blocks long, pairs array<long>")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sets = sets.select("node", F.least(block, "other").alias("lo"), F.greatest(block, "other").alias("hi"), "id", "root", "pairs")
    met = sets.groupBy("node", "lo", "hi").applyInArrow(compare, "v long, u long")
    if (most or 0) > TASK_WORDS:
        return components(met)
    return met.select("v", F.col("u").alias("root")).distinct()


def duplicates(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL, share: float = SHARE) -> DataFrame:
    """(doc_id, duplicate_of): every document that is an exact or near copy, with the least doc_id of its group, which stays.

    Fingerprints within distance make groups of candidates; of these, the texts whose sets of word pairs have a Jaccard similarity of share
    or more are linked, and a group is a connected component of them. Texts of the same words in the same order are exact copies. Each character
    of a script without spaces is a word. Null, empty and wordless texts and null ids belong to none. Rows that share a doc_id are one document, which is
    a copy if one of its texts is; of ties the least doc_id stays. A very long text is compared whole. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    seen = stage(fingerprints(docs), "fingerprints")
    text = [*FP, "seq"]
    texts = stage(seen.groupBy(*text).agg(F.min("doc_id").alias("text"), F.max("words").alias("words")), "texts")  # exact copies, combined before the shuffle
    reps = stage(texts.groupBy(*FP).agg(F.min("text").alias("id")), "reps")
    roots = components(links(reps, reps.count(), distance, recall))
    same = lambda a, b, names: reduce(lambda x, y: x & y, [a[c] == b[c] for c in names])
    of_rep = texts.join(reps, same(texts, reps, FP)).select("text", "id", texts["seq"], "words").join(roots, F.col("id") == F.col("v"), "left")
    copies = verified(docs, of_rep.select("text", "seq", "words", F.coalesce("root", "id").alias("root")), share)
    named = texts.join(copies, texts["text"] == copies["v"], "left").select(*text, F.coalesce("root", "text").alias("duplicate_of"))
    named = stage(named, "named")
    joined = seen.join(named, same(seen, named, text)).select("doc_id", "duplicate_of")
    return joined.where("doc_id <> duplicate_of").distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the copies that duplicates finds: one document of each group stays, that of the least doc_id, with all rows of that id.

    Null, empty and wordless texts and null ids stay. All rows of a doc_id go where one of its texts is a copy. An empty table gives an empty one; other
    columns stay as they are.
    """
    return without_ids(docs, duplicates(docs).select("doc_id"))
