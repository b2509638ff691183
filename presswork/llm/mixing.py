"""Sources mixed to target weights by cube-method balanced sampling.

Every document of a source has the same inclusion probability, by which the source gets its target of tokens. The
flight moves the probabilities within a source along the null space of two constraints, the number of documents
and their tokens, until no more than two of them are fractional; both totals stay as expected all the while. It
runs in groups of about GROUP documents, then among what these leave, level by level, until a source is one group.
The landing drops the tokens' constraint for the last two documents, then the documents' for the last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import BROADCAST_IDS, has, stage

#: Share of all tokens that is drawn, and the power of a source's tokens that its target goes by.
SHARE, POWER = 0.5, 0.5
#: Sources are summed up in steps of 1 / STEPS of a power of two for the one factor that all targets share; its error is less than that step's.
STEPS = 4096
#: Documents of a group of the first flight.
GROUP = 4096
SEED = 20240501
_EPS = 1e-9


def count_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, place): runs without ASCII white space in the text, 0 for a null one; a hash of id and text."""

    @at.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty(0, np.int64)]
            for _lo, _hi, data, offsets in at.chunks(batch.column("text")):
                starts, _, rows = at.tokens(at.SPACES[data], offsets)
                out.append(np.diff(rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(out)), batch.column("place")], ["doc_id", "source", "tokens", "place"])

    few = has(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text", F.xxhash64("doc_id", "text", F.lit(SEED)).alias("place"))
    return few.mapInArrow(run, "doc_id long, source string, tokens long, place long")


def factor(totals: np.ndarray, weights: np.ndarray, share: float, everything: float) -> float:
    """The factor of weights at which the targets, none above its total, sum to share of everything; or at which all that has a weight is drawn."""
    some = (totals > 0) & (weights > 0)
    totals, weights = totals[some].astype(float), weights[some].astype(float)
    if not len(totals):
        return 0.0
    want, low, high = share * everything, 0.0, float((totals / weights).max())
    if totals.sum() <= want:
        return high
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if np.minimum(totals, mid * weights).sum() >= want else (mid, high)
    return high


def level(totals: np.ndarray, share: float, power: float) -> float:
    """factor, where a source weighs as its tokens to the given power."""
    totals = totals[totals > 0].astype(float)
    return factor(totals, totals**power, share, float(totals.sum()))


def flight(p: np.ndarray, tokens: np.ndarray, random: np.random.Generator) -> None:
    """Moves p, in place, until two entries or fewer aren't 0 or 1; sums of p and of p * tokens don't change."""
    open_ = [int(i) for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS))]
    draws = iter(random.random(len(open_) + 1).tolist())
    q, t = p.tolist(), [float(x) for x in tokens]
    here, rest = open_[:3], iter(open_[3:])
    while len(here) == 3:
        i, j, k = here
        u = (t[j] - t[k], t[k] - t[i], t[i] - t[j])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - q[x]) / v if v > 0 else q[x] / -v for x, v in zip(here, u) if v)
        down = min(q[x] / v if v > 0 else (1 - q[x]) / -v for x, v in zip(here, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        for x, v in zip(here, u):
            q[x] += step * v
        stay = []
        for x in here:
            if q[x] <= _EPS:
                q[x] = 0.0
            elif q[x] >= 1 - _EPS:
                q[x] = 1.0
            else:
                stay.append(x)
        here = stay
        while len(here) < 3 and (x := next(rest, None)) is not None:
            here.append(x)
    p[:] = q


def landing(p: np.ndarray, random: np.random.Generator) -> None:
    """Makes the last entries 0 or 1, one by one, keeping their sum as near as whole numbers allow and each expectation."""
    left = list(np.flatnonzero((p > _EPS) & (p < 1 - _EPS)))
    while len(left) > 1:
        a, b = left[0], left[1]
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if random.random() * (up + down) < down else -down
        p[a] += step
        p[b] -= step
        left = [x for x in left if _EPS < p[x] < 1 - _EPS]
    for x in left:
        p[x] = float(random.random() < p[x])
    np.rint(p, out=p)


def _seed(table: pa.Table, name: str) -> np.random.Generator:
    source, chunk = table.column("source")[0].as_py(), table.column("chunk")[0].as_py()
    return np.random.default_rng([SEED, *(source or "").encode(), 0 if source is None else 1, chunk, *name.encode()])


def _fly(name: str, land: bool):
    @at.tidy_groups
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("tokens", "ascending")])
        p = table.column("p").to_numpy().copy()
        random = _seed(table, name)
        flight(p, table.column("tokens").to_numpy(), random)
        if land:
            landing(p, random)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return run


_ROW = "doc_id long, source string, tokens long, inclusion double, place long, chunk long, p double"


Weights = Mapping[str | None, float] | DataFrame


def _weighted(totals: DataFrame, weights: Weights | None, power: float) -> DataFrame:
    """totals (source, all_tokens, n) with weight."""
    if weights is None:
        return totals.withColumn("weight", F.when(F.col("all_tokens") > 0, F.pow(F.col("all_tokens").cast("double"), F.lit(float(power)))).otherwise(0.0))
    if isinstance(weights, Mapping):
        if any(not 0 <= w < math.inf for w in weights.values()):
            raise ValueError("weights are finite and not negative")
        weights = totals.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
    own = has(weights, "source", "weight").groupBy(F.col("source").cast("string").alias("_named")).agg(F.greatest(F.sum("weight"), F.lit(0.0)).cast("double").alias("weight"))
    return totals.join(own, F.col("source").eqNullSafe(F.col("_named")), "left").drop("_named").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def sample(docs: DataFrame, share: float = SHARE, power: float = POWER, weights: Weights | None = None) -> DataFrame:
    """(doc_id, source, tokens, inclusion): the documents drawn, with the probability that each had.

    weights are the sources' target weights, a mapping or a table (source, weight): a source's target is in proportion to its weight, but no more than all it
    has; targets sum to share of all tokens, or to all that the weighted sources have if that is less. A source that the weights don't name has weight 0
    and gives nothing; a weight of a source that isn't there counts for nothing; the null source may be named; of a table, a source's weights add up and nulls
    and negative sums are 0. Without weights a source weighs as its tokens to the given power.

    A null source is a source of its own. Texts without tokens, null and empty ones among them, are drawn as others of their source; a source without any
    tokens has inclusion 0. Repeated rows, rows that share a doc_id, and rows with a null doc_id, are documents each; of rows that agree in id, text and
    source any may be the one that is drawn. A very long text is counted whole, and may put its source's total off by up to its own tokens. An empty table
    gives an empty result; other columns, whatever their names, are ignored. The draw depends on the rows alone, not on their order or partitions.
    """
    counted = stage(count_tokens(docs), "tokens")
    totals = stage(_weighted(counted.groupBy("source").agg(F.sum("tokens").alias("all_tokens"), F.count("*").alias("n")), weights, power), "sources")
    largest, everything = totals.agg(F.max("n"), F.sum("all_tokens")).first()
    # sources whose targets reach their totals at nearly the same factor are one row: what comes here doesn't follow their number
    steps = totals.where("all_tokens > 0 and weight > 0").groupBy(F.floor(F.log2(F.col("all_tokens") / F.col("weight")) * STEPS)).agg(F.sum("all_tokens").cast("double").alias("t"), F.sum("weight").alias("w")).toPandas()
    scale = factor(steps["t"].to_numpy(), steps["w"].to_numpy(), share, float(everything or 0))
    inclusion = F.when(F.col("all_tokens") > 0, F.least(F.lit(1.0), F.lit(scale) * F.col("weight") / F.col("all_tokens"))).otherwise(0.0)
    of_source = totals.select(F.col("source").alias("_source"), inclusion.alias("inclusion"), F.ceil(F.col("n") / GROUP).cast("long").alias("groups"))
    rows = counted.join(of_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    flown = rows.select("doc_id", "source", "tokens", "inclusion", "place", F.pmod("place", "groups").alias("chunk"), F.col("inclusion").alias("p"))
    groups = -(-int(largest) // GROUP) if largest else 1
    done: list[DataFrame] = []
    depth = 0
    while True:
        last = groups <= 1
        flown = stage(flown.groupBy("source", "chunk").applyInArrow(_fly(f"flight{depth}", last), _ROW), f"flight{depth}")
        done.append(flown.where("p = 1"))
        if last:
            break
        groups, depth = -(-groups // (GROUP // 2)), depth + 1
        flown = flown.where("p > 0 and p < 1").withColumn("chunk", F.floor(F.col("chunk") / (GROUP // 2)).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "tokens", "inclusion")


def mix(docs: DataFrame, share: float = SHARE, power: float = POWER, weights: Weights | None = None) -> DataFrame:
    """The rows of docs whose doc_id sample draws, all columns as they are; rows that share a doc_id go together, and those with a null one go.

    Null and empty texts are drawn as others of their source. An empty table gives an empty one.
    """
    drawn = stage(sample(docs, share, power, weights).where("doc_id is not null").select(F.col("doc_id").alias("_drawn")).distinct(), "drawn")
    side = F.broadcast(drawn) if drawn.count() <= BROADCAST_IDS else drawn
    return docs.join(side, docs["doc_id"] == side["_drawn"], "left_semi")
