"""Approximate nearest neighbours by largest inner product: shifted space-filling curves.

Several curves order all vectors.  Each projects them onto its own few random
directions, shifts the projected cells by its own random amount and takes the
Hilbert index of the cell.  Spark sorts every curve by range, which gives each
vector a place on it; a query's candidates are the places up to ``window`` away,
on all curves together.  They are reranked with the inner product of the original
vectors in double precision.

The index is fitted (quantiles of the projections) on a bounded sample,
``FIT_ROWS`` vectors, but holds every row.  The window is the one that reaches
``recall`` of the true neighbours of ``FIT_QUERIES`` sample queries, found
against all rows: it is as wide as the data ask for, and at most the whole table.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite
components take no part, nor do those of another than the commonest length
(smallest on ties); a row is no candidate for itself or for a row with the same
id; equal scores go to the smaller id; with fewer than k candidates all are
returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import stored
from factorloom.plans.skew import running_total

CURVES, DIRECTIONS, BITS = 4, 6, 8
FIT_ROWS, FIT_QUERIES = 20_000, 256
RECALL = 0.95
BLOCK = 4096
QUERIES = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of non-negative cell numbers below ``2**bits`` (bits x columns below 64).

    From the finest scale's reflections and swaps (Skilling 2004), all rows at once.
    """
    axes = cells.T.astype("int64").copy()
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for axis in axes:
            upper = (axis >> level) & 1 == 1
            swap = np.where(upper, 0, (axes[0] ^ axis) & below)
            axis ^= swap
            axes[0] ^= np.where(upper, below, swap)
    # Gray code over the axes, corrected by the parity of the higher bits of the last.
    axes = np.bitwise_xor.accumulate(axes, axis=0)
    fix = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    axes ^= fix
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | (axis >> level) & 1
    return key


@dataclass(frozen=True)
class Curves:
    directions: np.ndarray  # curve x length x direction
    edges: np.ndarray  # curve x direction x quantile
    shifts: np.ndarray  # curve x direction, in cells
    bits: int

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Curve x vector."""
        out = []
        for directions, edges, shifts in zip(self.directions, self.edges, self.shifts):
            spots = vectors @ directions
            cells = np.stack([np.searchsorted(e, s) for e, s in zip(edges, spots.T)], 1) + shifts
            out.append(hilbert(cells, self.bits))
        return np.stack(out)


def fit_curves(sample: np.ndarray, curves: int, directions: int, bits: int, seed: int) -> Curves:
    """Half of each axis holds quantile cells; the shift moves them within the axis."""
    rng = np.random.default_rng(seed)
    length = sample.shape[1]
    count = max(1, min(directions, length, 62 // bits))
    half = 1 << (bits - 1)
    turns = [np.linalg.qr(rng.normal(size=(length, count)))[0] for _ in range(curves)]
    at = np.linspace(0, 1, half + 1)[1:-1]
    edges = [np.quantile(sample @ t, at, axis=0).T for t in turns]
    return Curves(np.stack(turns), np.stack(edges), rng.integers(0, half, (curves, count)), bits)


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added in the order of the components."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * v[:, j]
    return total


def best_of(ids: np.ndarray, q: np.ndarray, names: np.ndarray, v: np.ndarray, k: int, allowed: np.ndarray | None = None):
    """Per query the ``k`` best rows: (query numbers, row numbers, scores); ties to the smaller name."""
    k = min(k, len(v))
    s = q @ v.T
    s[(ids[:, None] == names[None, :]) if allowed is None else ~allowed | (ids[:, None] == names[None, :])] = -np.inf
    kth = np.partition(s, len(v) - k, axis=1)[:, len(v) - k]
    # Rows within rounding error of the k-th product are compared by the exact sum.
    near = kth - 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
    a, b = np.nonzero((s >= near[:, None]) & np.isfinite(s))
    scores = exact_products(q[a], v[b])
    order = np.lexsort((names[b], -scores, a))
    a, b, scores = a[order], b[order], scores[order]
    first = np.searchsorted(a, np.arange(len(q)))
    keep = np.arange(len(a)) - first[a] < k
    return a[keep], b[keep], scores[keep]


def valid_vectors(vectors: DataFrame, id: str, vector: str, queries: Column) -> DataFrame:
    """``row, id, v, query`` of the vectors that take part, written once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(good)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def neighbours(
    vectors: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding",
    curves: int = CURVES, directions: int = DIRECTIONS, bits: int = BITS, recall: float = RECALL, seed: int = 17,
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest found for every row where ``queries`` holds."""
    every = valid_vectors(vectors, id, vector, queries)
    lengths = every.groupBy(F.size("v").alias("length")).count().orderBy(F.col("count").desc(), "length").first()
    if lengths is None:
        return _shown(every.where("false").select("id", F.lit(1).alias("rank"), F.struct(F.lit(0.0).alias("minus"), F.lit(0).cast("long").alias("id")).alias("best")), id)
    rows = every.where(F.size("v") == lengths["length"])
    n = lengths["count"]
    sample = rows.orderBy(F.xxhash64("row", F.lit(seed))).limit(FIT_ROWS).select("v").toPandas()
    model = fit_curves(np.vstack(sample["v"].to_list()), curves, directions, bits, seed)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                keys = model.keys(np.vstack(b["v"].to_list()))
                for curve, key in enumerate(keys):
                    yield pd.DataFrame({"curve": curve, "key": key, "row": b["row"], "query": b["query"]})

    keys = rows.select("row", "query", "v").mapInPandas(keyed, "curve int, key long, row long, query boolean")
    placed = stored(running_total(keys, ["curve"], [F.col("key"), F.col("row")], name="place").drop("key"), "places")
    window = fitted_window(rows, placed, k, recall, seed)

    count = -(-n // BLOCK)
    size = -(-n // count)
    asked = rows.where("query").count()
    parts = max(1, -(-asked * min(n, 2 * window + size) // (n * QUERIES)))
    block = F.floor(F.col("place") / size)
    held = placed.join(rows.select("row", "id", "v"), "row").withColumn("block", block)
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else held.withColumn("part", F.lit(0))
    low, high = F.floor((F.col("place") - window) / size), F.floor((F.col("place") + window) / size)
    reach = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(count - 1)))
    asking = placed.where("query").join(rows.select("row", "id", "v"), "row")
    asking = asking.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("block", F.explode(reach))
    group, cols = ["curve", "block", "part"], ["place", "id", "v"]

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(v):
            names, places, held_v = v["id"].to_numpy(), v["place"].to_numpy(), np.vstack(v["v"].to_list())
            for first in range(0, len(q), 256):
                part = q.iloc[first : first + 256]
                allowed = np.abs(part["place"].to_numpy()[:, None] - places[None, :]) <= window
                ids = part["id"].to_numpy()
                a, b, scores = best_of(ids, np.vstack(part["v"].to_list()), names, held_v, k, allowed)
                ends = np.searchsorted(a, np.arange(len(part) + 1))
                found += [
                    (part_id, (-scores[i:j]).tolist(), names[b[i:j]].tolist())
                    for part_id, i, j in zip(ids.tolist(), ends[:-1], ends[1:])
                    if j > i
                ]
        return pd.DataFrame(found, columns=["id", "minus", "ids"])

    near = (
        asking.select(*_anew(group + cols)).groupBy(*group)
        .cogroup(held.select(*_anew(group + cols)).groupBy(*group))
        .applyInPandas(search, "id long, minus array<double>, ids array<long>")
    )
    pairs = F.arrays_zip("minus", F.col("ids").alias("id")).cast("array<struct<minus: double, id: long>>")
    merged = near.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(pairs))).alias("best"))
    ranked = merged.select("id", F.posexplode(F.slice(F.array_sort("best"), 1, k)).alias("rank", "best"))
    return _shown(ranked.withColumn("rank", F.col("rank") + 1), id)


def _anew(names: list[str]) -> list[Column]:
    """The same columns under new identities, so that both sides of a cogroup may come from one table."""
    return [F.col(c).alias(c) for c in names]


def _shown(ranked: DataFrame, id: str) -> DataFrame:
    return ranked.select(
        F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"),
        F.col("best.id").alias(id), (-F.col("best.minus") + F.lit(0.0)).alias("score"),
    )


def true_neighbours(rows: DataFrame, sample: pd.DataFrame, k: int) -> DataFrame:
    """``query, row``: the exact answer for a bounded set of queries, each task keeping its own k best."""
    ids, q = sample["id"].to_numpy(), np.vstack(sample["v"].to_list())
    asked = sample["row"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in range(0, len(b), BLOCK):
                part = b.iloc[first : first + BLOCK]
                a, c, s = best_of(ids, q, part["id"].to_numpy(), np.vstack(part["v"].to_list()), k)
                yield pd.DataFrame({"query": asked[a], "row": part["row"].to_numpy()[c], "id": part["id"].to_numpy()[c], "score": s})

    near = rows.select("row", "id", "v").mapInPandas(scan, "query long, row long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "row")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("query", "row")


def fitted_window(rows: DataFrame, placed: DataFrame, k: int, recall: float, seed: int) -> int:
    """The distance on the nearest curve that takes in ``recall`` of the sample's true neighbours."""
    sample = rows.where("query").orderBy(F.xxhash64("row", F.lit(seed + 1))).limit(FIT_QUERIES).select("row", "id", "v").toPandas()
    if not len(sample):
        return 0
    pairs = stored(true_neighbours(rows, sample, k), "pairs")  # at most FIT_QUERIES x k rows
    mine = placed.select(F.col("row").alias("query"), "curve", F.col("place").alias("from"))
    theirs = placed.select("row", "curve", "place")
    apart = pairs.join(mine, "query").join(theirs, ["row", "curve"])
    gaps = apart.groupBy("query", "row").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("gap")).toPandas()
    return int(np.quantile(gaps["gap"], recall, method="higher")) if len(gaps) else 0
