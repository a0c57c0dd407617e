"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, block by block.  One histogram of
scores per query is summed over all tasks and narrowed again and again around
the bin that holds the k-th value, until the bin is one score wide.  A last pass
keeps the scores from that value on, of which each task needs at most its own k
best (ties to the smaller id), and ranks them.

Queries are taken ``QUERIES`` at a time, so what is sent to the tasks has a fixed
bound; candidates are never collected.

Defined results: vectors that are NULL or hold NULL or non-finite components
take no part; vectors of another length than the query's take no part in its
answer; a row is no candidate for itself; repeated ids are separate candidates
except for a query with the same id, which asks once (with its smallest vector); with fewer than k candidates all are
returned; an empty table gives no rows.  Scores are exact while every product sum
stays below 2**62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import stored

QUERIES = 4096
BINS = 256
ROWS = 2048


def scaled(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of every component as a double; NULL if a component is NULL or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double"))))


class Block:
    """Queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.most = int(np.abs(vectors).max(initial=0))

    def scores(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries x rows, and which of them count."""
        bound = self.most * int(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
        if bound < 1 << 53:  # every partial sum is a whole number a double can hold
            s = (self.vectors.astype("float64") @ vectors.astype("float64").T).astype("int64")
        else:
            s = self.vectors @ vectors.T
        return s, self.ids[:, None] != ids[None, :]


def blocks_of(ids: list[int], vectors: list[np.ndarray], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length, at most ``rows`` at a time."""
    lengths = np.array([len(v) for v in vectors])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for first in range(0, len(at), rows):
            part = at[first : first + rows]
            yield np.array(ids)[part], np.vstack([vectors[i] for i in part]).astype("int64").reshape(len(part), n)


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if len(b):
            yield from blocks_of(b["id"].to_list(), b["v"].to_list(), ROWS)


def top_k(vectors: DataFrame, queries: Column, k: int, id: str = "vec_id", vector: str = "embedding", factor: int = 1024) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` largest integer products of each query, ties to the smaller id."""
    rows = vectors.select(
        F.col(f"`{id}`").cast("long").alias("id"), scaled(F.col(f"`{vector}`"), factor).alias("v"), queries.alias("query")
    ).where("v is not null and id is not null")
    rows = stored(rows, "vectors")
    asked = stored(rows.where("query").select("id", "v"), "queries")
    found, last = None, None
    while True:  # one round for every QUERIES queries
        ahead = asked if last is None else asked.where(F.col("id") > last)
        some = ahead.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(QUERIES).toPandas()
        if not len(some):
            break
        last = int(some["id"].iloc[-1])
        part = _round(rows, some, k, id)
        found = part if found is None else found.unionAll(part)
        if len(some) < QUERIES:
            break
    if found is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id), F.lit(0).cast("long").alias("score")).where("false")
    return found


def _round(rows: DataFrame, some: pd.DataFrame, k: int, id: str) -> DataFrame:
    context = rows.sparkSession.sparkContext
    blocks = [Block(i, v) for i, v in blocks_of(some["id"].to_list(), some["v"].to_list(), len(some))]
    shared = context.broadcast(blocks)  # at most QUERIES vectors
    total = len(some)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, n = np.full(total, 1 << 62), np.full(total, -(1 << 62)), np.zeros(total, "int64")
        for ids, v in _batches(batches):
            first = 0
            for b in shared.value:
                own = slice(first, first := first + len(b.ids))
                if b.vectors.shape[1] == v.shape[1]:
                    s, counts = b.scores(ids, v)
                    low[own] = np.minimum(low[own], np.where(counts, s, 1 << 62).min(1))
                    high[own] = np.maximum(high[own], np.where(counts, s, -(1 << 62)).max(1))
                    n[own] += counts.sum(1)
        yield pd.DataFrame({"q": np.arange(total), "low": low, "high": high, "n": n})

    got = rows.mapInPandas(ends, "q int, low long, high long, n long").groupBy("q").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
    ).toPandas().set_index("q").reindex(range(total))
    low, high, n = (got[c].to_numpy("int64").copy() for c in ("low", "high", "n"))
    low[n <= k] = np.minimum(low[n <= k], high[n <= k])
    high = np.where(n <= k, low, high)  # with k candidates or fewer all of them are wanted
    above = np.zeros(total, "int64")  # candidates known to score higher than `high`
    while (live := low < high).any():
        width = -((low - high - 1) // BINS)  # ceiling, so that BINS bins cover low to high
        bounds = context.broadcast((low, high, width, live))

        def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lows, highs, widths, open_ = bounds.value
            sums = np.zeros((total, BINS), "int64")
            for ids, v in _batches(batches):
                first = 0
                for b in shared.value:
                    own = np.arange(first, first := first + len(b.ids))
                    if b.vectors.shape[1] == v.shape[1] and open_[own].any():
                        s, counts = b.scores(ids, v)
                        inside = counts & (s >= lows[own, None]) & (s <= highs[own, None]) & open_[own, None]
                        at, _ = np.nonzero(inside)
                        bin_ = (s[inside] - lows[own][at]) // widths[own][at]
                        sums[own] += np.bincount(at * BINS + bin_, minlength=len(own) * BINS).reshape(-1, BINS)
            for q in np.flatnonzero(sums.any(1)):
                at = np.flatnonzero(sums[q])
                yield pd.DataFrame({"q": q, "bin": at, "n": sums[q, at]})

        summed = rows.mapInPandas(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        counts = np.zeros((total, BINS), "int64")
        for r in summed.toLocalIterator():  # at most QUERIES x BINS numbers
            counts[r["q"], r["bin"]] = r["n"]
        for q in np.flatnonzero(live):
            down = above[q] + np.cumsum(counts[q][::-1])
            at = BINS - 1 - int(np.argmax(down >= k))
            above[q] += counts[q][at + 1 :].sum()
            low[q], high[q] = low[q] + at * width[q], min(high[q], low[q] + (at + 1) * width[q] - 1)
        bounds.unpersist()
    limits = context.broadcast(low)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[tuple[int, int]]] = {}
        names: dict[int, int] = {}
        for ids, v in _batches(batches):
            first = 0
            for b in shared.value:
                own = np.arange(first, first := first + len(b.ids))
                if b.vectors.shape[1] == v.shape[1]:
                    s, counts = b.scores(ids, v)
                    for i, q in enumerate(own.tolist()):
                        at = np.flatnonzero(counts[i] & (s[i] >= limits.value[q]))
                        if len(at):
                            names[q] = int(b.ids[i])
                            pairs = kept.get(q, []) + list(zip((-s[i, at]).tolist(), ids[at].tolist()))
                            kept[q] = sorted(pairs)[:k]
        for q, pairs in kept.items():
            yield pd.DataFrame({"query_id": names[q], "score": [-s for s, _ in pairs], "id": [i for _, i in pairs]})

    from pyspark.sql import Window

    near = rows.mapInPandas(best, "query_id long, score long, id long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")  # at most k rows a task
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id), "score")
