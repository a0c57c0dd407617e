"""Choosing diverse factors: standardise, compare, cluster, take turns.

Factors are the points and panel rows the dimensions, so the distributed work
is one Gram matrix.  It is summed per partition in blocks of columns and stays a
table of pairs; nothing of its size reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.panel import KEYS, _quote
from factorloom.plans.durable import durable
from factorloom.plans.skew import spread_ranks

# Columns whose products one message holds.
BLOCK = 128
# Magnitude limit, and starts of the clustering.
CLIP = 1e6
RESTARTS = 10
# Rounds after which the clustering stops even if assignments still move.
ROUNDS = 100


def factor_columns(matrix: DataFrame, keys: Sequence[str] = KEYS) -> list[str]:
    return [c for c in matrix.columns if c not in keys]


def _clean(name: str) -> Column:
    x = F.col(_quote(name)).cast("double")
    kept = F.coalesce(F.when(x - x == 0.0, x), F.lit(0.0))
    return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), kept))


def standardize_matrix(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Missing and infinite to 0, clip, then (x - mean) / population deviation per factor.

    One aggregation over all columns; a constant column becomes 0.
    """
    names = factor_columns(matrix, keys)
    cleaned = matrix.select(*[_quote(k) for k in keys], *[_clean(n).alias(n) for n in names])
    stats = cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(_quote(n)).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(_quote(n)).alias(f"s{i}") for i, n in enumerate(names)],
    ).first()
    scaled = []
    for i, n in enumerate(names):
        mean, deviation = stats[f"m{i}"], stats[f"s{i}"]
        value = (F.col(_quote(n)) - F.lit(mean)) / F.lit(deviation) if deviation else F.lit(0.0)
        scaled.append(value.alias(n))
    return cleaned.select(*[_quote(k) for k in keys], *scaled)


def _products(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """``i, j, gram``: sums over all rows of the products of columns ``i`` and ``j``.

    Each partition adds up its own rows; the sums of a pair of column blocks meet
    in one group, which has one message per partition.
    """
    cuts = range(0, len(names), BLOCK)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            x = np.array(b["x"].to_list(), dtype=float).reshape(len(b), len(names))
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            pairs = [(i, j, total[i : i + BLOCK, j : j + BLOCK].tobytes()) for i in cuts for j in cuts]
            yield pd.DataFrame(pairs, columns=["a", "b", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in group["sums"])
        a, b = int(group["a"].iloc[0]), int(group["b"].iloc[0])
        width = min(BLOCK, len(names) - b)
        at = np.arange(len(total))
        return pd.DataFrame({"i": a + at // width, "j": b + at % width, "gram": total})

    rows = vectors.select(F.array(*[F.col(_quote(n)) for n in names]).alias("x"))
    parts = rows.mapInPandas(partial, "a int, b int, sums binary")
    return parts.groupBy("a", "b").applyInPandas(add, "i int, j int, gram double")


def _labels(spark, names: Sequence[str], place: str, label: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), f"{place} INT, {label} STRING")


def _named(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    spark = pairs.sparkSession
    return pairs.join(_labels(spark, names, "i", "f1"), "i").join(_labels(spark, names, "j", "f2"), "j")


def _gram(matrix: DataFrame, keys: Sequence[str]) -> tuple[list[str], DataFrame]:
    """Factor names, and the Gram matrix of the standardised factors as ``i, j, gram``, written once."""
    names = factor_columns(matrix, keys)
    standard = standardize_matrix(durable(matrix), keys)  # read by several passes
    return names, durable(_products(standard, names))


def factor_gram(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``f1, f2, gram, distance2`` for every pair of standardised factors."""
    names = factor_columns(matrix, keys)
    if not names:
        return matrix.sparkSession.createDataFrame([], "f1 STRING, f2 STRING, gram DOUBLE, distance2 DOUBLE")
    names, gram = _gram(matrix, keys)
    size = gram.where("i = j")
    pairs = gram.join(size.select("i", F.col("gram").alias("gi")), "i").join(size.select("j", F.col("gram").alias("gj")), "j")
    squared = F.greatest(F.col("gi") + F.col("gj") - 2 * F.col("gram"), F.lit(0.0))
    return _named(pairs.withColumn("distance2", squared), names).select("f1", "f2", "gram", "distance2")


def factor_similarity(
    matrix: DataFrame, metric: str = "spearman", keys: Sequence[str] = KEYS
) -> DataFrame:
    """``f1, f2, rho``.  Ranks of whole columns come from a range shuffle of value counts."""
    names = factor_columns(matrix, keys)
    if metric not in ("spearman", "pearson"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = matrix.sparkSession
    if not names:
        return spark.createDataFrame([], "f1 STRING, f2 STRING, rho DOUBLE")
    matrix = durable(matrix.withColumn("_row", F.monotonically_increasing_id()))  # read by several passes
    plain = [f"_c{i}" for i in range(len(names))]
    if metric == "pearson":
        compared = matrix.select(*keys, *[F.col(_quote(n)).alias(c) for n, c in zip(names, plain)])
    else:
        cleaned = matrix.select("_row", *keys, *[_clean(n).alias(c) for n, c in zip(names, plain)])
        ranks = {f"_r{i}": c for i, c in enumerate(plain)}
        ranked = spread_ranks(cleaned, "_row", [], ranks, as_percent=False)
        compared = ranked.select(*keys, *ranks)
    _, gram = _gram(compared, keys)
    size = F.sqrt(F.col("gi") * F.col("gj"))
    own = gram.where("i = j")
    pairs = gram.join(own.select("i", F.col("gram").alias("gi")), "i").join(own.select("j", F.col("gram").alias("gj")), "j")
    rho = F.when(size > 0, F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("gram") / size)).otherwise(0.0)
    return _named(pairs.withColumn("rho", rho), names).select("f1", "f2", "rho")


CLUSTERS = "factor_id INT, factor STRING, cluster INT, dist DOUBLE"


def cluster_factors(matrix: DataFrame, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """k-means over factors: ``factor_id, factor, cluster, dist`` to the cluster's centre.

    All work is on rows of the Gram matrix: the squared distance of factor i to
    the mean of cluster c is G_ii - 2 mean_j G_ij + mean_jl G_jl.  ``RESTARTS``
    runs go side by side, each from another first factor with the farthest ones
    added; the cheapest is kept.  Clusters are numbered by their first member.
    With one cluster the centre is factor 0.
    """
    spark = matrix.sparkSession
    names = factor_columns(matrix, keys)
    if not names:
        return spark.createDataFrame([], CLUSTERS)
    names, gram = _gram(matrix, keys)
    own = gram.where("i = j").select("i", F.col("gram").alias("own"))
    k = max(1, min(k, len(names)))
    if k == 1:
        zero = own.where("i = 0").first()["own"]
        first = gram.where("j = 0").join(own, "i")
        found = first.select("i", F.lit(0).alias("cluster"), (F.col("own") + F.lit(zero) - 2 * F.col("gram")).alias("d2"))
    else:
        found = _cheapest(gram, own, _spread_starts(spark, gram, own, k, len(names)))
    labelled = found.join(_labels(spark, names, "i", "factor"), "i")
    dist = F.sqrt(F.greatest(F.col("d2"), F.lit(0.0)))
    return labelled.select(F.col("i").alias("factor_id"), "factor", F.col("cluster").cast("int").alias("cluster"), dist.alias("dist"))


def _spread_starts(spark, gram: DataFrame, own: DataFrame, k: int, n: int) -> DataFrame:
    """``run, i, cluster``: every factor with the nearest of ``k`` first centres, chosen farthest first."""
    firsts = sorted({int(x) for x in np.linspace(0, n - 1, min(RESTARTS, n))})
    chosen = spark.createDataFrame([(r, f) for r, f in enumerate(firsts)], "run INT, j INT")
    state = None
    for c in range(k):
        centre = own.withColumnsRenamed({"i": "j", "own": "centre"})
        near = gram.join(F.broadcast(chosen), "j").join(own, "i").join(centre, "j")
        near = near.select("run", "i", (F.col("own") + F.col("centre") - 2 * F.col("gram")).alias("d"))
        if state is None:
            state = near.select("run", "i", F.lit(0).alias("cluster"), F.col("d").alias("d2"))
        else:
            both = state.join(near, ["run", "i"])
            closer = F.col("d") < F.col("d2")
            state = both.select(
                "run", "i", F.when(closer, c).otherwise(F.col("cluster")).alias("cluster"), F.least("d", "d2").alias("d2")
            )
        state = durable(state)
        chosen = state.groupBy("run").agg(F.max(F.struct("d2", -F.col("i")))["col2"].alias("j")).select("run", (-F.col("j")).alias("j"))
    return state.select("run", "i", "cluster")


def _cheapest(gram: DataFrame, own: DataFrame, state: DataFrame) -> DataFrame:
    """Lloyd's rounds for all runs at once, then ``i, cluster, d2`` of the run with the least total."""
    for _ in range(ROUNDS):
        to = state.withColumnsRenamed({"i": "j"})
        means = gram.join(to, "j").groupBy("run", "i", "cluster").agg(F.avg("gram").alias("mean"))
        inside = means.withColumnRenamed("cluster", "c").join(state, ["run", "i"]).where("c = cluster")
        spread = inside.groupBy("run", "cluster").agg(F.avg("mean").alias("inner"))
        apart = means.join(spread, ["run", "cluster"]).join(own, "i")
        d2 = (F.col("own") - 2 * F.col("mean") + F.col("inner")).alias("d2")
        best = apart.select("run", "i", "cluster", d2).groupBy("run", "i").agg(F.min(F.struct("d2", "cluster")).alias("best"))
        moved = best.join(state, ["run", "i"]).select(
            "run", "i", F.col("best.cluster").alias("cluster"), F.col("best.d2").alias("d2"), F.col("cluster").alias("was")
        )
        moved = durable(moved)
        state = moved.select("run", "i", "cluster")
        if moved.where("cluster <> was").isEmpty():
            break
    cost = moved.groupBy("run").agg(F.round(F.sum("d2"), 6).alias("cost"))
    least = cost.agg(F.min(F.struct("cost", "run"))["run"].alias("run"))
    kept = moved.join(F.broadcast(least), "run")  # one row
    first = kept.groupBy("cluster").agg(F.min("i").alias("first"))
    numbered = first.withColumn("number", F.row_number().over(Window.orderBy("first")) - 1)  # k rows
    return kept.join(numbered, "cluster").select("i", F.col("number").alias("cluster"), "d2")


def select_exemplars(clusters: DataFrame, n: int) -> DataFrame:
    """Clusters take turns giving their factor nearest to the centre, until ``n`` are chosen.

    No cluster gives more than ``n``, so Spark prunes each to ``n`` rows before
    the shuffle, and the final order is over ``n`` rows.
    """
    n = max(n, 0)
    turn = F.row_number().over(Window.partitionBy("cluster").orderBy("dist", "factor_id"))
    turns = clusters.withColumn("turn", turn).where(F.col("turn") <= n)
    ordered = turns.orderBy("turn", "cluster").limit(n)
    place = F.row_number().over(Window.orderBy("turn", "cluster"))
    return ordered.withColumn("place", place)
