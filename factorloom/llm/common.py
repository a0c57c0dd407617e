"""What several operators share."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.durable import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the cluster's shared folder and read back: a lost executor costs no rework."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What a Python worker keeps from task to task, one thing at a time.

    Spark deals the tasks of all operators of a session out to the same workers,
    also to more of them than run at once.
    """
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of what an operator before has kept in this Python worker."""
    _HELD.clear()


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a NULL key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds))


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``key, y``: one row per key with a label; a key labelled both ways is left out."""
    rows = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("y")).dropna()
    agreed = rows.groupBy("_key").agg(F.min("y").alias("y"), F.max("y").alias("_most"))
    return agreed.where("y = _most and y in (0, 1)").drop("_most")


def isotonic(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over binned scores: knots and non-decreasing rates between 0 and 1."""
    keep = counts > 0
    blocks: list[list[float]] = []
    for at, p, n in zip(x[keep], positives[keep], counts[keep]):
        blocks.append([at * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def columns_of(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]
