"""Stored factor sets, factor values and generated candidates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.panel import to_long

FACTOR_SET = "pos BIGINT, name STRING, expression STRING"


def write_factor_set(factors: DataFrame, path: str, format: str = "json") -> None:
    """Stores ``pos, name, expression``; ``pos`` carries the order."""
    factors.select(
        F.col("pos").cast("long").alias("pos"), "name", "expression"
    ).write.format(format).mode("overwrite").save(path)


def read_factor_set(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """The stored set, or an empty one where nothing is stored."""
    try:
        return spark.read.format(format).schema(FACTOR_SET).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FACTOR_SET)


def factor_id(expression):
    """A path-safe name for an expression."""
    return F.substring(F.sha2(expression, 256), 1, 16)


def write_factor_values(matrix: DataFrame, path: str) -> None:
    """One directory per factor, rows ``date, symbol, factor, value``.

    The rebalance hint gathers a factor's rows into files of even size instead
    of one small file per factor and task, and splits a factor too large for one.
    """
    long = to_long(matrix).withColumn("factor_id", factor_id(F.col("factor")))
    long.hint("rebalance", "factor_id").write.mode("overwrite").partitionBy("factor_id").parquet(path)


def read_factor_values(spark: SparkSession, path: str, expressions=None) -> DataFrame:
    """Stored values; only the directories of ``expressions`` are read when given."""
    stored = spark.read.parquet(path)
    if expressions is None:
        return stored
    wanted = [factor_id(F.lit(e)) for e in expressions]
    return stored.where(F.col("factor_id").isin(*wanted)) if wanted else stored.limit(0)


def write_candidates(candidates: DataFrame, path: str, format: str = "json") -> None:
    """Stores generated expressions; existing output is replaced."""
    candidates.write.format(format).mode("overwrite").save(path)
