"""Cutting lineage so that a result survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set, a folder beside the tables of the warehouse."""
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    path = configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table written mid-query."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows (and the partition each sits in) stay fixed from here on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
