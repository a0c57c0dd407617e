"""Expression tables that Spark derives from the given tables.

Each event stands for one mined expression: the run it belongs to, its place in
the run, and a seed picked by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.library import seed_expressions, seed_list
from factorloom.plans.skew import number_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mined(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, pos, name, expression, value, event_id, event_type``; ``pos`` counts from 0."""
    rows = table(spark, folder, "events").select(
        F.expr("user_id * 100 + pmod(event_id, 1 + pmod(user_id, 24))").alias("run_id"),
        "event_id", "event_type", "value",
    )
    picked = rows.withColumn("seed", F.expr("pmod(event_id * 7 + run_id, 101)"))
    seeds = seed_expressions(spark).select(F.col("pos").alias("seed"), "expression")
    joined = picked.join(F.broadcast(seeds), "seed").drop("seed")  # 101 rows
    placed = number_rows(joined, ["run_id"], [F.col("event_id").asc()], "pos")
    name = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("f"), "event_id"))
    return placed.withColumn("pos", F.col("pos") - 1).withColumn("name", name)


def seeds_sql() -> str:
    values = ", ".join(f"({i}, '{e}')" for i, e in enumerate(seed_list()))
    return f"seeds(seed, expression) as (values {values})"


MINED_SQL = """
mined as (
  select run_id, row_number() over (partition by run_id order by event_id) - 1 as pos,
         case when event_type = 'error' then '' else 'f' || event_id end as name,
         expression, value, event_id, event_type
  from (select user_id * 100 + event_id % (1 + user_id % 24) as run_id, event_id, event_type, value
        from events) e
  join seeds on seed = (event_id * 7 + run_id) % 101)
"""


def mined_ctes() -> str:
    return f"{seeds_sql()}, {MINED_SQL}"
