"""Bars (open, high, low, close, volume, amount) built from trade rows.

Order lines stand in for trades.  All aggregates are fixed-width, so both sides
of the shuffle use hash aggregation and a busy bar is combined before it moves.
A trade of quantity 0 has no price; it counts in volume and amount only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Prices are rounded to a 1/16 grid, which keeps window sums exact in any order.
TICK = 16
# Decimal digits of the packed trade key below the day: order number and price in
# ticks.  A DECIMAL(38) has place for every 64-bit order number and for prices up
# to 6e12; anything beyond is an overflow error, never a wrong bar.
ORDER_DIGITS, PRICE_DIGITS = 19, 14


def bars(trades: DataFrame, date: Column, symbol: Column) -> DataFrame:
    """``date, symbol`` and the six bar fields.

    The first and last trade of a bar go by (day, order number, price); the
    three are packed into one decimal, whose minimum and maximum carry the
    opening and closing price along.
    """
    ticks = F.floor(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")) * TICK + 0.5)
    rows = trades.select(
        date.alias("date"),
        symbol.cast("string").alias("symbol"),
        ticks.alias("ticks"),
        F.datediff(F.col("l_shipdate").cast("date"), date).cast("long").alias("day"),
        F.col("l_orderkey").alias("trade"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("a"),
    )
    key = F.expr(
        f"cast(cast(day as decimal(4,0)) * cast(1e{ORDER_DIGITS + PRICE_DIGITS} as decimal(34,0)) "
        f"+ cast(trade as decimal(19,0)) * cast(1e{PRICE_DIGITS} as decimal(15,0)) "
        f"+ cast(ticks as decimal({PRICE_DIGITS},0)) as decimal(38,0))"
    )
    grouped = rows.groupBy("date", "symbol").agg(
        F.min(key).alias("first"),
        F.max(key).alias("final"),
        F.max("ticks").alias("top"),
        F.min("ticks").alias("bottom"),
        F.sum("q").alias("volume"),
        F.sum("a").alias("paid"),
    )

    def opened(key: str) -> Column:
        return F.expr(f"cast({key} % cast(1e{PRICE_DIGITS} as decimal(15,0)) as bigint)")

    def price(ticks: Column) -> Column:
        return ticks / F.lit(float(TICK))

    return grouped.select(
        "date",
        "symbol",
        price(opened("first")).alias("open"),
        price(F.col("top")).alias("high"),
        price(F.col("bottom")).alias("low"),
        price(opened("final")).alias("close"),
        "volume",
        price(F.floor(F.col("paid") * TICK + 0.5)).alias("amount"),
    )


def weekly_brand_bars(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per week and part brand."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    parts = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_brand")
    trades = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    day = F.col("l_shipdate").cast("date")
    return bars(trades, F.date_sub(day, F.weekday(day)), F.col("p_brand"))


def daily_supplier_bars(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per day and supplier: a sparse panel, most pairs are absent."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return bars(lines, F.col("l_shipdate").cast("date"), F.col("l_suppkey"))
