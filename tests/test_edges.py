"""Values and tables at the edge: tiny operands, wide trade keys, clashing names, missing scores."""

import datetime as dt
import math

from pyspark.sql import functions as F

from factorloom.operators import chains, factors
from factorloom.sources import bars, panel_io


def test_tiny_values_rank_apart(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(d), s, 10.0 + (d % 2) * (i + 1) * 1e-3, 1e9) for d in range(6) for i, s in enumerate("abcd")]
    panel = spark.createDataFrame(rows, "date date, symbol string, close double, volume double")
    got = factors.compute_composed(panel, ["RANK(TS_MEAN(ABS(RET) / VOLUME, 5))"], fill=None).toDF("date", "symbol", "x")
    last = {r["symbol"]: r["x"] for r in got.where(F.col("date") == day + dt.timedelta(5)).collect()}
    assert last == {"a": 0.25, "b": 0.5, "c": 0.75, "d": 1.0}


BARS = {  # closes and volumes: uncorrelated ones in several sizes, one rising, one falling together
    "a": ([1, 2, 3], [7, 1, 7]),
    "b": ([0.1, 0.2, 0.3], [0.7, 0.1, 0.7]),
    "c": ([100.1, 100.2, 100.3], [1e6 / 7, 1e6 / 3, 1e6 / 7]),
    "d": ([1, 2, 3], [0.1, 0.2, 0.3]),
    "e": ([1, 2, 3], [0.3, 0.2, 0.1]),
}


def last_ranks(spark, formula, named=False):
    day = dt.date(2024, 1, 1)
    rows = [
        (day + dt.timedelta(i), s, *[float(x[i])] * 4, float(v[i]), 1.0) for s, (x, v) in BARS.items() for i in range(3)
    ]
    panel = spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double, amount double")
    got = factors.compute_dense(panel, {"x": formula}) if named else factors.compute_composed(panel, [formula], fill=None)
    return {r["symbol"]: r[2] for r in got.where(F.col("date") == day + dt.timedelta(2)).collect()}


def test_what_cancels_to_nothing_ties_at_zero(spark):
    tied = {"a": 0.6, "b": 0.6, "c": 0.6, "d": 1.0, "e": 0.2}
    assert last_ranks(spark, "RANK(CORREL(CLOSE, VOLUME, 3))") == tied
    assert last_ranks(spark, "RANK(-CORREL(CLOSE, VOLUME, 3) * 2)") == tied | {"d": 0.2, "e": 1.0}
    assert last_ranks(spark, "rank(cor(close, volume, 3))", named=True) == tied
    assert last_ranks(spark, "rank(cov(close, volume, 3))", named=True) == tied
    # The same mean twice, added up in two ways.
    assert set(last_ranks(spark, "RANK(TS_MEAN(CLOSE / 3, 3) - TS_MEAN(CLOSE, 3) / 3)").values()) == {0.6}
    # Terms of a fixed size, summed and differenced.
    assert set(last_ranks(spark, "RANK(TS_MEAN(CORREL(CLOSE, VOLUME, 2), 2) * 0 + 1)").values()) == {0.6}
    assert last_ranks(spark, "rank(sum(cor(close, volume, 3), 1))", named=True) == tied
    # 1e-12 and its multiples are no rounding errors.
    small = last_ranks(spark, "RANK(TS_MEAN(VOLUME, 3) * 0.000000000001)")
    assert small == {"b": 0.6, "a": 0.8, "c": 1.0, "d": 0.3, "e": 0.3}


TRADES = "l_orderkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double"


def test_bars_with_large_numbers_and_no_quantity(spark):
    monday, tuesday = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [(2**40 + 9, monday, 1.0, 10.0), (5, tuesday, 1.0, 20.0), (7, tuesday, 0.0, 3.0), (2**62, monday, 2.0, 400_000.0)]
    trades = spark.createDataFrame(rows, TRADES)
    got = bars.bars(trades, F.date_trunc("week", "l_shipdate").cast("date"), F.lit("s")).first()
    assert (got["open"], got["high"], got["low"], got["close"]) == (10.0, 200_000.0, 10.0, 20.0)
    assert got["volume"] == 4.0 and got["amount"] == 400_033.0
    empty = bars.bars(trades.where("l_quantity = 0"), F.col("l_shipdate").cast("date"), F.lit("s")).first()
    assert empty["open"] is None and empty["close"] is None and empty["volume"] == 0.0


def test_second_key_like_columns(spark):
    rows = [(dt.date(2024, 1, 1), "c1", "s1", "old", 5.0)]
    frame = spark.createDataFrame(rows, "trade_date date, code string, symbol string, DATE string, close double")
    normal = panel_io.normalize_panel(frame)
    assert normal.columns == ["date", "symbol", "close"] and normal.first()["symbol"] == "c1"


def factor_rows(spark, run, expressions):
    return spark.createDataFrame([(run, i, f"n{i}", e) for i, e in enumerate(expressions)], "run_id int, pos int, name string, expression string")


def test_nan_is_no_score(spark):
    scores = spark.createDataFrame([(1, "n0", 1.0), (1, "n1", math.nan), (1, "n2", 3.0)], "run_id int, name string, score double")
    got = chains.score_factors(factor_rows(spark, 1, "abc"), scores)
    assert {r["name"]: r["score"] for r in got.collect()} == {"n0": 1.0, "n1": 2.0, "n2": 3.0}
    only = chains.score_factors(factor_rows(spark, 1, "ab"), scores.where("isnan(score)"))
    assert {r["name"]: r["score"] for r in only.collect()} == {"n0": 1.0, "n1": 0.5}


def test_samples_without_chain_and_repeated_samples(spark):
    found = chains.initial_chains(factor_rows(spark, 1, ["RANK(CLOSE)", "ABS(RET)"]))
    samples = spark.createDataFrame([(1, 1, "RANK(CLOSE)"), (1, 1, "RANK(CLOSE)"), (2, 1, "RANK(CLOSE)")], "run_id int, sample_id int, expression string")
    got = sorted(map(tuple, chains.match_chain(samples, found).select("run_id", "chain_id", "score").collect()), key=str)
    assert got == [(1, 0, 1.0), (1, 0, 1.0), (2, None, None)]


def test_every_blank_separates(spark):
    text = spark.createDataFrame([("a　b c d e",)], "t string")
    assert text.select(chains.tokenize(F.col("t"))).first()[0] == ["A", "B", "C", "D", "E"]
