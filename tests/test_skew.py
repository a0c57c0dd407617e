"""Split plans must equal the ordinary ones, row by row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorloom.operators import factors, library, panel, transforms
from factorloom.plans import skew
from factorloom.plans.skew import Layout
from factorloom.sources import bars

FORMULAS = [
    "RANK(CLOSE)",
    "TS_MEAN(RET, 5)",
    "RANK(TS_STDDEV(RET, 10)) - Z_SCORE(VOLUME)",
    "DELTA(RANK(VWAP - CLOSE), 3)",
    "CORREL(CLOSE, VOLUME, 6)",
    "RANK(TS_MEAN(DELTA(RANK(VOLUME), 2), 4))",
    "RANK(-RET)",
    "RANK(OPEN)",
]


@pytest.fixture(scope="module")
def gappy(spark, folder):
    """Weekly bars with missing closes, most of them in runs."""
    weekly = bars.weekly_brand_bars(spark, folder)
    hidden = (F.weekofyear("date") % 7 < 2) & (F.length("symbol") == 7)
    return weekly.withColumn("close", F.when(~hidden, F.col("close"))).checkpoint()


def rows(df):
    ordered = df.orderBy("date", "symbol").collect()
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in ordered]


@pytest.mark.parametrize(
    "layout",
    [
        Layout(split_symbols=True, row_limit=37),
        Layout(split_dates=True, row_limit=12),
        Layout(split_symbols=True, split_dates=True, row_limit=12),
    ],
)
def test_split_plans_give_the_same_factors(spark, gappy, layout):
    usual = factors.compute_composed(gappy, FORMULAS, layout=Layout(), fill=None)
    split = factors.compute_composed(gappy, FORMULAS, layout=layout, fill=None)
    assert rows(split) == rows(usual)


def test_split_dense_factors(spark, folder):
    weekly = bars.weekly_brand_bars(spark, folder)
    tokens = ["alpha001", "alpha031", "alpha055"]
    measured = skew.measure_layout(weekly, row_limit=20)
    assert measured.split_symbols and measured.dates > 300 and measured.symbols == 25
    usual = factors.compute_named(weekly, tokens, layout=skew.measure_layout(weekly))
    split = factors.compute_named(weekly, tokens, layout=measured)
    assert rows(split) == rows(usual)


def test_return_is_carried_over_empty_segments(spark):
    rows_in = [("a", i, 2.0 if i == 0 else (3.0 if i == 95 else None)) for i in range(100)]
    frame = spark.createDataFrame(rows_in, "symbol STRING, d INT, close DOUBLE").select(
        F.expr("date_add(date'2024-01-01', d)").alias("date"), "symbol", "close"
    )
    layout = Layout(split_symbols=True, row_limit=10)
    out = factors.compute_composed(frame, ["TS_MEAN(RET, 3)", "RET"], layout=layout)
    got = {r["date"].timetuple().tm_yday - 1: r["RET"] for r in out.collect()}
    assert got[95] == 0.5 and sum(v != 0 for v in got.values()) == 1 and len(got) == 100


def test_running_total_over_one_dominant_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"), "id")
    got = skew.number_rows(df, ["g"], [F.col("id").desc()], spread=True)
    want = skew.number_rows(df, ["g"], [F.col("id").desc()], spread=False)
    assert got.exceptAll(want).isEmpty() and got.count() == 3000
    everything = skew.number_rows(df, [], [F.col("id").asc()])
    assert everything.where("rn <> id + 1").isEmpty()


def test_spread_ranks_with_one_dominant_value(spark):
    df = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") % 50).cast("double").alias("x")
    )
    got = skew.spread_ranks(df, "id", [], {"r": "x"})
    want = df.toPandas().set_index("id")["x"].rank(pct=True)
    for row in got.collect():
        assert row["r"] == pytest.approx(want[row["id"]], abs=1e-12)


def test_measured_layout(spark, folder):
    weekly = bars.weekly_brand_bars(spark, folder)
    assert not skew.measure_layout(weekly).split_dates
    tight = skew.measure_layout(weekly, row_limit=3)
    assert tight.split_dates and tight.split_symbols


def test_long_calendar_grid_equals_short_one(spark, folder, monkeypatch):
    weekly = bars.weekly_brand_bars(spark, folder)
    short = panel.densify(weekly)
    monkeypatch.setattr(panel, "CALENDAR_BLOCK", 7)
    nameless = weekly.limit(1).withColumn("date", F.lit(None).cast("date"))
    assert rows(panel.densify(weekly.unionByName(nameless))) == rows(short)


def test_exchanges_follow_depth_not_number(spark, folder):
    weekly = bars.weekly_brand_bars(spark, folder)
    batch = factors.compute_composed(weekly, library.seed_list(), layout=Layout())
    plan = batch._jdf.queryExecution().executedPlan().toString()
    # one for the bars, then symbol, date, symbol, date
    assert plan.count("Exchange hashpartitioning") == 5


@pytest.mark.parametrize("row_limit", [4, 5])
def test_leads_reach_over_segments(spark, row_limit):
    day = dt.date(2024, 1, 1)
    rows_of_symbol = [(day + dt.timedelta(i), "a", float(i * i)) for i in range(12)]
    frame = spark.createDataFrame(rows_of_symbol, "date date, symbol string, close double")
    layout = Layout(split_symbols=True, row_limit=row_limit)
    for periods in (-1, -3, 2):
        usual = transforms.lag_shift(frame, "close", periods, Layout(), allow_lead=True)
        assert rows(transforms.lag_shift(frame, "close", periods, layout, allow_lead=True)) == rows(usual)
    formulas = ["DELTA(CLOSE, -2)", "TS_MEAN(DELTA(CLOSE, -2), 3)", "DELTA(TS_MEAN(CLOSE, 3), -2)"]
    usual = factors.compute_composed(frame, formulas, layout=Layout(), fill=None, allow_lead=True)
    split = factors.compute_composed(frame, formulas, layout=layout, fill=None, allow_lead=True)
    assert rows(split) == rows(usual)


def test_repeated_and_missing_keys_rank_alike_in_both_plans(spark):
    day = dt.date(2024, 1, 1)
    names = ["a", "a", None, None, "b", "c", "c", "d"]
    rows_in = [(d, s, float((3 * i + j) % 5), float(i)) for j, d in enumerate([day, None, day + dt.timedelta(1)]) for i, s in enumerate(names)]
    frame = spark.createDataFrame(rows_in, "date date, symbol string, close double, volume double")
    formulas = ["RANK(CLOSE)", "RANK(VOLUME) + RANK(-CLOSE)", "Z_SCORE(CLOSE)", "RANK(Z_SCORE(CLOSE) * VOLUME)"]

    def found(layout):
        out = factors.compute_composed(frame, ["CLOSE", "VOLUME", *formulas], layout=layout, fill=None)
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.collect()), key=str)

    usual = found(Layout())
    assert len(usual) == len(rows_in)
    for limit in (2, 5, 1000):
        assert found(Layout(split_dates=True, row_limit=limit)) == usual


def test_ranks_over_the_limit_by_hand(spark):
    frame = spark.createDataFrame([(dt.date(2024, 1, 1), s, x) for s, x in [("a", 1.0), ("a", 5.0), (None, 2.0)]], "date date, symbol string, close double")
    got = factors.compute_composed(frame, ["CLOSE", "RANK(CLOSE)"], layout=Layout(split_dates=True, row_limit=2))
    assert sorted((r["CLOSE"], round(r["RANK(CLOSE)"], 6)) for r in got.collect()) == [(1.0, 0.333333), (2.0, 0.666667), (5.0, 1.0)]
