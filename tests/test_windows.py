"""Hand-made cases for every edge rule of the composed operators."""

import datetime as dt
import math

import pytest

from factorloom.operators import factors, panel, transforms
from factorloom.plans.skew import Layout

PLAIN = Layout()
SCHEMA = "date DATE, symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def series(spark, closes, volumes=None, symbol="a"):
    volumes = volumes or [1.0] * len(closes)
    rows = [
        (day(i), symbol, 1.0, 2.0, 0.5, c, v) for i, (c, v) in enumerate(zip(closes, volumes))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def cross(spark, closes, volumes=None):
    volumes = volumes or [1.0] * len(closes)
    rows = [
        (day(0), f"s{i}", 1.0, 2.0, 0.5, c, v) for i, (c, v) in enumerate(zip(closes, volumes))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def values(frame, formula, **options):
    out = factors.evaluate(frame, formula, layout=PLAIN, **options).orderBy("date", "symbol")
    return [r["value"] for r in out.collect()]


def test_rank_averages_ties_and_keeps_null(spark):
    assert values(cross(spark, [1.0, 1.0, 2.0, None]), "RANK(CLOSE)") == [0.5, 0.5, 1.0, None]


def test_rank_counts_infinity_as_a_value(spark):
    frame = cross(spark, [1.0, 2.0, 3.0], [1.0, 1.0, 0.0])
    assert values(frame, "RANK(CLOSE / VOLUME)") == [pytest.approx(x / 3) for x in (1, 2, 3)]


def test_many_ranks_together_equal_single_ranks(spark):
    frame = cross(spark, [3.0, 1.0, None, 1.0, 2.0], [5.0, 4.0, 4.0, None, 1.0])
    texts = ["RANK(CLOSE)", "RANK(VOLUME)", "RANK(CLOSE - VOLUME)", "RANK(CLOSE * VOLUME)", "RANK(-CLOSE)"]
    together = factors.compute_composed(frame, texts, layout=PLAIN, fill=None).orderBy("symbol").collect()
    for text in texts:
        assert [r[text] for r in together] == values(frame, text)


def test_many_ranks_keep_rows_with_equal_keys(spark):
    frame = cross(spark, [3.0, 1.0, 2.0]).unionByName(cross(spark, [3.0, 1.0, 2.0]))
    texts = ["RANK(CLOSE)", "RANK(-CLOSE)", "RANK(CLOSE * CLOSE)", "RANK(ABS(CLOSE))"]
    assert factors.compute_composed(frame, texts, layout=PLAIN).count() == 6


def test_ts_mean_skips_null_and_infinity(spark):
    assert values(series(spark, [1.0, None, 3.0]), "TS_MEAN(CLOSE, 2)") == [1.0, 1.0, 3.0]
    frame = series(spark, [1.0, 1.0, 3.0, None, 5.0], [1.0, 0.0, 1.0, 1.0, 1.0])
    assert values(frame, "TS_MEAN(CLOSE / VOLUME, 2)") == [1.0, 1.0, 3.0, 3.0, 5.0]


def test_ts_stddev_needs_two_values(spark):
    got = values(series(spark, [1.0, 3.0]), "TS_STDDEV(CLOSE, 5)")
    assert got[0] is None and got[1] == pytest.approx(math.sqrt(2))
    filled = factors.compute_factors(series(spark, [1.0]), ["TS_STDDEV(CLOSE, 5)"], layout=PLAIN)
    assert filled.first()["TS_STDDEV(CLOSE, 5)"] == 0.0


def test_correl_of_constant_is_null_and_stays_in_range(spark):
    frame = series(spark, [1.0, 1.0, 1.0], [1.0, 2.0, 3.0])
    assert values(frame, "CORREL(CLOSE, VOLUME, 3)") == [None, None, None]
    frame = series(spark, [0.1, 0.2, 0.3], [0.1, 0.2, 0.3])
    assert values(frame, "CORREL(CLOSE, VOLUME, 3)")[1:] == [pytest.approx(1.0)] * 2
    assert max(v for v in values(frame, "CORREL(CLOSE, VOLUME, 3)") if v is not None) <= 1.0


def test_delta_counts_present_rows(spark):
    frame = series(spark, [1.0, 5.0, 7.0]).where("date <> '2024-01-02'")
    assert values(frame, "DELTA(CLOSE, 1)") == [None, 6.0]


def test_z_score_of_constant_and_null_is_zero(spark):
    assert values(cross(spark, [2.0, 2.0, 2.0]), "Z_SCORE(CLOSE)") == [0.0, 0.0, 0.0]
    assert values(cross(spark, [1.0, 3.0, None]), "Z_SCORE(CLOSE)")[2] == 0.0


def test_return_fills_gaps(spark):
    assert values(series(spark, [1.0, None, 2.0]), "RET") == [0.0, 0.0, 1.0]
    assert values(series(spark, [0.0, 2.0]), "RET") == [0.0, 0.0]


def test_weighted_price(spark):
    assert values(cross(spark, [5.0], [0.0]), "VWAP") == [5.0]
    assert values(cross(spark, [2.0, 4.0], [1.0, 3.0]), "VWAP") == [0.5, 3.0]
    with pytest.raises(KeyError):
        panel.compute_weighted_price(cross(spark, [1.0]).drop("volume"))


def test_division_follows_ieee(spark):
    frame = series(spark, [1.0, -1.0, 0.0, None], [0.0] * 4)
    assert values(frame, "CLOSE / VOLUME") == [math.inf, -math.inf, None, None]


def test_power_and_constants(spark):
    frame = series(spark, [-4.0, 4.0])
    assert values(frame, "CLOSE ** 0.5") == [None, 2.0]
    assert values(frame, "3") == [3.0, 3.0]
    assert values(frame, "2 * 3 - 1") == [5.0, 5.0]


@pytest.mark.parametrize(
    "text",
    ["DELTA(CLOSE, -1)", "TS_MEAN(CLOSE, 0)", "NOPE(CLOSE)", "PRICE", "RANK(CLOSE", "RANK(3)",
     "CLOSE < OPEN", "DELTA(CLOSE)", "TS_MEAN(CLOSE, 2.5)", "'text'"],
)
def test_bad_formula_names_its_label(spark, text):
    with pytest.raises(ValueError, match="cannot be computed"):
        factors.compute_factors(series(spark, [1.0]), ["RANK(CLOSE)", text], layout=PLAIN)


def test_lead_only_when_allowed(spark):
    frame = series(spark, [1.0, 2.0, 4.0])
    assert values(frame, "DELTA(CLOSE, -1)", allow_lead=True) == [-1.0, -2.0, None]
    with pytest.raises(ValueError):
        transforms.lag_shift(frame, "close", -1)


def test_duplicate_labels_collapse_and_empty_batch_has_keys(spark):
    frame = series(spark, [1.0])
    out = factors.compute_factors(frame, ["CLOSE", " CLOSE "], layout=PLAIN)
    assert out.columns == ["date", "symbol", "CLOSE"]
    assert factors.compute_factors(frame, [], layout=PLAIN).columns == ["date", "symbol"]


def test_unknown_named_factor(spark):
    with pytest.raises(ValueError, match="unknown named"):
        factors.compute_factors(series(spark, [1.0]), ["alpha048"], layout=PLAIN)


def test_named_factor_needs_all_bar_fields(spark):
    with pytest.raises(ValueError, match="missing"):
        factors.compute_factors(series(spark, [1.0]), ["alpha101"], layout=PLAIN)


def test_available_and_allowed_inputs(spark):
    frame = series(spark, [1.0])
    assert panel.available_inputs(frame) == ["CLOSE", "HIGH", "LOW", "OPEN", "RET", "VOLUME", "VWAP"]
    assert panel.available_inputs(frame.drop("volume", "open")) == ["CLOSE", "HIGH", "LOW", "RET"]
    assert panel.allowed_inputs(frame, ["ret"]) == ["CLOSE", "HIGH", "LOW", "OPEN", "VOLUME", "VWAP"]
    with pytest.raises(ValueError, match="case"):
        panel.numeric_fields(frame.selectExpr("date", "symbol", "close", "high as Close_", "low as close_"))


def test_duplicate_keys_are_reported(spark):
    with pytest.raises(ValueError, match="duplicate"):
        panel.check_keys(series(spark, [1.0]).unionByName(series(spark, [2.0])))
