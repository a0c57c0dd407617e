"""Post-processing of one factor column: ``date, symbol, <column>`` in, the same out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factorloom.functions import timeseries as ts
from factorloom.operators.panel import apply_one
from factorloom.operators.registry import OPERATORS
from factorloom.plans.skew import Layout
from factorloom.plans.staging import Operator

_SHIFT = Operator(
    "_shift", ts.shift, by="symbol", integers=1, lookback=lambda n: max(n, 0), lookahead=lambda n: max(-n, 0)
)


def rank_transform(frame: DataFrame, column: str, layout: Layout | None = None) -> DataFrame:
    """Average-tie percentile rank per date."""
    return apply_one(
        frame, {"x": column}, lambda c: c.apply(OPERATORS["RANK"], c.field_node("x")), column, layout
    )


def zscore_normalize(frame: DataFrame, column: str, layout: Layout | None = None) -> DataFrame:
    """(x - date mean) / date sample deviation; 0 where undefined."""
    return apply_one(
        frame, {"x": column}, lambda c: c.apply(OPERATORS["Z_SCORE"], c.field_node("x")), column, layout
    )


normalize_factor_series = zscore_normalize


def lag_shift(
    frame: DataFrame, column: str, periods: int, layout: Layout | None = None, allow_lead: bool = False
) -> DataFrame:
    """The value ``periods`` present rows earlier; later rows only with ``allow_lead``."""
    if periods < 0 and not allow_lead:
        raise ValueError("a negative shift looks ahead")
    return apply_one(
        frame, {"x": column}, lambda c: c.apply(_SHIFT, c.field_node("x"), periods), column, layout
    )
