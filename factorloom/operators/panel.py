"""Panels: fields, derived fields, grids and reshaping.

A panel is a DataFrame with ``date``, ``symbol`` and numeric fields.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.functions.elementwise import drop_nan
from factorloom.plans.skew import Layout, measure_layout
from factorloom.plans.staging import FactorColumns

KEYS = ("date", "symbol")
BAR_FIELDS = ("open", "high", "low", "close", "volume", "amount")
# Dates that travel together in one array when a grid is laid out.
CALENDAR_BLOCK = 4096


def numeric_fields(panel: DataFrame) -> DataFrame:
    """Keys plus every numeric column as double under its upper-case name."""
    fields = [
        f for f in panel.schema if f.name not in KEYS and isinstance(f.dataType, T.NumericType)
    ]
    upper = [f.name.upper() for f in fields]
    clash = sorted({u for u in upper if upper.count(u) > 1})
    if clash:
        raise ValueError(f"columns differ only in case: {clash}")
    return panel.select(
        *KEYS, *[drop_nan(F.col(f.name).cast("double")).alias(f.name.upper()) for f in fields]
    )


def available_inputs(panel: DataFrame) -> list[str]:
    """Sorted names usable in composed formulas; reads the schema only."""
    names = {
        f.name.upper()
        for f in panel.schema
        if f.name not in KEYS and isinstance(f.dataType, T.NumericType)
    }
    present = {c.lower() for c in panel.columns}
    if "close" in present:
        names.add("RET")
        if "volume" in present:
            names.add("VWAP")
    return sorted(names)


def restrict_fields(panel: DataFrame, deny: Iterable[str]) -> DataFrame:
    """Drops denied fields, matched without regard to case."""
    denied = {d.upper() for d in deny}
    return panel.drop(*[c for c in panel.columns if c.upper() in denied and c not in KEYS])


def allowed_inputs(panel: DataFrame, deny: Iterable[str]) -> list[str]:
    denied = {d.upper() for d in deny}
    return [name for name in available_inputs(panel) if name not in denied]


def _match(panel: DataFrame, wanted: str) -> str | None:
    return next((c for c in panel.columns if c.lower() == wanted), None)


def apply_one(panel: DataFrame, inputs: dict[str, str], build, name: str, layout) -> DataFrame:
    """Adds one derived column, by the layout the panel's group sizes call for."""
    layout = layout or measure_layout(panel)
    columns = FactorColumns({k: f"_in_{k}" for k in inputs}, rank_noise_bits=None)
    fed = panel.select(
        *KEYS, *[drop_nan(F.col(c).cast("double")).alias(f"_in_{k}") for k, c in inputs.items()]
    )
    return columns.add_to(fed, {name: build(columns)}, layout)


def compute_weighted_price(
    panel: DataFrame,
    price_column: str | None = None,
    volume_column: str | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """``date, symbol, vwap``: price * volume over the date's total volume, else the price."""
    from factorloom.operators.registry import _VWAP

    price = price_column or _match(panel, "close")
    volume = volume_column or _match(panel, "volume")
    if not price or not volume:
        raise KeyError("a price and a volume column are needed")

    def build(c):
        return c.apply(_VWAP, c.field_node("price"), c.field_node("volume"))

    return apply_one(panel, {"price": price, "volume": volume}, build, "vwap", layout)


def traded_price(amount: Column, volume: Column) -> Column:
    """amount / (volume + 1e-7), the price the named factors use."""
    return amount / (volume + F.lit(1e-7))


def check_keys(panel: DataFrame) -> DataFrame:
    """The panel unchanged; fails while running if a (date, symbol) pair repeats."""
    counted = panel.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    found = counted.first()
    if found is not None:
        raise ValueError(f"duplicate key {found['date']}, {found['symbol']}")
    return panel


def densify(panel: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Every symbol on every date of the panel; absent pairs get NULL fields.

    Lags on the result count calendar positions.  A row whose date or symbol is
    NULL belongs to no place of the grid and is left out.
    """
    missing = [f for f in BAR_FIELDS if _match(panel, f) is None]
    if missing:
        raise ValueError(f"fields missing for a bar grid: {missing}")
    keyed = panel.where(F.col("date").isNotNull() & F.col("symbol").isNotNull())
    bars = keyed.select(*KEYS, *[F.col(_match(panel, f)).alias(f) for f in BAR_FIELDS])
    layout = layout or measure_layout(panel)
    dates = bars.select("date").distinct()
    count = layout.dates if layout.dates is not None else dates.count()
    blocks = max(1, -(-count // CALENDAR_BLOCK))
    calendar = dates.groupBy(F.pmod(F.xxhash64("date"), F.lit(blocks)).alias("block")).agg(
        F.collect_list("date").alias("dates")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    symbols = bars.select("symbol").distinct().withColumn("block", every)
    grid = symbols.join(calendar, "block").select("symbol", F.explode("dates").alias("date"))
    return grid.join(bars, list(KEYS), "left").select(*KEYS, *BAR_FIELDS)


def dense_layout(layout: Layout) -> Layout:
    """Group sizes after :func:`densify` follow from the counts already measured."""
    if layout.dates is None or layout.symbols is None:
        return layout
    return Layout(
        split_symbols=layout.dates > layout.row_limit,
        split_dates=layout.symbols > layout.row_limit,
        row_limit=layout.row_limit,
        dates=layout.dates,
        symbols=layout.symbols,
    )


def to_long(matrix: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide factor matrix to ``date, symbol, factor, value``; NULL values stay as rows."""
    names = list(columns) if columns is not None else [c for c in matrix.columns if c not in KEYS]
    plain = matrix.select(
        *KEYS, *[F.col(_quote(c)).cast("double").alias(f"_v{i}") for i, c in enumerate(names)]
    )
    pairs = [
        F.struct(F.lit(name).alias("factor"), F.col(f"_v{i}").alias("value"))
        for i, name in enumerate(names)
    ]
    return plain.select(*KEYS, F.explode(F.array(*pairs)).alias("p")).select(
        *KEYS, "p.factor", "p.value"
    )


def to_wide(long: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Back to one column per factor; the factor names are given, so no extra pass finds them."""
    return long.groupBy(*KEYS).agg(
        *[
            F.max(F.when(F.col("factor") == name, F.col("value"))).alias(name) for name in factors
        ]
    )


def combine_factor_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Full outer join on the keys."""
    return reduce(lambda a, b: a.join(b, list(KEYS), "full_outer"), frames)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

