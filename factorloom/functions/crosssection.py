"""Per-date functions.

A :class:`DateMoments` operator is written as a set of per-date aggregates plus
a row-wise finish.  The ordinary plan evaluates the aggregates as windows over
the date; for dates too large for one task the same aggregates run as a
partially combined ``groupBy`` joined back (see ``plans/skew.py``).
Percentile rank is the only order-based one and has its own two forms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.elementwise import drop_nan


@dataclass(frozen=True)
class DateMoments:
    """``aggregates(*series)`` lists per-date aggregates, ``finish(series, values)`` combines."""

    aggregates: Callable[..., list[Column]]
    finish: Callable[[list[Column], list[Column]], Column]

    def over_window(self, keys, *series: Column) -> Column:
        whole = Window.partitionBy(*keys)
        return self.finish(list(series), [a.over(whole) for a in self.aggregates(*series)])


def percent_rank_average(x: Column, keys=("date",)) -> Column:
    """Average-tie rank divided by the number of non-null values; NULL stays NULL.

    One window spec serves all three terms: ``rank`` is the lowest position of a
    tie, the running count (default RANGE frame) its highest.
    """
    by_value = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    middle = (F.rank().over(by_value) + F.count(x).over(by_value)) / 2
    return F.when(x.isNotNull(), middle / F.count(x).over(whole))


def rank_columns(df: DataFrame, columns: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Percentile ranks of many columns at once: ``date, symbol``, ``keep``, then the ranks.

    ``columns`` maps output name -> column.  Inside each task the wide rows are
    laid out as one short row per value, sorted once by (date, column, value),
    ranked by one window and folded back.  All three steps are satisfied by the
    one exchange on ``date``.  Kept columns ride along as further values.
    ``_row`` tells rows with equal keys apart; it is made and used up between
    two shuffles, so a rerun task makes its own.
    """
    values = [*columns.values(), *keep]
    # Only rows of the same date need to share a task.
    placed = df.repartition("date").withColumn("_row", F.monotonically_increasing_id())
    short = placed.select(
        "date", "symbol", "_row", F.posexplode(F.array(*values)).alias("_at", "_x")
    )
    x = F.when(F.col("_at") < len(columns), F.col("_x"))  # kept values need no rank
    ranked = short.withColumn("_r", percent_rank_average(x, ("date", "_at")))
    at = F.col("_at")
    folded = [
        *[F.max(F.when(at == i, F.col("_r"))).alias(name) for i, name in enumerate(columns)],
        *[
            F.max(F.when(at == len(columns) + i, F.col("_x"))).alias(name)
            for i, name in enumerate(keep)
        ],
    ]
    return ranked.groupBy("date", "symbol", "_row").agg(*folded).select(
        "date", "symbol", *keep, *columns
    )


def _zscore_finish(series, values):
    (x,), (mean, deviation) = series, values
    return F.coalesce(drop_nan(F.try_divide(x - mean, deviation)), F.lit(0.0))


ZSCORE = DateMoments(
    aggregates=lambda x: [F.avg(x), F.stddev_samp(x)],
    finish=_zscore_finish,
)

UNIT_SCALE = DateMoments(
    aggregates=lambda x: [F.sum(F.abs(x))],
    finish=lambda series, values: drop_nan(F.try_divide(series[0], values[0])),
)

# close * volume / total volume of the date; the plain close where that is undefined
WEIGHTED_PRICE = DateMoments(
    aggregates=lambda close, volume: [F.sum(volume)],
    finish=lambda series, values: F.coalesce(
        drop_nan(F.try_divide(series[0] * series[1], values[0])), series[0]
    ),
)


def z_score(x: Column, keys=("date",)) -> Column:
    return ZSCORE.over_window(keys, x)


def scale(x: Column, keys=("date",)) -> Column:
    return UNIT_SCALE.over_window(keys, x)


def weighted_price(close: Column, volume: Column, keys=("date",)) -> Column:
    return WEIGHTED_PRICE.over_window(keys, close, volume)
