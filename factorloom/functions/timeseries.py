"""Per-symbol window functions.

``over`` is a :class:`SymbolFrame`: it hides which columns make up the window
partition, so the same definition serves an unsplit symbol and one segment of a
symbol whose history was cut into pieces.

Two families share this module.  The *sparse* family (short windows allowed)
backs composed factors; the *full* family needs ``d`` values in the frame and
backs the named factors.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from factorloom.functions.elementwise import drop_nan, finite


class SymbolFrame:
    """Window specs over one symbol's rows in date order."""

    def __init__(self, keys=("symbol",), carries: dict[str, str] | None = None):
        self.keys = list(keys)
        self.ordered = Window.partitionBy(*self.keys).orderBy("date")
        self._carries = carries or {}

    def last(self, n: int):
        return self.ordered.rowsBetween(-(n - 1), 0)

    def previous_value(self, name: str) -> Column:
        """Last non-null value of column ``name`` strictly before this row."""
        history = self.ordered.rowsBetween(Window.unboundedPreceding, -1)
        seen = F.last(F.col(name), ignorenulls=True).over(history)
        carry = self._carries.get(name)
        return F.coalesce(seen, F.col(carry)) if carry else seen


# ---- sparse family: lags count present rows, partial windows give a value ----


def shift(x: Column, n: int, over: SymbolFrame) -> Column:
    return F.lag(x, n).over(over.ordered)


def delta(x: Column, n: int, over: SymbolFrame) -> Column:
    return drop_nan(x - F.lag(x, n).over(over.ordered))


def ts_mean(x: Column, n: int, over: SymbolFrame) -> Column:
    return F.avg(finite(x)).over(over.last(n))


def ts_stddev(x: Column, n: int, over: SymbolFrame) -> Column:
    """Sample deviation; a window with fewer than two values is NULL."""
    return F.stddev_samp(finite(x)).over(over.last(n))


def _paired(x: Column, y: Column) -> tuple[Column, Column]:
    both = finite(x).isNotNull() & finite(y).isNotNull()
    return F.when(both, x), F.when(both, y)


def correl(x: Column, y: Column, n: int, over: SymbolFrame) -> Column:
    """Pairwise-complete Pearson before clamping; NULL when either side is constant."""
    px, py = _paired(x, y)
    frame = over.last(n)
    scale = F.sqrt(F.var_samp(px).over(frame) * F.var_samp(py).over(frame))
    return F.try_divide(F.covar_samp(px, py).over(frame), scale)


def clamp_correlation(rho: Column) -> Column:
    """Rounding can push a perfect correlation just outside [-1, 1]."""
    return F.when(F.abs(rho) <= 1, rho).otherwise(F.signum(rho))


def raw_return(close: Column, over: SymbolFrame) -> Column:
    """close / previous bar's close - 1; NULL on the first bar and after a zero or missing bar."""
    return F.try_divide(close, F.lag(close, 1).over(over.ordered)) - 1.0


def previous_value(name: str, over: SymbolFrame) -> Column:
    return over.previous_value(name)


def filled_return(close: Column, previous: Column) -> Column:
    """Close-to-close change against the last known close, 0 wherever undefined.

    A missing close counts as the last known one, so its return is 0.
    """
    change = F.nanvl(F.try_divide(close, previous) - 1.0, F.lit(0.0))
    return F.coalesce(F.when(F.abs(change) != float("inf"), change), F.lit(0.0))


# ---- full family: NULL until the frame holds d values ----


def _when_full(value: Column, count: Column, d: int) -> Column:
    return F.when(count == d, value)


def full_sum(x, d, over):
    v, w = finite(x), over.last(d)
    return _when_full(F.sum(v).over(w), F.count(v).over(w), d)


def full_mean(x, d, over):
    v, w = finite(x), over.last(d)
    return _when_full(F.avg(v).over(w), F.count(v).over(w), d)


def full_stddev(x, d, over):
    v, w = finite(x), over.last(d)
    return _when_full(F.stddev_samp(v).over(w), F.count(v).over(w), d)


def full_min(x, d, over):
    v, w = finite(x), over.last(d)
    return _when_full(F.min(v).over(w), F.count(v).over(w), d)


def full_max(x, d, over):
    v, w = finite(x), over.last(d)
    return _when_full(F.max(v).over(w), F.count(v).over(w), d)


def full_correlation(x, y, d, over):
    px, _ = _paired(x, y)
    return _when_full(correl(x, y, d, over), F.count(px).over(over.last(d)), d)


def full_covariance(x, y, d, over):
    px, py = _paired(x, y)
    w = over.last(d)
    return _when_full(F.covar_samp(px, py).over(w), F.count(px).over(w), d)


def frame_values(x, d, over) -> Column:
    """The last ``d`` values, oldest first; NULL unless all are present.

    The array never holds more than ``d`` elements, ``d`` being a small constant.
    """
    values = F.collect_list(finite(x)).over(over.last(d))
    return F.when(F.size(values) == d, values)


def array_rank(values: Column, d: int) -> Column:
    """Average-tie rank of the newest element divided by ``d``."""
    newest = F.element_at(values, -1)
    below = F.size(F.filter(values, lambda v: v < newest))
    tied = F.size(F.filter(values, lambda v: v == newest))
    return F.when(values.isNotNull(), (below + (tied + 1) / 2.0) / float(d))


def array_argmax(values: Column) -> Column:
    """1-based position from the oldest bar, earliest wins."""
    return F.array_position(values, F.array_max(values)).cast("double")


def array_argmin(values: Column) -> Column:
    return F.array_position(values, F.array_min(values)).cast("double")


def array_decay(values: Column, d: int) -> Column:
    """Linearly weighted mean, weights 1..d from oldest to newest."""
    weighted = F.zip_with(values, F.sequence(F.lit(1), F.lit(d)), lambda v, k: v * k)
    return F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v) / (d * (d + 1) / 2.0)


def array_product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda acc, v: acc * v)
