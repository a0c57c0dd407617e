"""Operators available in composed formulas, and the way to add more."""

from __future__ import annotations

from factorloom.functions import crosssection as cs
from factorloom.functions import elementwise as ew
from factorloom.functions import timeseries as ts
from factorloom.plans.expressions import ADD
from factorloom.plans.staging import Node, Operator, mark_inexact



def window_terms(name: str, table, total: bool = False):
    """Terms of a window mean (or sum): the same window over the sizes of what it adds; an own field has one sign."""

    def terms(columns, x, n):
        if x.leaf:
            return None
        size = columns.size(x)
        if not isinstance(size, Node):
            return size * n if total else size
        return columns.apply(table()[name], size, n)

    return terms


def delta_terms(delay: Operator):
    """Terms of a difference with an earlier row: both sides."""

    def terms(columns, x, n):
        size = columns.size(x)
        if not isinstance(size, Node):
            return 2 * size
        return columns.apply(ADD, size, columns.apply(delay, size, n))

    return terms


_DELAY = Operator(
    "_delay", ts.shift, by="symbol", integers=1, lookback=lambda n: max(n, 0), lookahead=lambda n: max(-n, 0)
)

OPERATORS: dict[str, Operator] = {
    op.name: op
    for op in [
        Operator("RANK", None, by="date", round_operand=True),
        Operator(
            "DELTA", ts.delta, by="symbol", integers=1, lookback=lambda n: max(n, 0), lookahead=lambda n: max(-n, 0),
            terms=delta_terms(_DELAY),
        ),
        Operator(
            "TS_MEAN", ts.ts_mean, by="symbol", integers=1, lookback=lambda n: n - 1,
            terms=window_terms("TS_MEAN", lambda: OPERATORS),
        ),
        Operator("TS_STDDEV", ts.ts_stddev, by="symbol", integers=1, lookback=lambda n: n - 1),
        Operator(
            "CORREL",
            ts.correl,
            by="symbol",
            series=2,
            integers=1,
            lookback=lambda n: n - 1,
            finish=ts.clamp_correlation,
            terms=lambda columns, *args: 1.0,  # products over the deviations they are divided by
        ),
        Operator("Z_SCORE", cs.ZSCORE, by="date", terms=lambda columns, x: 1.0),
        Operator("SIGN", ew.sign),
        Operator("ABS", ew.absolute, terms=lambda columns, x: columns.terms(x)),
    ]
}
mark_inexact(["TS_MEAN", "TS_STDDEV", "CORREL", "Z_SCORE", "_vwap"])

_PREVIOUS = Operator(
    "_previous", ts.previous_value, by="symbol", carries=True, lookback=lambda: 0
)
_RETURN = Operator("_return", ts.filled_return, series=2, repeats_arguments=True)
_VWAP = Operator("_vwap", cs.WEIGHTED_PRICE, by="date", series=2)


def filled_return_node(reader):
    close = reader.columns.field_node("CLOSE")
    return reader.columns.apply(_RETURN, close, reader.columns.apply(_PREVIOUS, close))


def weighted_price_node(reader):
    columns = reader.columns
    return columns.apply(_VWAP, columns.field_node("CLOSE"), columns.field_node("VOLUME"))


def register_operator(
    name: str, fn, *, by: str | None = None, series: int = 1, integers: int = 0, lookback=None, lookahead=None
) -> None:
    """Make ``name`` usable in composed formulas.

    Row-wise: ``fn(*columns, *ints) -> Column``.  ``by="symbol"``: ``fn`` also
    receives the :class:`SymbolFrame` as last argument and ``lookback(*ints)``
    must say how many earlier rows it reads, ``lookahead(*ints)`` how many later
    ones (none, if it is not given).  ``by="date"``: ``fn`` is a :class:`DateMoments`.
    """
    if by == "symbol" and lookback is None:
        raise ValueError("a per-symbol operator must declare its lookback")
    if by == "date" and not isinstance(fn, cs.DateMoments):
        raise ValueError("a per-date operator is given as DateMoments")
    OPERATORS[name] = Operator(
        name,
        fn,
        by=by,
        series=series,
        integers=integers,
        lookback=lookback or (lambda *ints: 0),
        lookahead=lookahead or (lambda *ints: 0),
        repeats_arguments=by is None,
    )
    if by is not None:
        mark_inexact([name])
