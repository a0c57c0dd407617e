"""Batch evaluation of factor formulas."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators import named, panel as panels
from factorloom.operators.registry import OPERATORS, filled_return_node, weighted_price_node
from factorloom.plans.expressions import FormulaReader
from factorloom.plans.skew import Layout, measure_layout
from factorloom.plans.staging import FactorColumns

_NAMED_TOKEN = re.compile(r"alpha\d{3}", re.IGNORECASE)


def split_formulas(formulas: Sequence[str]) -> tuple[list[str], list[str]]:
    """Named tokens (lower-cased) and composed formulas, each in given order."""
    tokens, composed = [], []
    for formula in formulas:
        text = formula.strip()
        (tokens.append(text.lower()) if _NAMED_TOKEN.fullmatch(text) else composed.append(text))
    return tokens, composed


def compute_composed(
    panel: DataFrame,
    formulas: Sequence[str],
    *,
    layout: Layout | None = None,
    allow_lead: bool = False,
    fill: float | None = 0.0,
) -> DataFrame:
    """Composed formulas over the rows present in the panel, one column per distinct label."""
    fed = panels.numeric_fields(panel)
    columns = FactorColumns({c: c for c in fed.columns if c not in panels.KEYS})
    derived = {}
    if "CLOSE" in columns.fields:
        derived["RET"] = filled_return_node
        if "VOLUME" in columns.fields:
            derived["VWAP"] = weighted_price_node
    reader = FormulaReader(columns, OPERATORS, derived, allow_lead=allow_lead)
    roots = _read_all(reader, formulas)
    out = columns.add_to(fed, roots, layout or measure_layout(panel))
    return out if fill is None else out.fillna(fill, subset=list(roots)) if roots else out


def compute_dense(
    panel: DataFrame,
    formulas: Mapping[str, str],
    *,
    layout: Layout | None = None,
    use_amount: bool = False,
) -> DataFrame:
    """Formulas in the named library's functions, over the dense grid; NULL stays NULL."""
    layout = layout or measure_layout(panel)
    grid = panels.densify(panels.numeric_fields(panel), layout)
    fed = grid.select(
        *panels.KEYS,
        *panels.BAR_FIELDS,
        panels.traded_price(F.col("amount"), F.col("volume")).alias("vwap"),
    )
    columns = FactorColumns({c: c for c in fed.columns if c not in panels.KEYS})
    operators = named.operators(volume_field="amount" if use_amount else "volume")
    reader = FormulaReader(columns, operators, {"ret": named.return_node}, comparisons=True)
    roots = _read_all(reader, list(formulas.items()))
    return columns.add_to(fed, roots, panels.dense_layout(layout))


def compute_named(panel: DataFrame, tokens: Sequence[str], **options) -> DataFrame:
    """Named factors, one column per distinct token."""
    unknown = sorted({t for t in tokens if t not in named.FORMULAS})
    if unknown:
        raise ValueError(f"unknown named factors: {unknown}")
    return compute_dense(panel, {t: named.FORMULAS[t] for t in tokens}, **options)


def compute_factors(
    panel: DataFrame,
    formulas: Sequence[str],
    *,
    layout: Layout | None = None,
    sort: bool = False,
    allow_lead: bool = False,
    use_amount: bool = False,
) -> DataFrame:
    """Wide factor matrix for a mix of named and composed formulas.

    Composed factors end with NULL filled by 0.0, named ones keep NULL.
    """
    tokens, composed = split_formulas(formulas)
    layout = layout or measure_layout(panel)
    frames = []
    if tokens:
        frames.append(compute_named(panel, tokens, layout=layout, use_amount=use_amount))
    if composed:
        frames.append(compute_composed(panel, composed, layout=layout, allow_lead=allow_lead))
    if not frames:
        frames.append(panel.select(*panels.KEYS))
    out = panels.combine_factor_frames(frames)
    return out.orderBy(*panels.KEYS) if sort else out


def evaluate(panel: DataFrame, formula: str, **options) -> DataFrame:
    """One formula, not filled: ``date, symbol, value``."""
    tokens, composed = split_formulas([formula])
    if tokens:
        return compute_named(panel, tokens, **options).withColumnRenamed(tokens[0], "value")
    return compute_composed(panel, composed, fill=None, **options).toDF(*panels.KEYS, "value")


def _read_all(reader: FormulaReader, formulas) -> dict[str, object]:
    roots = {}
    for item in formulas:
        label, text = item if isinstance(item, tuple) else (item, item)
        try:
            root = reader.read(text)
            if isinstance(root, str) or root is None:
                raise ValueError(f"{root!r} is not a number")
            roots[label] = root
        except Exception as error:
            raise ValueError(f"factor {label!r} cannot be computed: {error}") from error
    return roots
