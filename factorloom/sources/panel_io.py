"""Reading and normalising market panels."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.operators.panel import check_keys as fail_on_duplicates

# Column names recognised as keys, compared in lower case.
DATE_NAMES = frozenset({"date", "trade_date", "calc_date", "datetime", "time"})
SYMBOL_NAMES = frozenset({"symbol", "ticker", "secid", "sec_code", "asset", "code", "unique_id"})

_FORMATS = {".parquet": "parquet", ".csv": "csv", ".txt": "csv"}


def load_panel(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: T.StructType | str | None = None,
    check_keys: bool = False,
) -> DataFrame:
    """Reads ``.parquet``, ``.csv`` or ``.txt`` (as CSV) and normalises the keys.

    Give ``schema`` for large text files: without it they are read twice, once
    to infer the types.
    """
    if format is None:
        suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
        if suffix not in _FORMATS:
            raise ValueError(f"unsupported file format {suffix!r}")
        format = _FORMATS[suffix]
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    panel = normalize_panel(reader.load(path))
    return fail_on_duplicates(panel) if check_keys else panel


def key_columns(columns: list[str]) -> tuple[str, str]:
    """The first column whose name marks a date, and the first that marks a symbol."""
    date = next((c for c in columns if c.lower() in DATE_NAMES), None)
    symbol = next((c for c in columns if c.lower() in SYMBOL_NAMES), None)
    if date is None or symbol is None:
        raise ValueError("the table needs a date column and a symbol column")
    return date, symbol


def normalize_panel(frame: DataFrame) -> DataFrame:
    """``date`` and ``symbol`` first, then every other column unchanged.

    A further column that is itself called ``date`` or ``symbol`` is left out: the
    first key-like column of either kind is the key.

    Rows are not sorted here: every window orders its own rows, and a global
    sort belongs to the sink.
    """
    date, symbol = key_columns(frame.columns)
    kept = [c for c in frame.columns if c not in (date, symbol) and c.lower() not in ("date", "symbol")]
    when = F.col(date)
    if not isinstance(frame.schema[date].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        when = F.to_timestamp(when.cast("string"))
    return frame.select(
        when.alias("date"), F.col(symbol).cast("string").alias("symbol"), *[F.col(f"`{c}`") for c in kept]
    )
