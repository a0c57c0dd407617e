"""Texts on their way through tokenizers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOOSE = re.compile(r" \s")
_CLEAN = re.compile(r"(?<=[^ ]) (?=\S)")


def blank_parts(text: str) -> list[str]:
    """Parts of a text between single blanks; a run of white space stays inside the part that it ends.

    Patterns that join one blank to the word behind it, and vocabularies with
    blanks only in front, never join text over such a cut.
    """
    if _LOOSE.search(text) is None and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return _CLEAN.split(text)


def bounded(batch: pd.DataFrame, text: str, size: int) -> Iterator[pd.DataFrame]:
    """Runs of rows with about ``size`` characters each."""
    ends = batch[text].str.len().fillna(0).cumsum().to_numpy() // size
    for first, last in zip(starts := [0, *(np.flatnonzero(np.diff(ends)) + 1)], [*starts[1:], len(batch)]):
        yield batch.iloc[first:last]


def with_texts(docs: DataFrame, text: str, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``k0, k1, ..., text``: what a Python worker gets, and the names of the columns that pass through.

    Whole numbers pass as decimals: beside a NULL, pandas would make them floating point.
    """
    def passing(name: str) -> Column:
        kind = docs.select(F.col(f"`{name}`").alias("x")).schema["x"].dataType
        return F.col(f"`{name}`").cast("string") if isinstance(kind, T.IntegralType) else F.col(f"`{name}`")

    names = [f"k{i}" for i in range(len(keep))]
    cols = [passing(c).alias(n) for c, n in zip(keep, names)]
    return docs.select(*cols, F.col(f"`{text}`").alias("text")), names


def restored(made: DataFrame, docs: DataFrame, keep: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The columns that passed through under their names and types."""
    kinds = [docs.select(F.col(f"`{c}`").alias("x")).schema["x"].dataType for c in keep]
    rest = [F.col(c) for c in made.columns if c not in set(names)]
    return made.select(*[F.col(n).cast(k).alias(c) for n, k, c in zip(names, kinds, keep)], *rest)


def byte_letters() -> dict[str, int]:
    """Byte of each letter in which byte-level vocabularies are written: visible Latin-1 letters stand for
    themselves, the other bytes in order for the letters from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
