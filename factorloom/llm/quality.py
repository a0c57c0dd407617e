"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

:func:`text_statistics` describes a whole text by a fixed number of figures.
:func:`train` maps them through random Fourier features (a Gaussian kernel),
sums the normal equations per partition, merges the sums in a few tasks, solves
one small system, and calibrates ridge scores of rows kept apart from the
equations to probabilities with isotonic regression.  :func:`score` applies the
model, a few thousand numbers, to any texts.

Defined results: NULL and empty texts have the same statistics and get a score
like any other; a text of any length is read whole; repeated rows get equal
scores; an empty table gives no rows; with no labelled rows of both classes
every score is the share of label 1 seen (0.5 if none).  Training reads only the
text and the label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import isotonic, release, stored

WAVES = 256
RIDGE = 1e-3
BINS = 512
# One fifth of the labelled rows is kept for calibration.
CALIBRATE = 5
# Partial normal equations are merged in so many tasks before the driver adds these up.
MERGERS = 8

# Character classes by code point below 128.
_KINDS = ("upper", "lower", "digit", "blank", "stop", "mark")


def _kind_table() -> np.ndarray:
    kinds = np.full(128, _KINDS.index("mark"), "int64")
    kinds[ord("A") : ord("Z") + 1] = _KINDS.index("upper")
    kinds[ord("a") : ord("z") + 1] = _KINDS.index("lower")
    kinds[ord("0") : ord("9") + 1] = _KINDS.index("digit")
    kinds[[9, 10, 11, 12, 13, 32]] = _KINDS.index("blank")
    kinds[[ord(c) for c in ".,;:?'\"()-"]] = _KINDS.index("stop")
    return kinds


_TABLE = _kind_table()
STATISTICS = 22


def text_statistics(text: str | None) -> np.ndarray:
    out = np.zeros(STATISTICS)
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    plain = codes < 128
    counts = np.bincount(_TABLE[codes[plain]], minlength=len(_KINDS)).astype(float)
    n = len(codes)
    other = n - plain.sum()
    letters = counts[0] + counts[1] + other
    words = text.split()
    w = len(words)
    out[0] = np.log1p(n)
    out[1] = np.log1p(w)
    out[2] = counts[0] / max(1.0, letters)
    out[3:8] = np.append(counts[2:], other) / n
    out[8] = np.sqrt(counts[5] / n)
    if w:
        lengths = np.fromiter(map(len, words), "int64", w)
        distinct = set(words)
        out[9] = lengths.mean() / 10
        out[10] = lengths.std() / 10
        out[11] = len(distinct) / w
        out[12] = np.log1p(w) - np.log1p(len(distinct))
        same = sum(a == b for a, b in zip(words, words[1:]))
        out[13] = same / w
        pairs = len(set(zip(words, words[1:])))
        out[14] = pairs / max(1, w - 1)
        out[15] = sum(map(str.isupper, words)) / w
        out[16] = sum(1 for x in distinct if not (x[-1].isalnum() or x[-1] in ".,")) / len(distinct)
        out[17] = min(1.0, lengths.max() / 100)
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    out[18] = np.log1p(len(lines))
    out[19] = len(set(filled)) / max(1, len(filled))
    out[20] = np.log1p(n / len(lines)) / 10
    out[21] = (text.count(".") + text.count("?") + text.count("!")) / max(1, w)
    return out


def statistics_frame(texts: pd.Series) -> np.ndarray:
    return np.array([text_statistics(t) for t in texts]).reshape(len(texts), STATISTICS)


@dataclass(frozen=True)
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    rates: np.ndarray

    def waves(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        waves = np.cos(np.clip(z, -8, 8) @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.waves(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.rates)


def _normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of waves x waves and waves x label: per partition, then in a few tasks, then here."""
    width = len(model.phases) + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            phi = model.waves(np.vstack(b["x"].to_list()))
            left += phi.T @ phi
            right += phi.T @ b["y"].to_numpy()
        yield pd.DataFrame({"sums": [np.vstack([left, right]).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1) * width)
        for b in batches:
            for sums in b["sums"]:
                total += np.frombuffer(sums)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = rows.mapInPandas(part, "sums binary").repartition(MERGERS).mapInPandas(add, "sums binary")
    total = np.zeros((width + 1, width))
    for row in parts.collect():  # MERGERS rows
        total += np.frombuffer(row["sums"]).reshape(width + 1, width)
    return total[:width], total[width]


def described(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``*keep, x``: the statistics of every text, written once; only these travel on."""
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *[c.alias(n) for n, c in keep.items()])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            x = statistics_frame(b.pop("_text"))
            yield b.assign(x=list(x))

    out = T.StructType([*rows.drop("_text").schema, T.StructField("x", T.ArrayType(T.DoubleType()))])
    return stored(rows.mapInPandas(describe, out), "statistics")


def labelled(rows: DataFrame, labels: DataFrame, key: str = "key") -> DataFrame:
    """``x, y, kept`` of the described rows with a label; ``labels`` has ``_key, y``."""
    joined = rows.join(labels, F.col(key) == F.col("_key"))
    return joined.select("x", "y", (F.pmod(F.xxhash64("x"), F.lit(CALIBRATE)) == 0).alias("kept"))


def train(rows: DataFrame, waves: int = WAVES, ridge: float = RIDGE, width: float = 0.12, seed: int = 7) -> QualityModel:
    """A model from :func:`labelled` rows; all of them count."""
    spread = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(STATISTICS)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(STATISTICS)],
    ).first()
    rng = np.random.default_rng(seed)
    centre = np.array([spread[f"m{i}"] or 0.0 for i in range(STATISTICS)])
    scale = np.array([spread[f"s{i}"] or 0.0 for i in range(STATISTICS)])
    empty = QualityModel(
        centre=centre,
        scale=np.where(scale > 1e-9, scale, 1.0),
        directions=rng.normal(size=(STATISTICS, waves)) * width,
        phases=rng.uniform(0, 2 * np.pi, waves),
        weights=np.zeros(waves + 1),
        knots=np.array([0.0]),
        rates=np.array([0.5 if spread["share"] is None else spread["share"]]),
    )
    if spread["share"] in (None, 0.0, 1.0):
        return empty
    left, right = _normal_equations(rows.where("not kept"), empty)
    left[np.diag_indices(waves)] += ridge * max(1.0, left[-1, -1])
    left[-1, -1] += 1e-9
    fitted = QualityModel(**{**empty.__dict__, "weights": np.linalg.lstsq(left, right, rcond=None)[0]})
    return calibrated(rows.where("kept"), fitted)


def calibrated(rows: DataFrame, model: QualityModel) -> QualityModel:
    """Isotonic rates over a fixed number of bins of the ridge score."""

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.raw(np.vstack(b["x"].to_list()))
            at = np.clip(np.floor((s + 0.5) / 2 * BINS), 0, BINS - 1).astype("int64")
            yield pd.DataFrame({"at": at, "s": s, "y": b["y"]})

    got = rows.mapInPandas(binned, "at long, s double, y double").groupBy("at").agg(
        F.avg("s").alias("s"), F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")
    ).orderBy("at").toPandas()  # at most BINS rows
    if not len(got):
        return model
    knots, rates = isotonic(got["s"].to_numpy(float), got["p"].to_numpy(float), got["n"].to_numpy(float))
    return QualityModel(**{**model.__dict__, "knots": knots, "rates": rates})


def score(model: QualityModel, x: Column) -> Column:
    """Probability of label 1 for a column of statistics."""

    @F.pandas_udf("double")
    def probability(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype="float64")
        return pd.Series(model.probability(np.vstack(rows.to_list())))

    return probability(x)


def score_text(model: QualityModel, text: Column) -> Column:
    """Probability of label 1 for a text column."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(statistics_frame(texts)))

    return probability(text)
