"""Toxicity: a convolutional text classifier trained in numpy.

Every word becomes the sum of two hashed embeddings, its own and that of its
first letters.  Filters one, two and three words wide slide over the whole text;
the largest answer of each filter goes into a logistic layer.  Training takes a
bounded sample of the labelled rows (``SAMPLE`` per label, chosen by hash) in one
task; buckets that the sample does not fill share one embedding fixed at zero.
Scores are then calibrated on labelled rows kept apart, language by language;
the language is guessed from the text's own letters and frequent words.

Defined results: NULL and empty texts have no words and get a score like any
other; texts are read whole in pieces of bounded size, so any length works;
repeated rows get equal scores; an empty table gives no rows; with no labelled
rows of both labels every score is the share of label 1 seen (0 if none).
Training reads only the text and the label.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import isotonic, release, stored

BUCKETS = 1 << 22
SIZE = 12
FILTERS = ((1, 24), (2, 8), (3, 8))
SAMPLE = 2500
# Training visits so many texts in all, however few there are: ten passes over a full sample.
VISITS = 50_000
PREFIX = 4
# Words of one text that are convolved at a time.
CHUNK = 16384
_WORD = re.compile(r"[^\W_]+")
BINS = 256
CALIBRATE = 4

# Frequent words by which a text's language group is guessed.
_FREQUENT = {
    "en": "the of and to in that is was for with this from by on it as be at",
    "fr": "de la le et les des en un une du que dans est pour au avec sur la",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine",
    "es": "de la que el en y los se del las un por con no una su para es",
}
LANGUAGES = (*_FREQUENT, "other")
_VOTES = {g: frozenset(w.split()) for g, w in _FREQUENT.items()}
_LETTERS = {"de": "äöüß", "fr": "èêç", "es": "ñóí"}


_LETTER_BITS = {c: 1 << i for i, g in enumerate(LANGUAGES[:-1]) for c in _LETTERS.get(g, "")}
_WORD_BITS: dict[str, int] = {}
for _i, _g in enumerate(LANGUAGES[:-1]):
    for _w in _VOTES[_g]:
        _WORD_BITS[_w] = _WORD_BITS.get(_w, 0) | 1 << _i


def language_votes(word: str) -> int:
    """Bit i: the word speaks for language i (a frequent word, or one of its own letters)."""
    bits = _WORD_BITS.get(word, 0)
    if not word.isascii():
        for c in word:
            bits |= _LETTER_BITS.get(c, 0)
    return bits


def bucket(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % BUCKETS


def bucketed(words: list[str]) -> np.ndarray:
    """Buckets of a text's words in order: the word's own, and that of its first letters."""
    return np.array([(bucket(w), bucket("^" + w[:PREFIX])) for w in words], "int64").reshape(-1, 2)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Network:
    buckets: np.ndarray  # sorted buckets with an embedding of their own
    embedding: np.ndarray  # row 0 is the shared zero
    kernels: list[np.ndarray]  # filters: width x SIZE x count
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    knots: list[np.ndarray] = field(default_factory=list)
    rates: list[np.ndarray] = field(default_factory=list)

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.buckets, buckets)
        at[at == len(self.buckets)] = 0
        known = self.buckets[at] == buckets if len(self.buckets) else np.zeros(buckets.shape, bool)
        return np.where(known, at + 1, 0)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answer of every filter over a text, and where it stands (-1: nowhere)."""
        tops, places = [], []
        x = self.embedding[rows[:, 0]] + self.embedding[rows[:, 1]] if len(rows) else np.zeros((0, SIZE), "float32")
        for kernel, bias in zip(self.kernels, self.biases):
            width, _, count = kernel.shape
            n = len(x) - width + 1
            if n <= 0:
                tops.append(np.zeros(count, "float32"))
                places.append(np.full(count, -1))
                continue
            answer = x[:n] @ kernel[0]
            for j in range(1, width):
                answer += x[j : j + n] @ kernel[j]
            place = answer.argmax(0)
            top = answer[place, np.arange(count)] + bias
            places.append(np.where(top > 0, place, -1))
            tops.append(np.maximum(top, 0))
        return np.concatenate(tops), places

    def probability(self, raw: np.ndarray, language: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw))
        for g in range(len(LANGUAGES)):
            own = language == g
            out[own] = np.interp(raw[own], self.knots[g], self.rates[g])
        return out


class Reader:
    """Reads whole texts: every known word has its part of all filters' answers in one table row.

    A filter's answer is a sum over its words, so the parts (one column per filter
    and place in it) of a word are computed once.  The table is emptied when full.
    """

    ENTRIES = 250_000

    def __init__(self, net: Network):
        self.net = net
        places = [k[j] for k in net.kernels for j in range(k.shape[0])]
        self._parts = net.embedding @ np.concatenate(places, axis=1)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.parts = np.zeros((1024, self._parts.shape[1]), "float32")
        self.votes = np.zeros(1024, "uint8")

    def _learn(self, words: list[str]) -> None:
        first, n = len(self.number), len(words)
        while len(self.parts) < first + n:
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
            self.votes = np.concatenate([self.votes, np.zeros_like(self.votes)])
        rows = self.net.rows(bucketed(words))
        self.parts[first : first + n] = self._parts[rows[:, 0]] + self._parts[rows[:, 1]]
        self.votes[first : first + n] = list(map(language_votes, words))
        self.number.update(zip(words, range(first, first + n)))

    def read(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """Logit and language group of every text."""
        out = []
        for first in range(0, len(texts), 100):
            lists = [words_of(t) for t in texts[first : first + 100]]
            if len(self.number) > self.ENTRIES:
                self._forget()
            missing = set().union(*lists).difference(self.number)
            if missing:
                self._learn(list(missing))
            get = self.number.__getitem__
            for words in lists:
                numbers = np.fromiter(map(get, words), "int64", len(words))
                out.append((self.raw(numbers), self.language(numbers)))
        return out

    def language(self, numbers: np.ndarray) -> int:
        votes = np.bincount(self.votes[numbers], minlength=1 << len(LANGUAGES))
        bits = np.arange(len(votes))
        counts = [int(votes[(bits >> i) & 1 == 1].sum()) for i in range(len(LANGUAGES) - 1)]
        best = int(np.argmax(counts))
        return best if counts[best] else len(LANGUAGES) - 1

    def raw(self, numbers: np.ndarray) -> float:
        """The logit of a whole text, in chunks that overlap by the widest filter."""
        best = np.zeros(len(self.net.out), "float32")
        step = CHUNK - max(k.shape[0] for k in self.net.kernels) + 1
        for first in range(0, max(1, len(numbers)), step):
            parts = self.parts[numbers[first : first + CHUNK]]
            column = at = 0
            for kernel, bias in zip(self.net.kernels, self.net.biases):
                width, _, count = kernel.shape
                n = len(parts) - width + 1
                if n > 0:
                    answer = parts[:n, column : column + count]
                    for j in range(1, width):
                        answer = answer + parts[j : j + n, column + j * count : column + (j + 1) * count]
                    np.maximum(best[at : at + count], answer.max(0) + bias, out=best[at : at + count])
                column += width * count
                at += count
        return float(best @ self.net.out + self.net.bias)


def reader(shared) -> Reader:
    """One per task: the worker keeps none of its words when the task is over."""
    release()
    return Reader(shared.value)


def start_network(texts: list[np.ndarray], seed: int) -> Network:
    """Embeddings for the buckets that occur in two sample texts or more."""
    seen = np.concatenate([np.unique(t) for t in texts]) if texts else np.zeros(0, "int64")
    buckets, times = np.unique(seen, return_counts=True)
    buckets = buckets[times > 1]
    rng = np.random.default_rng(seed)
    embedding = (rng.normal(size=(len(buckets) + 1, SIZE)) * 0.1).astype("float32")
    embedding[0] = 0
    kernels = [(rng.normal(size=(w, SIZE, c)) / np.sqrt(w * SIZE)).astype("float32") for w, c in FILTERS]
    biases = [np.full(c, 0.05, "float32") for _, c in FILTERS]
    out = (rng.normal(size=sum(c for _, c in FILTERS)) * 0.3).astype("float32")
    return Network(buckets, embedding, kernels, biases, out, 0.0)


def fit(texts: list[np.ndarray], labels: np.ndarray, visits: int = VISITS, seed: int = 3, rate: float = 0.05) -> Network:
    """Adagrad on the logistic loss, in batches of 32 texts; each label weighs half."""
    net = start_network(texts, seed)
    rows = [net.rows(t) for t in texts]
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    rng = np.random.default_rng(seed + 1)
    sums = {"e": np.full(net.embedding.shape, 1e-3, "float32"), "o": np.full(net.out.shape, 1e-3, "float32"), "b": 1e-3}
    sums |= {("k", i): np.full(k.shape, 1e-3, "float32") for i, k in enumerate(net.kernels)}
    sums |= {("c", i): np.full(b.shape, 1e-3, "float32") for i, b in enumerate(net.biases)}

    def move(name, value, slope):
        sums[name] += slope * slope
        value -= rate * slope / np.sqrt(sums[name])

    for _ in range(-(-visits // len(rows))):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), 32):
            batch = order[first : first + 32]
            kernel_slopes = [np.zeros_like(k) for k in net.kernels]
            bias_slopes = [np.zeros_like(b) for b in net.biases]
            out_slope, bias_slope = np.zeros_like(net.out), 0.0
            touched, slopes = [], []
            for i in batch:
                top, places = net.pooled(rows[i])
                p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.bias, -30, 30)))
                g = float(p - labels[i]) * weight[i] / len(batch)
                out_slope += g * top
                bias_slope += g
                at = 0
                for f, place in enumerate(places):
                    width, _, count = net.kernels[f].shape
                    up = g * net.out[at : at + count]
                    at += count
                    live = np.flatnonzero(place >= 0)
                    if not len(live):
                        continue
                    bias_slopes[f][live] += up[live]
                    for j in range(width):
                        pair = rows[i][place[live] + j]
                        x = net.embedding[pair[:, 0]] + net.embedding[pair[:, 1]]
                        kernel_slopes[f][j][:, live] += (x * up[live, None]).T
                        down = net.kernels[f][j][:, live].T * up[live, None]
                        touched += [pair[:, 0], pair[:, 1]]
                        slopes += [down, down]
            if touched:
                at, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                slope = np.zeros((len(at), SIZE), "float32")
                np.add.at(slope, inverse, np.concatenate(slopes))
                slope[at == 0] = 0
                sums["e"][at] += slope * slope
                net.embedding[at] -= rate * slope / np.sqrt(sums["e"][at])
            for f in range(len(net.kernels)):
                move(("k", f), net.kernels[f], kernel_slopes[f])
                move(("c", f), net.biases[f], bias_slopes[f])
            move("o", net.out, out_slope)
            sums["b"] += bias_slope**2
            net.bias -= rate * bias_slope / np.sqrt(sums["b"])
    return net


def train(
    docs: DataFrame, labels: DataFrame, key: Column, text: str = "text", sample: int = SAMPLE, visits: int = VISITS
) -> Network:
    """An uncalibrated network from at most ``sample`` documents of each label.

    ``labels`` (``_key, y``) holds what may be learnt from; rows kept for
    calibration are left out.
    """
    draw = F.xxhash64("_key", F.lit(5))
    picked = [labels.where(~held_back()).where(F.col("y") == y).orderBy(draw).limit(sample) for y in (0, 1)]
    rows = docs.select(F.col(f"`{text}`").alias("text"), key.alias("_doc"))
    chosen = rows.join(F.broadcast(picked[0].unionAll(picked[1])), F.col("_doc") == F.col("_key"))  # 2 x sample keys
    chosen = chosen.groupBy("_key", "y").agg(F.min("text").alias("text"))  # a key stands for one text

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [bucketed(words_of(t)).astype("int32").tobytes() for t in b["text"]]
            yield pd.DataFrame({"ids": ids, "y": b["y"], "key": b["_key"].astype(str)})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        got = pd.concat(got, ignore_index=True) if got else pd.DataFrame({"ids": [], "y": [], "key": []})
        got = got.sort_values(["key", "ids"], kind="stable")
        texts = [np.frombuffer(x, "int32").astype("int64").reshape(-1, 2) for x in got["ids"]]
        y = got["y"].to_numpy(float)
        if len(set(y)) < 2:
            net = start_network([], 0)
            net.out[:] = 0
            net.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else -16.0
        else:
            net = fit(texts, y, visits)
        yield pd.DataFrame({"net": [pickle.dumps(net)]})

    words = chosen.mapInPandas(number, "ids binary, y double, key string")
    return pickle.loads(words.repartition(1).mapInPandas(learn, "net binary").first()["net"])


def held_back() -> Column:
    """Labels kept for calibration."""
    return F.pmod(F.xxhash64("_key", F.lit(6)), F.lit(CALIBRATE)) == 0


def shared_model(spark: SparkSession, net: Network):
    """The network for the tasks; its size is bounded by the training sample."""
    return spark.sparkContext.broadcast(net)


def read(docs: DataFrame, keep: dict[str, Column], net: Network, text: str = "text") -> DataFrame:
    """``*keep, raw, language`` of every text, written once."""
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *[c.alias(n) for n, c in keep.items()])
    shared = shared_model(docs.sparkSession, net)

    def batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = reader(shared)
        for b in batches:
            got = words.read(b.pop("_text").to_list())
            yield b.assign(raw=[x for x, _ in got], language=[g for _, g in got])

    out = T.StructType(
        [*rows.drop("_text").schema, T.StructField("raw", T.DoubleType()), T.StructField("language", T.IntegerType())]
    )
    return stored(rows.mapInPandas(batch, out), "logits")


def calibrated(rows: DataFrame, labels: DataFrame, net: Network, key: str = "key") -> Network:
    """Isotonic rates by language group over bins of the logit; small groups lean on all rows.

    ``rows`` come from :func:`read`, ``labels`` (``_key, y``) from what may be learnt from.
    """
    joined = rows.join(labels.where(held_back()), F.col(key) == F.col("_key"))
    at = F.least(F.greatest(F.floor((F.col("raw") + 16) * BINS / 32), F.lit(0)), F.lit(BINS - 1))
    got = joined.groupBy("language", at.alias("at")).agg(
        F.sum("raw").alias("s"), F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")
    ).toPandas()  # at most languages x BINS rows
    every = got.groupby("at")[["s", "p", "n"]].sum().reset_index()
    net.knots, net.rates = [], []
    for g in range(len(LANGUAGES)):
        own = got[got["language"] == g]
        if own["p"].sum() < 20 or (own["n"] - own["p"]).sum() < 20:
            own = every
        own = own.sort_values("at")
        n = own["n"].to_numpy(float)
        p = own["p"].to_numpy(float)
        if p.sum() and (n - p).sum():
            knots, rates = isotonic(own["s"].to_numpy(float) / n, p, n)
        else:  # nothing to calibrate on: the network's own logistic answer
            knots = np.linspace(-8, 8, 33)
            rates = 1 / (1 + np.exp(-knots))
        net.knots.append(knots)
        net.rates.append(rates)
    return net


def score(net: Network, raw: Column, language: Column) -> Column:
    """Probability of label 1 for columns made by :func:`read`."""
    small = replace(net, buckets=net.buckets[:0], embedding=net.embedding[:1])

    @F.pandas_udf("double")
    def probability(raws: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series(small.probability(raws.to_numpy(float), languages.to_numpy()))

    return probability(raw, language)


def score_text(net: Network, text: Column, spark: SparkSession) -> Column:
    """Probability of label 1 for a text column."""
    shared = shared_model(spark, net)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = reader(shared)
        for texts in batches:
            got = np.array(words.read(texts.to_list()), float).reshape(-1, 2)
            yield pd.Series(words.net.probability(got[:, 0], got[:, 1].astype(int)))

    return probability(text)
