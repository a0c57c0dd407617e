"""Ranked lexical search by *bag deduplication*.

A document matters to the search only through its bag: how often it holds each
term of the items' vocabulary, and its length norm ``m``.  Documents are read
once into such bags.  Equal bags form a class: rows are dealt by a hash of the
bag and grouped by the bag itself, which verifies the hash.  Every class is
scored once against all items; a task keeps each item's ``k`` best classes, ties
to the class with the smallest document.  That is enough: each of these holds a
document that stands before all of a class left out.  The best classes of all
tasks are then expanded to their ``k`` smallest documents, and ranked.

Terms are maximal runs of ASCII letters, digits and any other code points from
U+0080; only A-Z are lower-cased.  All sums are whole numbers: they are added in
doubles only while below 2**53, where these are exact.

Items are met in blocks of about ``ITEMS`` (their vocabulary is what is
broadcast), each block against all documents.

Defined results: a NULL or empty text has no terms and does not count as a
document; rows of one item id (also NULL) are one item with the terms of all;
an item without a match has no rows; repeated documents are ranked one by one; a
NULL document id stands last among ties; empty tables give no rows; texts are
read whole; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import stored
from factorloom.llm.texts import bounded

TOP = 50
ITEMS = 1024
# Scores laid out at a time.
CELLS = 4_000_000
_LAST = (1 << 63) - 1
# Every byte that cannot be in a term becomes a blank, A-Z become a-z.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def terms_of(data: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return data.translate(_LETTERS).split()


def item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """``item, term``: every term of every item once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, data in zip(b["item"], b["data"]):
                terms = sorted(set(terms_of(data)))
                if terms:
                    yield pd.DataFrame({"item": [item] * len(terms), "term": terms})

    rows = items.select(F.to_json(F.struct(F.col(f"`{id}`").alias("id"))).alias("item"), F.col(f"`{text}`").cast("binary").alias("data"))
    return rows.where("data is not null").mapInPandas(run, "item string, term binary").distinct()


def bags(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``doc, n, bag`` of documents with terms: all terms, and pairs of a vocabulary term and its frequency.

    The bag is a row of little-endian 32-bit numbers, sorted by term.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = shared.value.get
        for batch in batches:
            for part in bounded(batch, "data", 16_000_000):
                n, own, row = [], [], []
                for i, data in enumerate(part["data"]):
                    terms = terms_of(data)
                    n.append(len(terms))
                    found = [x for x in map(place, terms) if x is not None]
                    own += found
                    row.append(len(found))
                code = np.repeat(np.arange(len(part)), row) << 32 | np.array(own, "int64")
                code, tf = np.unique(code, return_counts=True)
                flat = np.column_stack((code & 0xFFFFFFFF, tf)).astype("<u4").tobytes()
                ends = (8 * np.searchsorted(code, np.arange(1, len(part) + 1) << 32)).tolist()
                pieces = [flat[a:b] for a, b in zip([0, *ends], ends)]
                made = pd.DataFrame({"doc": part["doc"], "n": np.array(n, "int64"), "bag": pieces})
                yield made[made["n"] > 0]

    rows = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("doc"), F.col(f"`{text}`").cast("binary").alias("data")
    )
    return rows.where("data is not null").mapInPandas(run, "doc long, n long, bag binary")


def _pairs(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bag number, term and frequency of many bags in a row."""
    flat = np.frombuffer(b"".join(data), "<u4").reshape(-1, 2).astype("int64")
    return np.repeat(np.arange(len(data)), [len(x) // 8 for x in data]), flat[:, 0], flat[:, 1]


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size, "int64")
        for b in batches:
            sums += np.bincount(_pairs(b["bag"].tolist())[1], minlength=size)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"term": at, "df": sums[at]})

    total = np.zeros(size, "int64")
    for r in rows.select("bag").mapInPandas(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        total[r["term"]] = r["df"]  # at most one row for each term of the items
    return total


class Scorer:
    """Scores of bags against the items of a block, whose terms stand as postings."""

    def __init__(self, term: np.ndarray, item: np.ndarray, weight: np.ndarray, items: int):
        order = np.argsort(term, kind="stable")
        self.items, self.weight = items, weight
        self._item = item[order]
        self._starts = np.searchsorted(term[order], np.arange(len(weight) + 1))
        most = np.bincount(item, weight[term], items).max(initial=0)
        self._exact = most * 1e6 < 2**53  # a term adds less than its weight times a million

    def of(self, m: np.ndarray, data: list[bytes]) -> np.ndarray:
        """Rows of bags, columns of items."""
        row, term, tf = _pairs(data)
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        starts, each = self._starts[term], np.diff(self._starts)[term]
        at = np.repeat(starts - np.cumsum(each) + each, each) + np.arange(each.sum())
        key, value = np.repeat(row * self.items, each) + self._item[at], np.repeat(value, each)
        size = len(data) * self.items
        if self._exact:
            return np.bincount(key, value, size).astype("int64").reshape(-1, self.items)
        sums = np.zeros(size, "int64")
        np.add.at(sums, key, value)
        return sums.reshape(-1, self.items)


def best_classes(classes: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """``item, score, first, class``: the ``k`` best classes of every item within each task."""
    shared = classes.sparkSession.sparkContext.broadcast(scorer)
    step = max(1, CELLS // max(1, scorer.items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        least = np.ones(own.items, "int64")  # a score must reach this
        kept = np.zeros((4, 0), "int64")  # item, score, first document, class
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                scores = own.of(part["m"].to_numpy("int64"), part["bag"].tolist())
                at, item = np.nonzero(scores >= least)
                new = np.vstack((item, scores[at, item], part["first"].to_numpy("int64")[at], part["class"].to_numpy("int64")[at]))
                kept = np.hstack((kept, new))
                kept = kept[:, np.lexsort((kept[3], kept[2], -kept[1], kept[0]))]
                firsts = np.searchsorted(kept[0], kept[0])
                kept = kept[:, np.arange(kept.shape[1]) - firsts < k]
                last = np.searchsorted(kept[0], np.arange(own.items), "right") - 1
                full = np.bincount(kept[0], minlength=own.items) == k
                least[full] = kept[1][last[full]]
        if kept.shape[1]:
            yield pd.DataFrame(dict(zip(["item", "score", "first", "class"], kept)))

    return classes.select("class", "m", "bag", "first").mapInPandas(run, "item int, score long, first long, class long")


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``item, rank, key, score``: every item's ``k`` best documents; the key of documents is a whole number."""
    wanted = stored(item_terms(items, item, item_text), "terms")
    blocks = max(1, -(-wanted.select("item").distinct().count() // ITEMS))
    every = None
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toPandas()  # about ITEMS items
        if len(block):
            found = _round(docs, block, k, key, text)
            every = found if every is None else every.unionAll(found)
    kind = items.select(F.col(f"`{item}`").alias("id")).schema
    if every is None:
        every = docs.sparkSession.createDataFrame([], "item string, rank int, doc long, score long")
    return every.select(
        F.from_json("item", kind)["id"].alias(item), "rank", F.when(F.col("doc") != _LAST, F.col("doc")).alias(key), "score"
    )


def _round(docs: DataFrame, block: pd.DataFrame, k: int, key: str, text: str) -> DataFrame:
    names, item = np.unique(block["item"].to_numpy(str), return_inverse=True)
    terms = sorted(set(block["term"]))
    vocabulary = {t: i for i, t in enumerate(terms)}
    term = np.array([vocabulary[t] for t in block["term"]], "int64")
    rows = stored(bags(docs, vocabulary, key, text), "bags")
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n, length = totals["docs"], totals["terms"] or 1
    df = document_frequencies(rows, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], "int64")
    scorer = Scorer(term, item, weight, len(names))

    norm = F.expr(f"50 + (50 * n * {n}L) div {length}L")
    held = rows.where(F.length("bag") > 0).select("doc", norm.alias("m"), "bag").withColumn("hash", F.xxhash64("m", "bag"))
    classes = held.groupBy("hash", "m", "bag").agg(F.min("doc").alias("first"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    by_item = Window.partitionBy("item").orderBy(F.col("score").desc(), "first", "class")
    best = best_classes(classes, scorer, k).withColumn("at", F.row_number().over(by_item)).where(F.col("at") <= k)
    best = stored(best.select("item", "score", "class"), "best")  # at most k rows an item

    # Only the k smallest documents of a class can count.
    chosen = stored(classes.join(F.broadcast(best.select("class").distinct()), "class").select("class", "hash", "m", "bag"), "chosen")
    near = held.join(F.broadcast(chosen.select("hash").distinct()), "hash", "left_semi")
    in_class = Window.partitionBy("hash", "m", "bag").orderBy("doc")
    members = near.withColumn("at", F.row_number().over(in_class)).where(F.col("at") <= k)
    members = members.join(chosen, ["hash", "m", "bag"]).select("class", "doc")
    in_item = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc")
    ranked = best.join(members, "class").withColumn("rank", F.row_number().over(in_item)).where(F.col("rank") <= k)
    name = F.element_at(F.array(*[F.lit(x) for x in names.tolist()]), F.col("item") + 1)
    return stored(ranked.select(name.alias("item"), "rank", "doc", "score"), "ranked")
