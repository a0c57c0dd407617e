"""LM scoring by cross-entropy difference.

Two bigram models of the same form, one of a target text collection and one of
the whole background, share one vocabulary: the token ids of a public tokenizer.
A document's score is the mean over its tokens of target loss minus background
loss (nats): the lower, the more the document resembles the target.

    p(w | u) = (c(u, w) + PRIOR * p(w)) / (c(u) + PRIOR),
    p(w)     = (c(w) + 1 / V) / (tokens + 1)

Token ids are made once and stored in chunks of bounded size.  Each chunk sends
its distinct bigrams with their counts to the bigrams' slices; a slice adds up
the counts of all chunks and answers every chunk with the loss differences of
the bigrams it asked for.  Counts cover all documents, their table grows with
the corpus, and no task or driver ever holds it whole.

Defined results: NULL and empty texts have no tokens and a NULL score; repeated
rows are scored and counted separately; texts are read whole; an empty target
table gives the scores of an empty model; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import stored
from factorloom.llm.packing import encoder

PRIOR = 8.0
# Tokens of a chunk (a longer document is a chunk of its own), and chunk rows a slice should meet.
CHUNK = 1_000_000
SLICE_TOKENS = 8_000_000
START = 0xFFFF  # what stands before a document's first token; no token id


def token_chunks(docs: DataFrame, keep: dict[str, Column], tokenizer: str, text: str) -> DataFrame:
    """``chunk, keys, lengths, ids``: token ids of many documents in a row, written once."""
    rows = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*[c.alias(n) for n, c in keep.items()]).alias("key"))
    keyed = T.ArrayType(rows.schema["key"].dataType)
    out = T.StructType(
        [T.StructField("keys", keyed), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("ids", T.BinaryType())]
    )

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(tokenizer)
        keys, lengths, ids, held = [], [], [], 0

        def row():
            return pd.DataFrame({"keys": [keys], "lengths": [lengths], "ids": [b"".join(ids)]})

        for b in batches:
            if isinstance(b["key"], pd.DataFrame):
                own = b["key"].to_dict("records")
            else:
                own = b["key"].tolist()
            for first in range(0, len(b), 500):
                texts = [t or "" for t in b["_text"].iloc[first : first + 500]]
                for key, data in zip(own[first : first + 500], words.of(texts)):
                    small = np.frombuffer(data, "<u4").astype("<u2")
                    keys.append(key)
                    lengths.append(len(small))
                    ids.append(small.tobytes())
                    held += len(small)
                    if held >= CHUNK:
                        yield row()
                        keys, lengths, ids, held = [], [], [], 0
        if keys:
            yield row()

    made = rows.mapInPandas(tokens, out).withColumn("chunk", F.monotonically_increasing_id())
    return stored(made, "tokens")


def bigrams(ids: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A code for every token with the one before it, and the document it is in."""
    current = np.frombuffer(ids, "<u2").astype("uint32")
    n = np.asarray(lengths, "int64")
    before = np.r_[np.uint32(START), current[:-1]] if len(current) else current
    starts = np.cumsum(n) - n
    before = before.copy()
    before[starts[n > 0]] = START
    return (before.astype("uint32") << np.uint32(16)) | current, np.repeat(np.arange(len(n)), n)


def slice_of(codes: np.ndarray, slices: int) -> np.ndarray:
    return ((codes.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(slices)


def packed(codes: np.ndarray) -> bytes:
    """Sorted codes as compressed gaps."""
    return zlib.compress(np.diff(codes, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype="uint32")


def unigrams(chunks: DataFrame, size: int) -> np.ndarray:
    """Counts of every token as such and as the one before (row 1), of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, START + 1), "int64")
        for b in batches:
            for ids, lengths in zip(b["ids"], b["lengths"]):
                codes, _ = bigrams(ids, lengths)
                sums[0] += np.bincount(codes & np.uint32(0xFFFF), minlength=START + 1)
                sums[1] += np.bincount(codes >> np.uint32(16), minlength=START + 1)
        if sums.any():
            yield pd.DataFrame({"sums": [zlib.compress(sums.tobytes(), 1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * (START + 1), "int64")
        for b in batches:
            for x in b["sums"]:
                total += np.frombuffer(zlib.decompress(x), "int64")
        yield pd.DataFrame({"sums": [zlib.compress(total.tobytes(), 1)]})

    parts = chunks.select("ids", "lengths").mapInPandas(count, "sums binary").repartition(8).mapInPandas(add, "sums binary")
    total = np.zeros((2, START + 1), "int64")
    for r in parts.collect():  # 8 rows of fixed size
        total += np.frombuffer(zlib.decompress(r["sums"]), "int64").reshape(2, -1)
    return total


def losses(counts: np.ndarray, codes: np.ndarray, single: np.ndarray, size: int, prior: float) -> np.ndarray:
    """Loss of every bigram with ``counts``; ``single`` as made by :func:`unigrams`."""
    now, before = codes & np.uint32(0xFFFF), codes >> np.uint32(16)
    alone = (single[0, now] + 1 / size) / (single[0].sum() + 1)
    return -np.log((counts + prior * alone) / (single[1, before] + prior))


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", prior: float = PRIOR
) -> DataFrame:
    """``key, tokens, score`` for every document against the texts of ``target``."""
    size = vocabulary_size(tokenizer)
    if size > START:
        raise ValueError(f"{size} token ids do not fit into 16 bits")
    own = token_chunks(docs, {"key": F.col(f"`{key}`")}, tokenizer, text)
    wanted = token_chunks(target, {"key": F.lit(0)}, tokenizer, text)
    background, goal = unigrams(own, size), unigrams(wanted, size)
    context = docs.sparkSession.sparkContext
    single = context.broadcast((goal, background))  # fixed size
    slices = int(max(8, -(-int(background[0].sum()) // SLICE_TOKENS)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, is_target, ids, lengths in zip(b["chunk"], b["target"], b["ids"], b["lengths"]):
                codes, _ = bigrams(ids, lengths)
                codes, counts = np.unique(codes, return_counts=True)
                at = slice_of(codes, slices)
                for s in np.unique(at).tolist():
                    mine = at == s
                    yield pd.DataFrame(
                        {
                            "slice": [s], "chunk": [chunk], "target": [is_target], "codes": [packed(codes[mine])],
                            "counts": [zlib.compress(counts[mine].astype("<u4").tobytes(), 1)],
                        }
                    )

    both = own.select("chunk", F.lit(False).alias("target"), "ids", "lengths").unionAll(
        wanted.select("chunk", F.lit(True).alias("target"), "ids", "lengths")
    )
    asked = both.mapInPandas(ask, "slice int, chunk long, target boolean, codes binary, counts binary")

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        goal_single, all_single = single.value
        codes = [unpacked(x) for x in rows["codes"]]
        counts = [np.frombuffer(zlib.decompress(x), "<u4") for x in rows["counts"]]
        every = np.unique(np.concatenate(codes))
        sums = np.zeros((2, len(every)), "int64")
        for c, n, is_target in zip(codes, counts, rows["target"]):
            sums[0 if is_target else 1, np.searchsorted(every, c)] += n
        apart = losses(sums[0], every, goal_single, size, prior) - losses(sums[1], every, all_single, size, prior)
        apart = apart.astype("<f4")
        mine = [i for i, is_target in enumerate(rows["target"]) if not is_target]
        return pd.DataFrame(
            {
                "chunk": rows["chunk"].iloc[mine].to_numpy(),
                "slice": rows["slice"].iloc[mine].to_numpy(),
                "apart": [apart[np.searchsorted(every, codes[i])].tobytes() for i in mine],
            }
        )

    answers = asked.groupBy("slice").applyInPandas(answer, "chunk long, slice int, apart binary")
    kind = T.StructType([docs.select(F.col(f"`{key}`").alias("key")).schema["key"], T.StructField("tokens", T.LongType()), T.StructField("score", T.DoubleType())])

    def score(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame(columns=kind.names)
        keys, lengths = chunk["keys"].iloc[0], np.asarray(chunk["lengths"].iloc[0], "int64")
        codes, owner = bigrams(chunk["ids"].iloc[0], lengths)
        distinct, place = np.unique(codes, return_inverse=True)
        apart = np.zeros(len(distinct))
        at = slice_of(distinct, slices)
        for s, data in zip(got["slice"], got["apart"]):
            apart[at == s] = np.frombuffer(data, "<f4")
        total = np.bincount(owner, apart[place], minlength=len(lengths))
        mean = pd.Series(np.where(lengths > 0, total / np.maximum(lengths, 1), np.nan)).astype("Float64").mask(lengths == 0)
        return pd.DataFrame({"key": [k["key"] for k in keys], "tokens": lengths, "score": mean})

    scored = own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, kind)
    return scored.withColumnRenamed("key", key)
