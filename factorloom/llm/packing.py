"""Best-fit packing of tokenised documents into sequences of bounded length.

Three steps, each usable alone:

* :func:`stored_pieces`: token ids of every document, an end id behind them, cut
  only where a document is longer than a sequence;
* :func:`pack`: *hierarchical residual packing*.  Every partition packs its own
  pieces best-fit (longest first); bins that are nearly full are final.  The
  underfull bins move on as items: each round merges the bins of several
  partitions in one task and fits them again.  A bin is final when it is nearly
  full or not even the smallest bin fits in.  When a round saves no bin, the next
  one brings bins together that would fill each other up; if that saves none
  either, the rest is final;
* :func:`sequences`: the packed token ids themselves.

Defined results: a NULL text is an empty one; an empty document is its end id
alone; a repeated row is a further document; an empty table gives no rows; other
columns of the input are ignored unless listed in ``keep``, and names that the
operator adds (``piece_id, piece, start, length, ids``) may also stand in the
input.  A very long text is cut into as many pieces as it needs.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import held, stored
from factorloom.llm.texts import bounded, byte_letters

SEQUENCE = 2048
END_ID = 0
# Characters of texts encoded together.
CHARACTERS = 4_000_000
# A bin with at most this share of its place left is final.
SLACK = 1 / 256
# One merging task fits at most so many bins; so many partitions merge into one.
BINS_PER_TASK = 8192
FAN_IN = 8


class WordMerges:
    """Merges of a vocabulary with word ends, for many words at a time.

    Every round merges the leftmost of each word's pairs of the lowest rank, as
    merging one word alone would; words without a pair leave.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str):
        letters = {b: c for c, b in byte_letters().items()}
        self._inner = np.array([vocabulary[letters[b]] for b in range(256)], "int64")
        self._last = np.array([vocabulary[letters[b] + end] for b in range(256)], "int64")
        self._width = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self._width + vocabulary[b] for a, b in merges], "int64")
        order = np.argsort(keys, kind="stable")
        self._keys = np.r_[keys[order], np.int64(1 << 62)]
        self._ranks = np.r_[order, self.NONE]
        self._made = np.array([vocabulary[a + b] for a, b in merges], "int64")

    NONE = np.int64(1 << 40)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self._width + right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], self.NONE)

    def of(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of words of at least one byte."""
        sizes = np.array([len(w) for w in words], "int64")
        data = np.frombuffer(b"".join(words), "uint8")
        owner = np.repeat(np.arange(len(words)), sizes)
        ids = self._inner[data]
        lasts = np.cumsum(sizes) - 1
        ids[lasts] = self._last[data[lasts]]
        rank = np.full(len(ids), self.NONE)  # of the pair that starts here
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self._rank(ids[inside], ids[inside + 1])
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            over = lowest == self.NONE
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank, lowest = ids[~over], owner[~over], rank[~over], lowest[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == lowest)
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            ids[at] = self._made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol goes behind each
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            left = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            rank[left] = self._rank(ids[left], ids[left + 1])
            rank[at] = self.NONE
            right = at[at + 1 < len(ids)]
            right = right[owner[right] == owner[right + 1]]
            rank[right] = self._rank(ids[right], ids[right + 1])
        if not done_ids:
            return []
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]


class WordIds:
    """Ids (little-endian bytes) by blank-separated word.

    The vocabulary drops white space and letter case and never joins text across
    white space or between a letter and a mark, so a text's ids are those of its
    words in order.  Words that a batch of texts adds are encoded together: Latin
    letters, perhaps with a full stop or comma behind them, by :class:`WordMerges`,
    all others by the tokenizer itself.  Up to ``ENTRIES`` of them stay known, and
    between tasks the ``RESTING`` that were met first.
    """

    ENTRIES, RESTING = 400_000, 100_000
    # Latin letters that are one letter each in lower case.
    PLAIN = re.compile("^([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,64})([.,]?)$", re.M)

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as text:
            model = json.load(text)["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self._merges = WordMerges(model["vocab"], merges, model["end_of_word_suffix"])
        self.known: dict[str, bytes] = {"": b""}
        self._tails = {"": b""} | {mark: self._one(mark) for mark in ".,"}

    def _one(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _others(self, words: list[str]) -> None:
        """Any words, many in one text; a token belongs to the word in which its characters start."""
        for first in range(0, len(words), 512):
            part = words[first : first + 512]
            found = self._tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in part])
            starts = np.array([x for x, _ in found.offsets], "int64")
            cuts = (4 * np.searchsorted(starts, ends)).tolist()
            flat = array("I", found.ids).tobytes()
            self.known.update(zip(part, [flat[i:j] for i, j in zip([0, *cuts], cuts)]))

    def _learn(self, missing: set[str]) -> None:
        found = self.PLAIN.findall("\n".join(missing))
        whole = [base + mark for base, mark in found]
        self._others(list(missing.difference(whole)))
        lows = "\n".join([base for base, _ in found]).lower().split("\n") if found else []
        bases = list(set(lows))
        ids = dict(zip(bases, self._merges.of([w.encode() for w in bases])))
        tails = self._tails
        self.known.update(zip(whole, [ids[low] + tails[mark] for low, (_, mark) in zip(lows, found)]))

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of every text.  Arrow splits the texts and numbers their words; only distinct ones are looked up."""
        if not texts:
            return []
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        numbered = cut.flatten().dictionary_encode()
        words, at = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        known = self.known
        missing = set(words).difference(known)
        self._learn(missing)
        parts = list(map(known.__getitem__, words))
        sizes = np.fromiter(map(len, parts), "int64", len(parts)) // 4
        ids = np.frombuffer(b"".join(parts), "<u4")
        each = sizes[at]
        ends = np.cumsum(each)
        from_ = (np.cumsum(sizes) - sizes)[at] - (ends - each)
        out = ids[np.repeat(from_, each) + np.arange(ends[-1] if len(ends) else 0)]
        surplus = len(known) - self.ENTRIES
        for w in islice(missing, max(0, surplus)):  # the newest ones go: what is frequent was met early
            del known[w]
        cuts = np.r_[0, ends][cut.offsets.to_numpy()].tolist()
        return [out[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]

    def rest(self) -> None:
        """Gives memory back between tasks; Spark may hold more workers than run at once."""
        self.known = dict(islice(self.known.items(), self.RESTING))


def encoder(path: str) -> WordIds:
    """One per Python worker, until another operator runs there."""
    return held(("words", path), lambda: WordIds(path))


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    size: int = SEQUENCE,
    end_id: int = END_ID,
    ids: bool = True,
) -> DataFrame:
    """``*keep, piece, start, length, ids_crc32, ids`` (little-endian 32-bit; left out without ``ids``) per piece."""
    picked = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text")
    )
    names = [f"k{i}" for i in range(len(keep))]
    out = T.StructType(
        [f for f in picked.schema if f.name in names]
        + [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
        + [T.StructField("ids", T.BinaryType())] * ids
    )
    end, step = array("I", [end_id]).tobytes(), 4 * size

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(tokenizer)
        for batch in batches:
            for part in bounded(batch, "text", CHARACTERS):
                row, piece, cuts = [], [], []
                for i, data in enumerate(words.of([t or "" for t in part["text"]])):
                    data += end
                    for p, at in enumerate(range(0, len(data), step)):
                        row.append(i)
                        piece.append(p)
                        cuts.append(data[at : at + step])
                made = part[names].iloc[row].reset_index(drop=True)
                made["piece"] = np.array(piece, "int32")
                made["start"] = np.array(piece, "int64") * size
                made["length"] = np.array([len(x) // 4 for x in cuts], "int64")
                made["ids_crc32"] = np.array([zlib.crc32(x) for x in cuts], "int64")
                if ids:
                    made["ids"] = cuts
                yield made
                pa.default_memory_pool().release_unused()  # else each worker keeps its largest part's buffers
        words.rest()

    pieces = picked.mapInPandas(cut, out)
    return pieces.withColumnsRenamed(dict(zip(names, keep)))


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with place for it."""
    bins: list[list[int]] = []
    by_place: list[list[int]] = [[] for _ in range(size + 1)]
    open_places = 0  # bit p: some bin has exactly p free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = open_places >> n
        if fitting:
            place = n + (fitting & -fitting).bit_length() - 1
            at = by_place[place].pop()
            if not by_place[place]:
                open_places ^= 1 << place
            bins[at].append(i)
        else:
            place, at = size, len(bins)
            bins.append([i])
        if place > n:
            by_place[place - n].append(at)
            open_places |= 1 << (place - n)
    return bins


BIN = "fill long, items binary, lengths binary"


def _merge(frames: list[pd.DataFrame], size: int) -> pd.DataFrame:
    """Best fit over bins; a merged bin keeps its items in order."""
    rows = pd.concat(frames, ignore_index=True)
    items, lengths = rows["items"].tolist(), rows["lengths"].tolist()
    fills = rows["fill"].to_numpy("int64")
    bins = best_fit(fills, size)
    return pd.DataFrame(
        {
            "fill": [int(fills[b].sum()) for b in bins],
            "items": [b"".join(items[i] for i in b) for b in bins],
            "lengths": [b"".join(lengths[i] for i in b) for b in bins],
        }
    )


def pack(pieces: DataFrame, item: str = "piece_id", length: str = "length", size: int = SEQUENCE) -> DataFrame:
    """``item, sequence_id, offset``: where each piece of 1 to ``size`` tokens goes.

    ``item`` is unique and fixed (a stored column).  Offsets of a sequence are
    gapless from 0; ``sequence_id`` is the smallest item in it.
    """
    full = size - int(size * SLACK)
    start = pieces.select(F.col(f"`{item}`").alias("item"), F.col(f"`{length}`").alias("fill"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            rows = pd.concat(rows, ignore_index=True)
            numbers, n = rows["item"].to_numpy("int64"), rows["fill"].to_numpy("int64")
            bins = best_fit(n, size)
            yield pd.DataFrame(
                {
                    "fill": [int(n[b].sum()) for b in bins],
                    "items": [numbers[b].tobytes() for b in bins],
                    "lengths": [n[b].astype("int32").tobytes() for b in bins],
                }
            )

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if rows := list(batches):
            yield _merge(rows, size)

    done, left, width, stuck = [], None, start.rdd.getNumPartitions(), 0
    made = start.mapInPandas(local, BIN)
    while True:
        bins = stored(made, "bins")
        # A bin into which not even the smallest bin fits is final, too.
        least = bins.where(F.col("fill") < full).agg(F.min("fill"), F.count(F.lit(1))).first()
        final = (F.col("fill") >= full) | (F.col("fill") + F.lit(least[0]) > size)
        if not least[1]:
            done.append(bins)
            break
        open_bins = bins.where(~final)
        before, left = left, open_bins.count()
        narrower = max(1, -(-width // FAN_IN), -(-left // BINS_PER_TASK))
        stuck = stuck + 1 if before is not None and narrower >= width and left >= before else 0
        if left < 2 or stuck > 1:
            done.append(bins)  # nothing joins any more
            break
        done.append(bins.where(final))
        width = min(width, narrower)
        dealt = open_bins.repartition(width)
        if stuck:  # bins that would fill each other up come together
            dealt = open_bins.repartitionByRange(width, F.least(F.col("fill"), F.lit(size) - F.col("fill")), "fill")
        made = dealt.mapInPandas(again, BIN)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items = [np.frombuffer(x, "int64") for x in batch["items"]]
            lengths = [np.frombuffer(x, "int32").astype("int64") for x in batch["lengths"]]
            if items:
                yield pd.DataFrame(
                    {
                        "item": np.concatenate(items),
                        "sequence_id": np.concatenate([np.full(len(x), x.min()) for x in items]),
                        "offset": np.concatenate([np.cumsum(x) - x for x in lengths]),
                    }
                )

    every = done[0]
    for more in done[1:]:
        every = every.unionAll(more)
    return every.mapInPandas(place, "item long, sequence_id long, offset long").withColumnRenamed("item", item)


def stored_pieces(docs: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
                  size: int = SEQUENCE, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """The pieces of :func:`cut_pieces` with a fixed ``piece_id``, written once."""
    cut = cut_pieces(docs, tokenizer, text, keep, size, end_id, ids)
    return stored(cut.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the packed sequences (a group has at most ``size`` pieces)."""
    rows = pieces.join(places, "piece_id").groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda acc, part: F.concat(acc, part["ids"]))
    return rows.select("sequence_id", "length", joined.alias("ids"))
