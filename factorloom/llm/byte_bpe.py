"""Byte-level BPE by ranks: encoding with a hierarchical-bitmap queue, and decoding.

Each match of the splitting pattern is merged alone.  Its bytes are a linked
list; the pair that starts at a position waits in the bucket of its merge rank.
A bitmap of three levels (64 ranks a word, 64 words a word, and one word above)
marks the buckets that hold something, so find-first-set gives the lowest rank
in three steps; its smallest position is the leftmost pair, as the usual
quadratic search would pick.  A position whose pair has changed since is stale
and skipped.  Every merge costs a few queue steps, so a match of a million
characters takes time in proportion (times the logarithm of a bucket).  Short
matches of many texts share one queue, whose buckets then hold arrays of
positions and give every match's leftmost pair in one step.

Texts are cut at blanks where the pattern always cuts (:func:`blank_parts`), and
ids of at most ``ENTRIES`` such parts stay known to a Python worker; this
changes the time only.

Defined results: a NULL text is an empty one, which has no ids and decodes to no
bytes; repeated rows are rows; an empty table gives no rows; texts are read
whole; strings of special tokens are ordinary text; columns other than those
asked for may have any name.  An id without an entry is an error of decoding.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factorloom.llm.texts import blank_parts, bounded, restored, with_texts

class RankBits:
    """Which ranks have a bucket that holds something; the lowest is three find-first-set steps away."""

    def __init__(self, ranks: int):
        self._low = [0] * ((ranks >> 6) + 1)
        self._mid = [0] * ((ranks >> 12) + 1)
        self._top = 0

    def __bool__(self) -> bool:
        return self._top != 0

    def mark(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self._low[word] |= 1 << (rank & 63)
        self._mid[group] |= 1 << (word & 63)
        self._top |= 1 << group

    def clear(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self._low[word] &= ~(1 << (rank & 63))
        if not self._low[word]:
            self._mid[group] &= ~(1 << (word & 63))
            if not self._mid[group]:
                self._top &= ~(1 << group)

    def lowest(self) -> int:
        group = (self._top & -self._top).bit_length() - 1
        bits = self._mid[group]
        word = (group << 6) + (bits & -bits).bit_length() - 1
        bits = self._low[word]
        return (word << 6) + (bits & -bits).bit_length() - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(data: bytes, ranks: dict[bytes, int], bits: RankBits) -> list[int]:
    """Ids of one match of the pattern; ``bits`` is empty before and after."""
    n = len(data)
    ids = [ranks[data[i : i + 1]] for i in range(n)]
    behind = list(range(1, n + 2))  # where the next symbol starts
    before = list(range(-1, n))
    pair = [-1] * (n + 1)  # rank of the pair that starts here
    buckets: dict[int, list[int]] = {}

    def push(rank: int, position: int) -> None:
        if rank in buckets:
            heappush(buckets[rank], position)
        else:
            buckets[rank] = [position]
            bits.mark(rank)

    get = ranks.get
    for i in range(n - 1):
        if (rank := get(data[i : i + 2])) is not None:
            pair[i] = rank
            push(rank, i)
    while bits:
        rank = bits.lowest()
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            bits.clear(rank)
        if pair[i] != rank:
            continue  # stale
        gone = behind[i]
        end = behind[gone]
        ids[i], ids[gone], pair[gone], pair[i], behind[i] = rank, -1, -1, -1, end
        if end < n:
            before[end] = i
            if (rank := get(data[i : behind[end]])) is not None:
                pair[i] = rank
                push(rank, i)
        if (left := before[i]) >= 0:
            rank = get(data[left:end])
            pair[left] = -1 if rank is None else rank
            if rank is not None:
                push(rank, left)
    return [x for x in ids if x >= 0]


class PairRanks:
    """Rank of two neighbouring ids, for arrays of ids; -1 where they make no entry."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = max(ranks.values()) + 1  # stands beyond both ends; no id
        self._width = self.none + 1
        found = {}
        for data, rank in ranks.items():
            for cut in range(1, len(data)):
                left, right = ranks.get(data[:cut]), ranks.get(data[cut:])
                if left is not None and right is not None:
                    found[left * self._width + right] = rank
        self._keys = np.array(sorted(found), "int64")
        self._keys = np.r_[self._keys, np.int64(1 << 62)]
        self._ranks = np.array([*(found[k] for k in self._keys[:-1].tolist()), -1], "int32")

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype("int64") * self._width + right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], np.int32(-1))


def merge_many(matches: list[bytes], one: np.ndarray, pairs: PairRanks, bits: RankBits) -> list[bytes]:
    """Ids (little-endian 32-bit) of many matches that share one queue: a bucket holds positions of all of them.

    A step takes from the lowest bucket every match's leftmost pair; matches do
    not touch, so each is merged exactly as it would be alone.
    """
    lengths = np.array([len(m) for m in matches], "int64")
    data = np.frombuffer(b"".join(matches), "uint8")
    n = len(data)
    owner = np.repeat(np.arange(len(matches)), lengths)
    ids = np.r_[one[data], np.int32(pairs.none)]
    last = np.r_[owner[1:] != owner[:-1], True]
    behind = np.r_[np.where(last, n, np.arange(1, n + 1)), n]
    before = np.r_[np.where(np.r_[True, last[:-1]], n, np.arange(-1, n - 1)), n]
    pair = np.r_[pairs.of(ids[:-1], ids[behind[:-1]]), np.int32(-1)]
    buckets: dict[int, list[np.ndarray]] = {}

    def push(ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts) if len(cuts) else [positions]):
            if rank in buckets:
                buckets[rank].append(part)
            else:
                buckets[rank] = [part]
                bits.mark(rank)

    some = np.flatnonzero(pair >= 0)
    if len(some):
        push(pair[some], some)
    while bits:
        rank = bits.lowest()
        bits.clear(rank)
        held = buckets.pop(rank)
        at = np.sort(np.concatenate(held)) if len(held) > 1 else held[0]
        at = at[pair[at] == rank]  # the others are stale
        if len(at) > 1:
            own = owner[at]
            later = own[1:] == own[:-1]
            if later.any():
                later = np.r_[False, later]
                buckets[rank] = [at[later]]
                bits.mark(rank)
                at = at[~later]
        elif not len(at):
            continue
        gone = behind[at]
        end = behind[gone]
        left = before[at]
        ids[at], ids[gone], pair[gone] = rank, -1, -1
        behind[at] = end
        before[end] = at
        both = np.concatenate((at, left))
        new = pairs.of(ids[both], np.concatenate((ids[end], ids[at])))
        pair[both] = new
        pair[n] = -1
        keep = (new >= 0) & (both < n)
        if keep.any():
            push(new[keep], both[keep])
    kept = np.flatnonzero(ids[:n] >= 0)
    ends = (4 * np.searchsorted(kept, np.cumsum(lengths))).tolist()
    flat = ids[kept].astype("<i4").tobytes()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def foreign_letters(pattern: str) -> dict[int, str]:
    """Code points that the two libraries' Unicode tables class differently, and stand-ins of tiktoken's class.

    In a vocabulary of bytes and of ``a`` or ``1`` with the first byte of a
    longer character, the number of ids tells whether the pattern keeps both together.
    """
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for mark in b"a1":
        for lead in range(0xC2, 0xF5):
            ranks[bytes([mark, lead])] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = {kind: regex.compile(rf"\p{{{kind}}}") for kind in "LN"}
    stand_ins = {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        here = "L" if own["L"].match(c) else "N" if own["N"].match(c) else ""
        if not here and unicodedata.category(c)[0] not in "LN":
            continue
        n = len(c.encode())
        there = "L" if len(probe.encode_ordinary("a" + c)) == n else "N" if len(probe.encode_ordinary("1" + c)) == n else ""
        if here != there:
            stand_ins[code] = {"L": "a", "N": "1", "": "!"}[there]
    return stand_ins


class ByteBpe:
    """Encoder and decoder of one rank file."""

    ENTRIES = 300_000
    # Longer matches are merged alone.
    TOGETHER = 256
    # Characters of texts encoded together, and bytes merged together.
    BYTES = 4_000_000

    def __init__(self, path: str, pattern: str, stand_ins: dict[int, str]):
        self.ranks = read_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for data, rank in self.ranks.items():
            self.bytes_of[rank] = data
        self._one = np.array([self.ranks[bytes([b])] for b in range(256)], "int32")
        self._pairs: PairRanks | None = None
        self._split = regex.compile(pattern)
        self._stand_ins = stand_ins
        self._foreign = frozenset(map(chr, stand_ins))
        self._bits = RankBits(len(self.bytes_of))
        self._known: dict[str, bytes] = {}
        self._decimals: list[str] = []

    def matches(self, text: str) -> list[str]:
        if text.isascii() or self._foreign.isdisjoint(text):
            return self._split.findall(text)
        return [text[m.start() : m.end()] for m in self._split.finditer(text.translate(self._stand_ins))]

    def merged(self, matches: set[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian 32-bit) by match."""
        if self._pairs is None:
            self._pairs = PairRanks(self.ranks)
        found, waiting, size = {}, [], 0
        for match in matches:
            whole = self.ranks.get(match)
            if whole is not None:
                found[match] = np.array([whole], "<i4").tobytes()
            elif len(match) > self.TOGETHER:
                found[match] = np.array(merge(match, self.ranks, self._bits), "<i4").tobytes()
            else:
                waiting.append(match)
                size += len(match)
                if size > self.BYTES:
                    found.update(zip(waiting, merge_many(waiting, self._one, self._pairs, self._bits)))
                    waiting, size = [], 0
        if waiting:
            found.update(zip(waiting, merge_many(waiting, self._one, self._pairs, self._bits)))
        return found

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of every text."""
        cut = [blank_parts(t) for t in texts]
        known = self._known
        # A text's first part has no blank before it; no other part starts with one.
        for parts in cut:
            parts[0] = " " + parts[0]
        missing = set(chain.from_iterable(cut)).difference(known)
        split = {}
        for part in missing:
            whole = part[1:] if part[0] == " " else " " + part
            split[part] = [m.encode("utf-8", "surrogatepass") for m in self.matches(whole)]
        ids = self.merged({m for some in split.values() for m in some})
        for part, some in split.items():
            known[part] = ids[some[0]] if len(some) == 1 else b"".join([ids[m] for m in some])
        get = known.__getitem__
        out = [np.frombuffer(b"".join(map(get, parts)), "<i4") for parts in cut]
        if len(known) > self.ENTRIES:  # the newest ones go: what is frequent was met early
            self._known = dict(islice(known.items(), self.ENTRIES))
        return out

    def decimals(self) -> list[str]:
        if not self._decimals:
            self._decimals = [str(i) for i in range(len(self.bytes_of))]
        return self._decimals

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def digests(own: "ByteBpe", texts: Sequence[str]) -> Iterator[tuple[int, str, str]]:
    """Per text: number of ids, hash of the ids as decimals, hash of the bytes decoded from them."""
    names = own.decimals()
    for ids in own.encode(texts):
        listed = ids.tolist()
        written = " ".join(map(names.__getitem__, listed)).encode()
        yield len(listed), hashlib.sha256(written).hexdigest(), hashlib.sha256(own.decode(listed)).hexdigest()


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str, stand_ins: dict[int, str]) -> ByteBpe:
    """One per Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(path, pattern, stand_ins)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``*keep, ids`` (array of int) for every row."""
    rows, names = with_texts(docs, text, keep)
    out = T.StructType([rows.schema[n] for n in names] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    stand_ins = foreign_letters(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern, stand_ins)
        for batch in batches:
            for part in bounded(batch, "text", own.BYTES):
                yield part[names].assign(ids=own.encode([t or "" for t in part["text"]]))

    return restored(rows.mapInPandas(run, out), docs, keep, names)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``*keep, decoded`` (the bytes that ``ids`` stand for) for every row; NULL ids are none."""
    rows, names = with_texts(encoded, ids, keep)
    out = T.StructType([rows.schema[n] for n in names] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern, {})
        for batch in batches:
            yield batch[names].assign(decoded=[own.decode(x.tolist()) if x is not None else b"" for x in batch["text"]])

    return restored(rows.mapInPandas(run, out), encoded, keep, names)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``*keep, n_tokens, ids_sha256, decoded_sha256``: encoded and decoded again, in hashes.

    Hashes are lowercase hex: of the ids as decimals joined by one blank, and of the decoded bytes.
    """
    rows, names = with_texts(docs, text, keep)
    told = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    out = T.StructType([rows.schema[n] for n in names] + [T.StructField(n, k) for n, k in told])
    stand_ins = foreign_letters(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern, stand_ins)
        for batch in batches:
            for part in bounded(batch, "text", own.BYTES):
                made = pd.DataFrame(digests(own, [t or "" for t in part["text"]]), columns=[n for n, _ in told], index=part.index)
                yield pd.concat([part[names], made], axis=1)

    return restored(rows.mapInPandas(run, out), docs, keep, names)
