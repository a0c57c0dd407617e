"""Alignment of two tokenizers over the bytes of a text.

The tokens of each tokenizer lie on the text's bytes without gaps: a *token-byte
incidence matrix* has one row per token and one column per byte.  Both are kept
as plain CSR arrays.  The product A·Bᵀ, built row by row as Gustavson does (the
rows of Bᵀ that a row of A selects are added up), has an entry for every pair of
tokens that overlap: the *links*, with the number of bytes they share.  Places
where tokens of both end cut a text into groups; the product of the two
*group incidence matrices* has an entry for every pair that shares a group.

Corpus counts of linked id pairs grow with the corpus.  Documents are stored in
chunks; a chunk sends its distinct id pairs and their counts to slices of the B
ids, a slice adds them up, knows every B id's most frequent partner and answers
each chunk.  No task or driver holds the table whole.

Tokens and links never reach over a single blank before a word (a token of
either kind starts there), so parts of texts between such blanks are aligned
once per Python worker while they stay known (at most ``ENTRIES`` of them).

Defined results: a text that is NULL, empty, or not given back byte for byte by
the tokens of both has no tokens, and zeros; repeated rows are rows and count
again; an empty table gives no rows; texts are read whole; other columns may
have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import stored
from factorloom.llm.texts import blank_parts, bounded, byte_letters, restored, with_texts

# Links of a chunk (a longer document is a chunk of its own), and pairs that a slice should meet.
CHUNK = 1_000_000
SLICE_PAIRS = 8_000_000
# Products laid out at a time.
CELLS = 4_000_000


@dataclass
class Csr:
    """Rows of (column, value); row i holds ``indptr[i]`` up to ``indptr[i + 1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transposed(self) -> Csr:
        owner = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.r_[0, np.cumsum(counts)], owner[order], self.values[order], self.rows)

    def row_sizes(self, other: Csr) -> np.ndarray:
        """Products that each row of ``self @ other`` adds up."""
        each = np.diff(other.indptr)[self.indices]
        sums = np.r_[0, np.cumsum(each)]
        return sums[self.indptr[1:]] - sums[self.indptr[:-1]]

    def __matmul__(self, other: Csr) -> Csr:
        sizes = self.row_sizes(other)
        ends = np.cumsum(sizes)
        parts, first = [], 0
        while first < self.rows:  # so many rows that their products fit
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CELLS, "right")))
            parts.append(self._rows(other, first, last))
            first = last
        counts = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, "int64")
        indices, values = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, "int64") for i in (1, 2))
        return Csr(np.r_[0, np.cumsum(counts)], indices, values, other.columns)

    def _rows(self, other: Csr, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = slice(self.indptr[first], self.indptr[last])
        picked, factor = self.indices[own], self.values[own]
        row = np.repeat(np.arange(last - first), np.diff(self.indptr[first : last + 1]))
        starts = other.indptr[picked]
        each = other.indptr[picked + 1] - starts
        at = np.repeat(starts - np.cumsum(each) + each, each) + np.arange(each.sum())
        key = np.repeat(row, each) * other.columns + other.indices[at]
        value = np.repeat(factor, each) * other.values[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, "int64")
        sums = np.add.reduceat(value, new) if len(new) else value
        return np.bincount(key[new] // other.columns, minlength=last - first), key[new] % other.columns, sums


def on_bytes(ends: np.ndarray) -> Csr:
    """Token-byte incidence of tokens that end at ``ends`` (the first starts at 0)."""
    size = int(ends[-1]) if len(ends) else 0
    return Csr(np.r_[0, ends], np.arange(size), np.ones(size, "int64"), size)


def in_groups(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Group incidence: each token is in the group that ends at the first cut not before its end."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), np.ones(len(ends), "int64"), len(cuts))


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """Tokens of A by tokens of B: bytes in common."""
    return on_bytes(a_ends) @ on_bytes(b_ends).transposed()


def group_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """Tokens of A by tokens of B: 1 where both are in one group."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return in_groups(a_ends, cuts) @ in_groups(b_ends, cuts).transposed()


class Pair:
    """Both tokenizers, and what is known of parts of texts."""

    ENTRIES = 300_000
    # Bytes of parts that are encoded as one text.
    TOGETHER = 60_000

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        names = self._a.get_vocab()
        letters = byte_letters()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            if all(c in letters for c in name):
                self.a_bytes[i] = bytes(letters[c] for c in name)
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self._b.get_piece_size())]
        self._a_sizes = np.array([len(x) for x in self.a_bytes], "int64")
        self._b_sizes = np.array([len(x) for x in self.b_bytes], "int64")
        self.code = np.dtype("<u4" if len(self.a_bytes) * len(self.b_bytes) <= 1 << 32 else "<u8")
        # Names of ids with what may stand behind them in a text of groups.
        self._a_names = [f"{i}{mark}" for mark in ",|" for i in range(len(self.a_bytes))]
        self._b_names = [f"{i}{mark}" for mark in ",;\n" for i in range(len(self.b_bytes))]
        self._clear()

    def _piece(self, i: int) -> bytes:
        name = self._b.id_to_piece(i)
        if self._b.is_byte(i):
            return bytes([int(name[1:-1], 16)])
        return name.replace("▁", " ").encode("utf-8")

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._groups: list[str | None] = []  # None: the tokens do not give the text back
        self._codes: list[bytes] = []
        self._counts = np.zeros((0, 5), "int64")

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and of B for a blank and ``text``; None if either does not give it back."""
        data = (" " + text).encode("utf-8", "surrogatepass")
        a = self._a.encode(" " + text, add_special_tokens=False).ids
        b = self._b.encode(text, num_threads=1)
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        return np.array(a, "int64"), np.array(b, "int64")

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self._a_sizes[a]), np.cumsum(self._b_sizes[b])

    def _learn(self, parts: list[str]) -> None:
        """Adds parts; those between ordinary blanks are encoded as one text, as no token crosses the blanks."""
        together, alone, size = [], [], 0
        runs = [together]
        for part in parts:
            if part and part == part.strip() and "▁" not in part:
                size += len(part) + 1
                if size > self.TOGETHER:
                    runs.append([])
                    size = len(part)
                runs[-1].append(part)
            else:
                alone.append(part)
        for run in runs:
            if run and not self._add(run):
                alone += run
        for part in alone:
            if not self._add([part]):
                self._place[part] = len(self._groups)
                self._groups.append(None)
                self._codes.append(b"")
                self._counts = np.vstack((self._counts, np.zeros((1, 5), "int64")))

    def _add(self, parts: list[str]) -> bool:
        found = self.tokens(" ".join(parts))
        if found is None:
            return False
        a, b = found
        a_ends, b_ends = self.ends(a, b)
        last = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if len(np.intersect1d(cuts, last, assume_unique=True)) != len(last):
            return False
        links = on_bytes(a_ends) @ on_bytes(b_ends).transposed()
        a_group, b_group = in_groups(a_ends, cuts), in_groups(b_ends, cuts)
        shared = a_group.row_sizes(b_group.transposed())
        a_part, b_part = np.searchsorted(last, a_ends), np.searchsorted(last, b_ends)
        n_links = np.diff(links.indptr)
        n = len(parts)
        counts = np.column_stack(
            [
                np.bincount(a_part, minlength=n), np.bincount(b_part, minlength=n),
                np.bincount(np.searchsorted(last, cuts), minlength=n),
                np.bincount(a_part, n_links, n).astype("int64"), np.bincount(a_part, shared, n).astype("int64"),
            ]
        )
        codes = (b[links.indices] * len(self.a_bytes) + np.repeat(a, n_links)).astype(self.code).tobytes()
        split = (np.cumsum(counts[:, 3]) * self.code.itemsize).tolist()
        # Groups as text: ids of A, a bar, ids of B; the last id of a part carries a line end.
        ga, gb = a_group.indices, b_group.indices
        a_last = np.r_[ga[1:] != ga[:-1], True]
        b_last = np.r_[gb[1:] != gb[:-1], True].astype("int64")
        b_last[np.r_[b_part[1:] != b_part[:-1], True]] = 2
        at_a = np.arange(len(a)) + np.searchsorted(gb, ga)
        at_b = np.arange(len(b)) + np.searchsorted(ga, gb, "right")
        names = np.empty(len(a) + len(b), object)
        names[at_a] = [self._a_names[i] for i in (a + len(self.a_bytes) * a_last).tolist()]
        names[at_b] = [self._b_names[i] for i in (b + len(self.b_bytes) * b_last).tolist()]
        self._place.update(zip(parts, range(len(self._groups), len(self._groups) + n)))
        self._groups += "".join(names.tolist())[:-1].split("\n")
        self._codes += [codes[i:j] for i, j in zip([0, *split], split)]
        self._counts = np.vstack((self._counts, counts))
        return True

    def digests(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, str, bytes]]:
        """Per text: counts (A, B, groups, links, pairs sharing a group), the hash of its groups, codes of its links."""
        cut = [blank_parts(t) if t else [] for t in texts]
        if len(self._place) > self.ENTRIES:  # the newest ones go: what is frequent was met early
            self._place = dict(islice(self._place.items(), self.ENTRIES))
            del self._groups[self.ENTRIES :], self._codes[self.ENTRIES :]
            self._counts = self._counts[: self.ENTRIES].copy()
        self._learn(list(set().union(*cut).difference(self._place)))
        n = np.array([len(parts) for parts in cut], "int64")
        flat = list(map(self._place.__getitem__, chain.from_iterable(cut)))
        named, codes = list(map(self._groups.__getitem__, flat)), list(map(self._codes.__getitem__, flat))
        counts = np.zeros((len(cut), 5), "int64")
        ends = np.cumsum(n)
        if flat:
            counts[n > 0] = np.add.reduceat(self._counts[flat], (ends - n)[n > 0])
        for row, first, last in zip(counts, (ends - n).tolist(), ends.tolist()):
            own = named[first:last]
            if first == last or None in own:
                yield np.zeros(5, "int64"), "", b""
            else:
                yield row, hashlib.sha256(";".join(own).encode()).hexdigest(), b"".join(codes[first:last])


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One per Python worker."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def alignments(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``*keep`` and arrays: ``a_ids, a_ends, b_ids, b_ends`` (ends in bytes of the blank and the text),
    ``group_ends``, and the links as ``link_a, link_b`` (token numbers) with ``link_bytes``."""
    rows, names = with_texts(docs, text, keep)
    arrays = ["a_ids", "a_ends", "b_ids", "b_ends", "group_ends", "link_a", "link_b", "link_bytes"]
    out = T.StructType([rows.schema[n] for n in names] + [T.StructField(n, T.ArrayType(T.LongType())) for n in arrays])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, none = pair(a_path, b_path), np.zeros(0, "int64")
        for batch in batches:
            for part in bounded(batch, "text", 4_000_000):
                made = []
                for t in part["text"]:
                    found = own.tokens(t) if t else None
                    if found is None:
                        made.append([none] * len(arrays))
                        continue
                    a_ends, b_ends = own.ends(*found)
                    links = overlap_links(a_ends, b_ends)
                    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
                    at = np.repeat(np.arange(links.rows), np.diff(links.indptr))
                    made.append([found[0], a_ends, found[1], b_ends, cuts, at, links.indices, links.values])
                yield part[names].assign(**{n: [m[i] for m in made] for i, n in enumerate(arrays)})

    return restored(rows.mapInPandas(run, out), docs, keep, names)


def link_chunks(docs: DataFrame, key: str, a_path: str, b_path: str, text: str) -> DataFrame:
    """``chunk, keys, counts, hashes, lengths, codes``: many documents in a row, written once."""
    rows, _ = with_texts(docs, text, [key])
    out = T.StructType(
        [
            T.StructField("keys", T.ArrayType(rows.schema["k0"].dataType)),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("hashes", T.ArrayType(T.StringType())),
            T.StructField("codes", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pair(a_path, b_path)
        keys, counts, hashes, codes, held = [], [], [], [], 0

        def row():
            flat = np.concatenate(counts)
            return pd.DataFrame({"keys": [keys], "counts": [flat], "hashes": [hashes], "codes": [zlib.compress(b"".join(codes), 1)]})

        for batch in batches:
            for part in bounded(batch, "text", 4_000_000):
                for name, (n, digest, links) in zip(part["k0"].tolist(), own.digests(part["text"].tolist())):
                    keys.append(name)
                    counts.append(n)
                    hashes.append(digest)
                    codes.append(links)
                    held += int(n[3])
                    if held >= CHUNK:
                        yield row()
                        keys, counts, hashes, codes, held = [], [], [], [], 0
        if keys:
            yield row()

    made = rows.mapInPandas(run, out).withColumn("chunk", F.monotonically_increasing_id())
    return stored(made, "links")


def _packed(codes: np.ndarray) -> bytes:
    """Sorted codes as compressed gaps."""
    return zlib.compress(np.diff(codes, prepend=codes.dtype.type(0)).tobytes(), 1)


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), kind), dtype=kind)


def aligned_counts(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256`` for every row.

    ``n_shared``: pairs of an A and a B token in one group.  ``count_sum`` adds up,
    over a document's links, how many links of the corpus join the same two ids;
    ``n_best`` counts the links whose count is the highest of their B id.
    """
    sizes = pair(a_path, b_path)
    width, kind = len(sizes.a_bytes), sizes.code
    own = link_chunks(docs, key, a_path, b_path, text)

    def distinct(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.frombuffer(zlib.decompress(data), kind), return_counts=True)

    def slice_of(codes: np.ndarray, slices: int) -> np.ndarray:
        mixed = (codes // kind.type(width)).astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)) % np.uint64(slices)

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [len(distinct(x)[0]) for x in b["codes"]]})

    pairs = own.select("codes").mapInPandas(sized, "n long").agg(F.sum("n")).first()[0] or 0
    slices = int(max(8, -(-pairs // SLICE_PAIRS)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, data in zip(b["chunk"], b["codes"]):
                codes, counts = distinct(data)
                at = slice_of(codes, slices)
                for s in np.unique(at).tolist():
                    mine = at == s
                    yield pd.DataFrame(
                        {
                            "slice": [s], "chunk": [chunk], "codes": [_packed(codes[mine])],
                            "counts": [zlib.compress(counts[mine].astype("<u4").tobytes(), 1)],
                        }
                    )

    asked = own.select("chunk", "codes").mapInPandas(ask, "slice int, chunk long, codes binary, counts binary")

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        codes = [_unpacked(x, kind) for x in rows["codes"]]
        every = np.unique(np.concatenate(codes))
        sums = np.zeros(len(every), "<i8")
        for c, n in zip(codes, rows["counts"]):
            sums[np.searchsorted(every, c)] += np.frombuffer(zlib.decompress(n), "<u4")
        ids = every // kind.type(width)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        most = np.repeat(np.maximum.reduceat(sums, first), np.diff(np.r_[first, len(ids)]))
        told = np.where(sums == most, -sums, sums)  # a B id's highest counts are told with a minus
        return pd.DataFrame(
            {
                "chunk": rows["chunk"], "slice": rows["slice"],
                "told": [zlib.compress(told[np.searchsorted(every, c)].tobytes(), 1) for c in codes],
            }
        )

    answers = asked.groupBy("slice").applyInPandas(answer, "chunk long, slice int, told binary")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum"]
    out = T.StructType(
        [T.StructField("k0", own.schema["keys"].dataType.elementType)]
        + [T.StructField(n, T.LongType()) for n in names]
        + [T.StructField("groups_sha256", T.StringType())]
    )

    def finish(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame(columns=out.names)
        row = chunk.iloc[0]
        counts = np.asarray(row["counts"], "int64").reshape(-1, 5)
        codes, place = np.unique(np.frombuffer(zlib.decompress(row["codes"]), kind), return_inverse=True)
        told = np.zeros(len(codes), "int64")
        at = slice_of(codes, slices)
        for s, data in zip(got["slice"], got["told"]):
            told[at == s] = np.frombuffer(zlib.decompress(data), "<i8")
        ends = np.cumsum(counts[:, 3])

        def summed(values: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(values)]
            return total[ends] - total[ends - counts[:, 3]]

        columns = [*counts.T, summed(told[place] < 0), summed(np.abs(told[place]))]
        made = pd.DataFrame({"k0": pd.Series(list(row["keys"]), dtype=object)})
        return made.assign(**dict(zip(names, columns)), groups_sha256=row["hashes"])

    done = own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(finish, out)
    return restored(done, docs, [key], ["k0"])
