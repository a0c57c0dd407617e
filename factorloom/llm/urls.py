"""URL filters: domain rules first, then a ratio of two character models.

A rule (``host/path``) fits its host and all subdomains where the URL's path
starts with the rule's; the longest fitting rule decides.  URLs that rules accept
and reject train two character models of the same form: orders 0 to ``ORDER``,
each smoothed by the next shorter one.  Every other URL is judged by the
difference of the two log-likelihoods divided by its length, against a threshold
calibrated on rule-decided URLs kept apart.

Counts cover every rule-decided URL and are exact: a context of up to five bytes
and its character are one integer.  Each chunk of URLs sends its distinct grams
(with counts where it trains) to the slices of their contexts; a slice adds up
the counts of all chunks and answers every chunk with those of the grams it asked
for.  The counts grow with the input, and no task or driver ever holds them whole.

Defined results: a NULL URL and one without ``://`` have empty host and path, fit
no rule and are judged as text (NULL: as empty, difference 0); ties in rule length
go to block; a difference equal to the threshold is allowed; without rule-decided
URLs of both kinds the threshold lets all pass; repeated rows get equal
verdicts; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import columns_of, stored

ORDER = 5
# Cells of the hashed model for lists in memory.
CELLS = 1 << 18
# Rows of a chunk (as a power of two), characters looked at together, and characters a slice should meet.
CHUNK_BITS = 12
RUN = 1 << 18
SLICE = 2_000_000
# Weight of the next shorter context, in characters seen.
PRIOR = 4.0
# One fifth of the rule-decided URLs is kept for the threshold.
CALIBRATE = 5
BINS = 2048
# What a URL is there for, besides training kind 0 or 1: to be judged, or for the threshold.
OPEN, HELD = 2, 3


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (NULL: none), for ``rules`` of ``(verdict, host/path)``."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in reversed(ordered):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def cells_of(urls: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per character of all URLs: cells of its contexts, cells of context and character, and the URL it is in.

    Column k of the cells belongs to the context of k characters; an end mark
    closes each URL.
    """
    data = [bytes(ORDER) + (u or "").encode("utf-8", "surrogatepass") + b"\x01" for u in urls]
    flat = np.frombuffer(b"".join(data), "uint8").astype("uint64")
    lengths = np.array([len(x) for x in data], "int64")
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(len(flat)) - np.repeat(starts, lengths)
    at = np.flatnonzero(inside >= ORDER)
    contexts = np.zeros((len(at), ORDER + 1), "int64")
    grams = np.zeros((len(at), ORDER + 1), "int64")
    state = np.full(len(at), 14695981039346656037, "uint64")
    for k in range(ORDER + 1):
        if k:
            state = (state ^ flat[at - k]) * np.uint64(1099511628211)
        salted = _scatter(state + np.uint64(k * 2))
        contexts[:, k] = (salted % np.uint64(CELLS)).astype("int64")
        grams[:, k] = (_scatter(salted + flat[at] + np.uint64(1)) % np.uint64(CELLS)).astype("int64")
    return contexts, grams, np.repeat(np.arange(len(data)), lengths - ORDER)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def log_ratio(grams: Sequence[np.ndarray], contexts: Sequence[np.ndarray]) -> np.ndarray:
    """Accepted minus rejected log-likelihood of every character, from the counts (kind 0 reject, 1 accept) of each order."""
    logs = []
    for kind in (0, 1):
        p = np.full(len(grams[kind]), 1 / 256)
        for k in range(ORDER + 1):
            p = (grams[kind][:, k] + PRIOR * p) / (contexts[kind][:, k] + PRIOR)
        logs.append(np.log(np.minimum(p, 1.0)))
    return logs[1] - logs[0]


def mean_of(values: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(owner, values, minlength=count) / np.maximum(1, np.bincount(owner, minlength=count))


@dataclass(frozen=True)
class UrlModels:
    """Both models over hashed cells, for lists that fit in memory; grams that share a cell share counts."""

    counts: np.ndarray  # kind (0 reject, 1 accept) x (0 context, 1 context and character) x cell

    def difference(self, urls: Sequence[str | None]) -> np.ndarray:
        """Accepted minus rejected log-likelihood, per character."""
        contexts, grams, owner = cells_of(urls)
        apart = log_ratio([self.counts[k, 1, grams] for k in (0, 1)], [self.counts[k, 0, contexts] for k in (0, 1)])
        return mean_of(apart, owner, len(urls))


def grams_of(urls: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Per character of all URLs: a code for each order's context and character, and the URL it is in.

    A code holds the order, the context's bytes and in the lowest byte the
    character, so that all but the lowest byte stands for the context.
    """
    data = [bytes(ORDER) + (u or "").encode("utf-8", "surrogatepass") + b"\x01" for u in urls]
    flat = np.frombuffer(b"".join(data), "uint8").astype("uint64")
    lengths = np.array([len(x) for x in data], "int64")
    starts = np.cumsum(lengths) - lengths
    at = np.flatnonzero(np.arange(len(flat)) - np.repeat(starts, lengths) >= ORDER)
    codes = np.zeros((len(at), ORDER + 1), "uint64")
    code = flat[at]
    for k in range(ORDER + 1):
        if k:
            code = code | flat[at - k] << np.uint64(8 * k)
        codes[:, k] = code | np.uint64(k << 48)
    return codes, np.repeat(np.arange(len(data)), lengths - ORDER)


def runs(urls: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of URLs with about ``RUN`` characters."""
    first = held = 0
    for i, u in enumerate(urls):
        held += len(u or "") + 1
        if held >= RUN:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(urls):
        yield first, len(urls)


def added(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their counts."""
    if not parts:
        return np.zeros(0, "uint64"), np.zeros(0, "int64")
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    sums = np.zeros(len(codes), "int64")
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    return codes, sums


def counted(urls: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the URLs in order, and how often each occurs."""
    return added([np.unique(grams_of(urls[i:j])[0], return_counts=True) for i, j in runs(urls)])


def slice_of(codes: np.ndarray, slices: int) -> np.ndarray:
    return (_scatter(codes >> np.uint64(8)) % np.uint64(slices)).astype("int64")


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def lookup(known: np.ndarray, sums: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The columns of ``sums`` for the asked codes; 0 for unknown ones."""
    if not len(known):
        return np.zeros((2, len(asked)), "int64")
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, sums[:, at], 0)


def differences(rows: DataFrame) -> DataFrame:
    """``row, difference`` of the rows with role ``OPEN`` or ``HELD``; those with role 0 or 1 train that kind."""
    length = rows.agg(F.sum(F.coalesce(F.octet_length("url"), F.lit(0)) + 1)).first()[0] or 0
    slices = int(max(32, -(-length // SLICE)))
    rows = rows.withColumn("chunk", F.shiftright("row", CHUNK_BITS))

    def ask(chunk: pd.DataFrame) -> pd.DataFrame:
        role = chunk["role"].to_numpy()
        (rejected, n0), (accepted, n1), (asked, _) = (
            counted(chunk["url"][which].to_list()) for which in (role == 0, role == 1, role >= OPEN)
        )
        at = [slice_of(c, slices) for c in (rejected, accepted, asked)]
        out = []
        for s in np.unique(np.concatenate(at)).tolist():
            r, a, q = (x == s for x in at)
            columns = rejected[r], n0[r], accepted[a], n1[a], asked[q]
            out.append((s, chunk["chunk"].iloc[0], *map(packed, columns)))
        return pd.DataFrame(out, columns=["slice", "chunk", "c0", "n0", "c1", "n1", "asked"])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        kinds = []
        for kind in (0, 1):
            both = zip(part[f"c{kind}"], part[f"n{kind}"])
            kinds.append(added([(unpacked(c, "uint64"), unpacked(n, "int64")) for c, n in both]))
        known = np.union1d(kinds[0][0], kinds[1][0])
        sums = np.zeros((2, len(known)), "int64")
        for kind, (codes, counts) in enumerate(kinds):
            sums[kind, np.searchsorted(known, codes)] = counts
        contexts, first = np.unique(known >> np.uint64(8), return_index=True)
        whole = np.add.reduceat(sums, first, axis=1) if len(known) else sums
        found = []
        for x in part["asked"]:
            asked = unpacked(x, "uint64")
            found.append(packed(np.concatenate([lookup(known, sums, asked), lookup(contexts, whole, asked >> np.uint64(8))])))
        return pd.DataFrame({"chunk": part["chunk"], "slice": part["slice"], "found": found})

    def judge(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        urls = chunk["url"].to_list()
        known, _ = counted(urls)
        at = slice_of(known, slices)
        counts = np.zeros((4, len(known)), "int64")
        for s, data in zip(got["slice"], got["found"]):
            counts[:, at == s] = unpacked(data, "int64").reshape(4, -1)
        out = np.zeros(len(urls))
        for i, j in runs(urls):
            codes, owner = grams_of(urls[i:j])
            place = np.searchsorted(known, codes)
            out[i:j] = mean_of(log_ratio(counts[:2, place], counts[2:, place]), owner, j - i)
        return pd.DataFrame({"row": chunk["row"], "difference": out})

    sent = rows.groupBy("chunk").applyInPandas(
        ask, "slice long, chunk long, c0 binary, n0 binary, c1 binary, n1 binary, asked binary"
    )
    answers = sent.groupBy("slice").applyInPandas(answer, "chunk long, slice long, found binary")
    open_rows = rows.where(F.col("role") >= OPEN).select(*[F.col(c).alias(c) for c in ("row", "url", "chunk")])
    judged = open_rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(judge, "row long, difference double")
    return stored(judged, "differences")


def calibrate(rows: DataFrame) -> float:
    """The threshold with the best mean of both recalls, over bins of the difference; from ``difference, accepted``."""
    at = F.least(F.greatest(F.floor((F.col("difference") + 4) * BINS / 8), F.lit(0)), F.lit(BINS - 1)).cast("int")
    got = rows.groupBy(at.alias("at"), "accepted").count().toPandas()  # at most 2 x BINS rows
    sums = np.zeros((2, BINS))
    sums[got["accepted"].to_numpy(int), got["at"].to_numpy(int)] = got["count"]
    if not sums.sum(1).all():
        return -np.inf
    below = np.cumsum(sums, 1) - sums  # URLs under each bin's lower edge
    balance = below[0] / sums[0].sum() + 1 - below[1] / sums[1].sum()
    best = np.flatnonzero(balance == balance.max())
    return float(best[len(best) // 2] * 8 / BINS - 4)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``*keep, host, path, rule, difference, verdict`` for every row; ``difference`` is NULL where a rule decides."""
    names = [f"k{i}" for i in range(len(keep))]
    link = F.col(f"`{url}`").cast("string")
    rows = pages.select(*[c.alias(n) for n, c in zip(names, columns_of(pages, keep))], link.alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    numbered = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.monotonically_increasing_id().alias("row"))
    ruled = stored(numbered, "urls")
    accepted = (F.col("ruled") == "allow").cast("int")
    held = F.pmod(F.xxhash64("url"), F.lit(CALIBRATE)) == 0
    role = F.when(F.col("rule").isNull(), OPEN).when(held, HELD).otherwise(accepted)
    apart = differences(ruled.select("row", "url", role.alias("role")))
    judged = ruled.join(apart, "row", "left")
    threshold = calibrate(judged.where(F.col("rule").isNotNull() & held).select("difference", accepted.alias("accepted")))
    own = F.when(F.col("difference") >= threshold, "allow").otherwise("block")
    out = judged.select(
        *names, "host", "path", "rule",
        F.when(F.col("rule").isNull(), F.col("difference")).alias("difference"),
        F.coalesce(F.col("ruled"), own).alias("verdict"),
    )
    return out.withColumnsRenamed(dict(zip(names, keep)))
