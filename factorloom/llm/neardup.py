"""Near-duplicate documents: order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its
occurrence number, so that every labelled shingle is unique in its text.  One
sketch draws the ``PICKS`` labelled shingles with the smallest hashes and keeps
them *in text order*; two texts share a sketch only if they share these shingles
in the same order.  Texts that share a sketch are candidates.

A candidate pair is verified by alignment: the longest common subsequence of the
two shingle sequences within the band that the threshold allows.  As labelled
shingles are unique, that is a longest increasing run of positions, O(n log n).
With m aligned shingles of n1 and n2 the similarity is m / (n1 + n2 - m).

No bucket is expanded into pairs.  Exact copies are one class from the start and
only representatives go on.  In each bucket every text is first compared with
the bucket's centre (the text with the most sketch partners); linked texts form
classes.  In buckets that still hold several classes, texts of different classes
are compared, in blocks, so no link between classes is lost.  Most of these need
no alignment: a shingle that occurs in one class only cannot be shared with a text
of another, so the number of a text's other shingles (:func:`shared_counts`,
counted over all texts of such buckets, in ``PARTS`` parts by hash) bounds its
similarity to every text outside its class.  Edited copies of one text hold shingles of their own, so the bound
settles nearly all pairs of a large group of them, and only the rest is aligned.

Defined results: NULL texts are duplicates of nothing; texts equal up to white
space and letter case are copies, empty ones of each other; a text of fewer than
five words is one shingle; repeated rows share a class; ties go to the smaller
``doc_id``; an empty table gives no rows.  Texts are read whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import columns_of, release, stored

WORDS = 5
SIMILAR = 0.8
SKETCHES = 32
PICKS = 4
CELLS = 1 << 20
# Texts compared with one centre in one task.
GROUP = 128
BLOCK = 256
# Rows of small groups that one call handles together.
ROWS = 400
# Places of the table in which a text's shingles are marked.
MARKS = 1 << 20
# Shingles of a chunk of texts (a longer text is a chunk of its own), and shingles that a slice should meet.
CHUNK = 250_000
SLICE_SHINGLES = 8_000_000
# Parts by hash in which a text's shared shingles are counted; a part with more than HELD is not told.
PARTS, HELD = 32, 60_000
# Bits of a filter of row numbers: ten for each, at most 64 MB; beyond that texts meet by shuffle alone.
FILTER_BITS, FILTER_PIECE = 1 << 29, 1 << 19

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# A factor for each place in a shingle.
_PLACES = mixed(np.arange(1, 17, dtype="uint64") * _MIX) | np.uint64(1)
_FACTOR = 0xD1342543DE82EF95
_POWERS = [np.ones(1, "uint64"), np.ones(1, "uint64")]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd factor modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, factor in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            steps = np.full(2 * n, factor, "uint64")
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype="uint64")
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, from one polynomial sum over all its bytes."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), "uint8")
    inside = np.r_[False, data > 32, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, "uint64")
    np.cumsum((data + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def labelled_shingles(text: str, width: int = WORDS) -> np.ndarray:
    """Hashes of the shingles with their occurrence number, in text order."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    rolled = np.zeros(n, "uint64")
    for j in range(min(width, len(h))):
        rolled += h[j : j + n] * _PLACES[j % len(_PLACES)]
    rolled = mixed(rolled)
    ranked = np.sort(rolled)
    if n == 1 or (ranked[1:] != ranked[:-1]).all():
        return rolled
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    times = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    later = order[times > 0]  # the first occurrence keeps its hash
    rolled[later] = mixed(rolled[later] + times[times > 0].astype("uint64") * _MIX)
    return rolled


def sketches(shingles: np.ndarray, count: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """``count`` hashes, each of ``picks`` minimal shingles in text order."""
    n = len(shingles)
    seeds = mixed(np.arange(1, count + 1, dtype="uint64") * _MIX)
    out = np.arange(count, dtype="uint64")
    if not n:
        return mixed(out)
    step = max(1, CELLS // n)
    for first in range(0, count, step):  # so many sketches at a time that memory stays bounded
        own = slice(first, first + step)
        if n > picks:
            keyed = (shingles[None, :] ^ seeds[own, None]) * (seeds[own, None] | np.uint64(1))
            at = np.sort(np.argpartition(keyed, picks, axis=1)[:, :picks], axis=1)
        else:
            at = np.broadcast_to(np.arange(n), (len(seeds[own]), n))
        for j in range(at.shape[1]):
            out[own] = mixed(out[own] + shingles[at[:, j]] + _MIX)
    return out


def least_common(n1: int, n2: int, similar: float) -> int:
    """Shingles that two texts of so many must share to be similar."""
    return int(np.ceil(similar * (n1 + n2) / (1 + similar) - 1e-9))


def aligned(one: dict[int, int], n1: int, two: np.ndarray, similar: float = SIMILAR) -> float:
    """Similarity of two shingle sequences; 0 if it is below ``similar``.

    ``one`` maps the first text's labelled shingles to their positions.
    """
    n2 = len(two)
    if min(n1, n2) < similar * max(n1, n2):
        return 0.0
    least = least_common(n1, n2, similar)
    # A subsequence of `least` matches cannot leave this band around the diagonal.
    band = max(n1, n2) - least
    places = [p for p in map(one.get, two.tolist())]
    if len(places) - places.count(None) < least:
        return 0.0
    ends: list[int] = []
    for j, p in enumerate(places):
        if p is not None and abs(p - j) <= band:
            if not ends or p > ends[-1]:
                ends.append(p)
            else:
                ends[bisect_left(ends, p)] = p
    m = len(ends)
    found = m / (n1 + n2 - m)
    return found if m >= least and found >= similar - 1e-12 else 0.0


def text_id(text: Column) -> Column:
    """128-bit hash of a text without letter case and differences in white space; NULL for NULL."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def stored_rows(docs: DataFrame, key: str, text: str, whole: bool = False) -> DataFrame:
    """``row, doc, text, text_id`` (and ``all``, every column) of each row, written once; ``row`` is unique."""
    body = F.col(f"`{text}`")
    kept = F.struct(*columns_of(docs, docs.columns if whole else [text])).alias("all")
    rows = docs.select(F.col(f"`{key}`").alias("doc"), text_id(body).alias("text_id"), kept)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    return rows.withColumn("text", F.col("all").getField(text))  # of the struct only this is read


def holding(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose ``row`` is in ``wanted``, and a few others: a Bloom filter of bounded size.

    A join behind it then shuffles few texts that it does not need.
    """
    bits = 1 << max(10, (10 * wanted.count() - 1).bit_length())
    if bits > FILTER_BITS:
        return texts
    size = min(bits, FILTER_PIECE)

    def places(rows: np.ndarray) -> list[np.ndarray]:
        h = mixed(rows.astype("uint64") + _MIX)
        return [(x & np.uint64(bits - 1)).astype("int64") for x in (h, h >> np.uint64(32), mixed(h))]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(np.concatenate(places(b["row"].to_numpy("int64"))))
            for piece in np.unique(at // size).tolist():
                own = held.setdefault(piece, np.zeros(size, bool))
                own[at[at // size == piece] % size] = True
        for piece, own in held.items():
            yield pd.DataFrame({"piece": [piece], "bits": [zlib.compress(np.packbits(own).tobytes(), 1)]})

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(zlib.decompress(x), "uint8") for x in rows["bits"]]
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "bits": [np.bitwise_or.reduce(parts).tobytes()]})

    kind = "piece int, bits binary"
    marked = wanted.select("row").mapInPandas(mark, kind).groupBy("piece").applyInPandas(both, kind)
    whole = np.zeros(bits // 8, "uint8")
    for r in marked.toLocalIterator():  # at most FILTER_BITS in all
        data = np.frombuffer(r["bits"], "uint8")
        whole[r["piece"] * size // 8 :][: len(data)] = data
    shared = texts.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def held(rows: pd.Series) -> pd.Series:
        flags, out = shared.value, np.ones(len(rows), bool)
        for at in places(rows.to_numpy("int64")):
            out &= (flags[at >> 3] >> (7 - (at & 7)).astype("uint8")) & 1 == 1
        return pd.Series(out)

    return texts.where(held("row"))


def by_centre(pairs: DataFrame) -> DataFrame:
    """``a, b, tile``: texts ``b`` meet their centre ``a``, ``GROUP`` at a time, so any number of them spreads over tasks."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    return pairs.join(many, "a").select("a", "b", F.xxhash64("a", part).alias("tile"))


def compared(texts: pd.DataFrame, pairs: pd.DataFrame, similar: float) -> pd.DataFrame:
    """The pairs ``a, b`` similar enough, of tiles of ``row, text``.

    A text's shingles are made once a tile.  They are marked in a table by some of
    their bits, which tells at least as many common shingles as a pair has, so only
    pairs that hold enough of them are aligned.
    """
    found, marks = [], np.zeros(MARKS, bool)
    bits, places = np.uint64(MARKS - 1), texts.groupby("tile").indices
    for tile, own in pairs.groupby("tile", sort=False):
        at = places.get(tile, ())
        shingles = {r: labelled_shingles(t) for r, t in zip(texts["row"].iloc[at], texts["text"].iloc[at])}
        for a, partners in own.groupby("a", sort=False)["b"]:
            one, place = shingles[a], {}
            marks[one & bits] = True
            for b in partners.tolist():
                two = shingles[b]
                if np.count_nonzero(marks[two & bits]) >= least_common(len(one), len(two), similar):
                    place = place or {s: i for i, s in enumerate(one.tolist())}
                    near = aligned(place, len(one), two, similar)
                    if near:
                        found.append((a, b, near))
            marks[one & bits] = False
    return pd.DataFrame(found, columns=["a", "b", "similarity"])


def verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs ``a, b`` (row numbers) whose alignment is similar enough.

    ``pairs`` name the ``tile`` in which they are compared; a tile reads each of its
    texts once, however many pairs the text is in.
    """
    pairs = stored(pairs, "pairs")
    sides = pairs.select("tile", F.col("a").alias("row")).unionAll(pairs.select("tile", F.col("b").alias("row")))
    sides = stored(sides.distinct(), "sides")
    # Small tiles share a call.
    bins = max(1, -(-sides.count() // (2 * ROWS)))
    binned = lambda df: df.withColumn("bin", F.pmod("tile", F.lit(bins))).groupBy("bin")
    rows = sides.join(holding(texts.select("row", "text"), sides), "row")

    def compare(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        return compared(rows, pairs, similar)

    return binned(rows).cogroup(binned(pairs)).applyInPandas(compare, "a long, b long, similarity double")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``row, comp``: smallest text id reachable over links ``a, b``, by hooking and pointer jumping."""
    both = stored(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    state = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "row"), "comps")
    while True:
        # A neighbour's class, then the class of one's class.
        near = both.join(state.withColumnsRenamed({"row": "b", "comp": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        hooked = state.join(near.withColumnRenamed("a", "row"), "row").select(
            "row", "comp", F.least("comp", "near").alias("low")
        )
        up = state.select(F.col("row").alias("low"), F.col("comp").alias("upper"))
        jumped = hooked.join(up, "low", "left").select(
            "row", F.col("comp").alias("was"), F.least("low", F.coalesce("upper", "low")).alias("comp")
        )
        moved = stored(jumped, "comps")
        changed = moved.where("was <> comp").limit(1).count()
        state = moved.drop("was")
        if not changed:
            break
    return nodes.select("row").join(state, "row", "left").select(
        "row", F.coalesce("comp", "row").alias("comp")
    )


def sketch_rows(texts: DataFrame, count: int, picks: int) -> DataFrame:
    """``row, text_id, length, sketch`` (array of ``count`` hashes)."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            shingles = [labelled_shingles(t) for t in b["text"]]
            yield pd.DataFrame(
                {
                    "row": b["row"],
                    "text_id": b["text_id"],
                    "length": [len(s) for s in shingles],
                    "sketch": [sketches(s, count, picks).astype("int64") for s in shingles],
                }
            )

    return texts.mapInPandas(draw, "row long, text_id string, length int, sketch array<long>")


def classes(rows: DataFrame, similar: float = SIMILAR, count: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """``row, doc, comp`` for :func:`stored_rows`: each row's class, a row number (NULL text: NULL)."""
    texts = rows.where("text_id is not null").select("row", "text_id", "text")
    # One row stands for each text; copies share its class.
    copies = stored(texts.groupBy("text_id").agg(F.min("row").alias("row")), "copies")
    drawn = sketch_rows(texts, count, picks).drop("text_id")
    drawn = stored(drawn.join(copies.select("row"), "row", "left_semi"), "sketches")
    places = drawn.select("row", "length", F.posexplode("sketch").alias("i", "value"))
    # Buckets of one text say nothing; the others' sizes make a text more or less central.
    sizes = places.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(places.join(sizes, ["i", "value"]), "buckets")
    central = shared.groupBy("row").agg(F.sum("n").alias("weight"))
    weighed = shared.join(central, "row")
    centres = weighed.groupBy("i", "value").agg(F.max(F.struct("weight", -F.col("row"), "length")).alias("best"))
    centres = centres.select("i", "value", (-F.col("best.col2")).alias("a"), F.col("best.length").alias("a_length"))
    fits = F.least("length", "a_length") >= similar * F.greatest("length", "a_length")
    pairs = shared.join(centres, ["i", "value"]).where("a <> row").where(fits)
    pairs = stored(pairs.select("a", F.col("row").alias("b")).distinct(), "centre-pairs")
    links = stored(verified(by_centre(pairs), texts, similar), "links")
    comps = stored(components(links, drawn), "components")

    # What centres did not settle: buckets that hold several classes.
    parted = shared.join(comps, "row")
    several = parted.groupBy("i", "value").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    parted = parted.join(several.where("low <> high").drop("low", "high"), ["i", "value"])
    unsettled = stored(parted.select("row", "comp", "length").distinct(), "unsettled")
    counts = shared_counts(unsettled.join(holding(texts.select("row", "text"), unsettled), "row"), unsettled)
    able = unsettled.drop("comp", "length").join(counts, "row").where(F.col("shared") >= F.lit(similar) * F.col("length") - 1e-9)
    open_rows = parted.join(stored(able.select("row", "shared", "parts"), "able"), "row")
    known = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = stored(open_pairs(open_rows, similar).join(known, ["a", "b"], "left_anti"), "open")
    if not more.isEmpty():
        found = verified(more, texts, similar).select("a", "b")
        comps = stored(components(links.select("a", "b").unionAll(found), drawn), "components")
    members = copies.join(comps, "row").select("text_id", "comp")
    return rows.select("row", "doc", "text_id").join(members, "text_id", "left").select("row", "doc", "comp")


def _entries(shingles: np.ndarray, owner: np.ndarray, comps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle with the smallest and, if it is another, the largest class that holds it."""
    if not len(shingles):
        return shingles, comps[:0]
    order = np.argsort(shingles, kind="stable")
    s, c = shingles[order], comps[owner[order]]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    low, high = np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)
    two = low != high
    return np.r_[s[first], s[first][two]], np.r_[low, high[two]]


def in_several(shingles: np.ndarray, comps: np.ndarray) -> np.ndarray:
    """Of each entry, whether several classes hold its shingle."""
    out = np.empty(len(shingles), bool)
    piece = (shingles >> np.uint64(61)).astype("uint8")
    for p in np.unique(piece):  # an eighth at a time bounds the memory beside the entries
        at = np.flatnonzero(piece == p)
        order = at[np.argsort(shingles[at], kind="stable")]
        s, c = shingles[order], comps[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        two = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
        out[order] = np.repeat(two, np.diff(np.r_[first, len(s)]))
    return out


def answered(got: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's entries in one slice, whether several classes hold them (bits): one sort answers all chunks."""
    s = np.concatenate([np.frombuffer(x, "uint64") for x in got["s"]])
    c = np.concatenate([np.frombuffer(n, "<i8")[np.frombuffer(p, "<u4")] for n, p in zip(got["names"], got["place"])])
    ends = np.cumsum([len(x) // 8 for x in got["s"]])
    several = [np.packbits(x).tobytes() for x in np.split(in_several(s, c), ends[:-1])]
    return pd.DataFrame({"chunk": got["chunk"], "slice": got["slice"], "several": several})


def shared_counts(texts: DataFrame, sized: DataFrame) -> DataFrame:
    """``row, length, shared, parts``: how many shingles of a text also occur in texts of other classes,
    in all and by hash (16 bits a part; NULL if a part does not fit).

    ``texts`` has ``row, comp, text``; ``sized`` their ``length``.  Chunks of texts
    send each of their shingles once, with at most two classes, to the shingles'
    slices, which answer whether several classes hold it; a shingle in any
    number of texts is one entry of every chunk.
    """
    total = sized.agg(F.sum("length")).first()[0] or 0
    slices = int(max(8, -(-total // SLICE_SHINGLES)))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, comps, parts, held = [], [], [], 0

        def chunk():
            return pd.DataFrame(
                {
                    "rows": [np.array(rows, "<i8").tobytes()], "comps": [np.array(comps, "<i8").tobytes()],
                    "lengths": [np.array([len(x) for x in parts], "<i8").tobytes()], "shingles": [np.concatenate(parts).tobytes()],
                }
            )

        for b in batches:
            for row, comp, text in zip(b["row"], b["comp"], b["text"]):
                rows.append(row)
                comps.append(comp)
                parts.append(labelled_shingles(text))
                held += len(parts[-1])
                if held >= CHUNK:
                    yield chunk()
                    rows, comps, parts, held = [], [], [], 0
        if rows:
            yield chunk()

    fields = "rows binary, comps binary, lengths binary, shingles binary"
    made = texts.select("row", "comp", "text").mapInPandas(gather, fields)
    chunks = stored(made.withColumn("chunk", F.monotonically_increasing_id()), "shingles")

    def opened(x) -> tuple[np.ndarray, ...]:
        numbers = [np.frombuffer(x[c], "<i8") for c in ("rows", "comps", "lengths")]
        shingles = np.frombuffer(x["shingles"], "uint64")
        owner = np.repeat(np.arange(len(numbers[0])), numbers[2])
        return (*numbers, shingles, owner, *_entries(shingles, owner, numbers[1]))

    def slice_of(shingles: np.ndarray) -> np.ndarray:
        return (shingles >> np.uint64(24)) % np.uint64(slices)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.to_dict("records"):
                *_, s, c = opened(x)
                at = slice_of(s)
                for i in np.unique(at).tolist():
                    names, place = np.unique(c[at == i], return_inverse=True)
                    yield pd.DataFrame(
                        {
                            "slice": [i], "chunk": [x["chunk"]], "s": [s[at == i].tobytes()],
                            "names": [names.tobytes()], "place": [place.astype("<u4").tobytes()],
                        }
                    )

    asked = chunks.mapInPandas(ask, "slice int, chunk long, s binary, names binary, place binary")

    answers = asked.groupBy("slice").applyInPandas(answered, "chunk long, slice int, several binary")

    def count(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame(columns=["row", "length", "shared", "parts"])
        rows, _, lengths, shingles, owner, s, _ = opened(chunk.iloc[0])
        at, flags = slice_of(s), np.zeros(len(s), bool)
        for i, bits in zip(got["slice"], got["several"]):
            mine = at == i
            flags[mine] = np.unpackbits(np.frombuffer(bits, "uint8"), count=int(mine.sum())).astype(bool)
        held = np.isin(shingles, s[flags])
        code = owner[held] * PARTS + (shingles[held] % np.uint64(PARTS)).astype("int64")
        counts = np.bincount(code, minlength=len(rows) * PARTS).reshape(-1, PARTS)
        parts = [x.astype("<u2").tobytes() if x.max() <= HELD else None for x in counts]
        return pd.DataFrame({"row": rows, "length": lengths, "shared": counts.sum(1), "parts": parts})

    grouped = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return grouped.applyInPandas(count, "row long, length int, shared long, parts binary")


def open_pairs(rows: DataFrame, similar: float) -> DataFrame:
    """``a, b, tile``: pairs of different classes in one bucket that may still be similar, smaller number second.

    Texts outside a bucket's largest class meet all texts of the bucket, block by
    block; a pair goes on if the lengths, and the shingles that either shares with
    other classes, allow the similarity.
    """
    bucket = ["i", "value"]
    sized = rows.groupBy(*bucket, "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sized.groupBy(*bucket).agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
    spread = lambda seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.ceil(F.col("n") / BLOCK)).cast("int")
    marked = stored(
        rows.join(main, bucket).select(
            *bucket, "row", "length", "shared", "parts", "comp", (F.col("comp") != F.col("main")).alias("outside"),
            spread(9).alias("block"), spread(8).alias("part"),
        ),
        "marked",
    )
    outside = marked.where("outside").drop("part", "outside")
    # Every block of outside texts of a bucket meets every part of all texts of that bucket.
    parts = marked.select(*bucket, "part").distinct()
    blocks = outside.select(*bucket, "block").distinct()
    left = outside.join(parts, bucket)
    right = marked.drop("block", "outside").join(blocks, bucket)
    bins = max(1, -(-marked.count() // (10 * ROWS)))  # small tiles share a call

    def side(df: DataFrame) -> DataFrame:
        tile = F.xxhash64(*bucket, "block", "part").alias("tile")
        named = df.select(tile, *[F.col(c).alias(c) for c in ("i", "row", "length", "shared", "parts", "comp")])
        return named.withColumn("bin", F.pmod("tile", F.lit(bins)))

    def told(parts: bytes | None) -> np.ndarray:
        return np.frombuffer(parts, "<u2") if parts is not None else np.full(PARTS, 0xFFFF, "<u2")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = [(np.zeros(0, "int64"),) * 4]
        if len(a) and len(b):
            length_b, comp_b, id_b, shared_b = (b[c].to_numpy() for c in ("length", "comp", "row", "shared"))
            parts_b = np.vstack([told(x) for x in b["parts"]])
            partners = b.groupby("tile").indices
            for i, tile, t, n, shared, own, comp in zip(*[a[c] for c in ("i", "tile", "row", "length", "shared", "parts", "comp")]):
                at = partners.get(tile, ())
                if len(at):
                    lengths = length_b[at]
                    least = similar * (lengths + n) / (1 + similar) - 1e-9  # shingles that must be common
                    near = (np.minimum(lengths, n) >= similar * np.maximum(lengths, n)) & (comp_b[at] != comp)
                    near &= np.minimum(shared_b[at], shared) >= least
                    at, least = at[near], least[near]
                    x = id_b[at[np.minimum(parts_b[at], told(own)).sum(1, dtype="int64") >= least]]
                    if len(x):
                        found.append((np.maximum(x, t), np.minimum(x, t), np.full(len(x), i), np.full(len(x), tile)))
        return pd.DataFrame(dict(zip(("a", "b", "i", "tile"), map(np.concatenate, zip(*found)))))

    met = side(left).groupBy("bin").cogroup(side(right).groupBy("bin")).applyInPandas(meet, "a long, b long, i int, tile long")
    # The first bucket of a pair, so that the pairs of a group of texts stay in few tiles.
    return met.groupBy("a", "b").agg(F.min(F.struct("i", "tile"))["tile"].alias("tile"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, class_id`` for every row: the smallest key of its class; a row with a NULL text is its own class."""
    rows = classes(stored_rows(docs, key, text), **options)
    first = rows.where("comp is not null").groupBy("comp").agg(F.min("doc").alias("_first"))
    joined = rows.join(first, "comp", "left")
    return joined.select(F.col("doc").alias(key), F.when(F.col("comp").isNull(), F.col("doc")).otherwise(F.col("_first")).alias("class_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with one row of each class: the one with the smallest key.

    Rows with a NULL text stay.
    """
    rows = stored_rows(docs, key, text, whole=True)
    found = classes(rows, **options)
    order = F.struct(F.col("doc").isNull(), "doc", "row")
    chosen = found.where("comp is not null").groupBy("comp").agg(F.min(order)["row"].alias("row")).select("row")
    kept = chosen.unionAll(found.where("comp is null").select("row"))
    return rows.select("row", "all").join(kept, "row", "left_semi").select("all.*")
