"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every source gets a target: its weight's share of all sizes, stopped at
``most`` times its own size, with the excess shared again by weight until no
target is above.  Inside a source, documents stand in order of size; each adds
its expected copies (target / size of the source) to a prefix sum that starts at
one random offset per source, and is emitted once per integer boundary that it
crosses.  Documents of similar size are neighbours; every second run of neighbours
that shares one copy stands in falling order, so that a run's excess is made up by
the next one.  The words taken differ from the target by a part of
one document's size, and no document is emitted more often than its expected
copies rounded up.

Defined results: a NULL text has size 0; a NULL source is a source and stands
last; sources of size 0 have target 0; repeated rows are separate documents; an
empty table gives no rows.  Columns of the input that are not read may have any
name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import columns_of, stored
from factorloom.plans.skew import running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
# A table of so many sources is sent to every task; a larger one meets rows that are salted so many ways.
FEW_SOURCES = 50_000
SALTS = 64
# Expected copies are counted in steps of 2**-24, so prefix sums are exact integers.
STEPS = 1 << 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source_key, source_size, rows, target`` from rows of ``source, source_key, size``.

    Weights repeat over the sources by code point, NULL last.
    """
    sums = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    numbered = running_total(sums, [], [F.col("source").asc_nulls_last()], name="place")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(numbered.select("source_key", "source_size", "rows", pick.alias("weight")), "sources")
    level, capped = 0.0, -1
    while True:  # the level rises until no further source is above its stop
        full = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight")
        got = rows.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, F.lit(most) * F.col("source_size"))).alias("stopped"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if got["n"] == capped or not got["open"]:
            break
        capped, level = got["n"], ((got["total"] or 0) - (got["stopped"] or 0)) / got["open"]
    target = F.least(F.lit(level) * F.col("weight"), F.lit(float(most)) * F.col("source_size"))
    return rows.select("source_key", "source_size", "rows", target.cast("double").alias("target"))


def copies(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    identity: Sequence[str] = ("doc_id", "text"),
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST,
    seed: int = 11,
) -> DataFrame:
    """``*keep, row_key, size, source_size, target, copies`` per document.

    ``row_key`` hashes ``identity``; rows with the same key share a place in
    order, so it does not matter which of them is which.
    """
    names = [f"k{i}" for i in range(len(keep))]
    name = F.col(f"`{source}`").cast("string")
    sized = stored(
        docs.select(
            *[c.alias(n) for n, c in zip(names, columns_of(docs, keep))],
            row_key(docs, identity).alias("row_key"),
            name.alias("source"),
            F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("source_key"),
            word_count(F.col(f"`{text}`")).alias("size"),
        ),
        "sizes",
    )
    goal = targets(sized, weights, most)
    placed = running_total(
        sized.drop("source"), ["source_key"], [F.col("size"), F.col("row_key"), *[F.col(n) for n in names]], name="before"
    )
    # The copies of an average document: whole ones, and the rest in steps.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(rate)).withColumn(
        "steps", F.round((rate - F.floor(rate)) * STEPS).cast("long")
    )
    joined = _with_source(placed, goal)
    # Run b holds the places from first(b) up to first(b + 1), together one further copy.
    run = F.shiftright(F.col("before") * F.col("steps"), 24)
    first = F.expr(f"(run * {STEPS} + steps - 1) div steps")
    behind = F.least(F.expr(f"((run + 1) * {STEPS} + steps - 1) div steps"), F.col("rows"))
    turned = F.when((F.col("steps") > 0) & (F.col("run") % 2 == 1), first + behind - 1 - F.col("before"))
    at = F.coalesce(turned, F.col("before"))
    joined = joined.withColumn("run", run).withColumn("at", at)
    offset = F.pmod(F.xxhash64("source_key", F.lit(seed)), F.lit(STEPS))

    def crossed(rows: Column) -> Column:
        return F.shiftright(offset + rows * F.col("steps"), 24)

    drawn = F.col("whole") + crossed(F.col("at") + 1) - crossed(F.col("at"))
    return joined.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)],
        "row_key", "size", "source_size", "target", drawn.cast("long").alias("copies"),
    )


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source, wherever they lie: a source may hold most rows."""
    sources = stored(sources, "goals")
    if sources.count() <= FEW_SOURCES:
        return rows.join(F.broadcast(sources), "source_key")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)))
    copied = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return salted.join(copied, ["source_key", "_salt"]).drop("_salt")


def row_key(docs: DataFrame, identity: Sequence[str]) -> Column:
    """128 bits of the named columns."""
    cols = columns_of(docs, identity)
    flags = [c.isNull() for c in cols]
    one, two = F.xxhash64(*cols, *flags), F.xxhash64(F.lit(1), *reversed(cols), *flags)
    return F.concat_ws("-", F.hex(one), F.hex(two))


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
        most: float = MOST, seed: int = 11) -> DataFrame:
    """The documents of the mix, all columns, one row per copy."""
    drawn = copies(docs, (), text, source, docs.columns, weights, most, seed)
    times = drawn.groupBy("row_key").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    # Rows equal in every column are one row with all their copies.
    one = docs.select(F.struct(*columns_of(docs, docs.columns)).alias("_row"), row_key(docs, docs.columns).alias("_key"))
    one = one.dropDuplicates(["_key"]).join(times.withColumnRenamed("row_key", "_key"), "_key")
    return one.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
