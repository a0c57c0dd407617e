"""Exact window results when one group is too large for one task.

Everything here rests on :func:`running_total`: a range shuffle puts rows in
global order across tasks, each task sums its own piece, and the few totals per
piece give the offsets.  No group is ever gathered in one place, and the table
that is broadcast has at most one row per shuffle partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.plans.durable import durable

# A group above this many rows is not given to a single task.
GROUP_ROW_LIMIT = 4_000_000


@dataclass(frozen=True)
class Layout:
    """What was measured about a panel, and hence how its windows are laid out."""

    split_symbols: bool = False
    split_dates: bool = False
    row_limit: int = GROUP_ROW_LIMIT
    dates: int | None = None
    symbols: int | None = None


def measure_layout(panel: DataFrame, row_limit: int = GROUP_ROW_LIMIT) -> Layout:
    """One partially combined count per key; two rows come back."""

    def biggest(key: str) -> DataFrame:
        counts = panel.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(
            F.lit(key).alias("key"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("groups")
        )

    rows = {r["key"]: r for r in biggest("symbol").unionByName(biggest("date")).collect()}
    return Layout(
        split_symbols=(rows["symbol"]["largest"] or 0) > row_limit,
        split_dates=(rows["date"]["largest"] or 0) > row_limit,
        row_limit=row_limit,
        dates=rows["date"]["groups"],
        symbols=rows["symbol"]["groups"],
    )


def has_large_group(df: DataFrame, keys: Sequence[str], row_limit: int = GROUP_ROW_LIMIT) -> bool:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) > row_limit


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key, as in grouping; the left side's keys stay."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_right_{k}"])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    weight: Column | None = None,
    name: str = "before",
) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` (default 1) over the group's earlier rows.

    ``order`` must be unique inside a group.
    """
    weight = F.lit(1) if weight is None else weight
    keys = [F.col(c) for c in group]
    placed = durable(
        df.withColumn("_w", weight.cast("long"))
        .repartitionByRange(*keys, *order)
        .withColumn("_piece", F.spark_partition_id())
    )
    inside = Window.partitionBy("_piece", *group).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_w").over(earlier), F.lit(0)))

    # Offsets above zero exist only for a group that continues from the previous
    # piece, so there is at most one such row per piece: safe to broadcast.
    pieces = placed.groupBy(*group, "_piece").agg(F.sum("_w").alias("_pw"))
    spanning = pieces
    if group:
        wide = pieces.groupBy(*group).agg(F.count(F.lit(1)).alias("_np")).where("_np > 1")
        spanning = join_groups(pieces, wide.drop("_np"), group, "left_semi")
    across = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spanning.withColumn("_offset", F.sum("_pw").over(across))
        .where(F.col("_offset").isNotNull())
        .drop("_pw")
    )
    joined = join_groups(local, F.broadcast(offsets), [*group, "_piece"], "left")
    return joined.withColumn(
        name, F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))
    ).drop("_w", "_piece", "_local", "_offset")


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
    spread: bool | None = None,
) -> DataFrame:
    """1-based ``row_number`` per group; ``spread=None`` measures the largest group first."""
    if spread is None:
        spread = not group or has_large_group(df, group)
    if spread:
        out = running_total(df, group, order, name="_before")
        return out.withColumn(name, (F.col("_before") + 1).cast("long")).drop("_before")
    ranked = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, ranked.cast("long"))


# ---- symbols: cut long histories into overlapping segments ----


def split_history(
    df: DataFrame, lookback: int, layout: Layout, carry: Sequence[str], lookahead: int = 0
) -> DataFrame:
    """Adds ``_segment`` and ``_halo`` (rows repeated only for what other segments need of them).

    A segment holds ``row_limit`` rows, in front the ``lookback`` rows that precede
    it, and behind the ``lookahead`` rows that follow it.  Symbols below the limit are one segment.  For each column in
    ``carry`` the last non-null value before the segment comes along as
    ``_carry_<column>``.
    """
    size = max(layout.row_limit, lookback, lookahead, 1)
    positioned = running_total(df, ["symbol"], [F.col("date").asc()], name="_at")
    segment = F.floor(F.col("_at") / F.lit(size)).cast("int")
    next_start = (segment + 1) * F.lit(size)
    homes = F.filter(
        F.array(
            segment,
            F.when(F.col("_at") >= next_start - F.lit(lookback), segment + 1),
            F.when((F.col("_at") < segment * F.lit(size) + F.lit(lookahead)) & (segment > 0), segment - 1),
        ),
        lambda s: s.isNotNull(),
    )
    spread = (
        positioned.withColumn("_home", segment)
        .withColumn("_segment", F.explode(homes))
        .withColumn("_halo", F.col("_segment") != F.col("_home"))
    )
    if carry:
        # One row per segment: its last known values, handed on over missing stretches.
        # A segment reaches back ``lookback`` rows, and those rows still need the
        # value before them, so the carry is the one known ahead of the halo.
        visible = F.col("_at") < next_start - F.lit(lookback)
        lasts = positioned.withColumn("_segment", segment).groupBy("symbol", "_segment")
        ends = lasts.agg(
            *[
                F.max_by(F.col(c), F.when(F.col(c).isNotNull() & visible, F.col("_at"))).alias(
                    f"_ahead_{c}"
                )
                for c in carry
            ],
            *[
                F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_end_{c}")
                for c in carry
            ],
        )
        by_segment = Window.partitionBy("symbol").orderBy("_segment")
        older = by_segment.rowsBetween(Window.unboundedPreceding, -2)
        carried = ends.select(
            "symbol",
            "_segment",
            *[
                F.coalesce(
                    F.lag(f"_ahead_{c}", 1).over(by_segment),
                    F.last(f"_end_{c}", ignorenulls=True).over(older),
                ).alias(f"_carry_{c}")
                for c in carry
            ],
        )
        spread = spread.join(carried, ["symbol", "_segment"], "left")
    return spread.drop("_at", "_home")


# ---- dates: ranks and moments without gathering the date ----


def mark_large_dates(df: DataFrame, layout: Layout) -> DataFrame:
    """Adds ``_large``; the joined table has one row per date above the limit."""
    large = (
        df.groupBy("date")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > layout.row_limit)
        .select("date", F.lit(True).alias("_large"))
    )
    return join_groups(df, large, ["date"], "left")


def spread_moments(df: DataFrame, keys: Sequence[str], items) -> DataFrame:
    """``items``: (name, DateMoments, series columns).  Partial aggregation, then a join back."""
    aggregates, spans = [], []
    for i, (_, moments, series) in enumerate(items):
        own = [a.alias(f"_m{i}_{j}") for j, a in enumerate(moments.aggregates(*series))]
        aggregates += own
        spans.append([f"_m{i}_{j}" for j in range(len(own))])
    stats = df.groupBy(*keys).agg(*aggregates)
    joined = join_groups(df, stats, keys)
    outputs = [
        moments.finish(list(series), [F.col(c) for c in names]).alias(name)
        for (name, moments, series), names in zip(items, spans)
    ]
    return joined.select(*[F.col(c) for c in df.columns], *outputs)


def spread_ranks(
    df: DataFrame,
    row_id: str,
    group: Sequence[str],
    columns: dict[str, str],
    as_percent: bool = True,
) -> DataFrame:
    """Average-tie ranks of several columns per group, in a fixed number of shuffles.

    ``columns`` maps output name -> column to rank.  Equal values are counted
    before anything is ordered, so a value shared by most rows is one row in the
    ordered table.  ``row_id`` is a stored number that no other row has.
    """
    ids = list(dict.fromkeys([row_id, *group]))
    long = (
        df.select(*ids, *[F.col(c).cast("double").alias(out) for out, c in columns.items()])
        .unpivot(ids, list(columns), "_column", "_x")
        .where(F.col("_x").isNotNull())
    )
    per = ["_column", *group]
    values = long.groupBy(*per, "_x").agg(F.count(F.lit(1)).alias("_n"))
    ordered = running_total(values, per, [F.col("_x").asc()], weight=F.col("_n"), name="_below")
    rank = F.col("_below") + (F.col("_n") + 1) / 2
    if as_percent:
        totals = values.groupBy(*per).agg(F.sum("_n").alias("_total"))
        ranked = join_groups(ordered, totals, per).select(
            *per, "_x", ((F.col("_below") * 2 + F.col("_n") + 1) / 2 / F.col("_total")).alias("_r")
        )
    else:
        ranked = ordered.select(*per, "_x", rank.alias("_r"))
    back = (
        join_groups(long, ranked, [*per, "_x"])
        .groupBy(row_id)
        .agg(*[F.max(F.when(F.col("_column") == out, F.col("_r"))).alias(out) for out in columns])
    )
    return df.join(back, row_id, "left")
