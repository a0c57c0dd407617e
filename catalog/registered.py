"""Every registered query with, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import duck
from catalog.tables import mined, mined_ctes, seeds_sql, table
from factorloom.functions import crosssection as cs
from factorloom.functions import timeseries as ts
from factorloom.operators import chains, factors, library, mining, named, panel, registry, selection, transforms
from factorloom.plans.durable import scratch_path
from factorloom.plans.skew import measure_layout
from factorloom.sources import bars, factor_sets, panel_io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

weekly = bars.weekly_brand_bars
daily = bars.daily_supplier_bars


def query(name: str, sql: str | None = None):
    def keep(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


# Values with exact ties at the sixth digit, and values beyond the digits of a double.
MORE_DIGITS = {"alpha017": 8}
LOG_SCALE = frozenset({"alpha084"})


def shown(
    df: DataFrame,
    *names: str,
    more_digits: dict[str, int] = MORE_DIGITS,
    log_scale: frozenset[str] = LOG_SCALE,
) -> DataFrame:
    """Keys and rounded values, so that the last bits of a double do not matter."""
    names = names or tuple(c for c in df.columns if c not in ("date", "symbol"))

    def settled(name: str):
        x = F.col(f"`{name}`")
        if name in log_scale:
            x = F.signum(x) * F.ln(F.lit(1.0) + F.abs(x))
        return (F.round(x, more_digits.get(name, 6)) + 0.0).alias(name)

    return df.select("date", "symbol", *[settled(c) for c in names])


def composed(name: str, formulas: dict[str, str] | str, fill: bool = True, build_bars=weekly) -> None:
    """A query evaluating composed formulas over bars."""
    if isinstance(formulas, str):
        formulas = {"value": formulas}
    source = duck.WEEKLY_BARS if build_bars is weekly else duck.DAILY_BARS

    @query(name, duck.formulas_sql(formulas, fill=fill, bars=source))
    def run(spark, folder):
        texts = list(formulas.values())
        matrix = factors.compute_composed(
            build_bars(spark, folder), texts, fill=0.0 if fill else None
        )
        return shown(matrix.toDF("date", "symbol", *formulas))


def dense(name: str, formulas: dict[str, str] | str) -> None:
    if isinstance(formulas, str):
        formulas = {"value": formulas}

    labels = dict(more_digits=MORE_DIGITS, log_scale=LOG_SCALE)

    @query(name, duck.formulas_sql(formulas, named=True, **labels))
    def run(spark, folder):
        return shown(factors.compute_dense(weekly(spark, folder), formulas))


# ---- sources and sinks ----

BARS_SQL = f"select date, symbol, open, high, low, close, volume, amount from ({duck.WEEKLY_BARS})"
DAILY_SQL = f"select date, symbol, open, high, low, close, volume, amount from ({duck.DAILY_BARS})"


@query("S1_load_panel_parquet", BARS_SQL)
def _(spark, folder):
    path = scratch_path(spark, "panel") + ".parquet"
    stored = weekly(spark, folder).withColumnsRenamed({"date": "Trade_Date", "symbol": "TICKER"})
    stored.write.parquet(path)
    return panel_io.load_panel(spark, path, check_keys=True)


@query("S1_load_panel_csv", BARS_SQL)
def _(spark, folder):
    path = scratch_path(spark, "panel") + ".csv"
    weekly(spark, folder).write.option("header", True).csv(path)
    loaded = panel_io.load_panel(spark, path)
    return loaded.withColumn("date", F.col("date").cast("date"))


@query("S2_discover_keys", DAILY_SQL)
def _(spark, folder):
    stored = daily(spark, folder).withColumnsRenamed({"date": "CALC_DATE", "symbol": "SecID"})
    renamed = stored.select("open", "SecID", "high", "CALC_DATE", "low", "close", "volume", "amount")
    return panel_io.normalize_panel(renamed)


@query("S3_normalize_panel", DAILY_SQL)
def _(spark, folder):
    text = daily(spark, folder).withColumn("time", F.date_format("date", "yyyy-MM-dd")).drop("date")
    normal = panel_io.normalize_panel(text)
    return normal.withColumn("date", F.col("date").cast("date")).repartition("symbol").sortWithinPartitions("date")


@query("S4_read_factor_set", f"with {mined_ctes()} select event_id as pos, name, expression from mined")
def _(spark, folder):
    path = scratch_path(spark, "factors")
    factor_sets.write_factor_set(
        mined(spark, folder).withColumn("pos", F.col("event_id")), path, format="parquet"
    )
    empty = factor_sets.read_factor_set(spark, path + "-absent")
    return factor_sets.read_factor_set(spark, path, format="parquet").unionByName(empty)


@query("S5_write_factor_set", f"with {mined_ctes()} select event_id as pos, name, expression from mined")
def _(spark, folder):
    path = scratch_path(spark, "factors")
    factor_sets.write_factor_set(mined(spark, folder).withColumn("pos", F.col("event_id")), path)
    return factor_sets.read_factor_set(spark, path)


COMPOSED_SET = {
    "G1": "RANK(TS_MEAN(RET, 5)) - RANK(TS_MEAN(RET, 20))",
    "G2": "DELTA(RANK(VOLUME), 3) * SIGN(CLOSE - OPEN)",
    "G3": "SIGN(DELTA(RANK(CLOSE), 5)) * RANK(TS_STDDEV(RET, 10))",
    "G4": "DELTA(RANK(CORREL(CLOSE, VOLUME, 10)), 3)",
    "G5": "RANK(VWAP - CLOSE) * TS_MEAN(RET * VOLUME, 5)",
    "G6": "RANK(TS_STDDEV(RET, 10)) * SIGN(DELTA(RANK(CLOSE), 5))",
    "G7": "RANK(TS_MEAN(RET * VOLUME, 5)) - RANK(VWAP - CLOSE)",
    "G8": "DELTA(RANK(VOLUME), 3) * SIGN(RANK(CLOSE - OPEN))",
    "G9": "SIGN(DELTA(RANK(VOLUME), 3)) * RANK(CLOSE - OPEN)",
    "G10": "RANK(TS_MEAN(RET * VOLUME, 5)) - RANK(TS_MEAN(RET, 20))",
    "G11": "DELTA(RANK(VOLUME), 3) * SIGN(DELTA(RANK(CLOSE - OPEN), 5))",
}


def composed_matrix(spark, folder) -> DataFrame:
    matrix = factors.compute_composed(weekly(spark, folder), list(COMPOSED_SET.values()))
    return matrix.toDF("date", "symbol", *COMPOSED_SET)


LONG_SQL = duck.formulas_sql(
    COMPOSED_SET,
    fill=True,
    final="select date, symbol, factor, round(value, 6) + 0.0 as value from "
    "(unpivot matrix on columns(* exclude (date, symbol)) into name factor value value)",
)


@query("S6_write_factor_values", LONG_SQL)
def _(spark, folder):
    path = scratch_path(spark, "values")
    factor_sets.write_factor_values(composed_matrix(spark, folder), path)
    stored = factor_sets.read_factor_values(spark, path, list(COMPOSED_SET))
    return stored.select("date", "symbol", "factor", (F.round("value", 6) + 0.0).alias("value"))


@query("S7_write_candidates", f"with {mined_ctes()} select run_id, pos, expression from mined")
def _(spark, folder):
    path = scratch_path(spark, "candidates")
    factor_sets.write_candidates(mined(spark, folder).select("run_id", "pos", "expression"), path)
    return spark.read.schema("run_id LONG, pos LONG, expression STRING").json(path)


# ---- projection and derived fields ----


@query(
    "P1_numeric_fields",
    'select date, symbol, open as "OPEN", high as "HIGH", low as "LOW", close as "CLOSE", '
    f'volume as "VOLUME", amount as "AMOUNT" from ({duck.DAILY_BARS})',
)
def _(spark, folder):
    return panel.numeric_fields(daily(spark, folder).withColumn("note", F.lit("text")))


@query(
    "P2_available_inputs",
    f"select n as name, bars from (select count(*) as bars from ({duck.DAILY_BARS})), "
    "unnest(['AMOUNT','CLOSE','HIGH','LOW','OPEN','RET','VOLUME','VWAP']) u(n)",
)
def _(spark, folder):
    rows = daily(spark, folder)
    names = F.array(*[F.lit(n) for n in panel.available_inputs(rows)])
    return rows.agg(F.count(F.lit(1)).alias("bars")).select(F.explode(names).alias("name"), "bars")


composed("P3_ret_filled", "RET")


@query(
    "P4_vwap_cross_section",
    f"select date, symbol, coalesce(close * volume / nullif(sum(volume) over (partition by date), 0), close) "
    f"as vwap from ({duck.DAILY_BARS})",
)
def _(spark, folder):
    return panel.compute_weighted_price(daily(spark, folder))


dense("P5_vwap_traded", "vwap")
dense("P6_ret_raw", "ret")


@query("P7_restrict_fields", f"select date, symbol, open, close, volume from ({duck.DAILY_BARS})")
def _(spark, folder):
    return panel.restrict_fields(daily(spark, folder), ["HIGH", "low", "Amount"])


composed("P8_fill_policy", {"filled": "TS_STDDEV(CLOSE, 5)", "kept": "DELTA(CLOSE, 4)"})
composed(
    "P9_arithmetic",
    {
        "sum_diff": "CLOSE + OPEN - HIGH",
        "product": "CLOSE * VOLUME",
        "ratio": "(CLOSE - OPEN) / (HIGH - LOW)",
        "by_zero": "VOLUME / (CLOSE - CLOSE)",
        "zero_by_zero": "(OPEN - OPEN) / (CLOSE - CLOSE)",
        "power": "(HIGH - LOW) ** 0.5",
        "neg_power": "(LOW - HIGH) ** 0.5",
        "unary": "-CLOSE + +OPEN",
        "scalar": "2 * CLOSE / 3 - 1",
    },
    fill=False,
)
composed("P10_constant", {"three": "3", "folded": "2 * 3 - 1"})

# ---- joins and reshaping ----


@query(
    "J1_densify",
    f"with bars as ({duck.WEEKLY_BARS}), d as ({duck.DENSE}) "
    "select date, symbol, open, high, low, close, volume, amount from d",
)
def _(spark, folder):
    return panel.densify(weekly(spark, folder))


@query(
    "J1_densify_daily",
    f"with bars as ({duck.DAILY_BARS}), d as ({duck.DENSE}) "
    "select date, symbol, open, high, low, close, volume, amount from d",
)
def _(spark, folder):
    return panel.densify(daily(spark, folder))


FIELD_NAMES = ["open", "high", "low", "close", "volume", "amount"]


@query(
    "J2_to_long",
    f"with bars as ({duck.WEEKLY_BARS}), d as ({duck.DENSE}), m as (select * exclude (vwap) from d) "
    "select date, symbol, factor, value from m unpivot include nulls "
    "(value for factor in (open, high, low, close, volume, amount))",
)
def _(spark, folder):
    return panel.to_long(panel.densify(weekly(spark, folder)))


@query(
    "J2_to_wide",
    f"with bars as ({duck.WEEKLY_BARS}), d as ({duck.DENSE}) "
    "select date, symbol, open, high, low, close, volume, amount from d",
)
def _(spark, folder):
    return panel.to_wide(panel.to_long(panel.densify(weekly(spark, folder))), FIELD_NAMES)


@query(
    "J3_combine_frames",
    duck.formulas_sql({"rank": "RANK(CLOSE)"}, fill=True, final=(
        "select coalesce(m.date, n.date) as date, coalesce(m.symbol, n.symbol) as symbol, "
        'round(m.rank, 6) as rank, n.alpha101 from matrix m full outer join '
        f"({duck.formulas_sql({'alpha101': named.FORMULAS['alpha101']}, named=True)}) n "
        "on m.date = n.date and m.symbol = n.symbol"
    )),
)
def _(spark, folder):
    mixed = factors.compute_factors(weekly(spark, folder), ["RANK(CLOSE)", "ALPHA101"])
    return shown(mixed.withColumnRenamed("RANK(CLOSE)", "rank"), "rank", "alpha101")


composed("J4_aligned_pair", "CORREL(HIGH - LOW, VOLUME, 8)")

SCORES_SQL = (
    "scores as (select run_id, 'f' || event_id as name, value as score from mined where event_id % 3 = 0), "
    "scored as (select m.run_id, m.pos, m.expression, coalesce(s.score, a.mean, "
    "1.0 - m.pos / count(*) over (partition by m.run_id)) as score from mined m "
    "left join scores s on s.run_id = m.run_id and s.name = m.name "
    "left join (select run_id, avg(score) as mean from scores group by run_id) a on a.run_id = m.run_id)"
)


def scores_of(rows: DataFrame) -> DataFrame:
    return rows.where("event_id % 3 = 0").select(
        "run_id", F.concat(F.lit("f"), "event_id").alias("name"), F.col("value").alias("score")
    )


@query(
    "J5_score_lookup",
    f"with {mined_ctes()}, {SCORES_SQL} select run_id, pos, round(score, 6) as score from scored",
)
def _(spark, folder):
    rows = mined(spark, folder)
    scored = chains.score_factors(rows.select("run_id", "pos", "name", "expression"), scores_of(rows))
    return scored.select("run_id", "pos", F.round("score", 6).alias("score"))


# ---- windows, elementwise ----

composed("T1_delta", "DELTA(CLOSE, 3)", fill=False)
composed("T1_delta_sparse", "DELTA(CLOSE, 7)", fill=False, build_bars=daily)
composed("T2_ts_mean", "TS_MEAN(CLOSE, 7)", fill=False)
composed("T2_ts_mean_sparse", "TS_MEAN(HIGH - LOW, 5)", fill=False, build_bars=daily)
composed("T3_ts_stddev", "TS_STDDEV(VOLUME, 6)", fill=False)
composed("T4_correl", "CORREL(CLOSE, VOLUME, 6)", fill=False)
composed("T4_correl_sparse", "CORREL(CLOSE, VOLUME, 9)", fill=False, build_bars=daily)

_LAG_SQL = f"with bars as ({duck.WEEKLY_BARS}) select date, symbol, {{}} as close from bars"


@query("T5_lag_shift", _LAG_SQL.format(duck.lag_sql("close", 2)))
def _(spark, folder):
    return transforms.lag_shift(weekly(spark, folder), "close", 2)


@query("T5_lead_shift", _LAG_SQL.format(duck.lag_sql("close", 1).replace("lag", "lead")))
def _(spark, folder):
    return transforms.lag_shift(weekly(spark, folder), "close", -1, allow_lead=True)


composed("X1_rank", "RANK(VOLUME)", fill=False)
composed("X1_rank_daily", "RANK(CLOSE)", fill=False, build_bars=daily)
composed("X1_rank_small_values", "RANK(TS_MEAN(ABS(RET) / VOLUME / 1000000, 5))", fill=False)


@query("X2_rank_transform", duck.formulas_sql({"volume": "RANK(VOLUME)"}, bars=duck.DAILY_BARS))
def _(spark, folder):
    return shown(transforms.rank_transform(daily(spark, folder), "volume"))


composed("X3_z_score", "Z_SCORE(CLOSE)", fill=False)


@query("X4_normalize_factor", duck.formulas_sql({"volume": "Z_SCORE(VOLUME)"}, bars=duck.DAILY_BARS))
def _(spark, folder):
    return shown(transforms.normalize_factor_series(daily(spark, folder), "volume"))


@query("X5_zscore_normalize", duck.formulas_sql({"amount": "Z_SCORE(AMOUNT)"}))
def _(spark, folder):
    return shown(transforms.zscore_normalize(weekly(spark, folder), "amount"))


composed("E1_sign", "SIGN(CLOSE - OPEN)", fill=False)
composed("E2_abs", "ABS(CLOSE - OPEN)", fill=False)

# ---- batches ----

SEEDS = {f"s{i:03d}": e for i, e in enumerate(library.seed_list())}
UNIQUE_SEEDS = {k: e for k, e in SEEDS.items() if list(SEEDS.values()).index(e) == int(k[1:])}


@query("B1_seed_batch", duck.formulas_sql(UNIQUE_SEEDS, fill=True))
def _(spark, folder):
    matrix = factors.compute_factors(weekly(spark, folder), list(SEEDS.values()))
    return shown(matrix.toDF("date", "symbol", *UNIQUE_SEEDS))


@query(
    "B1_named_batch",
    duck.formulas_sql(named.FORMULAS, named=True, more_digits=MORE_DIGITS, log_scale=LOG_SCALE),
)
def _(spark, folder):
    return shown(factors.compute_named(weekly(spark, folder), list(named.FORMULAS)))


@query("B2_evaluate", duck.formulas_sql({"value": "TS_MEAN(RANK(CLOSE) * RET, 4)"}))
def _(spark, folder):
    return shown(factors.evaluate(weekly(spark, folder), "TS_MEAN(RANK(CLOSE) * RET, 4)"))


@query(
    "B3_named_and_composed",
    f"with n as ({duck.formulas_sql({'alpha012': named.FORMULAS['alpha012']}, named=True)}), "
    f"c as ({duck.formulas_sql({'delta': 'DELTA(CLOSE, 1)'}, fill=True)}) "
    "select n.date, n.symbol, n.alpha012, c.delta from n left join c "
    "on n.date = c.date and n.symbol = c.symbol",
)
def _(spark, folder):
    mixed = factors.compute_factors(weekly(spark, folder), [" Alpha012 ", "DELTA(CLOSE, 1)"])
    return shown(mixed.withColumnRenamed("DELTA(CLOSE, 1)", "delta"), "alpha012", "delta")


@query(
    "B4_registered_operator",
    f"with bars as ({duck.WEEKLY_BARS}) select date, symbol, round(case when open > 0 and close > 0 "
    f"then ln(close / open) end, 6) + 0.0 as log_ratio, round(max(high) over {duck.frame(5)} - "
    f"min(low) over {duck.frame(5)}, 6) as span, "
    "round(volume / sum(volume) over (partition by date), 6) as share from bars",
)
def _(spark, folder):
    registry.register_operator(
        "LOG_RATIO", lambda x, y: F.when((x > 0) & (y > 0), F.ln(x / y)), series=2
    )
    registry.register_operator(
        "SPAN",
        lambda high, low, n, over: F.max(high).over(over.last(n)) - F.min(low).over(over.last(n)),
        by="symbol", series=2, integers=1, lookback=lambda n: n - 1,
    )
    registry.register_operator(
        "SHARE",
        cs.DateMoments(lambda x: [F.sum(x)], lambda s, v: F.try_divide(s[0], v[0])),
        by="date",
    )
    texts = ["LOG_RATIO(CLOSE, OPEN)", "SPAN(HIGH, LOW, 5)", "SHARE(VOLUME)"]
    try:
        matrix = factors.compute_composed(weekly(spark, folder), texts, fill=None)
    finally:
        for name in ("LOG_RATIO", "SPAN", "SHARE"):
            registry.OPERATORS.pop(name)
    return shown(matrix.toDF("date", "symbol", "log_ratio", "span", "share"))


# ---- expression tables ----


@query(
    "L1_seed_usage",
    f"with {mined_ctes()}, u as (select expression, count(*) as uses from mined group by expression) "
    "select seed as pos, s.expression, coalesce(uses, 0) as uses from seeds s "
    "left join u on u.expression = s.expression",
)
def _(spark, folder):
    uses = mined(spark, folder).groupBy("expression").agg(F.count(F.lit(1)).alias("uses"))
    joined = library.seed_expressions(spark).join(uses, "expression", "left")
    return joined.select("pos", "expression", F.coalesce("uses", F.lit(0)).alias("uses"))


_NAMES_SQL = ", ".join(f"('{n}')" for n in sorted(named.FORMULAS))


@query(
    "L2_named_usage",
    f"with n(name) as (values {_NAMES_SQL}), u as (select 'alpha' || lpad(cast(event_id % 103 as varchar), 3, '0') "
    "as name, count(*) as uses from events group by 1) "
    "select row_number() over (order by n.name) - 1 as pos, n.name, coalesce(uses, 0) as uses "
    "from n left join u on u.name = n.name",
)
def _(spark, folder):
    token = F.format_string("alpha%03d", F.col("event_id") % 103)
    uses = table(spark, folder, "events").groupBy(token.alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    joined = library.named_factors(spark).join(uses, "name", "left")
    return joined.select("pos", "name", F.coalesce("uses", F.lit(0)).alias("uses"))


# One table of candidates with typical faults, by kind of event.
def candidates(spark, folder) -> DataFrame:
    text = F.col("expression")
    kind = F.col("event_type")
    return mined(spark, folder).select(
        "event_id",
        F.when(kind == "error", F.concat(text, F.lit(" +")))
        .when(kind == "view", F.regexp_replace(text, "CLOSE", "PRICE"))
        .when(kind == "signup", F.format_string("alpha%03d", F.col("event_id") % 200))
        .when(kind == "click", F.concat(F.lit("Z_SCORE("), text, F.lit(") / 2")))
        .otherwise(text)
        .alias("expression"),
    )


CANDIDATES_SQL = (
    "candidates as (select event_id, case event_type when 'error' then expression || ' +' "
    "when 'view' then replace(expression, 'CLOSE', 'PRICE') "
    "when 'signup' then 'alpha' || lpad(cast(event_id % 200 as varchar), 3, '0') "
    "when 'click' then 'Z_SCORE(' || expression || ') / 2' else expression end as expression from mined)"
)
_IDENT = r"'\b([A-Za-z_][A-Za-z0-9_]*)\b'"
_CALL = r"'\b([A-Za-z_][A-Za-z0-9_]*)\s*\('"
_KNOWN = "['RANK','DELTA','TS_MEAN','TS_STDDEV','CORREL','Z_SCORE','SIGN','ABS']"
_BASE = "['OPEN','HIGH','LOW','CLOSE','VOLUME','RET','VWAP','AMOUNT']"


@query(
    "L3_expression_profile",
    f"with {mined_ctes()}, {CANDIDATES_SQL} select event_id, "
    f"list_sort(list_distinct(regexp_extract_all(expression, {_CALL}, 1))) as functions, "
    f"list_sort(list_filter(list_distinct(regexp_extract_all(expression, {_IDENT}, 1)), "
    f"lambda v: not list_contains({_KNOWN}, v))) as variables from candidates",
)
def _(spark, folder):
    return library.expression_profile(candidates(spark, folder)).drop("expression")


@query(
    "L4_validate_candidates",
    f"with {mined_ctes()}, {CANDIDATES_SQL} select event_id, expression from candidates where "
    "regexp_full_match(expression, 'alpha[0-9]{3}') or (expression not like '% +' and "
    f"len(list_filter(regexp_extract_all(expression, {_IDENT}, 1), "
    f"lambda v: not list_contains(list_concat({_KNOWN}, {_BASE}), v))) = 0 and "
    f"len(list_filter(regexp_extract_all(expression, {_CALL}, 1), "
    "lambda v: not list_contains(['RANK','DELTA','TS_MEAN','Z_SCORE'], v))) = 0)",
)
def _(spark, folder):
    allowed = ["rank", "DELTA", "TS_MEAN", "Z_SCORE"]
    return library.validate_candidates(candidates(spark, folder), ["amount"], allowed)


@query("L4_validate_replies")
def _(spark, folder):
    lines = library.parse_responses(table(spark, folder, "conversations"))
    return library.mark_valid(lines).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "L5_extract_ops",
    f"with {mined_ctes()} select distinct run_id, op from (select run_id, unnest(regexp_extract_all(expression, "
    r"'\b(RANK|DELTA|TS_MEAN|TS_STDDEV|CORREL|Z_SCORE|SIGN|ABS)\b', 1)) as op from mined)",
)
def _(spark, folder):
    return library.extract_ops(mined(spark, folder))


_BREAK = library._LINE_BREAK
_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def replies_sql(source: str, keys: str) -> str:
    trim = f"'^{_BLANKS}|{_BLANKS}$', '', 'g'"
    return (
        f"with lines as (select {keys}, unnest(regexp_split_to_array(text, '{_BREAK}')) as raw, "
        f"unnest(range(len(regexp_split_to_array(text, '{_BREAK}')))) as line from {source}), "
        f"cut as (select {keys}, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, {trim}), "
        f"'^[^:]*:', ''), {trim}), '^`+|`+$', '', 'g') as expression from lines) "
        f"select {keys}, line, expression from cut where expression <> ''"
    )


@query("L6_parse_conversations", replies_sql("conversations", "conv_id, turn, role"))
def _(spark, folder):
    return library.parse_responses(table(spark, folder, "conversations"))


@query("L6_parse_documents", replies_sql("documents", "doc_id"))
def _(spark, folder):
    return library.parse_responses(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "L6_parse_replies",
    replies_sql(
        f"(with {mined_ctes()} select run_id, string_agg('FA' || pos || ': `' || expression || '`', "
        "chr(10) order by pos) as text from mined group by run_id)",
        "run_id",
    ),
)
def _(spark, folder):
    line = F.concat(F.lit("FA"), "pos", F.lit(": `"), "expression", F.lit("`"))
    entry = F.struct("pos", line.alias("t"))
    replies = mined(spark, folder).groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_list(entry)).t, "\n").alias("text")
    )
    return library.parse_responses(replies)


_CARDS_SQL = ", ".join(
    f"('{op}', '### {op}' || chr(10) || '{card}')" for op, card in library.OPERATOR_CARDS.items()
)
_PROMPT_FIELDS = ["CLOSE", "RET", "VOLUME", "VWAP"]
_PROMPT_WHITELIST = ["RANK", "DELTA", "TS_MEAN", "SIGN"]
_prompt_parts = library.PROMPT_FORMAT.split("%s")


@query(
    "L7_prompt_context",
    f"with {mined_ctes()}, cards(op, card) as (values {_CARDS_SQL}), "
    "shown as (select * from mined where pos < 24), "
    "path as (select *, row_number() over (partition by run_id order by value desc, pos) as r from mined "
    "qualify r <= 5), "
    "every as (select run_id, expression from shown union all select run_id, expression from path), "
    "used as (select distinct run_id, unnest(regexp_extract_all(expression, "
    r"'\b(RANK|DELTA|TS_MEAN|TS_STDDEV|CORREL|Z_SCORE|SIGN|ABS)\b', 1)) as op from every), "
    "allowed as (select run_id, op, card from used join cards using (op) "
    "where op in ('RANK', 'DELTA', 'TS_MEAN', 'SIGN')), "
    "a as (select run_id, list(op order by op) as ops, string_agg(card, chr(10) || chr(10) order by op) as cards "
    "from allowed group by run_id), "
    "s as (select run_id, string_agg('- ' || expression, chr(10) order by pos) as block from shown group by run_id), "
    "p as (select run_id, string_agg('- ' || expression, chr(10) order by r) as block from path group by run_id), "
    "c as (select s.run_id, coalesce(ops, []) as ops, coalesce(cards, '') as cards, s.block as sb, p.block as pb "
    "from s join p using (run_id) left join a using (run_id)) "
    "select run_id, ops, cards, substring(md5(cards), 1, 8) as checksum, "
    f"'{_prompt_parts[0]}' || substring(md5(cards), 1, 8) || '{_prompt_parts[1]}' || "
    f"case when cards <> '' then cards else '{library.NO_OPERATORS}' end || '{_prompt_parts[2]}' || sb || "
    f"'{_prompt_parts[3]}' || pb || '{_prompt_parts[4]}' || '5' || '{_prompt_parts[5]}' || "
    f"'CLOSE, RET, VOLUME, VWAP' || '{_prompt_parts[6]}' as prompt from c",
)
def _(spark, folder):
    rows = mined(spark, folder)
    shown_rows = library.first_entries(rows, 24).select("run_id", "pos", "expression")
    best = F.row_number().over(
        library.Window.partitionBy("run_id").orderBy(F.col("value").desc(), "pos")
    )
    path = rows.withColumn("r", best).where("r <= 5").select("run_id", F.col("r").alias("pos"), "expression")
    return library.prompt_context(
        shown_rows, path.withColumn("pos", F.col("pos").cast("long")), _PROMPT_FIELDS, _PROMPT_WHITELIST
    )


@query(
    "L8_append_candidates",
    f"with {mined_ctes()}, n(name) as (values {_NAMES_SQL}) "
    "select row_number() over (order by name) - 1 as pos, name, name as expression from n union all "
    "select 81 + row_number() over (order by event_id), 'alpha_' || (82 + row_number() over (order by event_id)), "
    "expression from mined",
)
def _(spark, folder):
    fresh = mined(spark, folder).select(F.col("event_id").alias("pos"), "expression")
    return library.append_candidates(library.named_factors(spark), fresh)


@query(
    "L8_append_distinct",
    f"with {mined_ctes()}, n(name) as (values {_NAMES_SQL}), "
    "d as (select expression, min(event_id) as e from mined group by expression) "
    "select row_number() over (order by name) - 1 as pos, name, name as expression from n union all "
    "select 81 + row_number() over (order by e), 'alpha_' || (82 + row_number() over (order by e)), expression from d",
)
def _(spark, folder):
    fresh = mined(spark, folder).select(F.col("event_id").alias("pos"), "expression")
    return library.append_candidates(library.named_factors(spark), fresh, dedupe=True)


# ---- selection ----

_GRAM_TAIL = (
    "n as (select count(*) as n from {rows}), "
    "l as (select * from (unpivot {rows} on columns(* exclude ({keys})) into name f value x)), "
    "r as (select a.f as f1, b.f as f2, corr(a.x, b.x) as c from l a join l b using ({keys}) group by 1, 2) "
)


@query(
    "K1_standardize_matrix",
    duck.formulas_sql(COMPOSED_SET, fill=True, final=(
        "select date, symbol, " + ", ".join(
            f'round(coalesce((g - avg(g) over ()) / nullif(stddev_pop(g) over (), 0), 0), 6) + 0.0 as "{k}"'
            .replace("g - ", f'"{k}" - ').replace("(g)", f'("{k}")')
            for k in COMPOSED_SET
        ) + " from matrix"
    )),
)
def _(spark, folder):
    return shown(selection.standardize_matrix(composed_matrix(spark, folder)))


@query(
    "K2_factor_gram",
    duck.formulas_sql(COMPOSED_SET, fill=True, final=(
        ", " + _GRAM_TAIL.format(rows="matrix", keys="date, symbol")
        + "select f1, f2, round(n * c, 4) + 0.0 as gram, "
        "round(greatest(2 * n * (1 - c), 0), 4) + 0.0 as distance2 from r, n"
    )),
)
def _(spark, folder):
    gram = selection.factor_gram(composed_matrix(spark, folder))
    return gram.select(
        "f1", "f2", (F.round("gram", 4) + 0.0).alias("gram"), (F.round("distance2", 4) + 0.0).alias("distance2")
    )


DIMENSIONS = 64


def embedding_matrix(spark, folder) -> DataFrame:
    """64 columns standing for factors, one row per vector."""
    cells = [F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(DIMENSIONS)]
    return table(spark, folder, "embeddings").select("vec_id", *cells)


_EMBEDDINGS = (
    "with m as (select vec_id, "
    + ", ".join(f"embedding[{i + 1}]::double as d{i}" for i in range(DIMENSIONS))
    + " from embeddings), "
)


@query(
    "K2_gram_embeddings",
    _EMBEDDINGS + _GRAM_TAIL.format(rows="m", keys="vec_id")
    + "select f1, f2, round(n * c, 4) + 0.0 as gram from r, n",
)
def _(spark, folder):
    gram = selection.factor_gram(embedding_matrix(spark, folder), keys=("vec_id",))
    return gram.select("f1", "f2", (F.round("gram", 4) + 0.0).alias("gram"))


@query("K3_cluster_factors")
def _(spark, folder):
    return selection.cluster_factors(composed_matrix(spark, folder), 4)


@query("K3_cluster_embeddings")
def _(spark, folder):
    return selection.cluster_factors(embedding_matrix(spark, folder), 12, keys=("vec_id",))


def planted(matrix: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first four columns and two linear copies of each: four groups of distance 0."""
    names = [c for c in matrix.columns if c not in keys][:4]
    copies = [(F.col(n) * 3 + 2).alias(f"{n}_b") for n in names] + [(F.col(n) / 4 - 1).alias(f"{n}_c") for n in names]
    return matrix.select(*keys, *names, *copies)


def planted_sql(names: list[str]) -> str:
    every = [f"{n}{end}" for end in ("", "_b", "_c") for n in names]
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(every))
    return (
        f"select cast(i as integer) as factor_id, n as factor, cast(i % 4 as integer) as cluster, 0.0::double as dist "
        f"from (values {values}) t(i, n)"
    )


@query("K3_planted_factors", planted_sql(list(COMPOSED_SET)[:4]))
def _(spark, folder):
    found = selection.cluster_factors(planted(composed_matrix(spark, folder), ("date", "symbol")), 4)
    return found.withColumn("dist", F.round("dist", 4) + 0.0)


@query("K3_planted_embeddings", planted_sql(["d0", "d1", "d2", "d3"]))
def _(spark, folder):
    matrix = planted(embedding_matrix(spark, folder), ("vec_id",))
    return selection.cluster_factors(matrix, 4, keys=("vec_id",)).withColumn("dist", F.round("dist", 4) + 0.0)


@query(
    "K3_single_cluster",
    _EMBEDDINGS + _GRAM_TAIL.format(rows="m", keys="vec_id")
    + "select cast(substring(f2, 2) as integer) as factor_id, f2 as factor, 0 as cluster, "
    "round(sqrt(greatest(2 * n * (1 - c), 0)), 4) + 0.0 as dist from r, n where f1 = 'd0'",
)
def _(spark, folder):
    found = selection.cluster_factors(embedding_matrix(spark, folder), 1, keys=("vec_id",))
    return found.withColumn("dist", F.round("dist", 4) + 0.0)


@query(
    "K4_select_exemplars",
    "with c as (select vec_id as factor_id, label as cluster, round(embedding[1]::double * embedding[1]::double, 6) "
    "as dist from embeddings), t as (select *, row_number() over (partition by cluster order by dist, factor_id) "
    "as turn from c) select row_number() over (order by turn, cluster) as place, factor_id, cluster, turn from t "
    "qualify place <= 50",
)
def _(spark, folder):
    first = F.col("embedding")[0].cast("double")
    groups = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("factor_id"), F.col("label").alias("cluster"), F.round(first * first, 6).alias("dist")
    )
    return selection.select_exemplars(groups, 50).select("place", "factor_id", "cluster", "turn")


_SPEARMAN_TAIL = (
    "l as (select * from (unpivot {rows} on columns(* exclude ({keys})) into name f value x)), "
    "k as (select {keys}, f, rank() over (partition by f order by x) "
    "+ (count(*) over (partition by f, x) - 1) / 2 as x from l), "
    "r as (select a.f as f1, b.f as f2, corr(a.x, b.x) as c from k a join k b using ({keys}) group by 1, 2) "
    "select f1, f2, round(c, 6) + 0.0 as rho from r"
)


@query(
    "K5_factor_similarity",
    duck.formulas_sql(COMPOSED_SET, fill=True, final=", " + _SPEARMAN_TAIL.format(
        rows="settled", keys="date, symbol").replace("l as (", "settled as (select date, symbol, " + ", ".join(
            f'round("{k}", 9) as "{k}"' for k in COMPOSED_SET) + " from matrix), l as (", 1)),
)
def _(spark, folder):
    matrix = composed_matrix(spark, folder)
    settled = matrix.select("date", "symbol", *[F.round(c, 9).alias(c) for c in COMPOSED_SET])
    found = selection.factor_similarity(settled)
    return found.select("f1", "f2", (F.round("rho", 6) + 0.0).alias("rho"))


@query("K5_similarity_embeddings", _EMBEDDINGS + _SPEARMAN_TAIL.format(rows="m", keys="vec_id"))
def _(spark, folder):
    found = selection.factor_similarity(embedding_matrix(spark, folder), keys=("vec_id",))
    return found.select("f1", "f2", (F.round("rho", 6) + 0.0).alias("rho"))


# ---- chains ----

CHAINS_SQL = (
    "ranked as (select run_id, expression, row_number() over (partition by run_id order by score desc, pos) - 1 as slot, "
    "cast(ceil(count(*) over (partition by run_id) / 3) as bigint) as chunk from {scored}), "
    "chains as (select run_id, cast(floor(slot / chunk) as integer) as chain_id, cast(slot % chunk as integer) as pos, "
    "expression from ranked)"
)
_PLAIN_SCORES = "plain as (select *, 1.0 - pos / count(*) over (partition by run_id) as score from mined)"
_UNSCORED = f"{mined_ctes()}, {_PLAIN_SCORES}, {CHAINS_SQL.format(scored='plain')}"


@query("C1_initial_chains", f"with {_UNSCORED} select run_id, chain_id, pos, expression from chains")
def _(spark, folder):
    return chains.initial_chains(mined(spark, folder).select("run_id", "pos", "name", "expression"))


@query(
    "C1_scored_chains",
    f"with {mined_ctes()}, {SCORES_SQL.replace('coalesce(s.score', 'coalesce(s.score', 1)}, "
    f"settled as (select run_id, pos, expression, round(score, 6) as score from scored), "
    f"{CHAINS_SQL.format(scored='settled')} select run_id, chain_id, pos, expression from chains",
)
def _(spark, folder):
    rows = mined(spark, folder)
    return chains.initial_chains(
        rows.select("run_id", "pos", "name", "expression"), scores_of(rows)
    )


def _tokens(text: str) -> str:
    spaced = f"upper(translate(replace({text}, 'ß', 'ss'), '()-+*/', '      '))"
    return f"list_sort(list_filter(list_distinct(regexp_split_to_array({spaced}, '{_BLANKS}')), lambda t: t <> ''))"


@query("C2_tokenize", f"with {mined_ctes()} select event_id, {_tokens('expression')} as tokens from mined")
def _(spark, folder):
    return mined(spark, folder).select("event_id", chains.tokenize(F.col("expression")).alias("tokens"))


@query("C2_tokenize_documents", f"select doc_id, {_tokens('text')} as tokens from documents")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", chains.tokenize(F.col("text")).alias("tokens"))


def samples(spark, folder) -> DataFrame:
    """One composed expression per event, to be matched within the event's run."""
    texts = F.array(*[F.lit(e) for e in COMPOSED_SET.values()])
    picked = F.element_at(texts, (F.col("event_id") % len(COMPOSED_SET) + 1).cast("int"))
    return mined(spark, folder).select("run_id", F.col("event_id").alias("sample_id"), picked.alias("expression"))


_COMPOSED_LIST = ", ".join(f"'{e}'" for e in COMPOSED_SET.values())
_MATCH_SQL = (
    f"with {_UNSCORED}, samples as (select run_id, event_id as sample_id, "
    f"[{_COMPOSED_LIST}][event_id % {len(COMPOSED_SET)} + 1] as expression from mined), "
    f"st as (select distinct run_id, sample_id, unnest({_tokens('expression')}) as t from samples), "
    f"ct as (select distinct run_id, chain_id, unnest({_tokens('expression')}) as t from chains), "
    "sn as (select run_id, sample_id, count(*) as n from st group by 1, 2), "
    "cn as (select run_id, chain_id, count(*) as n from ct group by 1, 2), "
    "pairs as (select sn.run_id, sample_id, chain_id, sn.n as a, cn.n as b, "
    "(select count(*) from st join ct on st.t = ct.t where st.run_id = sn.run_id and ct.run_id = cn.run_id "
    "and st.sample_id = sn.sample_id and ct.chain_id = cn.chain_id) as shared from sn join cn on sn.run_id = cn.run_id), "
    "best as (select *, shared / (a + b - shared) as score, row_number() over (partition by run_id, sample_id "
    "order by shared / (a + b - shared) desc, chain_id) as r from pairs) "
)


@query("C3_match_chain", _MATCH_SQL + "select run_id, sample_id, chain_id from best where r = 1")
def _(spark, folder):
    found = chains.initial_chains(mined(spark, folder).select("run_id", "pos", "name", "expression"))
    return chains.match_chain(samples(spark, folder), found).select("run_id", "sample_id", "chain_id")


@query("J6_match_scores", _MATCH_SQL + "select run_id, sample_id, round(score, 6) as score from best where r = 1")
def _(spark, folder):
    found = chains.initial_chains(mined(spark, folder).select("run_id", "pos", "name", "expression"))
    matched = chains.match_chain(samples(spark, folder), found)
    return matched.select("run_id", "sample_id", F.round("score", 6).alias("score"))


@query(
    "C4_extend_or_split",
    f"with {_UNSCORED}, additions as (select run_id, chain_id, expression as new from "
    "(select distinct run_id, chain_id from chains) join seeds on seed = (run_id * 5 + chain_id) % 101), "
    "state as (select a.run_id, a.chain_id, a.new, count(*) as n, bool_or(expression = new) as present "
    "from additions a join chains c on c.run_id = a.run_id and c.chain_id = a.chain_id group by 1, 2, 3), "
    "every as (select c.run_id, c.chain_id, c.pos, c.expression from chains c union all "
    "select run_id, chain_id, cast(n as integer), new from state where not present), "
    "cut as (select e.*, case when not present and n + 1 > 5 then floor((n + 1) / 2) end as middle "
    "from every e join state s on s.run_id = e.run_id and s.chain_id = e.chain_id) "
    "select run_id, chain_id, case when middle is not null and pos >= middle then 1 else 0 end as part, "
    "cast(case when middle is not null and pos >= middle then pos - middle else pos end as integer) as pos, "
    "expression from cut",
)
def _(spark, folder):
    found = chains.initial_chains(mined(spark, folder).select("run_id", "pos", "name", "expression"))
    seed = F.expr("cast(pmod(run_id * 5 + chain_id, 101) as int)")
    seeds = library.seed_expressions(spark).select(F.col("pos").alias("seed"), F.col("expression").alias("new"))
    additions = (
        found.select("run_id", "chain_id").distinct().withColumn("seed", seed)
        .join(F.broadcast(seeds), "seed").drop("seed")
    )
    return chains.extend_or_split(found, additions)


_HINTS_SQL = ", ".join(f"({i}, '{h}')" for i, h in enumerate(chains.COLD_START_HINTS))


@query(
    "C5_cold_start_hints",
    f"with h(pos, hint) as (values {_HINTS_SQL}) select 0 as source, pos, hint from h union all "
    "select 1, conv_id * 1000 + turn, t from (select conv_id, turn, "
    f"regexp_replace(text, '^{_BLANKS}|{_BLANKS}$', '', 'g') as t from conversations) where t <> ''",
)
def _(spark, folder):
    extra = table(spark, folder, "conversations").select(
        F.expr("conv_id * 1000 + turn").alias("pos"), F.col("text").alias("hint")
    )
    return chains.cold_start_hints(spark, extra)


# ---- one mining step, from bars to a prompt ----

# Twelve expressions, three times each: linear copies are at distance 0 and form one cluster.
MINED_GROUPS = [
    *[COMPOSED_SET[f"G{i}"] for i in (1, 2, 3, 4, 5)],
    "RANK(CLOSE - OPEN)", "TS_MEAN(RET, 5)", "RANK(VOLUME)", "Z_SCORE(HIGH - LOW)", "DELTA(CLOSE, 3)",
    "CORREL(OPEN, VOLUME, 8)", "TS_STDDEV(VOLUME, 6)",
]
MINED_LIBRARY = [*MINED_GROUPS, *[f"({e}) * 3" for e in MINED_GROUPS], *[f"({e}) / 4" for e in MINED_GROUPS]]
_MINED_TEXTS = ", ".join(f"({i}, '{e}')" for i, e in enumerate(MINED_LIBRARY))
_MINED_SQL = (
    f", texts(i, expression) as (values {_MINED_TEXTS}), "
    "sizes as (select " + ", ".join(f'avg(abs("f{i}")) as f{i}' for i in range(24)) + " from matrix), "
    "scores as (select cast(substring(f, 2) as integer) as i, round(s, 9) as score from (unpivot sizes on * into name f value s)), "
    "exemplars as (select i + 1 as place, i as factor_id, expression, i % 12 as cluster, cast(floor(i / 12) as integer) + 1 as turn, "
    "score from scores join texts using (i)), "
    "slots as (select *, row_number() over (order by score desc, place) - 1 as slot from exemplars) "
)


def mining_run(spark, folder):
    rows = [(i, f"alpha_{i + 1}", e) for i, e in enumerate(MINED_LIBRARY)]
    known = spark.createDataFrame(rows, "pos long, name string, expression string")
    return mining.mining_step(
        weekly(spark, folder), known, scratch_path(spark, "mining"), k=12, n=24, whitelist=["RANK", "DELTA", "TS_MEAN", "CORREL"]
    )


def _mined_formulas(final: str) -> str:
    return duck.formulas_sql({f"f{i}": e for i, e in enumerate(MINED_LIBRARY[:24])}, fill=True, final=_MINED_SQL + final)


@query(
    "M1_mining_exemplars",
    _mined_formulas(
        "select place, factor_id, expression, cluster, turn, round(score, 6) as score, "
        "cast(floor(slot / 8) as integer) as chain_id, cast(slot % 8 as integer) as pos from slots"
    ),
)
def _(spark, folder):
    step = mining_run(spark, folder)
    placed = step.exemplars.join(step.chains.select("chain_id", "pos", "expression"), "expression")
    return placed.select(
        "place", "factor_id", "expression", "cluster", "turn", F.round("score", 6).alias("score"), "chain_id", "pos"
    )


@query(
    "M2_mining_prompt",
    _mined_formulas(
        f", cards(op, card) as (values {_CARDS_SQL}), "
        "used as (select distinct unnest(regexp_extract_all(expression, "
        r"'\b(RANK|DELTA|TS_MEAN|TS_STDDEV|CORREL|Z_SCORE|SIGN|ABS)\b', 1)) as op from exemplars), "
        "a as (select list(op order by op) as ops, string_agg(card, chr(10) || chr(10) order by op) as cards "
        "from used join cards using (op) where op in ('RANK', 'DELTA', 'TS_MEAN', 'CORREL')), "
        "s as (select string_agg('- ' || expression, chr(10) order by place) as sb from exemplars), "
        "p as (select string_agg('- ' || expression, chr(10) order by slot) as pb from slots where slot < 8) "
        "select 0 as run_id, ops, cards, substring(md5(cards), 1, 8) as checksum, "
        f"'{_prompt_parts[0]}' || substring(md5(cards), 1, 8) || '{_prompt_parts[1]}' || cards || '{_prompt_parts[2]}' || sb || "
        f"'{_prompt_parts[3]}' || pb || '{_prompt_parts[4]}' || '5' || '{_prompt_parts[5]}' || "
        f"'AMOUNT, CLOSE, HIGH, LOW, OPEN, RET, VOLUME, VWAP' || '{_prompt_parts[6]}' as prompt from a, s, p"
    ),
)
def _(spark, folder):
    return mining_run(spark, folder).prompt


# ---- primitives of the named library ----

dense("N1_delay_delta", {"delay": "delay(close, 5)", "delta": "delta(close, 5)"})
dense("N2_sum_mean_sd", {"sum": "sum(volume, 6)", "mean": "adv(6)", "sd": "sd(close, 6)"})
dense("N3_correlation", {"cor": "cor(close, volume, 7)", "cov": "cov(close, volume, 7)"})
dense("N4_min_max", {"lowest": "ts_min(low, 8)", "highest": "ts_max(high, 8)"})
dense("N5_ts_rank", "tsr(volume, 9)")
dense("N6_arg_extremes", {"argmax": "ts_argmax(close, 10)", "argmin": "ts_argmin(volume, 10)"})
dense("N7_decay_linear", "dl(close, 6)")
dense("N8_product", "product(close / open, 4)")
dense("N9_scale", "scale(close - open)")
dense("N10_rank", "rank(volume)")
dense("N11_elementwise", {
    "power": "signedpower(close - open, 0.5)", "log": "log(close - open)",
    "sign": "sign(close - open)", "abs": "abs(close - open)",
})
dense("N12_pairwise", {"small": "min2(delta(close, 1), close - open)", "large": "max2(delta(close, 1), close - open)"})
dense("N13_conditions", {
    "less": "close < open", "at_most": "close <= open", "at_least": "close >= delay(close, 1)",
    "chosen": "where(close < open, high, low)",
})
dense("N14_average_volume", "adv(20)")


@query("N14_average_amount", duck.formulas_sql({"value": "sum(amount, 20) / 20"}, named=True))
def _(spark, folder):
    return shown(factors.compute_dense(weekly(spark, folder), {"value": "adv(20)"}, use_amount=True))


for _token, _formula in named.FORMULAS.items():
    dense(f"A{_token[-3:]}", {_token: _formula})

for _key, _formula in COMPOSED_SET.items():
    composed(_key, _formula)
