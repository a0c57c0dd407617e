"""Independent SQL for the correctness check, written for DuckDB.

Every sub-expression of a formula becomes one column of one CTE.  Nothing here
is shared with the Spark side except the formula text and the input tables.
"""

from __future__ import annotations

import ast
import math

WEEKLY_BARS = """
select date, symbol,
       arg_min(t, k) / 16.0::double as open, max(t) / 16.0::double as high,
       min(t) / 16.0::double as low, arg_max(t, k) / 16.0::double as close,
       sum(q) as volume, floor(sum(a) * 16 + 0.5) / 16 as amount
from (select date, symbol, t, q, a, row(day, l_orderkey, t) as k
      from (select cast(date_trunc('week', l_shipdate) as date) as date,
                   cast(l_shipdate as date) as day, p_brand as symbol, l_orderkey,
                   cast(floor(l_extendedprice / l_quantity * 16 + 0.5) as bigint) as t,
                   l_quantity as q, l_extendedprice as a
            from lineitem join part on l_partkey = p_partkey))
group by date, symbol
"""

DAILY_BARS = """
select date, symbol,
       arg_min(t, k) / 16.0::double as open, max(t) / 16.0::double as high,
       min(t) / 16.0::double as low, arg_max(t, k) / 16.0::double as close,
       sum(q) as volume, floor(sum(a) * 16 + 0.5) / 16 as amount
from (select date, symbol, t, q, a, row(l_orderkey, t) as k
      from (select cast(l_shipdate as date) as date, cast(l_suppkey as varchar) as symbol, l_orderkey,
                   cast(floor(l_extendedprice / l_quantity * 16 + 0.5) as bigint) as t,
                   l_quantity as q, l_extendedprice as a
            from lineitem))
group by date, symbol
"""

DENSE = """
select g.date, g.symbol, b.open, b.high, b.low, b.close, b.volume, b.amount,
       b.amount / (b.volume + 1e-7) as vwap
from (select d.date, s.symbol from (select distinct date from bars) d,
             (select distinct symbol from bars) s) g
left join bars b on b.date = g.date and b.symbol = g.symbol
"""

BY_DATE = "partition by date"
BY_SYMBOL = "partition by symbol order by date"


def frame(n: int) -> str:
    return f"({BY_SYMBOL} rows between {n - 1} preceding and current row)"


def no_nan(x: str) -> str:
    return f"case when not isnan({x}) then {x} end"


def fin(x: str) -> str:
    return f"(case when isfinite({x}) then {x} end)"


def rank_sql(x: str) -> str:
    w = f"({BY_DATE} order by {x} nulls last)"
    return (
        f"case when {x} is not null then (rank() over {w} + count({x}) over {w}) / 2 "
        f"/ count({x}) over ({BY_DATE}) end"
    )


def zscore_sql(x: str) -> str:
    w = f"({BY_DATE})"
    return (
        f"coalesce(case when stddev_samp({fin(x)}) over {w} <> 0 and isfinite({x}) "
        f"and count({x}) over {w} = count({fin(x)}) over {w} "
        f"then ({x} - avg({x}) over {w}) / stddev_samp({fin(x)}) over {w} end, 0.0)"
    )


def correl_sql(x: str, y: str, n: int) -> str:
    both = f"isfinite({x}) and isfinite({y})"
    px, py = f"(case when {both} then {x} end)", f"(case when {both} then {y} end)"
    w = frame(n)
    return (
        f"case when min({px}) over {w} < max({px}) over {w} and min({py}) over {w} < max({py}) over {w} "
        f"then greatest(-1.0, least(1.0, covar_samp({px}, {py}) over {w} "
        f"/ sqrt(var_samp({px}) over {w} * var_samp({py}) over {w}))) end"
    )


def exact_pair(x: str, y: str, grid_x: int, grid_y: int, n: int) -> dict[str, str]:
    """Sums of a window in whole numbers: x and y are multiples of 1/grid."""
    both = f"isfinite({x}) and isfinite({y})"
    px = f"(case when {both} then cast(round({x} * {grid_x}.0::double) as hugeint) end)"
    py = f"(case when {both} then cast(round({y} * {grid_y}.0::double) as hugeint) end)"
    w = frame(n)
    count = f"count({px}) over {w}"

    def moment(a, b):
        return f"({count} * sum({a} * {b}) over {w} - (sum({a}) over {w}) * (sum({b}) over {w}))"

    return {"n": count, "xy": moment(px, py), "xx": moment(px, px), "yy": moment(py, py)}


def exact_correl_sql(x: str, y: str, grid_x: int, grid_y: int, n: int) -> str:
    """A correlation of whole numbers: it is 0, 1 or -1 where it truly is."""
    m = {k: f"cast({v} as double)" for k, v in exact_pair(x, y, grid_x, grid_y, n).items()}
    return (
        f"case when {m['xx']} > 0 and {m['yy']} > 0 "
        f"then greatest(-1.0, least(1.0, {m['xy']} / sqrt({m['xx']} * {m['yy']}))) end"
    )


def exact_cov_sql(x: str, y: str, grid_x: int, grid_y: int, n: int) -> str:
    m = exact_pair(x, y, grid_x, grid_y, n)
    return (
        f"case when {m['n']} > 1 then cast({m['xy']} as double) "
        f"/ ({float(grid_x * grid_y)!r}::double * {m['n']} * ({m['n']} - 1)) end"
    )


def lag_sql(x: str, n: int) -> str:
    return f"lag({x}, {n}) over ({BY_SYMBOL})"


def full(x: str, n: int, value: str) -> str:
    return f"case when count({fin(x)}) over {frame(n)} = {n} then {value} end"


def divide_sql(a: str, b: str) -> str:
    return no_nan(
        f"(case when {b} = 0 then case when {a} > 0 then 'inf'::double "
        f"when {a} < 0 then '-inf'::double end else {a} / {b} end)"
    )


def pow_sql(a: str, b: str) -> str:
    return (
        f"case when {a} < 0 and {b} <> floor({b}) then null "
        f"when {a} = 0 and {b} < 0 then 'inf'::double else {no_nan(f'pow({a}, {b})')} end"
    )


INEXACT = {
    "TS_MEAN", "TS_STDDEV", "CORREL", "Z_SCORE", "VWAP",
    "sum", "adv", "sd", "cor", "cov", "scale", "dl", "product", "log", "signedpower",
}
ORDERED = {"RANK", "rank", "tsr", "ts_argmax", "ts_argmin"}

RET = (
    "coalesce(case when lastp <> 0 and isfinite(close / lastp - 1) then close / lastp - 1 end, 0.0)"
)


# A rank among at most 25 symbols is a multiple of 1 over this; bars are sixteenths, volumes whole.
RANK_GRID = 2 * math.lcm(*range(1, 26))
FIELD_GRIDS = {"open": 16, "high": 16, "low": 16, "close": 16, "amount": 16, "volume": 1}
KEEPS_GRID = {"delay", "delta", "DELTA", "ABS", "abs", "ts_min", "ts_max"}


class FormulaSql:
    """Levels of columns; a column at level n reads columns of lower levels only.

    ``grids`` says of which fraction a column's values are multiples, where that is known.
    """

    def __init__(self, base_fields: set[str], named: bool, symbols: int | None = None):
        self.base = base_fields
        self.named = named
        self.rank_grid = RANK_GRID if symbols is not None and symbols <= 25 else None
        self.grids: dict[str, int] = dict(FIELD_GRIDS)
        self.columns: dict[str, tuple[str, int, bool]] = {}
        self.levels: list[list[str]] = []

    def put(self, sql: str, level: int, inexact: bool) -> tuple[str, int, bool]:
        if sql not in self.columns:
            name = f"c{len(self.columns)}"
            while len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(f"{sql} as {name}")
            self.columns[sql] = (name, level + 1, inexact)
        return self.columns[sql]

    def visit(self, node):
        """(sql, first level it can be read at, inexact) or a python number."""
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            return self.field(node.id)
        if isinstance(node, ast.UnaryOp):
            inner = self.visit(node.operand)
            negative = isinstance(node.op, ast.USub)
            if not isinstance(inner, tuple):
                return -inner if negative else inner
            return self.on_grid(self.put(f"-{inner[0]}", inner[1], inner[2]), self.grid(inner)) if negative else inner
        if isinstance(node, (ast.BinOp, ast.Compare)):
            if isinstance(node, ast.BinOp):
                op, left, right = node.op, node.left, node.right
            else:
                op, left, right = node.ops[0], node.left, node.comparators[0]
            return self.combine(op, self.visit(left), self.visit(right))
        return self.call(node.func.id, [self.visit(a) for a in node.args])

    def grid(self, value) -> int | None:
        return self.grids.get(value[0]) if isinstance(value, tuple) else None

    def on_grid(self, made, grid: int | None):
        if grid is not None:
            self.grids[made[0]] = grid
        return made

    def field(self, name: str):
        key = name.lower()
        if key == "ret" and self.named:
            previous = lag_sql("close", 1)
            return self.put(
                f"case when {previous} <> 0 then close / {previous} - 1 end", 0, False
            )
        if key == "ret":
            self.put(
                f"last_value(close ignore nulls) over ({BY_SYMBOL} "
                "rows between unbounded preceding and 1 preceding)",
                0,
                False,
            )
            last = next(n for s, (n, _, _) in self.columns.items() if s.startswith("last_value"))
            return self.put(RET.replace("lastp", last), 1, False)
        if key == "vwap" and not self.named:
            total = f"sum(volume) over ({BY_DATE})"
            return self.put(
                f"coalesce(case when {total} <> 0 then close * volume / {total} end, close)", 0, True
            )
        assert key in self.base, name
        return (key, 0, False)

    def combine(self, op, left, right):
        if not isinstance(left, tuple) and not isinstance(right, tuple):
            code = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}[type(op)]
            return eval(f"({left!r}) {code} ({right!r})")  # two constants
        a, b = self.text(left), self.text(right)
        level = max(x[1] for x in (left, right) if isinstance(x, tuple))
        inexact = any(isinstance(x, tuple) and x[2] for x in (left, right))
        if isinstance(op, ast.Div):
            sql = divide_sql(a, b)
        elif isinstance(op, ast.Pow):
            sql, inexact = pow_sql(a, b), True
        elif isinstance(op, (ast.Lt, ast.LtE, ast.GtE)):
            code = {ast.Lt: "<", ast.LtE: "<=", ast.GtE: ">="}[type(op)]
            sql = f"cast({a} {code} {b} as double)"
        else:
            code = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}[type(op)]
            sql = no_nan(f"({a} {code} {b})")
        one, two = self.grid(left), self.grid(right)
        plain = isinstance(op, (ast.Add, ast.Sub)) and one is not None and two is not None and not inexact
        return self.on_grid(self.put(sql, level, inexact), math.lcm(one, two) if plain else None)

    @staticmethod
    def text(x) -> str:
        return x[0] if isinstance(x, tuple) else f"({float(x)!r})::double"

    def call(self, name: str, args: list):
        level = max((a[1] for a in args if isinstance(a, tuple)), default=0)
        inexact = name in INEXACT or (
            name not in ORDERED and any(isinstance(a, tuple) and a[2] for a in args)
        )
        if name in ORDERED and args[0][2]:
            # Rounded to 33 of 53 bits, so that the order of additions does not decide a tie.
            v = args[0][0]
            sql = f"case when abs({v}) < 1e290 then {v} * 1048577.0::double - ({v} * 1048577.0::double - {v}) else {v} end"
            rounded = self.put(sql, level, False)
            args, level = [rounded, *args[1:]], rounded[1]
        if name == "adv":
            args = [("volume", 0, False), args[0]]
            name = "mean"
        texts = [self.text(a) for a in args]
        x = texts[0]
        n = args[-1] if not isinstance(args[-1], tuple) else None
        if name in ("tsr", "ts_argmax", "ts_argmin", "dl", "product"):
            values = self.put(
                f"list({x}) filter (where isfinite({x})) over {frame(n)}", level, False
            )
            v, level = values[0], values[1]
            sql = f"case when len({v}) = {n} then {self.list_sql(name, v, n)} end"
            grid = {"tsr": 2 * n, "ts_argmax": 1, "ts_argmin": 1}.get(name)
            return self.on_grid(self.put(sql, level, inexact), grid)
        grids = [self.grid(a) for a in args if isinstance(a, tuple)]
        if name in ("cor", "cov", "CORREL") and None not in grids:
            exact = exact_cov_sql if name == "cov" else exact_correl_sql
            value = exact(x, texts[1], *grids, n)
            return self.put(value if name == "CORREL" else self.pair_full(x, texts[1], n, value), level, True)
        makers = {
            "RANK": lambda: rank_sql(x),
            "DELTA": lambda: no_nan(f"({x} - {lag_sql(x, n)})"),
            "TS_MEAN": lambda: f"avg({fin(x)}) over {frame(n)}",
            "TS_STDDEV": lambda: f"stddev_samp({fin(x)}) over {frame(n)}",
            "CORREL": lambda: correl_sql(x, texts[1], n),
            "Z_SCORE": lambda: zscore_sql(x),
            "SIGN": lambda: f"cast(sign({x}) as double)",
            "ABS": lambda: f"abs({x})",
            "rank": lambda: rank_sql(x),
            "delay": lambda: lag_sql(x, n),
            "delta": lambda: no_nan(f"({x} - {lag_sql(x, n)})"),
            "sum": lambda: full(x, n, f"sum({fin(x)}) over {frame(n)}"),
            "mean": lambda: full(x, n, f"avg({fin(x)}) over {frame(n)}"),
            "sd": lambda: full(x, n, f"stddev_samp({fin(x)}) over {frame(n)}"),
            "ts_min": lambda: full(x, n, f"min({fin(x)}) over {frame(n)}"),
            "ts_max": lambda: full(x, n, f"max({fin(x)}) over {frame(n)}"),
            "cor": lambda: self.pair_full(x, texts[1], n, correl_sql(x, texts[1], n)),
            "cov": lambda: self.pair_full(x, texts[1], n, self.cov_sql(x, texts[1], n)),
            "scale": lambda: (
                f"case when sum(abs({x})) over ({BY_DATE}) <> 0 "
                f"then {x} / sum(abs({x})) over ({BY_DATE}) end"
            ),
            "sign": lambda: f"cast(sign({x}) as double)",
            "abs": lambda: f"abs({x})",
            "log": lambda: f"case when {x} > 0 then ln({x}) end",
            "signedpower": lambda: f"sign({x}) * ({pow_sql(f'abs({x})', texts[1])})",
            "min2": lambda: self.both(texts, "least"),
            "max2": lambda: self.both(texts, "greatest"),
            "where": lambda: f"case when {x} <> 0 then {texts[1]} when {x} = 0 then {texts[2]} end",
        }
        grid = grids[0] if name in KEEPS_GRID and not inexact else None
        if name in ("RANK", "rank"):
            grid = self.rank_grid
        return self.on_grid(self.put(makers[name](), level, inexact), grid)

    @staticmethod
    def both(texts, fn):
        a, b = texts
        return f"case when {a} is not null and {b} is not null then {fn}({a}, {b}) end"

    @staticmethod
    def pair_full(x, y, n, value):
        both = f"isfinite({x}) and isfinite({y})"
        return f"case when count(case when {both} then 1 end) over {frame(n)} = {n} then {value} end"

    @staticmethod
    def cov_sql(x, y, n):
        both = f"isfinite({x}) and isfinite({y})"
        px, py = f"(case when {both} then {x} end)", f"(case when {both} then {y} end)"
        return f"covar_samp({px}, {py}) over {frame(n)}"

    @staticmethod
    def list_sql(name, v, n):
        return {
            "tsr": f"(len(list_filter({v}, lambda e: e < {v}[{n}])) "
            f"+ (len(list_filter({v}, lambda e: e = {v}[{n}])) + 1) / 2) / {n}",
            "ts_argmax": f"cast(list_position({v}, list_max({v})) as double)",
            "ts_argmin": f"cast(list_position({v}, list_min({v})) as double)",
            "dl": f"list_sum(list_transform({v}, lambda e, i: e * i)) / {n * (n + 1) / 2}",
            "product": f"list_product({v})",
        }[name]


def formulas_sql(
    formulas: dict[str, str],
    *,
    named: bool = False,
    bars: str = WEEKLY_BARS,
    fill: bool = False,
    digits: int = 6,
    final: str | None = None,
    more_digits: dict[str, int] = {},
    log_scale: frozenset[str] = frozenset(),
) -> str:
    """``date, symbol`` and one rounded column per formula (or ``final`` over table ``matrix``)."""
    fields = {"open", "high", "low", "close", "volume", "amount"} | ({"vwap"} if named else set())
    maker = FormulaSql(fields, named, 25 if bars == WEEKLY_BARS else None)
    outputs = {}
    for label, text in formulas.items():
        value = maker.visit(ast.parse(text, mode="eval").body)
        outputs[label] = maker.text(value)
    ctes = [f"bars as ({bars})", f"l0 as ({DENSE})" if named else "l0 as (select * from bars)"]
    for i, cols in enumerate(maker.levels):
        ctes.append(f"l{i + 1} as (select *, {', '.join(cols)} from l{i})")
    last = f"l{len(maker.levels)}"

    def shown(sql: str) -> str:
        return f"coalesce({no_nan(sql)}, 0.0)" if fill else no_nan(sql)

    if final is not None:
        cols = ", ".join(f'{shown(s)} as "{k}"' for k, s in outputs.items())
        ctes.append(f"matrix as (select date, symbol, {cols} from {last})")
        return f"with {', '.join(ctes)} {final}"

    def settled(label: str, sql: str) -> str:
        if label in log_scale:  # beyond the digits a double has
            return f"round(sign({sql}) * ln(1 + abs({sql})), 6) + 0.0"
        return f"round({shown(sql)}, {more_digits.get(label, digits)}) + 0.0"

    cols = ", ".join(f'{settled(k, s)} as "{k}"' for k, s in outputs.items())
    return f"with {', '.join(ctes)} select date, symbol, {cols} from {last}"
