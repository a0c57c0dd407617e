"""Tables of expressions: seeds, profiles, validation, replies, prompts."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators import named
from factorloom.operators.registry import OPERATORS
from factorloom.plans.skew import number_rows

# Hand-written seeds, then (template, first, last) parameter sweeps,
# and the size the list is cut to.
SEED_FORMULAS = (
    "RANK(CLOSE - OPEN)",
    "DELTA(CLOSE, 3)",
    "TS_MEAN(RET, 5)",
    "RANK(TS_STDDEV(RET, 10))",
    "RANK(CORREL(CLOSE, VOLUME, 5))",
    "RANK(VWAP - CLOSE)",
    "DELTA(RANK(CLOSE), 5)",
    "RANK(CLOSE)",
    "RANK(CLOSE - LOW)",
    "RANK(HIGH - CLOSE)",
    "TS_STDDEV(CLOSE - OPEN, 7)",
    "TS_MEAN(RET * VOLUME, 5)",
    "RANK(CORREL(RET, VWAP, 10))",
    "RANK(TS_STDDEV(VOLUME, 15))",
    "DELTA(RANK(VOLUME), 4)",
)
SEED_SWEEPS = (
    ("RANK(TS_MEAN(CLOSE - OPEN, %d))", 3, 22),
    ("DELTA(RANK(CLOSE - LOW), %d)", 2, 21),
    ("RANK(TS_STDDEV(VOLUME, %d))", 5, 24),
    ("RANK(CORREL(CLOSE, VOLUME, %d))", 6, 25),
    ("RANK(TS_MEAN(RET * VOLUME, %d))", 4, 13),
    ("RANK(DELTA(VWAP - CLOSE, %d))", 3, 12),
)
SEED_COUNT = 101

# Names always accepted, and the description of each operator.
BASE_FIELDS = ("OPEN", "HIGH", "LOW", "CLOSE", "VOLUME", "RET", "VWAP")
OPERATOR_CARDS = {
    "RANK": "RANK(x): 按日期对所有标的做截面排名，输出范围 [0,1]，并列取平均。",
    "DELTA": "DELTA(x, n): 每个标的的时间差分 x_t - x_{t-n}，n 为正整数，历史不足返回 NA。",
    "TS_MEAN": "TS_MEAN(x, n): 每个标的最近 n 个 bar (含当期) 的时间序列均值，历史不足返回 NA。",
    "TS_STDDEV": "TS_STDDEV(x, n): 每个标的最近 n 个 bar (含当期) 的时间序列标准差 (总体)，历史不足返回 NA。",
    "CORREL": "CORREL(x, y, n): 每个标的最近 n 个 bar 的皮尔逊相关系数，范围 [-1, 1]，历史不足返回 NA。",
    "Z_SCORE": "Z_SCORE(x): 每日截面 z-score，(x - 当日均值) / 当日标准差；若标准差为 0 则输出 0。",
    "SIGN": "SIGN(x): 元素级符号函数，输出 {-1, 0, 1}。",
    "ABS": "ABS(x): 元素级绝对值。",
}
# The prompt's wording.
PROMPT_FORMAT = (
    "OPS-CHECKSUM: %s\n"
    "仅可使用 Operator Specification 中列出的算子，且窗口参数需为正整数。禁止输出任何未列出的算子。\n\n"
    "%s\n\n# CSS exemplars\n%s\n\n# Chain-of-Experience (ICL hints)\n%s\n\n# Guardrails\n"
    "- 输出数量：%s 条，一行一个表达式，纯文本、勿加反引号。\n"
    "- 仅允许使用以下字段（大写）：%s\n"
    "- 严格使用上述算子；未知算子视为违规。\n"
    "- 表达式长度 <= 80 字符，嵌套层级 <= 2。"
)
NO_OPERATORS = "(no operators detected—fallback to whitelist)"
NO_ENTRIES = "- (none)"
DEFAULT_MAX_NEW = 5

# Every line boundary and blank character that text handling in Python knows.
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_BLANK = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def seed_list() -> list[str]:
    sweeps = [t % w for t, first, last in SEED_SWEEPS for w in range(first, last + 1)]
    return [*SEED_FORMULAS, *sweeps][:SEED_COUNT]


def seed_expressions(spark: SparkSession) -> DataFrame:
    """``pos, expression``: the starting library."""
    return spark.createDataFrame(list(enumerate(seed_list())), "pos INT, expression STRING")


def named_factors(spark: SparkSession) -> DataFrame:
    """``pos, name, expression`` of the named factors, sorted by name."""
    rows = [(i, n, n) for i, n in enumerate(sorted(named.FORMULAS))]
    return spark.createDataFrame(rows, "pos INT, name STRING, expression STRING")


def operator_cards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OPERATOR_CARDS.items()), "op STRING, card STRING")


# ---- looking at expressions ----


def called_functions(expression: Column) -> Column:
    pattern = F.lit(r"(?<![A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_]*)\s*\(")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_unquoted(expression), pattern, F.lit(1))))


def identifiers(expression: Column) -> Column:
    pattern = F.lit(r"(?<![A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_]*)")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_unquoted(expression), pattern, F.lit(1))))


def _unquoted(expression: Column) -> Column:
    return F.regexp_replace(expression, "'[^']*'|\"[^\"]*\"", "''")


def expression_profile(expressions: DataFrame) -> DataFrame:
    """Adds ``functions`` and ``variables``; an unknown call name is in both."""
    known = F.array(*[F.lit(n) for n in OPERATORS])
    text = F.col("expression")
    return expressions.withColumn("functions", called_functions(text)).withColumn(
        "variables", F.array_except(identifiers(text), known)
    )


_TOKEN = re.compile(r"alpha\d{3}", re.IGNORECASE)
_SYNTAX = (
    ast.Expression, ast.Load, ast.BinOp, ast.UnaryOp, ast.Call, ast.Constant,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.USub, ast.UAdd,
)


def is_valid(text: str, names: frozenset[str], functions: frozenset[str] | None) -> bool:
    """Only known names and plain arithmetic; called names within ``functions`` if given."""
    if _TOKEN.fullmatch(text.strip()):
        return True
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            if node.id not in names:
                return False
        elif not isinstance(node, _SYNTAX):
            return False
        elif (
            functions is not None
            and isinstance(node, ast.Call)
            and isinstance(node.func, ast.Name)
            and node.func.id.upper() not in functions
        ):
            return False
    return True


def mark_valid(
    candidates: DataFrame, fields: Iterable[str] = (), operators: Iterable[str] | None = None
) -> DataFrame:
    """Adds boolean ``valid``.

    Python's own grammar is the definition, so this one check runs in Arrow
    batches; a text repeated in a batch is parsed once.
    """
    names = frozenset([*OPERATORS, *BASE_FIELDS, *[f.upper() for f in fields]])
    # an empty list restricts nothing
    functions = frozenset(o.upper() for o in operators or ()) or None

    @F.pandas_udf("boolean")
    def valid(texts: pd.Series) -> pd.Series:
        verdicts = {t: t is not None and is_valid(t, names, functions) for t in texts.unique()}
        return texts.map(verdicts).astype(bool)

    return candidates.withColumn("valid", valid("expression"))


def validate_candidates(
    candidates: DataFrame, fields: Iterable[str] = (), operators: Iterable[str] | None = None
) -> DataFrame:
    """The rows whose ``expression`` is acceptable."""
    return mark_valid(candidates, fields, operators).where("valid").drop("valid")


_CARD_NAMES = "|".join(OPERATOR_CARDS)


def mentioned_operators(expression: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(expression, F.lit(rf"\b({_CARD_NAMES})\b"), F.lit(1))
    )


def extract_ops(expressions: DataFrame, run: str = "run_id") -> DataFrame:
    """``run, op``: distinct operators mentioned by each run's expressions."""
    return expressions.select(
        run, F.explode(mentioned_operators(F.col("expression"))).alias("op")
    ).distinct()


# ---- replies ----


def parse_responses(replies: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate line: all other columns, ``line`` (from 0) and ``expression``.

    Blank lines go; so does everything up to a line's first colon, and backticks
    around the rest.
    """
    rest = [c for c in replies.columns if c != text]
    blank, tick = F.lit(_BLANK), F.lit("`")
    lines = replies.select(*rest, F.posexplode(F.split(text, _LINE_BREAK)).alias("line", "_raw"))
    colon = F.instr(F.trim("_raw", blank), ":")  # 0 where there is none: the whole line stays
    unlabelled = F.trim(F.substr(F.trim("_raw", blank), colon + 1), blank)
    return lines.select(*rest, "line", F.trim(unlabelled, tick).alias("expression")).where(
        F.col("expression") != ""
    )


# ---- prompts ----


def prompt_context(
    exemplars: DataFrame,
    chains: DataFrame,
    fields: Iterable[str],
    whitelist: Iterable[str] = (),
    max_new: int = DEFAULT_MAX_NEW,
) -> DataFrame:
    """Per run: ``ops, cards, checksum, prompt`` from the chosen exemplars and chain.

    ``exemplars`` and ``chains``: ``run_id, pos, expression``, already cut down to
    what a prompt shows (the selection step's ``n``, a chain's few entries).
    """
    allowed = sorted(set(whitelist))
    parts = exemplars.select("run_id", F.lit(0).alias("kind"), "pos", "expression").unionByName(
        chains.select("run_id", F.lit(1).alias("kind"), "pos", "expression")
    )
    entry = F.struct("pos", "expression")
    runs = parts.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == 0, entry))).alias("shown"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == 1, entry))).alias("path"),
    )
    texts = F.concat(F.col("shown.expression"), F.col("path.expression"))
    ops = F.array_sort(mentioned_operators(F.array_join(texts, "\n")))
    if allowed:
        ops = F.array_intersect(ops, F.array(*[F.lit(w) for w in allowed]))
    cards = F.create_map(
        *[F.lit(v) for op, card in OPERATOR_CARDS.items() for v in (op, f"### {op}\n{card}")]
    )

    def block(column: str) -> Column:
        lines = F.transform(F.col(column), lambda e: F.concat(F.lit("- "), e["expression"]))
        return F.coalesce(
            F.when(F.size(column) > 0, F.array_join(lines, "\n")), F.lit(NO_ENTRIES)
        )

    with_cards = runs.withColumn("ops", ops).withColumn(
        "cards", F.array_join(F.transform("ops", lambda op: cards[op]), "\n\n")
    )
    checksum = F.substring(F.md5(F.encode("cards", "UTF-8")), 1, 8)
    shown_cards = F.when(F.col("cards") != "", F.col("cards")).otherwise(F.lit(NO_OPERATORS))
    prompt = F.format_string(
        PROMPT_FORMAT, F.col("checksum"), shown_cards, block("shown"), block("path"),
        F.lit(str(max_new)), F.lit(", ".join(fields)),
    )
    return (
        with_cards.withColumn("checksum", checksum)
        .withColumn("prompt", prompt)
        .select("run_id", "ops", "cards", "checksum", "prompt")
    )


def first_entries(expressions: DataFrame, n: int) -> DataFrame:
    """Each run's first ``n`` expressions by ``pos``: what a prompt has room for.

    Spark prunes to ``n`` rows per run before the shuffle, however large the run.
    """
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("pos"))
    return expressions.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def append_candidates(library: DataFrame, candidates: DataFrame, dedupe: bool = False) -> DataFrame:
    """Library rows, then the candidates named ``alpha_<n>`` counting on from its size.

    ``candidates``: ``pos, expression`` with unique ``pos``.  ``dedupe`` leaves out
    expressions already present and repeats among the candidates.
    """
    size = library.count()
    fresh = candidates.select("pos", "expression")
    if dedupe:
        fresh = fresh.groupBy("expression").agg(F.min("pos").alias("pos"))
        fresh = fresh.join(library.select("expression").distinct(), "expression", "left_anti")
    numbered = number_rows(fresh, [], [F.col("pos").asc()], "_rn")
    count = (F.col("_rn") + size).cast("long")
    return library.select(F.col("pos").cast("long").alias("pos"), "name", "expression").unionByName(
        numbered.select(
            (count - 1).alias("pos"),
            F.concat(F.lit("alpha_"), count.cast("string")).alias("name"),
            "expression",
        )
    )
