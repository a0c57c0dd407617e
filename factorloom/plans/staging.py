"""Factor columns laid out in stages.

Formulas share sub-expressions; each distinct one is a named column.  Columns
whose windows run along a symbol and columns whose windows run across a date
are computed in alternating stages, so the number of exchanges follows the
nesting depth of the formulas, not their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.crosssection import DateMoments, percent_rank_average, rank_columns
from factorloom.functions.timeseries import SymbolFrame
from factorloom.plans import skew
from factorloom.plans.durable import durable
from factorloom.plans.skew import Layout


@dataclass(frozen=True)
class Operator:
    """How one function becomes a column.

    ``by=None``: ``fn(*args)`` row-wise.  ``by="symbol"``: ``fn(*args, over)``.
    ``by="date"``: ``fn`` is a :class:`DateMoments`, or ``None`` for percentile rank.
    ``series`` counts the leading series arguments, the rest are integers;
    ``lookback`` and ``lookahead`` are how many earlier and later rows of the symbol
    the result depends on.
    """

    name: str
    fn: object
    by: str | None = None
    series: int = 1
    integers: int = 0
    lookback: Callable[..., int] = lambda *ints: 0
    lookahead: Callable[..., int] = lambda *ints: 0
    repeats_arguments: bool = False
    round_operand: bool = False
    carries: bool = False
    finish: Callable[[Column], Column] | None = None  # row-wise step on the stored result
    # ``terms(columns, *args)``: size of the terms that the result adds up and that may cancel
    # (a number or a node); None where the result is as large as its terms.
    terms: Callable | None = None


@dataclass
class Node:
    name: str
    operator: Operator | None
    args: tuple = ()
    source: str | None = None
    stored: bool = False
    users: int = 0
    place: tuple[int, int] = (0, 0)
    computed: bool = False  # value comes out of a floating point window

    @property
    def leaf(self) -> bool:
        return self.operator is None


@dataclass
class FactorColumns:
    """Collects formulas over named fields, then adds their columns to a panel."""

    fields: dict[str, str]
    # Lowest bits of a computed operand that do not count when it is ordered: with 20 of
    # 53 bits, values that agree to about 1e-10 of their size are ties, and what is left of
    # terms 1e10 times as large is zero.  None: all count.
    rank_noise_bits: int | None = 20
    nodes: dict[tuple, Node] = field(default_factory=dict)

    def field_node(self, name: str) -> Node:
        return self._intern(("field", name), lambda n: Node(n, None, source=self.fields[name]))

    def apply(self, operator: Operator, *args) -> Node:
        if operator.round_operand:
            args = (self.settled(args[0]), *args[1:])
        key = (operator.name, *[a.name if isinstance(a, Node) else ("const", a) for a in args])

        def build(name: str) -> Node:
            node = Node(name, operator, args)
            node.computed = operator.name in _INEXACT or (
                operator.name not in _EXACT and any(_inexact(a) for a in args)
            )
            return node

        node = self._intern(key, build)
        if operator.finish is None:
            return node
        last = Operator(f"{operator.name}_finish", operator.finish, repeats_arguments=True, terms=_through)
        return self.apply(last, node)

    def settled(self, arg):
        """An operand about to be ordered, free of last-bit noise from window sums."""
        if not self.rank_noise_bits or not _inexact(arg):
            return arg
        terms = self.terms(arg)
        if terms is None:
            return self.apply(_ROUND, arg, self.rank_noise_bits)
        return self.apply(_SETTLE, arg, terms, self.rank_noise_bits)

    def terms(self, arg):
        """Size of the terms that may have cancelled in ``arg``; None: none larger than itself.

        It says how far from zero a value must be to mean something: what is smaller
        than the last of its terms' leading bits is zero, however small the terms are.
        """
        if not _inexact(arg) or arg.operator.terms is None:
            return None
        return arg.operator.terms(self, *arg.args)

    def size(self, arg):
        """Like :meth:`terms`, with the absolute value where there is nothing to cancel."""
        if not isinstance(arg, Node):
            return abs(arg)
        terms = self.terms(arg)
        return self.apply(_SIZE, arg) if terms is None else terms

    def _intern(self, key, build) -> Node:
        if key not in self.nodes:
            self.nodes[key] = build(f"_f{len(self.nodes)}")
        return self.nodes[key]

    # -- layout --

    def _place(self) -> None:
        order = list(self.nodes.values())  # arguments are created before their users
        for node in order:
            for arg in {a.name: a for a in node.args if isinstance(a, Node)}.values():
                arg.users += 1
        for node in order:
            if node.leaf:
                continue
            if node.operator.by is not None:
                node.stored = True
            if node.operator.by is not None or node.operator.repeats_arguments:
                for arg in node.args:
                    if isinstance(arg, Node) and not arg.leaf:
                        arg.stored = True
            if node.users > 1:
                node.stored = True
        for node in order:
            if node.leaf:
                continue
            stage, step = max([a.place for a in node.args if isinstance(a, Node)], default=(0, 0))
            if stage > 0:
                node.stored = True  # one result travels on instead of its operands
            if node.operator.by is None:
                node.place = (stage, step + 1) if node.stored else (stage, step)
            elif stage > 0 and _stage_key(stage) == node.operator.by:
                node.place = (stage, step + 1)
            else:
                later = stage + 1
                while _stage_key(later) != node.operator.by:
                    later += 1
                node.place = (later, 1)

    def _value(self, node, over=None):
        """Column for a node: by name once stored, inline otherwise."""
        if not isinstance(node, Node):
            return node
        if node.leaf:
            return F.col(node.source)
        if node.stored:
            return F.col(node.name)
        return self._define(node, over)

    def _define(self, node: Node, over=None) -> Column:
        operator = node.operator
        args = [self._value(a, over) for a in node.args]
        if operator.by is None:
            return operator.fn(*args)
        if operator.by == "symbol":
            if operator.carries:
                args[0] = node.args[0].source or node.args[0].name
            return operator.fn(*args, over)
        if operator.fn is None:
            return percent_rank_average(*args)
        return operator.fn.over_window(["date"], *args)

    # -- execution --

    def add_to(self, panel: DataFrame, roots: dict[str, object], layout: Layout) -> DataFrame:
        """``date, symbol`` plus one column per root."""
        self._place()
        stored = [n for n in self.nodes.values() if n.stored]
        places = sorted({n.place for n in stored})
        df = panel
        for stage in sorted({s for s, _ in places}):
            steps = [
                [n for n in stored if n.place == place] for place in places if place[0] == stage
            ]
            needed = self._needed_after(stage, roots)
            if _stage_key(stage) == "symbol":
                df = self._symbol_stage(df, steps, layout)
            elif _stage_key(stage) == "date":
                df = self._date_stage(df, steps, layout, needed)
            else:
                df = self._plain_steps(df, steps, None)
            df = df.select("date", "symbol", *needed)
        outputs = [_output(self._value(root)).alias(label) for label, root in roots.items()]
        return df.select("date", "symbol", *outputs)

    def _needed_after(self, stage: int, roots) -> list[str]:
        """Columns later stages or the outputs still read."""
        wanted: dict[str, None] = {}

        def visit(node) -> None:
            if not isinstance(node, Node):
                return
            if node.leaf:
                wanted[node.source] = None
            elif node.stored and node.place[0] <= stage:
                wanted[node.name] = None
            else:
                for arg in node.args:
                    visit(arg)

        for root in roots.values():
            visit(root)
        return [c for c in wanted if c not in ("date", "symbol")]

    def _plain_steps(self, df: DataFrame, steps, over) -> DataFrame:
        for nodes in steps:
            df = df.select("*", *[self._define(n, over).alias(n.name) for n in nodes])
        return df

    def _symbol_stage(self, df: DataFrame, steps, layout: Layout) -> DataFrame:
        if not layout.split_symbols:
            return self._plain_steps(df, steps, SymbolFrame())
        lookback, lookahead = (
            sum(max((_reach(n, way) for n in nodes), default=0) for nodes in steps)
            for way in ("lookback", "lookahead")
        )
        carry = sorted(
            {n.args[0].source or n.args[0].name for ns in steps for n in ns if n.operator.carries}
        )
        pieces = skew.split_history(df, lookback, layout, carry, lookahead)
        frame = SymbolFrame(("symbol", "_segment"), {c: f"_carry_{c}" for c in carry})
        out = self._plain_steps(pieces, steps, frame)
        helpers = ["_segment", "_halo", *[f"_carry_{c}" for c in carry]]
        return out.where(~F.col("_halo")).drop(*helpers)

    def _date_stage(self, df: DataFrame, steps, layout: Layout, needed) -> DataFrame:
        steps = _gather_ranks(steps)
        if not layout.split_dates:
            return self._usual_dates(df, steps, needed)
        # Rows are known by number: keys may repeat or be missing.
        numbered = skew.mark_large_dates(df, layout).withColumn("_row", F.monotonically_increasing_id())
        marked = durable(numbered)
        usual = marked.where(F.col("_large").isNull()).drop("_large", "_row")
        large = marked.where(F.col("_large")).drop("_large")
        for nodes in steps:
            plain = [n for n in nodes if n.operator.by is None]
            large = self._plain_steps(large, [plain], None) if plain else large
            moments = [n for n in nodes if isinstance(n.operator.fn, DateMoments)]
            if moments:
                items = [(n.name, n.operator.fn, [self._value(a) for a in n.args]) for n in moments]
                large = skew.spread_moments(large, ["date"], items)
            ranks = [n for n in nodes if _is_rank(n)]
            if ranks:
                large = skew.spread_ranks(large, "_row", ["date"], _rank_inputs(ranks))
        return self._usual_dates(usual, steps, needed).select("date", "symbol", *needed).unionByName(
            large.select("date", "symbol", *needed)
        )

    def _usual_dates(self, df: DataFrame, steps, needed) -> DataFrame:
        for i, nodes in enumerate(steps):
            ranks = [n for n in nodes if _is_rank(n)]
            if len(ranks) < MANY_RANKS:
                df = self._plain_steps(df, [nodes], None)
                continue
            others = [n for n in nodes if not _is_rank(n)]
            df = self._plain_steps(df, [others], None) if others else df
            made = {n.name for n in ranks}
            wanted = set(needed)
            for later in steps[i + 1 :]:
                for node in later:
                    wanted.update(self._reads(node))
            keep = [c for c in df.columns if c in wanted and c not in made]
            keep = [c for c in keep if c not in ("date", "symbol")]
            df = rank_columns(df, _rank_inputs(ranks), keep)
        return df

    def _reads(self, node: Node) -> set[str]:
        """Columns a node's definition mentions."""
        found: set[str] = set()
        for arg in node.args:
            if isinstance(arg, Node):
                if arg.leaf:
                    found.add(arg.source)
                elif arg.stored:
                    found.add(arg.name)
                else:
                    found |= self._reads(arg)
        return found


# From this many ranks in one step on, rows are laid out one value each.
MANY_RANKS = 4


def _is_rank(node: Node) -> bool:
    return node.operator.by == "date" and node.operator.fn is None


def _rank_inputs(ranks) -> dict[str, str]:
    return {n.name: n.args[0].source or n.args[0].name for n in ranks}


def _gather_ranks(steps) -> list[list[Node]]:
    """Puts off each rank to the last step it can wait for, so that ranks come together."""
    flat = [n for nodes in steps for n in nodes]
    order = {n.name: i for i, nodes in enumerate(steps) for n in nodes}
    last = max((order[n.name] for n in flat if _is_rank(n)), default=0)
    due = {n.name: last if _is_rank(n) else order[n.name] for n in flat}

    def used_by(node, reader) -> bool:
        return any(
            a is node or (not a.stored and not a.leaf and used_by(node, a))
            for a in reader.args
            if isinstance(a, Node)
        )

    for node in reversed(flat):  # users come after what they use
        if _is_rank(node):
            users = [due[u.name] for u in flat if u is not node and used_by(node, u)]
            due[node.name] = max(order[node.name], min([due[node.name], *[u - 1 for u in users]]))
    return [[n for n in flat if due[n.name] == i] for i in range(len(steps))]


def _stage_key(stage: int) -> str | None:
    return None if stage == 0 else ("symbol" if stage % 2 else "date")


def _reach(node: Node, way: str) -> int:
    if node.operator.by != "symbol":
        return 0
    return getattr(node.operator, way)(*[a for a in node.args if not isinstance(a, Node)])


def _inexact(arg) -> bool:
    return isinstance(arg, Node) and arg.computed


def _output(value) -> Column:
    column = value if isinstance(value, Column) else F.lit(float(value))
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))



def _shortened(x: Column, bits: int) -> Column:
    """``x`` rounded to ``bits`` fewer bits, whatever its size (Veltkamp's splitting)."""
    scaled = x * F.lit(2.0**bits + 1)
    return F.when(F.abs(x) < 1e290, scaled - (scaled - x)).otherwise(x)


def _settle(x: Column, terms, bits: int) -> Column:
    """:func:`_shortened`, and 0 where the terms' bits that count do not reach ``x``."""
    least = (F.abs(terms) if isinstance(terms, Column) else F.lit(float(terms))) * F.lit(2.0 ** (bits - 53))
    return F.when(F.abs(x) <= least, F.lit(0.0)).otherwise(_shortened(x, bits))


def _through(columns: FactorColumns, x, *_):
    return columns.terms(x)


_ROUND = Operator("_round", _shortened, integers=1, repeats_arguments=True)
_SETTLE = Operator("_settle", _settle, series=2, integers=1, repeats_arguments=True)
_SIZE = Operator("_size", F.abs)

# Operators whose result depends on the order floating point terms were combined in.
_INEXACT: set[str] = set()
# Ranks are counts; whatever noise the operand had is gone.
_EXACT = {"RANK", "rank", "_round", "_settle"}


def mark_inexact(names: Iterable[str]) -> None:
    _INEXACT.update(names)
