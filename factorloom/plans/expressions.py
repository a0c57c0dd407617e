"""From formula text to factor columns, by way of Python's own ``ast``."""

from __future__ import annotations

import ast
import operator as python_operator
from collections.abc import Mapping

from factorloom.functions import elementwise as ew
from factorloom.plans.staging import FactorColumns, Node, Operator, mark_inexact


def _plain(name, fn, repeats=False, series=2, terms=None):
    return Operator(name, fn, series=series, repeats_arguments=repeats, terms=terms)


def _summed(columns, a, b):
    """A sum or difference is as uncertain as both its sides."""
    return columns.apply(ADD, columns.size(a), columns.size(b))


def _multiplied(columns, a, b):
    if columns.terms(a) is None and columns.terms(b) is None:
        return None
    return columns.apply(MULTIPLY, columns.size(a), columns.size(b))


def _divided(columns, a, b):
    top, below = columns.terms(a), columns.terms(b)
    if top is None and below is None:
        return None
    ratio = columns.apply(_BINARY[ast.Div][0], columns.size(a), b)
    return ratio if below is None else columns.apply(MULTIPLY, ratio, columns.apply(_BINARY[ast.Div][0], below, b))


ADD = _plain("+", ew.add, terms=_summed)
MULTIPLY = _plain("*", ew.multiply, terms=_multiplied)
_BINARY = {
    ast.Add: (ADD, python_operator.add),
    ast.Sub: (_plain("-", ew.subtract, terms=_summed), python_operator.sub),
    ast.Mult: (MULTIPLY, python_operator.mul),
    ast.Div: (_plain("/", ew.divide, repeats=True, terms=_divided), python_operator.truediv),
    ast.Pow: (_plain("**", ew.power), python_operator.pow),
}
mark_inexact(["**"])  # math libraries differ in the last bit of a power
_NEGATE = _plain("neg", ew.negate, series=1, terms=lambda columns, x: columns.terms(x))
_COMPARE = {
    ast.Lt: _plain("<", ew.less),
    ast.LtE: _plain("<=", ew.less_equal),
    ast.GtE: _plain(">=", ew.greater_equal),
}


class FormulaReader:
    """Turns formulas into nodes of one :class:`FactorColumns`.

    ``derived`` names fields that are themselves formulas (such as returns);
    they are read once and shared.
    """

    def __init__(
        self,
        columns: FactorColumns,
        operators: Mapping[str, Operator],
        derived: Mapping[str, object] | None = None,
        comparisons: bool = False,
        allow_lead: bool = False,
    ):
        self.columns = columns
        self.operators = operators
        self.derived = dict(derived or {})
        self.comparisons = comparisons
        self.allow_lead = allow_lead

    def read(self, text: str):
        return self._visit(ast.parse(text, mode="eval").body)

    def _visit(self, node):
        match node:
            case ast.Constant(value=value):
                return value
            case ast.Name(id=name):
                return self._name(name)
            case ast.UnaryOp(op=ast.UAdd(), operand=inner):
                return self._visit(inner)
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                value = self._visit(inner)
                return self.columns.apply(_NEGATE, value) if isinstance(value, Node) else -value
            case ast.BinOp(op=op, left=left, right=right) if type(op) in _BINARY:
                spark_op, scalar_op = _BINARY[type(op)]
                a, b = self._visit(left), self._visit(right)
                if isinstance(a, Node) or isinstance(b, Node):
                    return self.columns.apply(spark_op, a, b)
                return scalar_op(a, b)
            case ast.Compare(left=left, ops=[op], comparators=[right]) if (
                self.comparisons and type(op) in _COMPARE
            ):
                return self.columns.apply(_COMPARE[type(op)], self._visit(left), self._visit(right))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                return self._call(name, [self._visit(a) for a in args])
        raise ValueError(f"unsupported syntax: {ast.unparse(node)}")

    def _name(self, name: str):
        if name in self.derived:
            value = self.derived[name]
            if callable(value):
                value = self.derived[name] = value(self)
            return value
        if name not in self.columns.fields:
            raise ValueError(f"unknown variable {name!r}")
        return self.columns.field_node(name)

    def _call(self, name: str, args: list):
        if name not in self.operators:
            raise ValueError(f"unsupported function {name!r}")
        target = self.operators[name]
        if not isinstance(target, Operator):
            return target(self, *args)  # shorthand built from other operators
        if len(args) != target.series + target.integers:
            raise ValueError(f"{name} takes {target.series + target.integers} arguments")
        series, integers = args[: target.series], args[target.series :]
        if target.by is not None and not all(isinstance(a, Node) for a in series):
            raise ValueError(f"{name} needs a series argument")
        for n in integers:
            if isinstance(n, bool) or not isinstance(n, int):
                raise ValueError(f"{name} needs an integer window, got {n!r}")
            if n < 1 and not self.allow_lead:
                raise ValueError(f"{name} would look ahead with window {n}")
        if target.by is None and not any(isinstance(a, Node) for a in args):
            raise ValueError(f"{name} needs a series argument")
        return self.columns.apply(target, *series, *integers)
