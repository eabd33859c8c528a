"""Catalogue and user formulas compiled to column expressions.

A formula is text. It is turned into one ``Column`` at plan time; rows are
only ever touched by generated code. Column-wide z-scores read their mean and
deviation from a one-row subquery that all formulas share.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import numeric


class FormulaError(ValueError):
    """The text is not an arithmetic formula over known names."""


STATS = "_moments"

_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: numeric.divide,
    ast.Pow: F.pow,
}

_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "log1p": F.log1p,
    "exp": F.exp,
    "log": lambda x: F.when(x > 0, F.ln(x)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "abs": F.abs,
    "sigmoid": numeric.sigmoid,
    "avg": numeric.row_mean,
    "max": lambda *xs: F.greatest(*xs) if len(xs) > 1 else xs[0],
    "min": lambda *xs: F.least(*xs) if len(xs) > 1 else xs[0],
}


def variables(formula: str) -> list[str]:
    """Names a formula reads, functions left out, in order of appearance."""
    tree = _parse(formula)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    names = [n for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called]
    names.sort(key=lambda n: n.col_offset)
    return list(dict.fromkeys(n.id for n in names))


def _parse(formula: str) -> ast.expr:
    try:
        return ast.parse(formula, mode="eval").body
    except SyntaxError as error:
        raise FormulaError(f"cannot read formula {formula!r}") from error


class FrameFormulas:
    """Compiles formulas against the columns of one frame."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._standardised: dict[str, Column] = {}

    def compile(self, formulas: dict[str, str]) -> dict[str, Column]:
        """name -> column; a formula with an unknown input becomes NULL."""
        trees = {}
        for name, formula in formulas.items():
            missing = [v for v in variables(formula) if v not in self.df.columns]
            trees[name] = None if missing else _parse(formula)
        self._collect_standardised([t for t in trees.values() if t is not None])
        return {
            name: F.lit(None).cast("double") if tree is None else self._column(tree).cast("double")
            for name, tree in trees.items()
        }

    def _collect_standardised(self, trees: list[ast.expr]) -> None:
        """One aggregate for every z-score argument of every formula.

        It yields the mean and the reciprocal deviation (0 for a column that is
        constant or has one value), so a row costs one subtraction and one
        multiplication.
        """
        arguments = {}
        for tree in trees:
            for node in ast.walk(tree):
                if isinstance(node, ast.Call) and getattr(node.func, "id", "") == "zscore":
                    if len(node.args) != 1:
                        raise FormulaError("zscore takes one argument")
                    arguments[ast.dump(node.args[0])] = self._column(node.args[0]).cast("double")
        self._standardised = arguments
        if arguments:
            parts = []
            for i, x in enumerate(arguments.values()):
                std, n = F.stddev_samp(x), F.count(x)
                scale = F.when((n <= 1) | (std == 0), 0.0).otherwise(1 / std)
                parts += [F.avg(x).alias(f"m{i}"), scale.alias(f"k{i}")]
            self.df = self.df.withColumn(STATS, self.df.agg(F.struct(*parts).alias("stats")).scalar())

    def _column(self, node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in self.df.columns:
                raise FormulaError(f"unknown name {node.id}")
            return F.col(node.id)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self._column(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](self._column(node.left), self._column(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            if node.func.id == "zscore":
                key = ast.dump(node.args[0])
                i = list(self._standardised).index(key)
                stat = F.col(STATS).getField
                return (self._standardised[key] - stat(f"m{i}")) * stat(f"k{i}")
            if node.func.id in _FUNCTIONS:
                return _FUNCTIONS[node.func.id](*[self._column(a) for a in node.args])
        raise FormulaError(f"not allowed in a formula: {ast.unparse(node)}")


def catalogue(sheets: list[str] | None = None) -> dict[str, str]:
    """feature column -> formula text for the chosen sheets."""
    chosen = sheets or list(fixed.FORMULAS)
    return {f"f_{s}_{slug}": text for s in chosen for slug, text in fixed.FORMULAS.get(s, {}).items()}


def with_formulas(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Adds one column per formula; the moments travel as one struct column."""
    compiler = FrameFormulas(df)
    columns = compiler.compile(formulas)
    return compiler.df.withColumns(columns).drop(STATS)


def sheet_metrics(df: DataFrame, sheet: str) -> DataFrame:
    return with_formulas(df, catalogue([sheet]))


def all_metrics(df: DataFrame) -> DataFrame:
    return with_formulas(df, catalogue())


def user_formula(df: DataFrame, formula: str, name: str = "result") -> DataFrame:
    """A formula supplied at run time; what cannot be read gives NULL."""
    try:
        return with_formulas(df, {name: formula})
    except FormulaError:
        return df.withColumn(name, F.lit(None).cast("double"))


