"""Grading of make-24 puzzles: columns for the text, a small Arrow function for the arithmetic."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def evaluate(expression: str | None) -> float | None:
    """The value of an expression of integers, + - * / and parentheses; None if it is anything else."""

    def of(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) is int:
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return -of(node.operand) if isinstance(node.op, ast.USub) else of(node.operand)
        raise ValueError

    try:
        return float(of(ast.parse((expression or "").strip(), mode="eval").body))
    except (ValueError, SyntaxError, ZeroDivisionError, RecursionError, OverflowError, MemoryError):
        return None


@F.pandas_udf(T.DoubleType())
def _value(expressions: pd.Series) -> pd.Series:
    return pd.Series([evaluate(x) for x in expressions], dtype="float64")


def only_boxed(x: Column) -> Column:
    """The content of the only box of a text."""
    found = F.regexp_extract_all(x, F.lit(r"\\boxed\{(.*?)\}"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def makes_24(answer: Column, puzzle: Column) -> Column:
    """Whether an answer uses each number of the puzzle (array of int) once and comes to 24."""
    bare = F.regexp_replace(answer, r"\s*=\s*24\s*$", "")
    allowed = bare.rlike(r"^[\d+*/\-()\s\\timesfrac{}]+$")
    expression = F.regexp_replace(F.regexp_replace(bare, r"\\times", "*"), r"\\frac\{([^}]+)\}\{([^}]+)\}", "($1)/($2)")
    used = F.sort_array(F.transform(F.regexp_extract_all(expression, F.lit(r"\d+"), F.lit(0)), lambda s: s.try_cast("int")))
    candidate = allowed & (used == F.sort_array(puzzle))
    value = _value(F.when(F.coalesce(candidate, F.lit(False)), expression))
    return F.coalesce(F.abs(value - 24) < 1e-6, F.lit(False))


def reaches(numbers: tuple[float, ...], target: float = 24.0) -> bool:
    """Whether + - * / over all numbers, each once, can come to the target: pairs are merged until one number is left."""
    sets = {tuple(sorted(numbers))}
    for _ in range(len(numbers) - 1):
        merged = set()
        for s in sets:
            for i in range(len(s)):
                for j in range(i):
                    a, b, rest = s[i], s[j], s[:j] + s[j + 1 : i] + s[i + 1 :]
                    values = [a + b, a - b, b - a, a * b] + ([a / b] if b else []) + ([b / a] if a else [])
                    merged.update(tuple(sorted((*rest, round(v, 9)))) for v in values)
        sets = merged
    return any(abs(s[0] - target) < 1e-6 for s in sets if s)


@F.pandas_udf(T.BooleanType())
def can_make_24(puzzles: pd.Series) -> pd.Series:
    """Whether the numbers of a puzzle can come to 24; give it distinct puzzles."""
    return pd.Series([p is not None and len(p) > 0 and reaches(tuple(float(x) for x in p)) for p in puzzles], dtype="bool")
