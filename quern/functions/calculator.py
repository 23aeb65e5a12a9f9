"""Arithmetic expressions over columns, from an allow-listed syntax tree."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTANTS = {"pi": math.pi, "e": math.e, "tau": math.tau, "inf": math.inf}
FUNCTIONS = {
    "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "log": F.log, "log2": F.log2, "log10": F.log10, "exp": F.exp,
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "degrees": F.degrees, "radians": F.radians, "max": F.greatest, "min": F.least,
}
MOST = 1000


def calculate(expression: str, **columns: Column) -> Column:
    """The value of an arithmetic expression; names are constants or the given columns."""
    return _column(ast.parse(expression, mode="eval").body, columns)


def _column(node: ast.AST, columns: dict) -> Column:
    match node:
        case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
            return F.lit(float(v))
        case ast.Name(id=name) if name in columns:
            return columns[name]
        case ast.Name(id=name) if name in CONSTANTS:
            return F.lit(CONSTANTS[name])
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_column(x, columns)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _column(x, columns)
        case ast.BinOp(left=a, op=op, right=b):
            x, y = _column(a, columns), _column(b, columns)
            match op:
                case ast.Add():
                    return x + y
                case ast.Sub():
                    return x - y
                case ast.Mult():
                    return x * y
                case ast.Div():
                    return x / y
                case ast.Mod():
                    return F.pmod(x, y)
                case ast.FloorDiv():
                    return F.floor(x / y)
                case ast.Pow():
                    if isinstance(b, ast.Constant) and abs(b.value) > MOST:
                        raise ValueError("exponent too large")
                    return F.pow(x, y)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            return FUNCTIONS[name](*[_column(a, columns) for a in args])
    raise ValueError(f"not allowed: {ast.dump(node)[:80]}")
