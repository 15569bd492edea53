"""Script expressions as Spark Columns: variables name columns, and every row is evaluated in the JVM.

Whole numbers are BIGINT within an expression, so that products don't overflow;
comparisons and logic give 1 or 0, and both sides of && and || are evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.script.language import Parser, ScriptError


def _truth(c: Column) -> Column:
    return c != 0


def _whole_division(a: Column, b: Column) -> Column:
    q = F.abs(a) - F.abs(a) % F.abs(b)
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise((q / F.abs(b)).cast("long") * F.when((a < 0) == (b < 0), 1).otherwise(-1))


_BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _whole_division, "%": lambda a, b: a % b,
    "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b),
    "<": lambda a, b: (a < b).cast("long"), ">": lambda a, b: (a > b).cast("long"), "<=": lambda a, b: (a <= b).cast("long"), ">=": lambda a, b: (a >= b).cast("long"),
    "==": lambda a, b: (a == b).cast("long"), "!=": lambda a, b: (a != b).cast("long"),
    "&&": lambda a, b: (_truth(a) & _truth(b)).cast("long"), "||": lambda a, b: (_truth(a) | _truth(b)).cast("long"),
}
_UNARY = {"-": lambda a: -a, "+": lambda a: a, "~": F.bitwise_not, "!": lambda a: (~_truth(a)).cast("long")}
_CASTS = {"i": "int", "l": "long", "d": "double"}


def compile_expression(text: str) -> Column:
    parser = Parser(text)
    node = parser.expression()
    if parser.at != len(parser.tokens):
        raise ScriptError("expected one expression")
    return _column(node)


def _column(node: tuple) -> Column:
    what, *parts = node
    if what == "const":
        v = parts[0]
        return F.lit(v).cast("long") if isinstance(v, int) else F.lit(v)
    if what == "name":
        return F.col(parts[0])
    if what == "binary":
        return _BINARY[parts[0]](_column(parts[1]), _column(parts[2]))
    if what == "unary":
        return _UNARY[parts[0]](_column(parts[1]))
    if what == "cast":
        return _column(parts[1]).cast(_CASTS[parts[0]])
    raise ScriptError(f"{what} has no meaning in a column")
