"""Whole-number expressions of C: their value, with names known from a map."""

from __future__ import annotations

import operator
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\s*(0[xX][0-9A-Fa-f]+[uUlL]*|\d+[uUlL]*(?![\w.])|[A-Za-z_]\w*|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^~!<>()])")
#: Binary operators of C from loose to tight.
LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", "<=", ">", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]
TIGHTNESS = {op: k for k, ops in enumerate(LEVELS) for op in ops}
UNARY = len(LEVELS)
COMPARES = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
PLAIN = {"+": operator.add, "-": operator.sub, "*": operator.mul, "&": operator.and_, "|": operator.or_, "^": operator.xor}
EVALUATED = T.StructType([T.StructField("value", T.LongType()), T.StructField("text", T.StringType())])
NAME = re.compile(r"(?<![\w.])[A-Za-z_]\w*")


def _number(text: str) -> int:
    digits = text.rstrip("uUlL")
    if digits[:2] in ("0x", "0X"):
        return int(digits, 16)
    return int(digits, 8 if len(digits) > 1 and digits[0] == "0" else 10)


def _binary(op: str, a: int, b: int) -> int:
    """The result as C gives it: quotients are cut toward zero, and comparisons are 0 or 1."""
    if op in ("/", "%"):
        whole = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return whole if op == "/" else a - b * whole
    if op in ("<<", ">>"):
        if not 0 <= b < 64:
            raise ValueError(op)
        return a << b if op == "<<" else a >> b
    if op in ("&&", "||"):
        return int(bool(a) and bool(b)) if op == "&&" else int(bool(a) or bool(b))
    if op in COMPARES:
        return int(COMPARES[op](a, b))
    return PLAIN[op](a, b)


def value_of(text: str | None, names: dict[str, int] | None = None) -> int | None:
    """The value of an expression by operator precedence; None for what is none, for unknown names and beyond 64 bits."""
    values: list[int] = []
    waiting: list[str] = []

    def reduce() -> None:
        op = waiting.pop()
        if op.startswith("u"):
            a = values.pop()
            values.append({"u-": -a, "u+": a, "u~": ~a, "u!": int(not a)}[op])
        else:
            b, a = values.pop(), values.pop()
            values.append(_binary(op, a, b))

    tight = lambda op: UNARY if op.startswith("u") else TIGHTNESS.get(op, -1)
    at, operand, text = 0, True, (text or "").strip()
    try:
        while at < len(text):
            m = TOKEN.match(text, at)
            if m is None:
                return None
            at, token = m.end(), m[1]
            if operand and token in ("-", "+", "~", "!"):
                waiting.append("u" + token)
            elif token == "(" and operand:
                waiting.append(token)
            elif token == ")" and not operand:
                while waiting[-1] != "(":
                    reduce()
                waiting.pop()
            elif token in TIGHTNESS and not operand:
                while waiting and tight(waiting[-1]) >= TIGHTNESS[token]:
                    reduce()
                waiting.append(token)
                operand = True
            elif operand and token not in TIGHTNESS and token not in ("(", ")", "~", "!"):
                values.append(_number(token) if token[0].isdigit() else int((names or {})[token]))
                operand = False
            else:
                return None
        if operand or "(" in waiting:
            return None
        while waiting:
            reduce()
        return values[0] if len(values) == 1 and -(2**63) <= values[0] < 2**63 else None
    except (ArithmeticError, IndexError, KeyError, ValueError):
        return None


@F.pandas_udf(EVALUATED)
def evaluated(text: pd.Series, names: pd.Series) -> pd.DataFrame:
    """The value of each expression with its map of names, and its text with those names put in."""
    known = [dict(n) if n is not None else {} for n in names]
    put_in = [NAME.sub(lambda m, k=k: str(k[m[0]]) if m[0] in k else m[0], t or "") for t, k in zip(text, known, strict=True)]
    return pd.DataFrame({"value": pd.array([value_of(t, k) for t, k in zip(text, known, strict=True)], dtype="Int64"), "text": put_in})
