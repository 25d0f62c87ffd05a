"""Answers in LaTeX: the content of boxes, a normal form, and equivalence of expressions."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.numbers import close, let, parse_number
from tallyforge.functions.text import strip

_BOX = "\\boxed{"


def last_box(text: str | None) -> str | None:
    """Content of the last closed box of a text, whatever the braces nest; a box that never closes ends the search."""
    found, at = None, 0
    while text is not None and (start := text.find(_BOX, at)) >= 0:
        open_at = start + len(_BOX)
        depth, end = 1, None
        for brace in re.finditer(r"[{}]", text[open_at:]):
            depth += 1 if brace.group() == "{" else -1
            if not depth:
                end = open_at + brace.start()
                break
        if end is None:
            break
        found, at = text[open_at:end].strip(), end + 1
    return found


@F.pandas_udf(T.StringType())
def _last_box(texts: pd.Series) -> pd.Series:
    return texts.map(last_box, na_action="ignore")


def boxed_answer(text: Column) -> Column:
    """As ``last_box``; texts without a box are not sent to Python."""
    return _last_box(F.when(text.contains(_BOX), text))


#: Rewrites in order; each as (pattern, replacement, whether the pattern is a regular expression).
REWRITES = [
    *[(rf"\\{name}\{{([^}}]*)\}}", "$1", True) for name in ("text", "mathrm", "textbf", "mathbf", "displaystyle")],
    ("$", "", False),
    ("\\left", "", False),
    ("\\right", "", False),
    (r"\\frac\{([^}]*)\}\{([^}]*)\}", "($1)/($2)", True),
    (r"\\sqrt\{([^}]*)\}", "sqrt($1)", True),
    (r"\\sqrt\[([^\]]*)\]\{([^}]*)\}", "($2)**(1/($1))", True),
    (r"\^\{([^}]*)\}", "**($1)", True),
    (r"\^(\w)", "**$1", True),
    ("\\pi", "pi", False),
    ("\\infty", "oo", False),
    ("\\cdot", "*", False),
    ("\\times", "*", False),
    (r"\\[a-zA-Z]+", "", True),
    (r"\\[,;!: ]", "", True),
    (r"[\s\p{Z}]+", " ", True),
]


def normal_form(answer: Column) -> Column:
    """LaTeX rewritten into plain arithmetic text; the order of the rewrites matters."""
    out = strip(answer)
    for pattern, replacement, regular in REWRITES:
        out = F.regexp_replace(out, pattern, replacement) if regular else F.replace(out, F.lit(pattern), F.lit(replacement))
    return strip(out)


# Expressions are compared by value: parsed by a small grammar (nothing is evaluated as code) and computed at
# fixed points of their variables.
_LEXEME = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|(sqrt|pi|oo|[A-Za-z])|(\*\*|[-+*/()^]))")
_POINTS = (0.7310585786, 1.6180339887, -1.3247179572, 2.2360679775, -2.7182818284, 3.3019272488)


def _parse(text: str):
    tokens, at = [], 0
    while at < len(text.rstrip()):
        found = _LEXEME.match(text, at)
        if not found or found.end() == at:
            raise ValueError(text)
        tokens.append(found.group(1) or found.group(2) or found.group(3))
        at = found.end()
    tokens.append("")
    place = 0

    def peek():
        return tokens[place]

    def take(expected=None):
        nonlocal place
        token = tokens[place]
        if expected is not None and token != expected:
            raise ValueError(text)
        place += 1
        return token

    def total():
        node = product()
        while peek() in ("+", "-"):
            node = (take(), node, product())
        return node

    def product():
        node = signed()
        while True:
            if peek() in ("*", "/"):
                node = (take(), node, signed())
            elif peek() and (peek() == "(" or peek()[0].isalnum() or peek()[0] == "."):
                node = ("*", node, power())  # juxtaposed
            else:
                return node

    def signed():
        if peek() in ("+", "-"):
            return ("neg", signed()) if take() == "-" else signed()
        return power()

    def power():
        base = atom()
        if peek() in ("**", "^"):
            take()
            return ("**", base, signed())
        return base

    def atom():
        token = take()
        if token == "(":
            node = total()
            take(")")
            return node
        if token == "sqrt":
            take("(")
            node = total()
            take(")")
            return ("sqrt", node)
        if token and (token[0].isdigit() or token[0] == "."):
            return float(token)
        if token and token[0].isalpha():
            return token
        raise ValueError(text)

    node = total()
    if peek():
        raise ValueError(text)
    return node


def _value(node, point: float) -> complex:
    if isinstance(node, float):
        return node
    if isinstance(node, str):
        if node == "oo":
            return math.inf
        return math.pi if node == "pi" else (ord(node) % 13 + 1) / 7 * point + point * point / 11
    op, *parts = node
    a = _value(parts[0], point)
    if op == "neg":
        return -a
    if op == "sqrt":
        return complex(a) ** 0.5
    b = _value(parts[1], point)
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return a / b
    if abs(b) > 4096 or abs(a) > 1e12:
        raise ValueError("too large")
    return complex(a) ** b


def same_value(a: str | None, b: str | None) -> bool | None:
    """Whether two expressions have equal values; None if either is no expression."""
    if a is None or b is None:
        return None
    try:
        left, right = _parse(a), _parse(b)
        for point in _POINTS:
            x, y = complex(_value(left, point)), complex(_value(right, point))
            if x == y:
                continue
            if not abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y)):
                return False
        return True
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError, TypeError):
        return None


@F.pandas_udf(T.BooleanType())
def _same_value(pairs: pd.DataFrame) -> pd.Series:
    return pd.Series([same_value(x, y) for x, y in zip(pairs["a"], pairs["b"])], dtype="object")


def math_match(prediction: Column, reference: Column, symbolic: bool = True) -> Column:
    """Two answers agree: as numbers if both are (and then that is final), else by value, else as text.

    Only pairs that numbers and text leave undecided are sent to Python. Null on either side is no match.
    """
    p, r = normal_form(prediction), normal_form(reference)
    pair = F.struct(parse_number(p).alias("a"), parse_number(r).alias("b"))
    numeric = let(pair, lambda v: F.when(v["a"].isNotNull() & v["b"].isNotNull(), close(v["a"], v["b"])))
    decided = F.coalesce(numeric, F.when(p == r, F.lit(True)))
    if not symbolic:
        return F.coalesce(decided, F.lit(False))
    by_value = _same_value(F.when(decided.isNull(), F.struct(p.alias("a"), r.alias("b"))))
    return F.coalesce(decided, by_value, F.lit(False))
