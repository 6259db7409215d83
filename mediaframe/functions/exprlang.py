"""The expression language of crop and scale: arithmetic on named values, evaluated in Python or as a column.

Grammar: sums of products of powers; ``^`` folds to the left and binds tighter than a sign before it; functions min max mod
floor ceil trunc round abs clip. A variable's name wins over a function's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from mediaframe.errors import MediaError

ARITY = {"min": 2, "max": 2, "mod": 2, "floor": 1, "ceil": 1, "trunc": 1, "round": 1, "abs": 1, "clip": 3}
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|([-+*/^(),]))")
DEPTH = 100


@dataclass(frozen=True)
class Node:
    kind: str  # number, name, neg, call or an operator
    value: float | str = 0.0
    args: tuple[Node, ...] = ()

    def names(self) -> set[str]:
        return ({self.value} if self.kind == "name" else set()).union(*(a.names() for a in self.args))  # type: ignore[arg-type]


class ExpressionError(MediaError):
    pass


def parse(text: str, names: set[str]) -> Node:
    tokens: list[tuple[str, str]] = []
    at = 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at:].strip()!r} in {text!r}")
        tokens.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos][1] if pos < len(tokens) and tokens[pos][0] == "op" else None

    def take(op: str) -> None:
        nonlocal pos
        if peek() != op:
            raise ExpressionError(f"expected {op!r} in {text!r}")
        pos += 1

    def total(depth: int) -> Node:
        nonlocal pos
        if depth > DEPTH:
            raise ExpressionError("expression is nested too deeply")
        node = product(depth)
        while (op := peek()) in ("+", "-"):
            pos += 1
            node = Node(op, args=(node, product(depth)))
        return node

    def product(depth: int) -> Node:
        nonlocal pos
        node = power(depth)
        while (op := peek()) in ("*", "/"):
            pos += 1
            node = Node(op, args=(node, power(depth)))
        return node

    def sign() -> bool:
        nonlocal pos
        negative = False
        if peek() in ("+", "-"):
            negative = peek() == "-"
            pos += 1
        return negative

    def power(depth: int) -> Node:
        nonlocal pos
        negative = sign()
        node = primary(depth)
        while peek() == "^":
            pos += 1
            minus = sign()
            right = primary(depth)
            node = Node("^", args=(node, Node("neg", args=(right,)) if minus else right))
        return Node("neg", args=(node,)) if negative else node

    def primary(depth: int) -> Node:
        nonlocal pos
        if pos >= len(tokens):
            raise ExpressionError(f"{text!r} ends too early")
        kind, value = tokens[pos]
        if kind == "number":
            pos += 1
            return Node("number", float(value))
        if kind == "name":
            pos += 1
            if value in names:
                return Node("name", value)
            if value not in ARITY:
                raise ExpressionError(f"undefined name {value!r} in {text!r}")
            take("(")
            args = [total(depth + 1)]
            while peek() == ",":
                pos += 1
                args.append(total(depth + 1))
            take(")")
            if len(args) != ARITY[value]:
                raise ExpressionError(f"{value} takes {ARITY[value]} values, {len(args)} given")
            return Node("call", value, tuple(args))
        take("(")
        node = total(depth + 1)
        take(")")
        return node

    node = total(0)
    if pos != len(tokens):
        raise ExpressionError(f"unexpected {tokens[pos][1]!r} in {text!r}")
    return node


def _div(a: float, b: float) -> float:
    return a / b if b else a * math.inf


def _round(a: float) -> float:
    return math.copysign(math.floor(abs(a) + 0.5), a) if math.isfinite(a) else a


def _whole(f: Callable[[float], int]) -> Callable[[float], float]:
    return lambda a: float(f(a)) if math.isfinite(a) else a


def _power(a: float, b: float) -> float:
    try:
        out = a**b
        return out if isinstance(out, float) else math.nan
    except ZeroDivisionError:
        return math.inf
    except OverflowError:
        return math.inf


def _clip(x: float, low: float, high: float) -> float:
    return math.nan if any(map(math.isnan, (x, low, high))) or low > high else min(max(x, low), high)


PLAIN: dict[str, Callable[..., float]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _div, "^": _power, "neg": lambda a: -a,
    "min": lambda a, b: a if a < b else b, "max": lambda a, b: a if a > b else b, "mod": lambda a, b: a - PLAIN["floor"](_div(a, b)) * b,
    "floor": _whole(math.floor), "ceil": _whole(math.ceil), "trunc": _whole(math.trunc), "round": _round, "abs": abs, "clip": _clip,
}


def evaluate(node: Node, values: Mapping[str, float]) -> float:
    if node.kind == "number":
        return float(node.value)
    if node.kind == "name":
        return float(values[node.value])  # type: ignore[index]
    f = PLAIN[str(node.value) if node.kind == "call" else node.kind]
    return f(*(evaluate(a, values) for a in node.args))


def column(node: Node, values: Mapping[str, Column]) -> Column:
    """The expression over DOUBLE columns, with the same results, also under ANSI mode."""
    if node.kind == "number":
        return F.lit(float(node.value))
    if node.kind == "name":
        return values[node.value].cast("double")  # type: ignore[index]
    a = [column(x, values) for x in node.args]
    op = str(node.value) if node.kind == "call" else node.kind
    nan, inf = F.lit(math.nan), F.lit(math.inf)
    div = lambda x, y: F.when(y != 0, F.try_divide(x, y)).otherwise(x * inf)
    below = lambda x, y: ~F.isnan(x) & ~F.isnan(y) & (x < y)
    whole = lambda f, x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))
    if op in ("+", "-", "*"):
        return a[0] + a[1] if op == "+" else a[0] - a[1] if op == "-" else a[0] * a[1]
    if op == "neg":
        return -a[0]
    return {
        "/": lambda x, y: div(x, y),
        "^": lambda x, y: F.pow(x, y),
        "min": lambda x, y: F.when(below(x, y), x).otherwise(y),
        "max": lambda x, y: F.when(below(y, x), x).otherwise(y),
        "mod": lambda x, y: x - whole(F.floor, div(x, y)) * y,
        "floor": lambda x: whole(F.floor, x),
        "ceil": lambda x: whole(F.ceil, x),
        "trunc": lambda x: whole(lambda v: F.signum(v) * F.floor(F.abs(v)), x),
        "round": lambda x: whole(lambda v: F.round(v, 0), x),
        "abs": F.abs,
        "clip": lambda x, lo, hi: F.when(F.isnan(x) | F.isnan(lo) | F.isnan(hi) | (lo > hi), nan).when(x < lo, lo).when(x > hi, hi).otherwise(x),
    }[op](*a)
