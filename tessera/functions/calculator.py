"""A calculator that goes from left to right, without precedence."""

from __future__ import annotations

import math
import re

_FUNCS = {"sqrt": math.sqrt, "abs": abs, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log10, "ln": math.log}
_OPS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "^": lambda a, b: a**b}


def evaluate(expr: str) -> float:
    """`2 + 3 * 4` is 20. Functions take a bracketed expression; pi and e are known."""
    s = re.sub(r"\s+", "", expr.lower())
    if not s:
        raise ValueError("nothing to calculate")
    at = 0

    def value() -> float:
        nonlocal at
        if at < len(s) and s[at] == "-":
            at += 1
            return -value()
        if m := re.compile(r"(sqrt|abs|sin|cos|tan|log|ln)?\(").match(s, at):
            at = m.end()
            inner = run()
            if at >= len(s) or s[at] != ")":
                raise ValueError("a bracket is not closed")
            at += 1
            return _FUNCS[m[1]](inner) if m[1] else inner
        if m := re.compile(r"pi|e|\d+\.?\d*|\.\d+").match(s, at):
            at = m.end()
            return {"pi": math.pi, "e": math.e}.get(m[0]) or float(m[0])
        raise ValueError(f"not understood: {s[at:]}")

    def run() -> float:
        nonlocal at
        x = value()
        while at < len(s) and s[at] in _OPS:
            op = s[at]
            at += 1
            x = _OPS[op](x, value())
        return x

    out = run()
    if at != len(s):
        raise ValueError(f"not understood: {s[at:]}")
    return out
