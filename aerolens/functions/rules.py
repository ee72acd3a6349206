"""A small language of colour rules: comparisons of L, a, b and C with numbers, joined by &."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
_TERM = re.compile(r"\s*([LabC])\s*(>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)\s*\Z")


def parse_rule(rule: str) -> list[tuple[str, str, float]]:
    out = []
    for part in rule.split("&"):
        m = _TERM.match(part)
        if not m:
            raise ValueError(f"not a rule: {part!r} in {rule!r}")
        out.append((m[1], m[2], float(m[3])))
    return out


def rule_column(rule: str, l: Column | None = None, a: Column | None = None, b: Column | None = None) -> Column:  # noqa: E741
    """The rule as a predicate over columns L, a and b; C is the chroma of a and b."""
    l, a, b = (x if x is not None else F.col(n) for x, n in ((l, "L"), (a, "a"), (b, "b")))  # noqa: E741
    names = {"L": l, "a": a, "b": b, "C": F.hypot(a, b)}
    out = F.lit(True)
    for name, op, x in parse_rule(rule):
        out = out & _OPS[op](names[name], F.lit(x))
    return out
