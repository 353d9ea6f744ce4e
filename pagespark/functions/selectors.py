"""CSS selectors as Catalyst predicates.

A selector is translated on the driver into one boolean Column, so matching needs no Python.
``node`` maps a field name to a Column: ``F.col`` for flat node rows, where Spark generates code
for it, or ``x.getField`` for a node inside a lambda, where Spark interprets it in the JVM.

Supported: ``tag``, ``.class``, ``#id``, ``[a]``, ``[a="v"]``, ``[a*="v"]``, compounds of
these, ``:not(...)`` of one simple selector, and comma lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Node = Callable[[str], Column]

_SIMPLE = re.compile(
    r"""(?P<not>:not\((?P<inner>[^()]+)\))
      | \[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<value>[^"]*)")?\]
      | \.(?P<cls>[\w-]+) | \#(?P<id>[\w-]+) | (?P<tag>[a-zA-Z][\w-]*|\*)""",
    re.X,
)


_COMMA = re.compile(r",(?![^\[]*\])")  # not inside [attr="a,b"]


def css(selector: str, node: Node = F.col) -> Column:
    """Predicate that is true for nodes matching any part of a comma list; never NULL."""
    return reduce(lambda a, b: a | b, [_compound(p.strip(), node) for p in _COMMA.split(selector)])


def _compound(text: str, node: Node) -> Column:
    tests, pos = [], 0
    while pos < len(text):
        m = _SIMPLE.match(text, pos)
        if m is None:
            raise ValueError(f"unsupported selector: {text!r}")
        tests.append(~_compound(m["inner"], node) if m["not"] else _simple(m, node))
        pos = m.end()
    if not tests:
        raise ValueError("empty selector")
    return reduce(lambda a, b: a & b, tests)


def _simple(m: re.Match, node: Node) -> Column:
    if m["tag"]:
        return F.lit(True) if m["tag"] == "*" else node("tag") == m["tag"].upper()
    if m["cls"]:
        return F.array_contains(node("classes"), m["cls"])
    if m["id"]:
        return F.coalesce(node("id") == m["id"], F.lit(False))
    value = F.try_element_at(node("attrs"), F.lit(m["attr"].lower()))
    if m["op"] is None:
        return value.isNotNull()
    test = value == m["value"] if m["op"] == "=" else F.contains(value, F.lit(m["value"]))
    return F.coalesce(test, F.lit(False))


def first_match(selectors: Sequence[str], node: Node = F.col) -> Column:
    """Position of the first matching selector, NULL when none matches; row-local."""
    out = F.when(css(selectors[0], node), F.lit(0))
    for i, s in enumerate(selectors[1:], 1):
        out = out.when(css(s, node), F.lit(i))
    return out


def all_matches(selectors: Sequence[str], node: Node = F.col) -> Column:
    """Array of the positions of every matching selector."""
    return F.array_compact(F.array(*[F.when(css(s, node), F.lit(i)) for i, s in enumerate(selectors)]))


def selector_name(selectors: Sequence[str], ix: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in selectors]), ix + 1)
