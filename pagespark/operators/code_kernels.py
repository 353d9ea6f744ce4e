"""K2 and K3: one file -> definitions, two texts -> line differences.  Inside Spark tasks only.

Both need what SQL lacks (a grammar, and difflib's matching with its junk heuristic);
everything after them is Column expressions.
"""

from __future__ import annotations

import ast
import difflib

KINDS = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}


def definitions_of(source: str | None) -> tuple[list[dict], str | None]:
    """Every function and class in pre-order, with 0-based inclusive lines, and the parse error if any."""
    if source is None or not source.strip():
        return [], None
    try:
        tree = ast.parse(source)
    except Exception as e:  # syntax errors, NUL bytes, nesting limits: the file yields nothing
        return [], f"{type(e).__name__}: {e}"
    lines, out = source.splitlines(), []
    # an explicit stack, because code can nest expressions deeper than Python recurses
    todo = [(tree, "")]
    while todo:
        node, prefix = todo.pop()
        kind = KINDS.get(type(node))
        if kind:
            prefix = f"{prefix}.{node.name}" if prefix else node.name
            first, last = node.lineno - 1, node.end_lineno - 1
            out.append(
                {
                    "ord": len(out),
                    "name": node.name,
                    "qualname": prefix,
                    "node_type": kind,
                    "start_line": first,
                    "end_line": last,
                    "source_code": "\n".join(lines[first : last + 1]),
                    "decorators": [ast.unparse(d) for d in node.decorator_list],
                    "docstring": _docstring(node),
                }
            )
        todo.extend((child, prefix) for child in reversed(list(ast.iter_child_nodes(node))))
    return out, None


def _docstring(node) -> str | None:
    first = node.body[0] if node.body else None
    value = first.value if isinstance(first, ast.Expr) else None
    return value.value if isinstance(value, ast.Constant) and isinstance(value.value, str) else None


def line_statuses(old: str | None, new: str | None) -> list[dict]:
    """Status of every line on both sides; inside a replaced block, old lines map to new ones in order."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    names = {"equal": ("unchanged", "unchanged"), "replace": ("changed", "changed"), "delete": ("removed", None),
             "insert": (None, "added")}
    olds, news = [], []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        for i in range(i1, i2):
            j = j1 + i - i1
            mapped = j if op == "replace" and j < j2 else None
            olds.append({"side": "old", "line_no": i, "status": names[op][0], "mapped_line": mapped, "line": a[i]})
        for j in range(j1, j2):
            news.append({"side": "new", "line_no": j, "status": names[op][1], "mapped_line": None, "line": b[j]})
    return olds + news


def unified(old: str | None, new: str | None, old_label: str, new_label: str) -> str:
    a, b = (old or "").splitlines(), (new or "").splitlines()
    return "\n".join(difflib.unified_diff(a, b, fromfile=old_label, tofile=new_label, lineterm=""))
