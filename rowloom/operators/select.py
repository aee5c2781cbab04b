"""Selection by criteria, as row positions.

A criterion is (kind, columns, key): exact, glob, globnc (glob without case) or keyword (a word
of the text starts with the key, without case; the key is a regular expression). Criteria must
all hold; of several columns in one criterion any may match.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

from rowloom.operators.position import first as first_rows
from rowloom.plans.registry import operator
from rowloom.plans.view import View


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: * ? [set] and backslash."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            out.append("[" + glob[i + 1 : end].replace("\\", "\\\\").replace("^", "\\^").replace("[", "\\[") + "]")
            i = end
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
            out.append(re.escape(glob[i]))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def _matches(column: Column, kind: str, key: Any) -> Column:
    text = column.cast("string")
    if kind == "exact":
        return column == F.lit(key)
    if kind == "glob":
        return text.rlike(glob_pattern(key))
    if kind == "globnc":
        return text.rlike("(?i)" + glob_pattern(key))
    if kind == "keyword":
        return text.rlike(f"(?i)\\b{key}")
    raise ValueError(f"unknown kind of criterion: {kind}")


@operator
def select(v: View, criteria: Sequence[tuple[str, Sequence[str | int] | str | int, Any]] = (), sort: Sequence[str | int] = (), rsort: Sequence[str | int] = (), first: int = 0, count: int | None = None) -> View:
    """Positions of matching rows, sorted, then from ``first`` on, at most ``count``.

    ``rsort`` keys come before ``sort`` keys and turn the whole order so far: less significant
    keys and ties go backwards, too.
    """
    conditions = [reduce(lambda a, b: a | b, [_matches(v.col(c), kind, key) for c in ([columns] if isinstance(columns, (str, int)) else columns)]) for kind, columns, key in criteria]
    by = [*rsort, *sort]
    # Only whether a row matches and its sort keys are numbered, not the other columns.
    needed = [("matches", reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)), *((str(c), v.col(c)) for c in by)]
    w = View.build(v.df, needed, v.ordering(), v.dense).numbered()
    found = w.df.filter("c0")
    keys = [(F.col("_o0"), True)]
    for i in reversed(range(len(rsort), len(by))):
        keys.insert(0, (F.col(f"c{i + 1}"), True))
    for i in reversed(range(len(rsort))):
        keys = [(F.col(f"c{i + 1}"), False), *((k, not up) for k, up in keys)]
    out = View.build(found, [("index", F.col("_o0"))], keys)
    if first:
        numbered = out.numbered()
        out = View(numbered.df.filter(numbered.rid() >= first), numbered.names, numbered.order)
    return out if count is None else first_rows(out, count)
