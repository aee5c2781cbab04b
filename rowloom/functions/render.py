"""Text, HTML and single values. These bring rows to the driver: they are for looking at small views."""

from __future__ import annotations

import html as _html
from typing import Any

from pyspark.sql import functions as F

from rowloom.functions.schema import meta, types
from rowloom.operators.position import first
from rowloom.plans.registry import operator
from rowloom.plans.view import View

WIDEST = 50


def _shown(value: Any) -> str:
    if isinstance(value, (bytes, bytearray)):
        return f"{len(value)}b"
    if isinstance(value, list):
        return f"#{len(value)}"
    return "" if value is None else str(value)


@operator
def dump(v: View, maxrows: int = 20) -> str:
    """Fixed-width text of the first rows: bytes as Nb, nested views as #N, columns of 50 characters at most."""
    if not v.width:
        return f"  ({v.df.count()} rows, no columns)"
    rows = first(v, maxrows + 1).rows()
    more, rows = len(rows) > maxrows, rows[:maxrows]
    cells = [[_shown(x) for x in r] for r in rows]
    kinds = types(v)
    wide = [min(WIDEST, max(len(n), *(len(r[i]) for r in cells), 0)) if cells else len(n) for i, n in enumerate(v.names)]
    fit = lambda x, i: (x[: wide[i]].rjust if kinds[i] in "ILFD" else x[: wide[i]].ljust)(wide[i])
    lines = ["  " + "  ".join(fit(n, i) for i, n in enumerate(v.names)).rstrip(), "  " + "  ".join("-" * w for w in wide)]
    lines += ["  " + "  ".join(fit(x, i) for i, x in enumerate(r)).rstrip() for r in cells]
    return "\n".join([*lines, *(["  ..."] if more else [])])


@operator
def html(v: View) -> str:
    """An HTML table with row numbers; nested views are tables in cells."""

    def table(names: list[str], rows: list[Any]) -> str:
        head = "<tr><th></th>" + "".join(f"<th>{_html.escape(n)}</th>" for n in names) + "</tr>"
        return "<table>" + head + "".join(f"<tr><td>{i}</td>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for i, r in enumerate(rows)) + "</table>"

    def cell(x: Any) -> str:
        if isinstance(x, list):
            return table(list(x[0].asDict()) if x else [], x)
        return _html.escape(_shown(x))

    return table(list(v.names), v.rows())


@operator
def get(v: View, *path: Any) -> Any:
    """Follows a path: nothing for all items in one list; ``#`` for the row count, ``@`` for the schema, ``*`` for all rows; a row number (negative from the end) for a row; then a column for a cell, and so on into nested views."""
    if not path:
        return [x for r in v.rows() for x in r]
    step, *rest = path
    if step == "#":
        return v.df.count()
    if step == "@":
        return get(meta(v), *rest) if rest else meta(v)
    if step == "*":
        return [r[v.at(rest[0])] for r in v.rows()] if rest else v.rows()
    if isinstance(step, str) and not step.lstrip("-").isdigit():
        return get(v, "*", step)
    from rowloom.operators.sorting import row_at

    found = row_at(v, int(step)).rows()
    if not found:
        raise IndexError("row out of range")
    if not rest:
        return found[0]
    value = int(step) if rest[0] == "#" else found[0][v.at(rest[0])]
    for s in rest[1:]:
        value = len(value) if s == "#" else value[s] if isinstance(s, (int, str)) else value
    return value


@operator
def lengths(v: View, column: str | int) -> list[int]:
    """Characters, bytes or nested rows of each cell of a column."""
    c = v.col(column)
    size = F.size(c) if types(v)[v.at(column)] == "V" else F.length(c)
    return [r[0] for r in v.with_columns([("n", size)]).rows()]
