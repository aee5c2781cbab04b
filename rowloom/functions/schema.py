"""Schemas as text and as data: two descriptor grammars, type strings, meta views."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import SparkSession, types as T

from rowloom.plans.registry import operator
from rowloom.plans.view import LETTERS, View, letter

KINDS: dict[str, T.DataType] = {v: k() for k, v in LETTERS.items()}
Meta = list[tuple[str, str, Any]]  # name, type letter, nested meta


def mdef(definition: Any) -> Meta:
    """A nested list definition: ``"A"``, ``"B:I"``, ``("C", ["D:L"])`` for nested columns, ``"C:V"`` for untyped ones."""
    out: Meta = []
    for item in definition.split() if isinstance(definition, str) else definition:
        if isinstance(item, str):
            name, _, kind = item.partition(":")
            kind = kind or "S"
            if kind not in "BDFLISV" or len(kind) != 1:
                raise ValueError(f"unknown type: {kind}")
            out.append((name, kind, []))
        else:
            name, nested = item
            out.append((name, "V", mdef(nested)))
    return out


def mdesc(text: str) -> Meta:
    """A flat descriptor: ``A,B:I,C[D:L]``."""
    tokens = re.findall(r"[\[\],]|[^\[\],]+", text)
    at = 0

    def columns() -> Meta:
        nonlocal at
        out: Meta = []
        while at < len(tokens) and tokens[at] != "]":
            name = tokens[at]
            if name in "[],":
                raise ValueError("invalid view")
            at += 1
            if at < len(tokens) and tokens[at] == "[":
                at += 1
                nested = columns()
                if at >= len(tokens) or tokens[at] != "]":
                    raise ValueError("invalid view")
                at += 1
                out.append((name, "V", nested))
            else:
                out += mdef([name])
            if at < len(tokens) and tokens[at] == ",":
                at += 1
                if at == len(tokens) or tokens[at] == "]":
                    raise ValueError("invalid view")
        return out

    found = columns()
    if at != len(tokens):
        raise ValueError("invalid view")
    return found


def struct_of(meta: Meta) -> T.StructType:
    """Nested columns become arrays of structs; untyped ones, and those without columns, cannot be stored as such."""
    fields = []
    for name, kind, nested in meta:
        if kind == "V" and not nested:
            raise ValueError(f"column {name} has no structure")
        fields.append(T.StructField(name, T.ArrayType(struct_of(nested)) if kind == "V" else KINDS[kind]))
    return T.StructType(fields)


def meta_of(fields: list[tuple[str, T.DataType]]) -> Meta:
    return [(n, letter(k), meta_of([(f.name, f.dataType) for f in k.elementType]) if letter(k) == "V" else []) for n, k in fields]


def fields_of(v: View) -> list[tuple[str, T.DataType]]:
    return [(n, v.kind(i)) for i, n in enumerate(v.names)]


def desc_of(m: Meta) -> str:
    return ",".join(f"{n}[{desc_of(s)}]" if s else n if k == "S" else f"{n}:{k}" for n, k, s in m)


def letters_of(m: Meta) -> str:
    return "".join(f"({letters_of(s)})" if s else k for _, k, s in m)


@operator
def meta(v: View) -> View:
    """The schema as a view with the columns name, type and subv (the nested schema as a descriptor)."""
    rows = [(i, n, k, desc_of(s)) for i, (n, k, s) in enumerate(meta_of(fields_of(v)))]
    return View.of(v.spark.createDataFrame(rows, "i int, name string, type string, subv string"), ["i"], ["name", "type", "subv"])


@operator
def names(v: View) -> list[str]:
    return list(v.names)


@operator
def namecol(v: View) -> View:
    """The names as a view of one column."""
    return View.of(v.spark.createDataFrame(list(enumerate(v.names)), "i int, name string"), ["i"], ["name"])


@operator
def types(v: View) -> list[str]:
    return [k for _, k, _ in meta_of(fields_of(v))]


@operator
def structure(v: View) -> str:
    """Type letters, nested ones in parentheses."""
    return letters_of(meta_of(fields_of(v)))


@operator
def structdesc(v: View) -> str:
    """The flat descriptor; ``mdesc`` reads it back."""
    return desc_of(meta_of(fields_of(v)))


@operator
def size(v: View) -> int:
    return v.df.count()


@operator
def width(v: View) -> int:
    return v.width


def types_match(a: Meta, b: Meta) -> bool:
    return len(a) == len(b) and all(x[1] == y[1] and types_match(x[2], y[2]) for x, y in zip(a, b))


@operator
def compat(v: View, w: View) -> bool:
    """Whether the column types match place by place, nested ones too; names don't matter."""
    return types_match(meta_of(fields_of(v)), meta_of(fields_of(w)))


def need_compat(v: View, w: View) -> None:
    if not compat(v, w):
        raise ValueError("invalid view")


@operator(name="type")
def type_name(value: Any) -> str:
    return type(value).__name__


@operator
def trace(value: Any, level: str = "INFO") -> Any:
    """Sets Spark's log level and goes on."""
    SparkSession.active().sparkContext.setLogLevel(level)
    return value


@operator
def lineage(v: View) -> str:
    """Spark's plans of the view."""
    return v.df._jdf.queryExecution().toString()
