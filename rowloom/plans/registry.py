"""Named operators, named views and pipelines.

An operator is a function whose first argument is a view. ``@operator`` registers one, built in
or a user's own; every registered operator is a method of ``View`` and a stage of ``pipe``.
Views under a name are kept as builders, so a view that refers to another follows its changes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from rowloom.plans.view import View

OPERATORS: dict[str, Callable[..., Any]] = {}


def operator(fn: Callable[..., Any] | None = None, name: str | None = None) -> Callable[..., Any]:
    """Registers a function as an operator under its own or another name."""
    if fn is None:
        return lambda f: operator(f, name)
    OPERATORS[name or fn.__name__] = fn
    return fn


Stage = str | tuple | Callable[[Any], Any]


def run_stage(value: Any, stage: Stage) -> Any:
    if callable(stage):
        return stage(value)
    name, *args = (stage,) if isinstance(stage, str) else stage
    if name not in OPERATORS:
        raise KeyError(f"unknown operator: {name}")
    return OPERATORS[name](value, *args)


@operator
def pipe(value: Any, *stages: Stage) -> Any:
    """Hands the value from stage to stage: (operator, argument...), an operator's name, or a function."""
    for stage in stages:
        value = run_stage(value, stage)
    return value


@operator
def do(value: Any, script: Sequence[Stage | None]) -> Any:
    """A pipeline as a list; None and strings that start with # are comments."""
    return pipe(value, *(s for s in script if s is not None and not (isinstance(s, str) and s.startswith("#"))))


@operator
def debug(value: Any, script: Sequence[Stage | None], show: Callable[[str], None] = print) -> Any:
    """As ``do``, showing rows, columns and milliseconds after each stage; the stage ``?`` shows the value itself."""
    from rowloom.functions.render import dump

    for stage in script:
        if stage is None or isinstance(stage, str) and stage.startswith("#"):
            continue
        if stage == "?":
            show(dump(value) if isinstance(value, View) else str(value))
            continue
        began = time.perf_counter()
        value = run_stage(value, stage)
        if isinstance(value, View):
            rows = value.df.count()
            show(f"{rows} rows, {value.width} cols, {1000 * (time.perf_counter() - began):.0f} ms: {stage}")
    return value


@operator
def use(_: Any, other: Any) -> Any:
    """Goes on with another value."""
    return other


class Registry:
    """Views by name. A builder is run at each access, so it sees the names as they are then."""

    def __init__(self) -> None:
        self._builders: dict[str, Callable[[], View]] = {}
        self._parents: dict[str, list[str]] = {}
        self._reading: list[str] = []

    def to(self, name: str, view: View | Callable[[], View]) -> View | Callable[[], View]:
        """Stores a view, or a function that makes one, and returns it."""
        self._builders[name] = view if callable(view) and not isinstance(view, View) else lambda: view
        self._parents[name] = []
        return view

    def ref(self, name: str) -> View:
        if name not in self._builders:
            raise KeyError(f"can't read {name!r}: no such view")
        if name in self._reading:
            raise ValueError(f"{name!r} refers to itself")
        if self._reading:
            parents = self._parents[self._reading[-1]]
            parents += [name] if name not in parents else []
        self._reading.append(name)
        try:
            return self._builders[name]()
        finally:
            self._reading.pop()

    def bind(self, name: str, view: View) -> Callable[..., Any]:
        """A function that runs stages on the view."""
        self.to(name, view)
        return lambda *stages: pipe(self.ref(name), *stages)

    def deps(self, name: str) -> list[str]:
        """Names of the views whose builders read this one, as far as they have been run."""
        return sorted(n for n, parents in self._parents.items() if name in parents)

    def views(self) -> list[str]:
        return sorted(self._builders)

    def close(self, name: str) -> None:
        self._builders.pop(name)
        self._parents.pop(name)

    def publish(self, name: str) -> DataFrame:
        """Makes the view's rows a temporary view for Spark SQL."""
        frame = self.ref(name).frame()
        frame.createOrReplaceTempView(name)
        return frame

    def resolve(self, path: str) -> Any:
        """``name``, ``name!row`` or ``name!row.column``, and so on into nested views; a view, a row or a cell."""
        from rowloom.functions.render import get

        head, *rest = path.split("!")
        steps: list[Any] = []
        for part in rest:
            row, _, column = part.partition(".")
            steps += [int(row), *([column] if column else [])]
        return get(self.ref(head), *steps) if steps else self.ref(head)
