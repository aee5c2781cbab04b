"""Ordered relational views over Spark DataFrames."""

from rowloom.functions import render, schema
from rowloom.operators import aggregates, changes, columns, filters, lookup, nesting, position, select, sets, sorting
from rowloom.plans.registry import OPERATORS, Registry, operator
from rowloom.plans.view import View
from rowloom.sources import filetree, tables

__all__ = ["OPERATORS", "Registry", "View", "operator"]
