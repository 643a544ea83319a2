"""Comparisons that keep pattern-language semantics: families of types never mix, null is never equal."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def never() -> Column:
    """A test that no row passes."""
    return F.lit(None).cast("boolean")


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "number" if isinstance(kind, T.NumericType) else "other"


def value_family(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "string" if isinstance(value, str) else "number" if isinstance(value, (int, float)) else "other"


def compare(column: Column | None, kind: T.DataType | None, operator: str, value: Any = None) -> Column:
    """column <operator> value. column None: a property that the rows don't have, always null."""
    operator = operator.upper()
    if operator in ("IS NULL", "IS NOT NULL"):
        test = F.lit(True) if column is None else column.isNull()
        return test if operator == "IS NULL" else ~test
    if column is None or value is None:
        return never()
    if operator == "IN":
        tests = [compare(column, kind, "EQ", v) for v in value]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    if family(kind) != value_family(value):
        return F.when(column.isNotNull(), F.lit(True)) if operator == "<>" else never()
    if operator in ("CONTAINS", "STARTS WITH", "ENDS WITH"):
        if family(kind) != "string":
            return never()
        return {"CONTAINS": column.contains, "STARTS WITH": column.startswith, "ENDS WITH": column.endswith}[operator](value)
    v = F.lit(value)
    tests = {"EQ": lambda: column == v, "=": lambda: column == v, "<>": lambda: column != v, ">": lambda: column > v, ">=": lambda: column >= v, "<": lambda: column < v, "<=": lambda: column <= v}
    if operator not in tests:
        raise ValueError(f"unknown operator {operator}")
    return tests[operator]()
