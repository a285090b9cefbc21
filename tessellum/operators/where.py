"""Filter documents (``{"$and": [...]}``, ``{"col": {"$gte": 3}}``, ...) as Spark predicates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
}


class FilterError(ValueError):
    pass


def _in(column: Column, values: list) -> Column:
    if not values:
        return F.lit(False)
    if len({isinstance(v, str) for v in values}) > 1:
        raise FilterError("$in holds strings and other values")
    return column.isin(values)


def predicate(where: Mapping[str, Any] | None, columns: list[str], strict: bool = True) -> Column:
    """The condition of a filter document over these columns.

    Keys of one document are joined by AND; ``$and`` and ``$or`` decide alone and make the keys beside them void. An
    empty ``$in`` is false. An unknown column raises if ``strict``, else its clause is void.
    """
    if not where:
        return F.lit(True)
    for key, join in (("$and", lambda a, b: a & b), ("$or", lambda a, b: a | b)):
        if key in where:
            parts = [predicate(p, columns, strict) for p in where[key]]
            return reduce(join, parts) if parts else F.lit(True)
    clauses = []
    for key, wanted in where.items():
        if key not in columns:
            if strict:
                raise FilterError(f"unknown column {key}")
            continue
        if not isinstance(wanted, Mapping):
            clauses.append(F.col(key) == wanted)
            continue
        for op, value in wanted.items():
            if op == "$in":
                clauses.append(_in(F.col(key), list(value)))
            elif op in _COMPARE:
                clauses.append(_COMPARE[op](F.col(key), value))
            else:
                raise FilterError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, clauses) if clauses else F.lit(True)
