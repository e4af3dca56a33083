"""Metric specifications, such as {"n": "count()", "total": "sum(price)"}, as aggregate Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .predicates import Source

_SPEC = re.compile(r"\s*([A-Za-z]+)\s*\(\s*([A-Za-z_]\w*)?\s*\)\s*")
#: An average is one division of the sum by the count; nulls count for nothing in either.
_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": lambda c: F.sum(c.cast("double")) / F.count(c),
    "min": F.min,
    "max": F.max,
    "countdistinct": F.count_distinct,
}
_NUMERIC = {"sum", "avg"}


def compile_metrics(specs: dict[str, str], find: Callable[[str], Source]) -> list[Column]:
    if not specs:
        raise QueryError("no metrics")
    out = []
    for alias, spec in specs.items():
        m = _SPEC.fullmatch(spec) if isinstance(spec, str) else None
        if not m:
            raise QueryError(f"can't read metric {spec!r}")
        name, argument = m[1].lower(), m[2]
        if name == "count":
            if argument:
                raise QueryError("count() takes no field")
            out.append(F.count("*").alias(alias))
            continue
        if name not in _AGGREGATES:
            raise QueryError(f"unknown aggregate {m[1]!r}")
        if not argument:
            raise QueryError(f"{m[1]} needs a field")
        source = find(argument)
        if name in _NUMERIC and source.type in ("string", "boolean"):
            raise QueryError(f"{m[1]} needs numbers; {argument} is a {source.type}")
        out.append(_AGGREGATES[name](source.value()).alias(alias))
    return out
