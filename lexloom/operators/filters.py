"""Filters over metadata columns as predicates, and the facet toggles of a search page."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = {"gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v}


def _alike(kind: T.DataType, value: Any) -> bool:
    """Whether a literal can equal values of a type: numbers, texts and booleans never equal each other."""
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    return isinstance(kind, T.StringType)


def _one_of(column: Column, kind: T.DataType, values: list[Any]) -> Column:
    base = kind.elementType if isinstance(kind, T.ArrayType) else kind
    lits = [v for v in values if v is not None and _alike(base, v)]
    hit = (lambda x: x.isin(lits)) if lits else (lambda x: F.lit(False))
    if isinstance(kind, T.ArrayType):
        inside = F.coalesce(F.exists(column, lambda x: F.coalesce(hit(x), F.lit(False)) | (x.isNull() if None in values else F.lit(False))), F.lit(False))
    else:
        inside = F.coalesce(hit(column), F.lit(False))
    return inside | column.isNull() if None in values else inside


def predicate(df: DataFrame, field: str, want: Any, get: Callable[[str], Column] | None = None) -> Column:
    """One field of a filter: a value (any element of a list column may equal it), a list of values, or a
    mapping of ``in``, ``exists``, ``gte``, ``gt``, ``lte``, ``lt``. Ranges hold for numbers only; a field
    the table does not have is null everywhere. Null equals null; an empty list matches nothing. ``get`` gives
    the column of a field, where that is not one of ``df`` itself."""
    names = {f.name: f.dataType for f in df.schema.fields}
    column, kind = (get(field) if get else F.col(f"`{field}`"), names[field]) if field in names else (F.lit(None).cast("string"), T.StringType())
    if isinstance(want, Mapping):
        parts = []
        for op, v in want.items():
            if v is None and op != "in":
                continue
            if op == "in":
                parts.append(_one_of(column, kind, list(v)))
            elif op == "exists":
                parts.append(column.isNotNull() if v else column.isNull())
            elif op in RANGES:
                parts.append(F.coalesce(RANGES[op](column, v), F.lit(False)) if isinstance(kind, T.NumericType) else F.lit(False))
            else:
                raise ValueError(f"unknown predicate {op!r}")
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return _one_of(column, kind, list(want) if isinstance(want, (list, tuple, set)) else [want])


def matches(df: DataFrame, where: Mapping[str, Any] | None, get: Callable[[str], Column] | None = None) -> Column:
    """All fields of a filter together; no filter and an empty one match every row."""
    return reduce(lambda a, b: a & b, [predicate(df, f, w, get) for f, w in (where or {}).items()], F.lit(True))


def toggle_facet(where: Mapping[str, Any], field: str, value: str) -> dict[str, Any]:
    """The filter with one facet value added, or removed if it is there (by its text); ranges are kept."""
    now = where.get(field)
    spec = dict(now) if isinstance(now, Mapping) else {"in": list(now) if isinstance(now, (list, tuple)) else [] if field not in where else [now]}
    chosen = [v for v in spec.pop("in", None) or []]
    left = [v for v in chosen if str(v) != value]
    chosen = left if len(left) < len(chosen) else [*chosen, value]
    rest = {k: v for k, v in spec.items() if v is not None} | ({"in": chosen} if chosen else {})
    out = {k: v for k, v in where.items() if k != field}
    return out | ({field: rest} if rest else {})
