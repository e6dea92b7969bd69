"""Declarative JSON predicates compiled to columns, which Catalyst can see through.

A predicate is a dict: ``all``, ``any``, ``not``, ``always``, or ``<field>_<op>`` with the operators in ``OPS``. Fields
may be dotted paths. A missing field, a null, an empty predicate and a value of the wrong kind do not match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operator suffixes; the longest that fits is taken.
OPS = ["contains", "includes", "regex", "equals", "truthy", "gte", "lte", "in"]


def split_match(key: str) -> tuple[str, str]:
    for op in sorted(OPS, key=len, reverse=True):
        if key.endswith(f"_{op}"):
            return key[: -len(op) - 1], op
    raise ValueError(f"no operator in {key!r}")


def java_regex(pattern: str) -> str:
    """Named groups and Unicode classes as Java spells them."""
    return "(?U)" + re.sub(r"\(\?P<", "(?<", pattern)


class Predicates:
    """Compiles predicates for one table."""

    def __init__(self, df: DataFrame) -> None:
        self.schema = df.schema

    def field(self, path: str) -> tuple[Column, T.DataType] | None:
        """The column of a dotted path and its type; None if there is no such field."""
        kind: T.DataType = self.schema
        out: Column | None = None
        for part in path.split("."):
            if isinstance(kind, T.StructType) and part in kind.names:
                out = F.col(f"`{part}`") if out is None else out.getField(part)
                kind = kind[part].dataType
            elif isinstance(kind, T.MapType) and out is not None:
                out, kind = out.getItem(part), kind.valueType
            else:
                return None
        return out, kind

    def compile(self, rule: dict | None) -> Column:
        """The predicate as a boolean column that is never null."""
        if not rule:
            return F.lit(False)
        parts = []
        for key, value in rule.items():
            if key == "always":
                parts.append(F.lit(bool(value)))
            elif key == "all":
                parts.append(reduce(lambda a, b: a & b, map(self.compile, value), F.lit(True)))
            elif key == "any":
                parts.append(reduce(lambda a, b: a | b, map(self.compile, value), F.lit(False)))
            elif key == "not":
                parts.append(~self.compile(value))
            else:
                path, op = split_match(key)
                found = self.field(path)
                parts.append(F.coalesce(self._match(*found, op, value), F.lit(False)) if found else F.lit(op == "truthy" and not value))
        return reduce(lambda a, b: a & b, parts)

    def _match(self, col: Column, kind: T.DataType, op: str, value) -> Column:
        text, many = isinstance(kind, T.StringType), isinstance(kind, T.ArrayType)
        if op == "contains":
            low = str(value).lower()
            return F.exists(col, lambda x: F.lower(x.cast("string")) == low) if many else F.lower(col).contains(low) if text else F.lit(False)
        if op == "includes":
            return F.array_contains(col, value) if many else F.lit(False)
        if op == "regex":
            return col.rlike(java_regex(value)) if text else F.lit(False)
        if op == "equals":
            return col.eqNullSafe(F.lit(value))
        if op == "in":
            return col.isin(list(value))
        if op == "truthy":
            full = F.size(col) > 0 if many or isinstance(kind, T.MapType) else col != "" if text else col if isinstance(kind, T.BooleanType) else col != 0
            return F.coalesce(full, F.lit(False)) if value else ~F.coalesce(full, F.lit(False))
        number = col.try_cast("double") if not many else F.lit(None).cast("double")
        return number >= float(value) if op == "gte" else number <= float(value)

    def captures(self, path: str, pattern: str) -> dict[str, Column]:
        """A column for each named group of a pattern."""
        col, _ = self.field(path) or (F.lit(None).cast("string"), None)
        order = sorted(re.compile(pattern).groupindex.items(), key=lambda x: x[1])
        return {name: F.nullif(F.regexp_extract(col, java_regex(pattern), i), F.lit("")) for name, i in order}


def first_match(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first case that holds."""
    out = default
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out
