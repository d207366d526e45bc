"""The metadata filter dialect, compiled to one Boolean column, and access rules built on it.

{"region": "EU"}                      equality; of an array column, membership
{"year": {"$gte": 2020, "$lt": 2025}} operators on one field are all required
{"$or": [{...}, {...}]}               $and and $or take non-empty lists

A missing value satisfies $ne and $nin only; $in matches it when null is among the operands. A
comparison of a value with another kind of value is false.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AccessDenied, FilterError

_ORDER = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
_KNOWN = {"$eq", "$ne", "$in", "$nin", *_ORDER}
Filter = Mapping[str, Any]


def validate(flt: Any) -> None:
    if not isinstance(flt, Mapping):
        raise FilterError("a filter is a mapping")
    for key, value in flt.items():
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)) or not value:
                raise FilterError(f"{key} takes a list that isn't empty")
            for part in value:
                validate(part)
        elif key.startswith("$"):
            raise FilterError(f"{key} can't stand here")
        elif isinstance(value, Mapping):
            for op, operand in value.items():
                if op not in _KNOWN:
                    raise FilterError(f"unknown operator {op}")
                if op in ("$in", "$nin") and not isinstance(operand, (list, tuple)):
                    raise FilterError(f"{op} takes a list")


def combine(*filters: Filter | None) -> Filter | None:
    """All of the filters that aren't empty."""
    some = [f for f in filters if f]
    return None if not some else some[0] if len(some) == 1 else {"$and": some}


def _comparable(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool) or isinstance(kind, T.BooleanType):
        return isinstance(kind, (T.BooleanType, T.NumericType)) and isinstance(value, (bool, int, float))
    if isinstance(kind, T.NumericType):
        return isinstance(value, (int, float))
    return isinstance(kind, (T.StringType, T.DateType, T.TimestampType)) and isinstance(value, str)


def _literal(kind: T.DataType, value: Any) -> Column:
    if isinstance(kind, T.NumericType) and isinstance(value, bool):
        value = int(value)
    if isinstance(kind, T.BooleanType):
        return F.lit(bool(value)) if value in (0, 1) else F.lit(None).cast("boolean")
    return F.lit(value)


def _equals(column: Column, kind: T.DataType, value: Any) -> Column:
    if isinstance(kind, T.ArrayType):
        if value is None:
            return column.isNull() | F.exists(column, lambda x: x.isNull())
        if not _comparable(kind.elementType, value):
            return F.lit(False)
        return F.coalesce(F.array_contains(column, _literal(kind.elementType, value)), F.lit(False))
    if value is None:
        return column.isNull()
    return F.coalesce(column == _literal(kind, value), F.lit(False)) if _comparable(kind, value) else F.lit(False)


def _test(column: Column, kind: T.DataType, op: str, operand: Any) -> Column:
    if op in ("$eq", "$ne"):
        out = _equals(column, kind, operand)
    elif op in ("$in", "$nin"):
        out = reduce(lambda a, b: a | b, [_equals(column, kind, v) for v in operand], F.lit(False))
    elif operand is None or not _comparable(kind, operand):
        return F.lit(False)
    else:
        return F.coalesce(_ORDER[op](column, _literal(kind, operand)), F.lit(False))
    return ~out if op in ("$ne", "$nin") else out


def compile_filter(flt: Filter | None, df: DataFrame) -> Column:
    """A column that is true where a row of df matches, and never null."""
    if not flt:
        return F.lit(True)
    validate(flt)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def one(part: Filter) -> Column:
        tests = []
        for key, value in part.items():
            if key in ("$and", "$or"):
                join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
                tests.append(reduce(join, [one(p) for p in value]))
                continue
            kind = kinds.get(key, T.NullType())
            column = df[key] if key in kinds else F.lit(None).cast("string")
            for op, operand in value.items() if isinstance(value, Mapping) else [("$eq", value)]:
                tests.append(_test(column, kind, op, operand))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    return one(flt)


@dataclass(frozen=True)
class Caller:
    """Who asks."""

    tenant_id: str | None = None
    user_id: str | None = None
    roles: Sequence[str] = ()
    attributes: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class AccessRules:
    """Columns that hold a row's tenant, allowed roles and attributes. "*" in a row admits everyone."""

    enabled: bool = True
    tenant: str | None = None
    roles: str | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)
    required: bool = True

    def filter_for(self, caller: Caller | None) -> Filter | None:
        """What a caller may see; a caller's own filter can only narrow it. Rows without the tag are not seen."""
        if not self.enabled:
            return None
        if caller is None:
            if self.required:
                raise AccessDenied("these documents are for known callers")
            caller = Caller()
        parts: list[Filter] = []
        if self.tenant:
            parts.append({self.tenant: {"$in": [*([caller.tenant_id] if caller.tenant_id else []), "*"]}})
        if self.roles:
            parts.append({self.roles: {"$in": [*caller.roles, "*"]}})
        for column, name in self.attributes.items():
            value = caller.attributes.get(name)
            parts.append({column: {"$in": [*([value] if value is not None else []), "*"]}})
        return combine(*parts)

    def untagged(self, df: DataFrame) -> DataFrame:
        """Rows that nobody can see since a tag is missing or empty."""
        names = [c for c in (self.tenant, self.roles, *self.attributes) if c]
        blank = lambda c: F.col(c).isNull() | (F.size(c) == 0 if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c).cast("string") == "")
        return df.where(reduce(lambda a, b: a | b, [blank(c) for c in names], F.lit(False)))
