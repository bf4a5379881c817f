"""JSON row predicates, compiled to a two-valued Column.

``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}``, or a test: ``{"path": "a.b.0.length", ...}`` or
``{"var": name, ...}`` with one or more of exists, truthy, eq, ne, in, gt, gte, lt, lte, all of which must hold.
A path that leads nowhere, an absent variable and null are missing: a missing value passes ``exists: false`` alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
TESTS = ("exists", "truthy", "eq", "ne", "in", *ORDERED)


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def validate(condition, where: str = "when"):
    """The condition itself; TypeError, with the place, if its shape is wrong."""

    def fail(message: str):
        raise TypeError(f"{where}: {message}" if not message.startswith(".") else where + message)

    if not isinstance(condition, Mapping):
        fail("a condition must be an object")
    kind = next((k for k in ("all", "any", "not") if k in condition), None)
    if kind is None:
        named = [k for k in ("path", "var") if isinstance(condition.get(k), str) and condition[k]]
        if len(named) != 1:
            fail("a test needs exactly one of path or var")
        allowed = {named[0], *TESTS}
    else:
        allowed = {kind}
    for key in condition:
        if key not in allowed:
            fail(f"unexpected key {key!r}")
    if kind == "not":
        validate(condition["not"], f"{where}.not")
    elif kind:
        parts = condition[kind]
        if not isinstance(parts, (list, tuple)) or not parts:
            fail(f".{kind} must be a non-empty array of conditions")
        for i, part in enumerate(parts):
            validate(part, f"{where}.{kind}[{i}]")
    else:
        tests = [k for k in TESTS if k in condition]
        if not tests:
            fail(f"a test needs at least one of {', '.join(TESTS)}")
        for key in tests:
            v = condition[key]
            if key in ORDERED and not _number(v):
                fail(f".{key} must be a number")
            if key in ("exists", "truthy") and not isinstance(v, bool):
                fail(f".{key} must be a boolean")
            if key == "in" and not isinstance(v, (list, tuple)):
                fail(".in must be an array")
    return condition


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column and type that a dotted path leads to; None if the schema has no such place."""
    first, *rest = path.split(".")
    if first not in schema.fieldNames():
        return None
    column, kind = F.col(f"`{first}`"), schema[first].dataType
    for part in rest:
        if part == "length" and isinstance(kind, (T.ArrayType, T.StringType)):
            column = F.size(column) if isinstance(kind, T.ArrayType) else F.length(column)
            if isinstance(kind, T.ArrayType):
                column = F.when(column >= 0, column)
            kind = T.IntegerType()
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            column, kind = F.get(column, int(part)), kind.elementType
        elif isinstance(kind, T.StructType) and part in kind.fieldNames():
            column, kind = column[part], kind[part].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        else:
            return None
    return column, kind


def _comparable(value, kind: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if _number(value):
        return isinstance(kind, T.NumericType)
    return isinstance(value, str) and isinstance(kind, T.StringType)


def _truthy(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.NumericType):
        return (c != 0) & ~F.isnan(c.cast("double"))
    if isinstance(kind, T.StringType):
        return c != ""
    return F.lit(True)


def _test(tests: Mapping, column: Column, kind: T.DataType) -> Column:
    held = F.lit(True)
    for key in TESTS:
        if key not in tests:
            continue
        v = tests[key]
        if key == "exists":
            if not v:
                # a present value fails; a missing one passes only if nothing else is asked
                return column.isNull() if sum(k in tests for k in TESTS) == 1 else F.lit(False)
            part = F.lit(True)
        elif key == "truthy":
            part = _truthy(column, kind) if v else ~_truthy(column, kind)
        elif key == "eq":
            part = column == F.lit(v) if _comparable(v, kind) else F.lit(False)
        elif key == "ne":
            part = column != F.lit(v) if _comparable(v, kind) else F.lit(True)
        elif key == "in":
            same = [x for x in v if _comparable(x, kind)]
            part = column.isin(*same) if same else F.lit(False)
        else:
            part = ORDERED[key](column, F.lit(v)) if isinstance(kind, T.NumericType) else F.lit(False)
        held = held & part
    return F.coalesce(column.isNotNull() & held, F.lit(False))


_VARIABLE = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}


def compile_condition(condition: Mapping, schema: T.StructType, variables: Mapping | None = None) -> Column:
    """A Column that is true or false, never null."""
    if "all" in condition or "any" in condition:
        kind = "all" if "all" in condition else "any"
        parts = [compile_condition(c, schema, variables) for c in condition[kind]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if kind == "all" else out | p
        return out
    if "not" in condition:
        return ~compile_condition(condition["not"], schema, variables)
    if "var" in condition:
        value = (variables or {}).get(condition["var"])
        found = None if value is None else (F.lit(value), _VARIABLE.get(type(value), T.StringType()))
    else:
        found = resolve(schema, condition["path"])
    if found is None:
        return F.lit(condition.get("exists") is False and sum(k in condition for k in TESTS) == 1)
    return _test(condition, *found)


def where(df: DataFrame, condition: Mapping, variables: Mapping | None = None) -> DataFrame:
    return df.where(compile_condition(validate(condition), df.schema, variables))


def usable_text_layer(column: str = "document", least: int = 1) -> dict:
    """The predicate that a text layer was read without error and has so many boxes."""
    return {"all": [{"path": f"{column}.exception", "eq": ""}, {"path": f"{column}.bboxes.length", "gte": least}]}
