"""The only home of the dialect's numeric and null rules, as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from ..errors import IncompatibleTypeError, InternalError, StringOverflowError
from ..plans import ast
from .types import ColumnType


def literal_family(value: ast.Literal) -> str:
    if value.kind in ("int", "float"):
        return "number"
    if value.kind == "str":
        return "text"
    if value.kind == "null":
        return "null"
    raise InternalError(f"{value.text} cannot be a value here")


def check(left: ColumnType, right: ColumnType) -> None:
    if left.family != right.family or left.family == "other":
        raise IncompatibleTypeError(str(left), str(right))


def check_literal(column: ColumnType, value: ast.Literal) -> None:
    family = literal_family(value)
    if family != "null" and (family != column.family or column.family == "other"):
        raise IncompatibleTypeError(str(column), value.kind)
    if family == "text" and column.kind in ("CHAR", "DATETIME") and len(value.value.encode()) > column.length:
        raise StringOverflowError(f"{value.value!r} is longer than {column}")


def literal(column: ColumnType, value: ast.Literal) -> Column:
    """A literal cast to the column's type, so that the column itself is never cast."""
    check_literal(column, value)
    if value.kind == "null":
        return F.lit(None).cast(column.spark)
    if value.kind == "str":
        return F.lit(value.value).cast(column.spark)
    if column.kind == "INT":
        n = math.trunc(value.value)
        if not -(2**31) <= n < 2**31:
            raise IncompatibleTypeError(str(column), value.text)
        return F.lit(n)
    if column.kind == "FLOAT":
        return F.lit(value.value).cast("float")
    exact = value.value if value.kind == "int" else float(value.text)
    if column.integral and exact != math.trunc(exact):
        return F.lit(exact)
    return F.lit(int(exact) if column.integral else exact).cast(column.spark)


def constant(value: ast.Literal) -> tuple[Column, ColumnType]:
    """A constant on its own: as the narrow type of its kind."""
    kinds = {"int": ("INT", 4), "float": ("FLOAT", 4), "str": ("CHAR", len(value.text.encode())), "null": ("INT", 4)}
    if value.kind not in kinds:
        literal_family(value)
    of = ColumnType.declared(*kinds[value.kind])
    return literal(of, value), of


def compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def compare_typed(op: str, a: Column, left: ColumnType, b: Column, right: ColumnType) -> Column:
    """Columns of two types; numbers of unlike types are compared as doubles."""
    check(left, right)
    if left.family == "number" and left.spark != right.spark and not (left.integral and right.integral):
        a, b = a.cast("double"), b.cast("double")
    return compare(op, a, b)


def finite(value: Column, what: str) -> Column:
    """The value; an infinite or undefined one stops the statement."""
    wrong = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(wrong, F.raise_error(F.lit(f"{what} is not finite"))).otherwise(value)


def aggregate(call: ast.Aggregate, column: Column | None, of: ColumnType | None, whole: bool, narrow: bool) -> tuple[Column, ColumnType]:
    """An aggregate and its type.

    ``whole``: no GROUP BY, so an empty input has a row.  ``narrow``: it reads
    declared tables only.

    On declared columns counts and sums are as narrow as the column, sums run in
    wider arithmetic, and INT aggregates of an empty input are 0.
    """
    if call.function == "COUNT":
        value = F.count(F.lit(1)) if column is None else F.count_distinct(column) if call.distinct else F.count(column)
        return (value.cast("int"), ColumnType.declared("INT", 4)) if narrow else (value, ColumnType.wide(T.LongType()))
    narrow = of.is_declared
    if call.function in ("SUM", "AVG") and of.family != "number":
        raise IncompatibleTypeError(call.function, str(of))
    if of.family == "other":
        raise IncompatibleTypeError(call.function, str(of))
    if call.function in ("MIN", "MAX"):
        value, out = (F.min if call.function == "MIN" else F.max)(column), of
    elif call.function == "AVG":
        value, out = F.avg(column.cast("double")), ColumnType.wide(T.DoubleType())
        if narrow:
            value, out = finite(value.cast("float"), call.caption()), ColumnType.declared("FLOAT", 4)
    elif narrow and of.kind == "INT":
        value, out = F.sum(column.cast("bigint")).cast("int"), of
    elif narrow:
        value, out = finite(F.sum(column.cast("double")).cast("float"), call.caption()), of
    else:
        value, out = F.sum(column), ColumnType.wide(T.LongType() if of.integral else T.DoubleType() if not isinstance(of.spark, T.DecimalType) else of.spark)
    if whole and narrow and out.kind == "INT":
        value = F.when(F.count(F.lit(1)) == 0, F.lit(0)).otherwise(value)
    return value, out


def sort(value: Column, descending: bool) -> Column:
    """Null is the greatest value."""
    return value.desc_nulls_first() if descending else value.asc_nulls_last()


def key_part(value: Column, of: ColumnType) -> Column:
    """A part of an index key: null counts as the zero of its type."""
    zero = F.lit("") if of.family == "text" else F.lit(0)
    return F.coalesce(value, zero.cast(of.spark))


def cut_bytes(value: Column, length: int) -> Column:
    """Text cut to ``length`` bytes, as UPDATE stores it; a character that would be split goes whole."""
    raw = F.encode(value, "UTF-8")
    kept = value
    for short in range(4):
        part = F.substring(raw, 1, max(0, length - short))
        good = F.is_valid_utf8(part.cast("string")) if hasattr(F, "is_valid_utf8") else F.lit(True)
        kept = F.when(good, part.cast("string")) if short == 0 else kept.when(good, part.cast("string"))
    return F.when(F.octet_length(value) <= length, value).otherwise(kept)
