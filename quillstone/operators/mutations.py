"""INSERT, DELETE and UPDATE as new snapshots of a declared table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnNotFoundError, IncompatibleTypeError, InternalError, InvalidValueCountError, StringOverflowError, UniqueKeyError
from ..functions import expressions as X
from ..functions.types import ColumnType
from ..plans import ast
from ..plans.analyzer import Ref, Scope
from ..plans.builder import quoted
from ..sources.storage import Stored, Warehouse


def _plain(value: ast.Literal, of: ColumnType) -> object:
    """A literal as the Python value that a column stores."""
    family = X.literal_family(value)
    if family == "null":
        return None
    if family != of.family:
        raise IncompatibleTypeError(str(of), value.kind)
    if of.kind == "INT":
        n = math.trunc(value.value)
        if not -(2**31) <= n < 2**31:
            raise IncompatibleTypeError("INT", value.text)
        return n
    if of.kind == "FLOAT":
        return float(np.float32(value.value))
    if len(value.value.encode()) > of.length:
        raise StringOverflowError(f"{value.value!r} is longer than {of}")
    return value.value


def insert(house: Warehouse, name: str, table: Stored, values: tuple) -> Stored:
    types = table.types()
    if len(values) != len(types):
        raise InvalidValueCountError(f"{name} has {len(types)} columns, not {len(values)}")
    row = tuple(_plain(v, t) for v, t in zip(values, types.values(), strict=True))
    names = list(types)
    for index in table.indexes:
        at = [names.index(c) for c in index]

        def key(r, at=at):
            return tuple((0 if types[names[i]].family == "number" else "") if r[i] is None else r[i] for i in at)

        if any(key(r) == key(row) for r in table.rows) or table.parts and _held(house, table, index, key(row), types):
            raise UniqueKeyError(f"{name}({', '.join(index)}) has {key(row)} already")
    return house.append_row(name, table, row)


def _held(house: Warehouse, table: Stored, index, key: tuple, types) -> bool:
    frame = house.frame(Stored(table.columns, parts=table.parts))
    for c, v in zip(index, key, strict=True):
        test = quoted(c) == F.lit(v).cast(types[c].spark)
        frame = frame.where(test | quoted(c).isNull() if v in (0, "") else test)
    return not frame.limit(1).isEmpty()


def _condition(house: Warehouse, name: str, table: Stored, where: tuple) -> Column:
    scope = Scope((ast.TableRef(name),), lambda n: house.view(n, table))
    out = F.lit(True)
    for c in where:
        t = scope.test(c)
        left = quoted(t.left.name)
        if t.op in ("null", "notnull"):
            one = left.isNull() if t.op == "null" else left.isNotNull()
        elif isinstance(t.right, Ref):
            one = X.compare_typed(t.op, left, t.left.type, quoted(t.right.name), t.right.type)
        else:
            one = X.compare(t.op, left, X.literal(t.left.type, t.right))
        out = out & one
    return F.coalesce(out, F.lit(False))


def delete(house: Warehouse, name: str, table: Stored, where: tuple) -> Stored:
    chosen = _condition(house, name, table, where)
    return house.rewrite(name, table, chosen, lambda frame: frame.where(~chosen))


def _number(value: ast.Literal) -> float:
    if value.kind not in ("int", "float"):
        raise IncompatibleTypeError("a number", value.kind)
    return float(value.value)


def _assigned(clause: ast.SetClause, types: dict[str, ColumnType]) -> Column:
    """The new value of a column, from the old row."""
    if clause.column not in types:
        raise ColumnNotFoundError(clause.column)
    of = types[clause.column]
    if not isinstance(clause.base, ast.Column):
        value = clause.base
        if X.literal_family(value) == "text" == of.family:
            return X.cut_bytes(F.lit(value.value), of.length)
        return F.lit(_plain(value, of)).cast(of.spark)
    if clause.base.name not in types:
        raise ColumnNotFoundError(clause.base.name)
    source, base = types[clause.base.name], quoted(clause.base.name)
    if source.family != of.family:
        raise IncompatibleTypeError(str(of), str(source))
    if not clause.terms:
        if of.family == "text":
            return X.cut_bytes(base, of.length)
        return base.cast(of.spark) if of.kind != "INT" or source.kind == "INT" else base.cast("double").cast("int")
    if of.family != "number":
        raise IncompatibleTypeError(str(of), "arithmetic")
    if len(clause.terms) > 1 and clause.base.name != clause.column:
        raise InternalError("a chain of terms starts with the column that is set")
    value = base.cast("double")
    for op, literal in clause.terms:
        n = F.lit(_number(literal))
        if op == "/" and _number(literal) == 0:
            raise InternalError("division by zero")
        value = {"+": value + n, "-": value - n, "*": value * n, "/": value / n}[op]
        if len(clause.terms) > 1 or of.kind == "FLOAT":
            value = X.finite(value.cast("float"), clause.column).cast("double")
    return value.cast("int") if of.kind == "INT" else value.cast("float")


def update(house: Warehouse, name: str, table: Stored, sets: tuple, where: tuple) -> Stored:
    types = table.types()
    new = {}
    for s in sets:
        new[s.column] = _assigned(s, types)
    chosen = _condition(house, name, table, where)

    def after(frame: DataFrame, *more: Column) -> DataFrame:
        frame = frame.withColumn("__chosen", chosen)
        return frame.select(*[(F.when(F.col("__chosen"), new[c]).otherwise(quoted(c)) if c in new else quoted(c)).alias(c) for c in types], *more)

    old = [X.key_part(quoted(c), types[c]).alias(f"__old_{c}") for c in new]
    for index in table.indexes:
        if set(index) & set(new):
            _unique(after(house.frame(table), *old, "__chosen"), name, index, types, set(new))
    return house.rewrite(name, table, chosen, after)


def _unique(after: DataFrame, name: str, index, types, changed: set[str]) -> None:
    """No changed key may be there twice; rows that held a key twice before may stay."""
    keys = [X.key_part(quoted(c), types[c]).alias(f"__key_{c}") for c in index]
    moved = F.col("__chosen") & ~F.forall(F.array(*[X.key_part(quoted(c), types[c]) == quoted(f"__old_{c}") for c in index if c in changed]), lambda x: x)
    names = [f"__key_{c}" for c in index]
    held = after.select(*keys, moved.alias("__moved"))
    # only rows that share a key with one that moved are counted
    held = held.join(held.where("__moved").select(*names).distinct(), names, "left_semi")
    double = held.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.max("__moved").alias("moved"))
    if not double.where("n > 1 AND moved").limit(1).isEmpty():
        raise UniqueKeyError(f"{name}({', '.join(index)}) would have a key twice")
