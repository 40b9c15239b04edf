"""Names, types and grouping rules: a parsed query to a bound one, or an error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import AmbiguousColumnError, ColumnNotFoundError, IncompatibleTypeError, InternalError
from ..functions import expressions as X
from ..functions.types import ColumnType, unify
from . import ast


@dataclass(frozen=True)
class Table:
    """What the catalog knows of a table: its columns in order, and how to read it."""

    name: str
    columns: dict[str, ColumnType]
    load: Callable[[], DataFrame] = field(compare=False)
    declared: bool = True
    indexes: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class Source:
    at: int
    alias: str
    table: Table


@dataclass(frozen=True)
class Ref:
    """A column of one source; ``internal`` is its name inside plans."""

    source: int
    name: str
    type: ColumnType
    shown: str

    @property
    def internal(self) -> str:
        return f"s{self.source}_{self.name}"


@dataclass(frozen=True)
class Call:
    call: ast.Aggregate
    argument: Ref | None

    @property
    def internal(self) -> str:
        inner = "" if self.argument is None else self.argument.internal
        return f"a_{self.call.function}_{'d_' if self.call.distinct else ''}{inner}"


@dataclass(frozen=True)
class Test:
    left: object
    op: str
    right: object = None


@dataclass(frozen=True)
class Output:
    expr: object
    name: str


@dataclass(frozen=True)
class BoundSelect:
    sources: tuple[Source, ...]
    filters: tuple[tuple[int, Test], ...]
    joins: tuple[Test, ...]
    outputs: tuple[Output, ...]
    star: bool
    group: tuple[Ref, ...]
    grouped: bool
    having: tuple[Test, ...]
    order: tuple[tuple[object, bool], ...]
    limit: int | None
    offset: int

    @property
    def narrow(self) -> bool:
        return all(s.table.declared for s in self.sources)

    def calls(self) -> list[Call]:
        exprs = [o.expr for o in self.outputs] + [e for t in self.having for e in (t.left, t.right)]
        return list(dict.fromkeys(e for e in exprs if isinstance(e, Call)))


@dataclass(frozen=True)
class BoundUnion:
    branches: tuple[BoundSelect, ...]
    names: tuple[str, ...]
    types: tuple[ColumnType, ...]
    order: tuple[tuple[int, bool], ...]


def _constant(value) -> ast.Literal:
    if isinstance(value, ast.Arith) or value.kind == "param":
        raise InternalError("a parameter has no value")
    X.literal_family(value)
    return value


def type_of(expr, narrow: bool = True) -> ColumnType:
    if isinstance(expr, Ref):
        return expr.type
    if isinstance(expr, ast.Literal):
        return X.constant(expr)[1]
    f, of = expr.call.function, expr.argument and expr.argument.type
    if f in ("SUM", "AVG") and of.family != "number":
        raise IncompatibleTypeError(f, str(of))
    if f == "COUNT":
        return ColumnType.declared("INT", 4)
    if f == "AVG" and of.is_declared:
        return ColumnType.declared("FLOAT", 4)
    return of


class Scope:
    """The sources of a FROM list and the lookup of names in them."""

    def __init__(self, refs: tuple[ast.TableRef, ...], lookup: Callable[[str], Table]):
        self.sources = tuple(Source(i, r.alias or r.name, lookup(r.name)) for i, r in enumerate(refs))
        names = [s.alias for s in self.sources]
        if len(set(names)) < len(names):
            raise InternalError("two tables of FROM have the same name")

    def column(self, c: ast.Column) -> Ref:
        if c.table is None:
            found = [s for s in self.sources if c.name in s.table.columns]
        else:
            named = [s for s in self.sources if s.alias == c.table] or [s for s in self.sources if s.table.name == c.table]
            found = [s for s in named if c.name in s.table.columns]
        if not found:
            raise ColumnNotFoundError(str(c))
        if len(found) > 1:
            raise AmbiguousColumnError(str(c))
        s = found[0]
        return Ref(s.at, c.name, s.table.columns[c.name], f"{s.alias}.{c.name}")

    def every(self) -> list[Ref]:
        return [Ref(s.at, n, t, f"{s.alias}.{n}") for s in self.sources for n, t in s.table.columns.items()]

    def call(self, a: ast.Aggregate) -> Call:
        bound = Call(a, None if a.column is None else self.column(a.column))
        type_of(bound)
        return bound

    def test(self, c: ast.Condition) -> Test:
        """A condition of WHERE or ON: a column against a column or a constant."""
        left = self.column(c.left)
        if c.op in ("null", "notnull"):
            return Test(left, c.op)
        if isinstance(c.right, ast.Aggregate):
            raise InternalError("an aggregate has no place in WHERE")
        if isinstance(c.right, ast.Column):
            right = self.column(c.right)
            X.check(left.type, right.type)
            return Test(left, c.op, right)
        X.check_literal(left.type, _constant(c.right))
        return Test(left, c.op, c.right)


def _whole(value: ast.Literal | None) -> int | None:
    if value is None:
        return None
    if isinstance(value, ast.Arith) or value.kind != "int" or value.value < 0:
        raise InternalError("LIMIT and OFFSET take whole numbers that are not negative")
    return value.value


def bind_select(q: ast.Select, lookup: Callable[[str], Table]) -> BoundSelect:
    scope = Scope(q.tables, lookup)
    filters, joins = [], []
    for c in q.where:
        t = scope.test(c)
        if isinstance(t.right, Ref) and t.right.source != t.left.source:
            joins.append(t)
        else:
            filters.append((t.left.source, t))

    def expr(e):
        if isinstance(e, ast.Column):
            return scope.column(e)
        return scope.call(e) if isinstance(e, ast.Aggregate) else _constant(e)

    group = tuple(scope.column(c) for c in q.group)
    has_call = any(isinstance(i.expr, ast.Aggregate) for i in q.items or ()) or any(isinstance(e, ast.Aggregate) for c in q.having for e in (c.left, c.right))
    grouped = bool(group) or has_call
    if q.items is None:
        if grouped or q.having:
            raise InternalError("* has no place beside groups and aggregates")
        outputs = tuple(Output(r, r.name) for r in scope.every())
    else:
        outputs = tuple(Output(expr(i.expr), i.alias or (i.expr.caption() if isinstance(i.expr, ast.Aggregate) else i.expr.name if isinstance(i.expr, ast.Column) else i.expr.text)) for i in q.items)
    if q.having and not grouped:
        raise InternalError("HAVING needs groups or an aggregate")
    if grouped:
        for o in outputs:
            if isinstance(o.expr, Ref) and o.expr not in group:
                raise InternalError(f"{o.expr.shown} is neither grouped nor aggregated")
    having = []
    for c in q.having:
        left, right = expr(c.left), expr(c.right)
        for e in (left, right):
            if isinstance(e, Ref) and e not in group:
                raise InternalError(f"{e.shown} is not grouped")
        _check_pair(left, right)
        having.append(Test(left, c.op, right))
    order = tuple((_order_expr(o.expr, outputs, scope, grouped), o.descending) for o in q.order)
    return BoundSelect(scope.sources, tuple(filters), tuple(joins), outputs, q.items is None, group, grouped, tuple(having), order, _whole(q.limit), _whole(q.offset) or 0)


def _check_pair(left, right) -> None:
    if isinstance(left, ast.Literal) and isinstance(right, ast.Literal):
        a, b = X.literal_family(left), X.literal_family(right)
        if a != b and "null" not in (a, b):
            raise IncompatibleTypeError(left.kind, right.kind)
    elif isinstance(right, ast.Literal):
        _check_value(type_of(left), right)
    elif isinstance(left, ast.Literal):
        _check_value(type_of(right), left)
    else:
        X.check(type_of(left), type_of(right))


def _check_value(of: ColumnType, value: ast.Literal) -> None:
    family = X.literal_family(value)
    if family not in ("null", of.family):
        raise IncompatibleTypeError(str(of), value.kind)


def _order_expr(e, outputs: tuple[Output, ...], scope: Scope, grouped: bool):
    """What ORDER BY names: an output by its name first, then a column of a source."""
    if isinstance(e, (ast.Literal, ast.Arith)):
        raise InternalError("ORDER BY takes no constant")
    if isinstance(e, ast.Column) and e.table is None:
        for o in outputs:
            if o.name == e.name:
                return o.expr
    bound = scope.call(e) if isinstance(e, ast.Aggregate) else scope.column(e)
    if grouped and bound not in [o.expr for o in outputs]:
        raise InternalError("ORDER BY of groups takes selected columns and aggregates only")
    if not grouped and isinstance(bound, Call):
        raise InternalError("ORDER BY has an aggregate without groups")
    return bound


def bind_union(q: ast.Union, lookup: Callable[[str], Table]) -> BoundUnion:
    for b in q.branches:
        if b.order or b.limit is not None:
            raise InternalError("a branch of UNION has no ORDER BY and no LIMIT")
    branches = tuple(bind_select(b, lookup) for b in q.branches)
    width = len(branches[0].outputs)
    if any(len(b.outputs) != width for b in branches):
        raise InternalError("the branches of UNION differ in the number of columns")
    types = []
    for i in range(width):
        found: ColumnType | None = None
        for b in branches:
            of = _union_type(b.outputs[i].expr, b.narrow)
            merged = of if found is None else unify(found, of)
            if merged is None:
                raise IncompatibleTypeError(str(found), str(of))
            found = merged
        types.append(found)
    names = tuple(o.name for o in branches[0].outputs)
    order = []
    for o in q.order:
        if not isinstance(o.expr, ast.Column) or o.expr.table not in (None, q.alias):
            raise InternalError("ORDER BY of UNION takes output names")
        if o.expr.name not in names:
            raise ColumnNotFoundError(str(o.expr))
        order.append((names.index(o.expr.name), o.descending))
    return BoundUnion(branches, names, tuple(types), tuple(order))


def _union_type(expr, narrow: bool) -> ColumnType:
    """The type of a branch's column; on declared tables SUM counts as FLOAT."""
    if isinstance(expr, Call):
        if expr.call.function == "SUM" and expr.argument.type.is_declared:
            return ColumnType.declared("FLOAT", 4)
        return X.aggregate(expr.call, None if expr.argument is None else X.F.lit(None).cast(expr.argument.type.spark), expr.argument and expr.argument.type, False, narrow)[1]
    return type_of(expr)
