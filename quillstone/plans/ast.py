"""Statements as they are written, before names and types are known."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    """kind: int, float, str, null, bool or param.  A float keeps its digits in ``text``."""

    kind: str
    value: object = None
    text: str = ""


@dataclass(frozen=True)
class Arith:
    """Constant arithmetic that waits for a parameter."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Column:
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: Column | None = None
    distinct: bool = False

    def caption(self) -> str:
        inner = "*" if self.column is None else self.column.name
        return f"{self.function}({'DISTINCT ' if self.distinct else ''}{inner})"


@dataclass(frozen=True)
class Condition:
    """op: = <> < > <= >= or, without a right side, null and notnull."""

    left: object
    op: str
    right: object = None


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: object
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None  # None: *
    tables: tuple[TableRef, ...]
    where: tuple[Condition, ...] = ()
    group: tuple[Column, ...] = ()
    having: tuple[Condition, ...] = ()
    order: tuple[Order, ...] = ()
    limit: object = None
    offset: object = None


@dataclass(frozen=True)
class Union:
    branches: tuple[Select, ...]
    alias: str
    order: tuple[Order, ...] = ()


@dataclass(frozen=True)
class Explain:
    query: Select


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    length: int = 0


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class CreateIndex:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class DropIndex:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[object, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class SetClause:
    column: str
    base: object  # Literal, Arith or Column
    terms: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[SetClause, ...]
    where: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Load:
    path: str
    table: str


@dataclass(frozen=True)
class Describe:
    table: str


@dataclass(frozen=True)
class ShowIndex:
    table: str


@dataclass(frozen=True)
class Isolation:
    level: str


@dataclass(frozen=True)
class Simple:
    """show_tables, help, exit, checkpoint, begin, commit or rollback."""

    what: str


@dataclass(frozen=True)
class OutputFile:
    on: bool


@dataclass(frozen=True)
class Token:
    kind: str  # word, int, float, str, path, param, op, end
    text: str
    at: int = field(compare=False, default=0)
