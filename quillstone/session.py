"""A session: statements in, DataFrames out; transactions over manifests."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BatchError, ColumnNotFoundError, DialectError, IndexExistsError, IndexNotFoundError, InternalError, InvalidColumnLengthError, InvalidValueCountError, LoadError, StatementNotFoundError, TableExistsError, TableNotFoundError, TransactionAbortError
from .functions.types import ColumnType
from .operators import explain, mutations
from .plans import ast, parameters
from .plans.analyzer import Table, bind_select, bind_union
from .plans.builder import build_select, build_union
from .plans.parser import parse
from .sources import csv_load, output
from .sources.storage import State, Stored, Taken, Warehouse

#: What HELP shows of the dialect.
HELP = (
    "SELECT * | item, ... FROM table, ... | JOIN table ON conditions [WHERE conditions] [GROUP BY columns] [HAVING conditions] [ORDER BY keys] [LIMIT n [OFFSET m]];",
    "SELECT * FROM (select UNION select ...) AS name [ORDER BY keys];",
    "INSERT INTO table VALUES (value, ...);",
    "DELETE FROM table [WHERE conditions];",
    "UPDATE table SET column = value, ... [WHERE conditions];",
    "LOAD path INTO table;",
    "CREATE TABLE table (column INT | FLOAT | CHAR(n) | DATETIME, ...); DROP TABLE table;",
    "CREATE INDEX table (column, ...); DROP INDEX table (column, ...);",
    "SHOW TABLES; SHOW INDEX FROM table; DESC table; EXPLAIN ANALYZE select;",
    "BEGIN; COMMIT; ROLLBACK; ABORT; SET TRANSACTION ISOLATION LEVEL SNAPSHOT ISOLATION | SERIALIZABLE;",
    "CREATE STATIC_CHECKPOINT; SET OUTPUT_FILE ON | OFF; HELP; EXIT",
)
#: Conf that holds while a statement is analysed.
RULES = {"spark.sql.caseSensitive": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}
MOST_PREPARED = 256


@dataclass
class Transaction:
    level: str
    base: int
    state: State
    explicit: bool = True
    read: set[str] = field(default_factory=set)
    written: dict[str, int] = field(default_factory=dict)  # table -> its version before the first write
    failed: bool = False


@dataclass(frozen=True)
class Prepared:
    statement: object
    types: tuple[str, ...]
    is_query: bool


@dataclass(frozen=True)
class Ingest:
    table: str
    frame: DataFrame

    def rows(self, types: dict[str, ColumnType]) -> DataFrame:
        if len(self.frame.columns) != len(types):
            raise InvalidValueCountError(f"{self.table} has {len(types)} columns, not {len(self.frame.columns)}")
        out = []
        for old, (name, of) in zip(self.frame.columns, types.items(), strict=True):
            value = F.col(f"`{old}`").cast(of.spark)
            if of.family == "text":
                long = F.raise_error(F.concat(F.lit(f"{name}: longer than {of.length} bytes: "), value)).cast("string")
                value = F.when(value.isNull() | (F.octet_length(value) <= of.length), value).otherwise(long)
            out.append(value.alias(name))
        return self.frame.select(*out)


class Session:
    """Statements of the dialect over declared tables of a warehouse and registered external ones."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None, output_path: str | None = None):
        self.spark = spark
        self._root, self._house = warehouse, None
        self.external: dict[str, Table] = {}
        self.paths: dict[str, str] = {}
        self.isolation = "read committed"
        self.transaction: Transaction | None = None
        self.output_path, self.output_on = output_path, output_path is not None
        self.prepared: dict[int, Prepared] = {}
        self.closed = False

    # --- tables

    @property
    def house(self) -> Warehouse:
        if self._house is None:
            root = self._root or f"{self.spark.conf.get('spark.sql.warehouse.dir')}/quillstone"
            self._house = Warehouse(self.spark, root)
        return self._house

    def register(self, name: str, frame: DataFrame) -> None:
        """An external table: any DataFrame, with its own types and read-only."""
        columns = {f.name: ColumnType.wide(f.dataType) for f in frame.schema.fields}
        self.external[name] = Table(name, columns, lambda: frame, False)

    def register_parquet(self, name: str, path: str) -> None:
        self.register(name, self.spark.read.parquet(path))

    def lazily(self, name: str, path: str) -> None:
        """An external Parquet table whose footer is read when a statement first names it."""
        self.paths[name] = path

    def ingest(self, name: str, frame: DataFrame) -> None:
        """Append a DataFrame's columns, by position, to a declared table: LOAD for data that Spark reads already.

        Values are cast to the declared types (a number that doesn't fit stops
        it); texts longer than their column stop it; keys are not checked.
        """
        with self._rules():
            self._define(Ingest(name, frame))

    def _state(self) -> State:
        t = self.transaction
        if t is None:
            return self.house.latest()[1]
        if t.level == "read committed":
            # each statement sees what others have committed, and its own writes
            number, now = self.house.latest()
            if number != t.base:
                for name in {*now.tables, *t.state.tables} - set(t.written):
                    t.state = t.state.put(name, now.tables.get(name))
                t.base = number
        return t.state

    def _table(self, name: str) -> Stored:
        found = self._state().tables.get(name)
        if found is None:
            if name in self.external or name in self.paths:
                raise InternalError(f"{name} is an external table and cannot be changed")
            raise TableNotFoundError(name)
        return found

    def _lookup(self, name: str) -> Table:
        if name in self.paths:
            self.register_parquet(name, self.paths.pop(name))
        if name in self.external:
            return self.external[name]
        stored = self._table(name)
        if self.transaction:
            self.transaction.read.add(name)
        return self.house.view(name, stored)

    # --- statements

    def execute(self, sql: str) -> DataFrame | None:
        """Run one statement.  Queries give a DataFrame, commands None."""
        return self._run(lambda: parse(sql))

    def render(self, sql: str) -> str:
        """Run one statement and show its result as the client's table (empty for commands)."""
        return self._shown(parse(sql), self.execute(sql))

    def _shown(self, statement, frame: DataFrame | None) -> str:
        if frame is None:
            return ""
        if isinstance(statement, ast.Explain) or isinstance(statement, ast.Simple) and statement.what == "help":
            return "\n".join(r[0] for r in frame.collect()) + "\n"
        counted = isinstance(statement, (ast.Select, ast.Union))
        return output.render_to_file(frame, self.output_path, counted) if self.output_on else output.render(frame, counted)

    def _run(self, statement_of) -> DataFrame | None:
        if self.closed:
            raise InternalError("the session has ended")
        t = self.transaction
        try:
            statement = statement_of()
            ends = isinstance(statement, ast.Simple) and statement.what in ("rollback", "commit")
            if t is not None and t.failed and not ends:
                raise TransactionAbortError("the transaction has failed; ROLLBACK ends it")
            with self._rules():
                return self._dispatch(statement)
        except Exception:
            if t is not None and self.transaction is t:
                t.failed = True
            raise

    @contextmanager
    def _rules(self):
        before = {k: self.spark.conf.get(k, None) for k in RULES}
        for k, v in RULES.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

    def _dispatch(self, s) -> DataFrame | None:
        if isinstance(s, ast.Select):
            return build_select(bind_select(s, self._lookup))
        if isinstance(s, ast.Union):
            return build_union(bind_union(s, self._lookup))
        if isinstance(s, ast.Explain):
            lines = explain.report(bind_select(s.query, self._lookup))
            return output.text_frame(self.spark, ["plan"], [(x,) for x in lines])
        if isinstance(s, ast.Insert):
            return self._change(s.table, lambda t: mutations.insert(self.house, s.table, t, s.values))
        if isinstance(s, ast.Delete):
            return self._change(s.table, lambda t: mutations.delete(self.house, s.table, t, s.where))
        if isinstance(s, ast.Update):
            return self._change(s.table, lambda t: mutations.update(self.house, s.table, t, s.sets, s.where))
        if isinstance(s, ast.Isolation):
            if self.transaction:
                raise InternalError("the level is set outside a transaction")
            self.isolation = s.level
            return None
        if isinstance(s, ast.OutputFile):
            self.output_on = s.on and self.output_path is not None
            return None
        if isinstance(s, (ast.Describe, ast.ShowIndex)) or isinstance(s, ast.Simple):
            return self._simple(s)
        return self._define(s)

    # --- changes and transactions

    def _change(self, name: str, change) -> None:
        """A statement that makes a new version of one table."""
        if self.transaction:
            old = self._table(name)
            self.transaction.written.setdefault(name, old.version)
            self.transaction.state = self.transaction.state.put(name, change(old))
            return
        for _ in range(16):
            number, state = self.house.latest()
            self._table(name)
            try:
                self.house.publish(number, state.put(name, change(state.tables[name])))
                return
            except Taken:
                continue  # another statement was first: this one starts anew on its result
        raise TransactionAbortError(f"{name} changes too often")

    def _begin(self) -> None:
        if self.transaction:
            raise InternalError("a transaction is open already")
        number, state = self.house.latest()
        self.transaction = Transaction(self.isolation, number, state)

    def _commit(self) -> None:
        t = self.transaction
        if t is None:
            raise InternalError("no transaction is open")
        self.transaction = None
        if t.failed:
            raise TransactionAbortError("a statement of the transaction failed; its changes are gone")
        for _ in range(16):
            number, now = self.house.latest()
            guarded = set(t.written) | (t.read if t.level == "serializable" else set())
            for name in guarded:
                before = t.written.get(name, t.state.tables[name].version if name in t.state.tables else None)
                if name not in now.tables or now.tables[name].version != before:
                    raise TransactionAbortError(f"another transaction changed {name} first")
            if not t.written:
                return
            for name in t.written:
                now = now.put(name, t.state.tables[name])
            try:
                self.house.publish(number, now)
                return
            except Taken:
                continue
        raise TransactionAbortError("too many other commits")

    # --- definitions and utilities

    def _define(self, s) -> None:
        if self.transaction:
            raise InternalError("definitions and LOAD have no place in a transaction")
        for _ in range(16):
            number, state = self.house.latest()
            try:
                self.house.publish(number, self._defined(s, state))
                return None
            except Taken:
                continue
        raise TransactionAbortError("too many other commits")

    def _defined(self, s, state: State) -> State:
        if isinstance(s, ast.CreateTable):
            if s.name in state.tables or s.name in self.external or s.name in self.paths:
                raise TableExistsError(s.name)
            names = [c.name for c in s.columns]
            if len(set(names)) < len(names):
                raise InternalError(f"{s.name} has a column twice")
            for c in s.columns:
                if c.kind == "CHAR" and not 1 <= c.length <= 2048:
                    raise InvalidColumnLengthError(f"{c.name} cannot have {c.length} bytes")
            return state.put(s.name, Stored(tuple((c.name, c.kind, c.length) for c in s.columns)), ddl=True)
        name = s.name if isinstance(s, ast.DropTable) else s.table
        if name not in state.tables:
            raise TableNotFoundError(name)
        table = state.tables[name]
        if isinstance(s, ast.DropTable):
            return state.put(name, None, ddl=True)
        if isinstance(s, ast.Load):
            rows = csv_load.read(self.spark, s.path, table.types())
            try:
                return state.put(name, self.house.append(name, table, rows))
            except Exception as e:
                if bad := csv_load.first_bad(self.spark, s.path, table.types()):
                    raise LoadError(bad) from e
                raise
        if isinstance(s, Ingest):
            return state.put(name, self.house.append(name, table, s.rows(table.types())))
        if isinstance(s, ast.CreateIndex):
            for c in s.columns:
                if c not in table.types():
                    raise ColumnNotFoundError(c)
            if s.columns in table.indexes:
                raise IndexExistsError(name, s.columns)
            return state.put(name, replace(table, indexes=(*table.indexes, s.columns)), ddl=True)
        if s.columns not in table.indexes:
            raise IndexNotFoundError(name, s.columns)
        return state.put(name, replace(table, indexes=tuple(i for i in table.indexes if i != s.columns)), ddl=True)

    def _simple(self, s) -> DataFrame | None:
        if isinstance(s, ast.Describe):
            types = self._lookup(s.table).columns
            shown = {"CHAR": "STRING"}
            return output.text_frame(self.spark, ["Field", "Type", "Index"], [(n, shown.get(t.kind, t.kind if t.is_declared else str(t)), "NO") for n, t in types.items()])
        if isinstance(s, ast.ShowIndex):
            found = self._lookup(s.table).indexes
            return output.text_frame(self.spark, ["Tables", "Type", "Column"], [(s.table, "unique", f"({','.join(i)})") for i in found])
        if s.what == "show_tables":
            return output.text_frame(self.spark, ["Tables"], [(n,) for n in [*self._state().tables, *self.external, *self.paths]])
        if s.what == "help":
            return output.text_frame(self.spark, ["help"], [(x,) for x in HELP])
        if s.what == "begin":
            self._begin()
        elif s.what == "commit":
            self._commit()
        elif s.what == "rollback":
            if self.transaction is None:
                raise InternalError("no transaction is open")
            self.transaction = None
        elif s.what == "exit":
            self.transaction, self.closed = None, True
        elif s.what == "checkpoint":
            self._checkpoint()
        return None

    def _checkpoint(self) -> None:
        """Compact every table, publish, and remove parts that nothing names any more."""
        if self.transaction:
            raise InternalError("a checkpoint has no place in a transaction")
        number, state = self.house.latest()
        for name, table in state.tables.items():
            state = state.put(name, self.house.compact(name, table))
        try:
            self.house.publish(number, state)
        except Taken as e:
            raise TransactionAbortError("a commit came between; try again") from e
        self.house.sweep(state)

    # --- prepared statements and batches

    def prepare(self, number: int, sql: str, types: tuple[str, ...] = ()) -> None:
        """Keep a parsed statement under a number; ``types`` are those of $1, $2, ..."""
        if len(self.prepared) >= MOST_PREPARED and number not in self.prepared:
            raise InternalError(f"more than {MOST_PREPARED} prepared statements")
        if bad := [t for t in types if t not in parameters.TYPES]:
            raise InternalError(f"no parameter type {bad[0]}")
        statement = parse(sql)
        if parameters.numbers(statement) - set(range(1, len(types) + 1)):
            raise InternalError("a parameter has no declared type")
        self.prepared[number] = Prepared(statement, tuple(types), isinstance(statement, (ast.Select, ast.Union, ast.Explain)))

    def execute_prepared(self, number: int, values: tuple = ()) -> DataFrame | None:
        """Run a prepared statement; names are looked up anew, so it survives changes of the catalog."""
        if number not in self.prepared:
            raise StatementNotFoundError(f"no prepared statement {number}")
        p = self.prepared[number]
        if len(values) != len(p.types):
            raise InvalidParameters(f"{len(p.types)} values are needed, not {len(values)}")
        bound = {i: parameters.as_literal(v, t) for i, (v, t) in enumerate(zip(values, p.types, strict=True), 1)}
        return self._run(lambda: parameters.bind(p.statement, bound))

    def execute_batch(self, operations: list[tuple[int, tuple]]) -> list[DataFrame | None]:
        """Prepared statements in order.  The first failure ends the batch and an open transaction."""
        out = []
        for i, (number, values) in enumerate(operations):
            try:
                out.append(self.execute_prepared(number, values))
            except Exception as e:
                self.transaction = None
                raise BatchError(i, e) from e
        return out


class InvalidParameters(DialectError):
    """A prepared statement is given too few or too many values."""
