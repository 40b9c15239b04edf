"""Tokens to statements, by recursive descent."""

from __future__ import annotations

import numpy as np

from ..errors import SyntaxFailure
from . import ast
from .lexer import tokens

#: Words that cannot name a table or a column.
KEYWORDS = frozenset(
    """SHOW TABLES CREATE TABLE DROP DESC INSERT INTO VALUES DELETE FROM ASC EXPLAIN ANALYZE ORDER BY AND JOIN ON
    WHERE UPDATE SET SELECT INT CHAR FLOAT DATETIME INDEX AS COUNT MAX MIN AVG SUM DISTINCT GROUP HAVING LIMIT OFFSET
    UNION IS NOT NULL TRUE FALSE LOAD BEGIN COMMIT ABORT ROLLBACK HELP EXIT STATIC_CHECKPOINT OUTPUT_FILE TRANSACTION
    ISOLATION LEVEL""".split()
)
COMPARE = ("=", "<>", "<", ">", "<=", ">=")
INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def parse(text: str):
    """The one statement of a text."""
    return _Parser(text).statement()


class _Parser:
    def __init__(self, text: str):
        self.tokens = tokens(text)
        self.at = 0

    # --- tokens

    @property
    def now(self) -> ast.Token:
        return self.tokens[self.at]

    def is_word(self, *words: str) -> bool:
        return all(t.kind == "word" and t.text.upper() == w for t, w in zip(self.tokens[self.at :], words, strict=False)) and len(self.tokens) - self.at >= len(words)

    def take(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.wrong(" ".join(words))

    def op(self, *ops: str) -> str | None:
        if self.now.kind == "op" and self.now.text in ops:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def need_op(self, *ops: str) -> str:
        return self.op(*ops) or self._raise(" or ".join(ops))

    def _raise(self, wanted: str):
        raise self.wrong(wanted)

    def wrong(self, wanted: str) -> SyntaxFailure:
        return SyntaxFailure(f"expected {wanted}, found {self.now.text or 'the end'!r} at {self.now.at}")

    def name(self) -> str:
        if self.now.kind != "word" or self.now.text.upper() in KEYWORDS:
            raise self.wrong("a name")
        self.at += 1
        return self.tokens[self.at - 1].text

    def names(self) -> tuple[str, ...]:
        self.need_op("(")
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        self.need_op(")")
        return tuple(out)

    # --- statements

    def statement(self):
        loose = True
        if self.take("HELP"):
            out = ast.Simple("help")
        elif self.take("EXIT"):
            out = ast.Simple("exit")
        elif self.take("SET", "OUTPUT_FILE"):
            on = self.take("ON")
            if not on:
                self.need("OFF")
            out = ast.OutputFile(on)
        else:
            out, loose = self.body(), False
        if not self.op(";") and not loose:
            raise self.wrong(";")
        if self.now.kind != "end":
            raise self.wrong("the end")
        return out

    def body(self):
        if self.take("SHOW"):
            if self.take("TABLES"):
                return ast.Simple("show_tables")
            self.need("INDEX", "FROM")
            return ast.ShowIndex(self.name())
        if self.take("DESC"):
            return ast.Describe(self.name())
        if self.take("CREATE"):
            return self.create()
        if self.take("DROP"):
            if self.take("TABLE"):
                return ast.DropTable(self.name())
            self.need("INDEX")
            return ast.DropIndex(self.name(), self.names())
        if self.take("LOAD"):
            if self.now.kind != "path":
                raise self.wrong("a path")
            self.at += 1
            path = self.tokens[self.at - 1].text
            self.need("INTO")
            return ast.Load(path, self.name())
        if self.take("INSERT"):
            self.need("INTO")
            table = self.name()
            self.need("VALUES")
            self.need_op("(")
            values = [self.value()]
            while self.op(","):
                values.append(self.value())
            self.need_op(")")
            return ast.Insert(table, tuple(values))
        if self.take("DELETE"):
            self.need("FROM")
            return ast.Delete(self.name(), self.where())
        if self.take("UPDATE"):
            table = self.name()
            self.need("SET")
            sets = [self.set_clause()]
            while self.op(","):
                sets.append(self.set_clause())
            return ast.Update(table, tuple(sets), self.where())
        if self.take("EXPLAIN"):
            self.need("ANALYZE")
            return ast.Explain(self.select())
        if self.take("SET"):
            self.need("TRANSACTION", "ISOLATION", "LEVEL")
            if self.take("SERIALIZABLE"):
                return ast.Isolation("serializable")
            self.need("SNAPSHOT", "ISOLATION")
            return ast.Isolation("snapshot")
        for word, what in (("BEGIN", "begin"), ("COMMIT", "commit"), ("ABORT", "rollback"), ("ROLLBACK", "rollback")):
            if self.take(word):
                return ast.Simple(what)
        if self.is_word("SELECT"):
            return self.union() if self.starts_union() else self.select()
        raise self.wrong("a statement")

    def starts_union(self) -> bool:
        texts = [t.text.upper() for t in self.tokens[self.at + 1 : self.at + 4]]
        return texts == ["*", "FROM", "("]

    def create(self):
        if self.take("STATIC_CHECKPOINT"):
            return ast.Simple("checkpoint")
        if self.take("INDEX"):
            table = self.name()
            if self.take("ON"):
                table = self.name()
            return ast.CreateIndex(table, self.names())
        self.need("TABLE")
        table = self.name()
        self.need_op("(")
        columns = [self.column_def()]
        while self.op(","):
            columns.append(self.column_def())
        self.need_op(")")
        return ast.CreateTable(table, tuple(columns))

    def column_def(self) -> ast.ColumnDef:
        name = self.name()
        for word in ("INT", "FLOAT", "DATETIME"):
            if self.take(word):
                return ast.ColumnDef(name, word, 19 if word == "DATETIME" else 4)
        self.need("CHAR")
        self.need_op("(")
        length = self.integer()
        self.need_op(")")
        return ast.ColumnDef(name, "CHAR", length)

    def integer(self) -> int:
        if self.now.kind != "int":
            raise self.wrong("a whole number")
        self.at += 1
        return int(self.tokens[self.at - 1].text)

    def set_clause(self) -> ast.SetClause:
        column = self.name()
        if sign := self.op("+=", "-="):
            return ast.SetClause(column, ast.Column(column), ((sign[0], self.value()),))
        self.need_op("=")
        if self.now.kind != "word" or self.now.text.upper() in ("TRUE", "FALSE", "NULL"):
            return ast.SetClause(column, self.value())
        base = ast.Column(self.name())
        terms = []
        if first := self.op("+", "-", "*", "/"):
            terms.append((first, self.value()))
            while first in "+-" and (more := self.op("+", "-")):
                terms.append((more, self.value()))
        return ast.SetClause(column, base, tuple(terms))

    # --- queries

    def union(self) -> ast.Union:
        self.at += 4
        branches = [self.select()]
        while self.take("UNION"):
            branches.append(self.select())
        if len(branches) < 2:
            raise self.wrong("UNION")
        self.need_op(")")
        self.need("AS")
        return ast.Union(tuple(branches), self.name(), self.order())

    def select(self) -> ast.Select:
        self.need("SELECT")
        items = None
        if not self.op("*"):
            items = [self.item()]
            while self.op(","):
                items.append(self.item())
        self.need("FROM")
        tables, where = [self.table()], []
        while True:
            if self.op(","):
                tables.append(self.table())
            elif self.take("JOIN"):
                tables.append(self.table())
                if self.take("ON"):
                    where += self.conjunction()
            else:
                break
        where += self.where()
        group: list[ast.Column] = []
        if self.take("GROUP", "BY"):
            group.append(self.column())
            while self.op(","):
                group.append(self.column())
        having: list[ast.Condition] = []
        if self.take("HAVING"):
            having.append(self.having())
            while self.take("AND"):
                having.append(self.having())
        order = self.order()
        limit = offset = None
        if self.take("LIMIT"):
            limit = self.count()
            if self.take("OFFSET"):
                offset = self.count()
        return ast.Select(tuple(items) if items is not None else None, tuple(tables), tuple(where), tuple(group), tuple(having), order, limit, offset)

    def count(self) -> ast.Literal:
        value = self.value()
        if value.kind == "int" and value.value >= 0 or value.kind == "param":
            return value
        raise self.wrong("a count")

    def table(self) -> ast.TableRef:
        name = self.name()
        if self.take("AS"):
            return ast.TableRef(name, self.name())
        if self.now.kind == "word" and self.now.text.upper() not in KEYWORDS:
            return ast.TableRef(name, self.name())
        return ast.TableRef(name)

    def item(self) -> ast.Item:
        expr = self.operand(arithmetic=False)
        return ast.Item(expr, self.name() if self.take("AS") else None)

    def column(self) -> ast.Column:
        first = self.name()
        return ast.Column(self.name(), first) if self.op(".") else ast.Column(first)

    def operand(self, arithmetic: bool = True):
        """An aggregate, a column or a constant."""
        for f in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
            if self.take(f):
                return self.aggregate(f)
        if self.now.kind == "word" and self.now.text.upper() not in KEYWORDS:
            return self.column()
        return self.arith() if arithmetic else self.value()

    def aggregate(self, function: str) -> ast.Aggregate:
        self.need_op("(")
        if function == "COUNT" and self.op("*"):
            self.need_op(")")
            return ast.Aggregate("COUNT")
        distinct = function == "COUNT" and self.take("DISTINCT")
        wrapped = distinct and self.op("(")
        column = self.column()
        if wrapped:
            self.need_op(")")
        self.need_op(")")
        return ast.Aggregate(function, column, bool(distinct))

    def where(self) -> tuple[ast.Condition, ...]:
        return tuple(self.conjunction()) if self.take("WHERE") else ()

    def conjunction(self) -> list[ast.Condition]:
        out = [self.condition()]
        while self.take("AND"):
            out.append(self.condition())
        return out

    def condition(self) -> ast.Condition:
        left = self.column()
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return ast.Condition(left, "notnull" if negated else "null")
        return ast.Condition(left, self.need_op(*COMPARE), self.operand())

    def having(self) -> ast.Condition:
        left = self.operand()
        if self.is_word("IS"):
            raise SyntaxFailure("IS NULL has no place in HAVING")
        return ast.Condition(left, self.need_op(*COMPARE), self.operand())

    def order(self) -> tuple[ast.Order, ...]:
        if not self.take("ORDER", "BY"):
            return ()
        out = [self.order_item()]
        while self.op(","):
            out.append(self.order_item())
        return tuple(out)

    def order_item(self) -> ast.Order:
        expr = self.operand()
        if self.take("DESC"):
            return ast.Order(expr, True)
        self.take("ASC")
        return ast.Order(expr)

    # --- constants

    def arith(self):
        left = self.term()
        while op := self.op("+", "-"):
            left = fold(op, left, self.term())
        return left

    def term(self):
        left = self.factor()
        while op := self.op("*", "/"):
            left = fold(op, left, self.factor())
        return left

    def factor(self):
        if self.op("("):
            out = self.arith()
            self.need_op(")")
            return out
        return self.value()

    def value(self) -> ast.Literal:
        negative = bool(self.op("-"))
        t = self.now
        if t.kind in ("int", "float"):
            self.at += 1
            sign = "-" if negative else ""
            if t.kind == "float":
                return real(sign + t.text)
            n = int(sign + t.text)
            if not INT_MIN <= n <= INT_MAX:
                raise SyntaxFailure(f"{n} is no 32-bit number")
            return ast.Literal("int", n, str(n))
        if negative:
            raise self.wrong("a number")
        if t.kind == "str":
            self.at += 1
            return ast.Literal("str", t.text, t.text)
        if t.kind == "param":
            self.at += 1
            n = int(t.text[1:])
            if n < 1:
                raise SyntaxFailure("parameters are numbered from $1")
            return ast.Literal("param", n, t.text)
        for word, value in (("TRUE", ast.Literal("bool", True, "TRUE")), ("FALSE", ast.Literal("bool", False, "FALSE")), ("NULL", ast.Literal("null", None, "NULL"))):
            if self.take(word):
                return value
        raise self.wrong("a value")


def real(text: str) -> ast.Literal:
    """A float literal: its nearest 32-bit value, and its digits for columns that are wider."""
    with np.errstate(over="ignore"):
        value = float(np.float32(text))
    return ast.Literal("float", value, text)


def fold(op: str, left, right):
    """Constant arithmetic: 32-bit whole numbers with truncating division, or 32-bit floats."""
    if isinstance(left, ast.Arith) or isinstance(right, ast.Arith) or "param" in (left.kind, right.kind):
        return ast.Arith(op, left, right)
    if not {left.kind, right.kind} <= {"int", "float"}:
        raise SyntaxFailure("arithmetic is for numbers")
    a, b = left.value, right.value
    if op == "/" and b == 0:
        raise SyntaxFailure("division by zero")
    if left.kind == right.kind == "int":
        if op == "/":
            n = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        else:
            n = {"+": a + b, "-": a - b, "*": a * b}[op]
        if not INT_MIN <= n <= INT_MAX:
            raise SyntaxFailure("whole-number overflow")
        return ast.Literal("int", n, str(n))
    x, y = np.float32(a), np.float32(b)
    with np.errstate(all="ignore"):
        f = {"+": x + y, "-": x - y, "*": x * y, "/": x / y if y else np.float32("nan")}[op]
    if not np.isfinite(f):
        raise SyntaxFailure("float overflow")
    return ast.Literal("float", float(f), repr(float(f)))
