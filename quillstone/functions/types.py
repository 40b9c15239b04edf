"""Column types.

A declared column is INT, FLOAT, CHAR(n) or DATETIME and has the dialect's
narrow rules.  A column of an external table keeps its Spark type ("wide"): its
literals are cast to it, aggregates keep Spark's types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DECLARED = {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "CHAR": T.StringType(), "DATETIME": T.StringType()}


@dataclass(frozen=True)
class ColumnType:
    kind: str  # INT FLOAT CHAR DATETIME, or WIDE
    length: int = 0
    spark: T.DataType = T.StringType()

    @classmethod
    def declared(cls, kind: str, length: int = 0) -> ColumnType:
        return cls(kind, length, DECLARED[kind])

    @classmethod
    def wide(cls, spark: T.DataType) -> ColumnType:
        return cls("WIDE", 0, spark)

    @property
    def is_declared(self) -> bool:
        return self.kind != "WIDE"

    @property
    def family(self) -> str:
        """number, text (which dates of external tables compare with) or other."""
        if isinstance(self.spark, T.NumericType):
            return "number"
        if isinstance(self.spark, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "text"
        return "other"

    @property
    def integral(self) -> bool:
        return isinstance(self.spark, T.IntegralType)

    def __str__(self) -> str:
        return f"CHAR({self.length})" if self.kind == "CHAR" else self.kind if self.is_declared else self.spark.simpleString()

    def field(self, name: str) -> T.StructField:
        about = {"char_len": self.length} if self.kind == "CHAR" else {"datetime": True} if self.kind == "DATETIME" else {}
        return T.StructField(name, self.spark, True, about)


def unify(a: ColumnType, b: ColumnType) -> ColumnType | None:
    """The type that UNION gives two branches' columns; None: they don't go together."""
    if a == b:
        return a
    if a.is_declared and b.is_declared:
        if {a.kind, b.kind} == {"INT", "FLOAT"}:
            return ColumnType.declared("FLOAT", 4)
        if a.kind == b.kind:
            return ColumnType.declared(a.kind, max(a.length, b.length))
        return None
    if a.family == b.family == "number":
        if a.integral and b.integral:
            return ColumnType.wide(T.LongType())
        return ColumnType.wide(T.DoubleType())
    return ColumnType.wide(a.spark) if a.spark == b.spark else None
