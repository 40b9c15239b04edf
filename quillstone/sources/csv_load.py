"""LOAD: a CSV file to typed rows, split and checked on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileMissingError, LoadError
from ..functions.types import ColumnType

#: Fixed value: a field of a CSV line, with the comma before it.
_FIELD = r',("(?:[^"]|"")*"|[^,]*)'


def fields(line: Column) -> Column:
    """The fields of a line: quoted ones without quotes and with doubled quotes undone."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, 2, 1 << 30).substr(F.lit(1), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _split(line: str) -> list[str]:
    return [f[1:-1].replace('""', '"') if f.startswith('"') else f for f in re.findall(_FIELD, "," + line)]


def header(line: str, names: list[str]) -> list[int] | None:
    """Where each column's field stands if the line is a header: every field a different column."""
    found = [f.strip() for f in _split(line)]
    if len(found) == len(names) + 1 and not found[-1]:
        found.pop()
    if len(found) == len(names) and set(found) == set(names):
        return [found.index(n) for n in names]
    return None


def _typed(text: Column, name: str, of: ColumnType) -> tuple[Column, Column]:
    """A field's value, and what is wrong with it (null: nothing)."""
    if of.kind == "INT":
        good = text.rlike(r"^\s*[+-]?[0-9]+$")
        value, why = F.when(good, F.trim(text).try_cast("int")), "no 32-bit whole number"
        right = (text == "") | value.isNotNull()
    elif of.kind == "FLOAT":
        good = text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        value, why = F.when(good, F.trim(text).try_cast("double").cast("float")), "no finite number"
        right = (text == "") | value.isNotNull() & (F.abs(value) < F.lit(float("inf")))
    else:
        value, why = text, f"longer than {of.length} bytes"
        right = F.octet_length(text) <= of.length
    return value, F.when(~right, F.concat(F.lit(f"{name}: {why}: "), text))


def _parsed(spark: SparkSession, path: str, columns: dict[str, ColumnType]) -> tuple[DataFrame, DataFrame, list[tuple[str, Column, Column]]]:
    """All lines with their place (start of the file's split, number within the scan); data lines as fields f; and per column its name, value and what is wrong."""
    try:
        lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
        top = lines.where("start = 0").limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileMissingError(path) from e
        raise
    if not top:
        raise LoadError(f"{path} is empty")
    names = list(columns)
    places = header(top[0]["line"], names)
    rows = lines.where(F.length("line") > 0)
    if places:  # the first line of the file, by its place: a later line may say the same
        rows = rows.where((F.col("start") != 0) | (F.col("id") != top[0]["id"]))
    else:
        places = list(range(len(names)))
    need = max(places) + 1
    rows = rows.select(fields(F.col("line")).alias("f"), "line", "start", "id")
    few = F.when(F.size("f") < need, F.concat(F.lit("too few fields: "), F.col("line")))
    typed = [(n, *_typed(F.get(F.col("f"), F.lit(p)), n, t)) for p, (n, t) in zip(places, columns.items(), strict=True)]
    return lines, rows, [(n, v, F.coalesce(few, wrong)) for n, v, wrong in typed]


def read(spark: SparkSession, path: str, columns: dict[str, ColumnType]) -> DataFrame:
    """The rows of a file.

    A first line that names every column once is a header and maps fields by
    name; a later line that says the same is data.  Blank lines are skipped,
    fields beyond the columns ignored; a line with too few fields, a bad number
    or too long a text stops the statement.  Empty INT and FLOAT fields are
    null, empty texts stay empty.
    """
    _, rows, parsed = _parsed(spark, path, columns)
    return rows.select(*[F.when(wrong.isNull(), v).otherwise(F.raise_error(wrong).cast(columns[n].spark)).alias(n) for n, v, wrong in parsed])


def first_bad(spark: SparkSession, path: str, columns: dict[str, ColumnType]) -> str | None:
    """What is wrong with the first line that doesn't fit, and its number in the file; None: all lines fit."""
    lines, rows, parsed = _parsed(spark, path, columns)
    bad = rows.select("start", "id", F.coalesce(*[wrong for _, _, wrong in parsed]).alias("why")).where("why IS NOT NULL")
    found = bad.agg(F.min(F.struct("start", "id", "why")).alias("first")).first()["first"]
    if found is None:
        return None
    number = lines.where((F.col("start") < found["start"]) | (F.col("start") == found["start"]) & (F.col("id") <= found["id"])).count()
    return f"line {number}: {found['why']}"
