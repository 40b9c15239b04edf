"""Results as text: the bordered table of the client, and the lines of the output file."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the client's table.
WIDTH, BUFFER, FOOTER = 16, 8192, 40


def cell(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (float, np.floating)):
        return f"{value:.6f}"
    return str(value)


def _fit(text: str) -> str:
    raw = text.encode()
    return raw[: WIDTH - 3].decode(errors="ignore") + "..." if len(raw) > WIDTH else " " * (WIDTH - len(raw)) + text


def most_shown(names: list[str]) -> int:
    """More rows than the client's buffer can hold."""
    return BUFFER // (2 + (WIDTH + 3) * len(names)) + 1


def table(names: list[str], rows: Iterable[tuple], count: bool = True, total: int | None = None) -> str:
    """The bordered table; rows beyond the client's buffer are left out and marked, but counted, or there are ``total``."""
    rule = "+" + ("-" * (WIDTH + 2) + "+") * len(names) + "\n"

    def line(cells: Iterable[str]) -> str:
        return "|" + "".join(f" {_fit(c)} |" for c in cells) + "\n"

    out = [rule, line(names), rule]
    size, cut, n = sum(map(len, out)), False, 0
    for row in rows:
        n += 1
        if not cut:
            text = line(map(cell, row))
            cut = size + len(text) + FOOTER >= BUFFER
            if not cut:
                out.append(text)
                size += len(text)
    out.append(rule)
    if cut:
        out.append("... ...\n")
    return "".join(out) + (f"Total record(s): {n if total is None else total}\n" if count else "")


def render(frame: DataFrame, count: bool = True) -> str:
    """A DataFrame as the client shows it: only rows that can be shown reach the driver, the others are counted where they are."""
    most = most_shown(frame.columns)
    rows = [tuple(r) for r in frame.limit(most).collect()]
    return table(frame.columns, rows, count, frame.count() if count and len(rows) == most else len(rows))


def render_to_file(frame: DataFrame, path: str, count: bool = True) -> str:
    """The same, with all rows appended to the output file; they stream through the driver one partition at a time."""
    most = most_shown(frame.columns)
    rows = (tuple(r) for r in frame.toLocalIterator())
    head = list(islice(rows, most))
    n = append_lines(path, frame.columns, head) + append_lines(path, None, rows)
    return table(frame.columns, head, count, n)


def append_lines(path: str, names: list[str] | None, rows: Iterable[tuple]) -> int:
    """Compact borderless lines, as the output file takes them; says how many rows there were."""
    n = 0
    with open(path, "a", encoding="utf-8") as f:
        if names:
            f.write("|" + "".join(f" {c} |" for c in names) + "\n")
        for row in rows:
            f.write("|" + "".join(f" {cell(c)} |" for c in row) + "\n")
            n += 1
    return n


def text_frame(spark, names: list[str], rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))
