"""Snapshots: immutable Parquet files under a numbered sequence of manifests.

A manifest names, for every table, its columns, indexes and files (parts); few
fresh rows are kept in the manifest itself.  A mutation writes anew only the
files that hold a row it changes.  Publishing renames a finished file to the
next number, which fails if another writer has taken it, so the first committer
wins and a reader always sees a whole state.  All file access goes through
Hadoop's file systems, as any store that Spark writes to has one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import ColumnType
from ..plans.analyzer import Table

#: Rows that a manifest keeps itself; more are written to a part.
INLINE_ROWS = 512
#: Bytes below which a checkpoint merges a file with others.
SMALL_FILE = 64 << 20
#: Manifests that stay at a checkpoint, for readers that are still at one of them.
OLD_MANIFESTS = 8


@dataclass(frozen=True)
class Stored:
    """One table of a manifest."""

    columns: tuple[tuple[str, str, int], ...]
    indexes: tuple[tuple[str, ...], ...] = ()
    parts: tuple[str, ...] = ()
    rows: tuple[tuple, ...] = ()
    version: int = 0

    def types(self) -> dict[str, ColumnType]:
        return {n: ColumnType.declared(k, length) for n, k, length in self.columns}

    def schema(self) -> T.StructType:
        return T.StructType([t.field(n) for n, t in self.types().items()])


@dataclass(frozen=True)
class State:
    tables: dict[str, Stored] = field(default_factory=dict)
    generation: int = 0

    def put(self, name: str, table: Stored | None, ddl: bool = False) -> State:
        tables = {k: v for k, v in self.tables.items() if k != name}
        if table is not None:
            tables[name] = table
        return State(dict(sorted(tables.items())), self.generation + ddl)


class Taken(Exception):
    """Another writer published first."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.fs.mkdirs(self._path("_manifest"))
        self._cache: tuple[int, State] = (0, State())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # --- manifests

    def latest(self) -> tuple[int, State]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("_manifest"))]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        number = max(numbers, default=0)
        if number and number != self._cache[0]:
            self._cache = (number, self._read(number))
        return self._cache

    def _read(self, number: int) -> State:
        stream = self.fs.open(self._path(f"_manifest/{number:012d}.json"))
        try:
            raw = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        tables = {
            n: Stored(tuple(map(tuple, t["columns"])), tuple(map(tuple, t["indexes"])), tuple(t["parts"]), tuple(map(tuple, t["rows"])), t["version"])
            for n, t in raw["tables"].items()
        }
        return State(tables, raw["generation"])

    def publish(self, base: int, state: State) -> int:
        """Make ``state`` manifest number base + 1; Taken if there is one."""
        number = base + 1
        raw = {"generation": state.generation, "tables": {n: vars(t) for n, t in state.tables.items()}}
        draft = self._path(f"_manifest/draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(json.dumps(raw).encode()))
        stream.close()
        files = self.jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 0)
        target = self._path(f"_manifest/{number:012d}.json")
        try:
            files.FileContext.getFileContext(draft.toUri(), self.conf).rename(self.fs.makeQualified(draft), self.fs.makeQualified(target), none)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(target):
                raise Taken from e
            raise
        self._cache = (number, state)
        return number

    # --- tables

    def frame(self, table: Stored) -> DataFrame:
        schema = table.schema()
        out = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in table.parts]) if table.parts else None
        if table.rows or out is None:
            columns = [pa.array([r[i] for r in table.rows], {"INT": pa.int32(), "FLOAT": pa.float32()}.get(k, pa.string())) for i, (_, k, _) in enumerate(table.columns)]
            fresh = self.spark.createDataFrame(pa.Table.from_arrays(columns, [c[0] for c in table.columns]), schema)
            out = fresh if out is None else out.union(fresh)
        return out

    def view(self, name: str, table: Stored) -> Table:
        return Table(name, table.types(), lambda: self.frame(table), True, table.indexes)

    def rewrite(self, name: str, table: Stored, chosen: Column, change: Callable[[DataFrame], DataFrame]) -> Stored:
        """The table after ``change``, which keeps all rows but the ``chosen`` as they are.

        Files without a chosen row are kept.  Rows of the manifest stay there.
        """
        rows = table.rows and tuple(map(tuple, change(self.frame(replace(table, parts=()))).collect()))
        touched: set[str] = set()
        if table.parts:
            hit = self.frame(replace(table, rows=())).withColumn("__file", F.input_file_name()).where(chosen)
            touched = {"/".join(unquote(r["__file"]).split("/")[-2:]) for r in hit.select("__file").distinct().collect()}
        old = tuple(p for p in table.parts if p.removeprefix(f"{name}/") in touched)
        fresh = self._part(name, table, change(self.frame(replace(table, parts=old, rows=())))) if old else ()
        return replace(table, parts=(*(p for p in table.parts if p not in old), *fresh), rows=rows, version=table.version + 1)

    def append(self, name: str, table: Stored, rows: DataFrame) -> Stored:
        return replace(table, parts=(*table.parts, *self._part(name, table, rows)), version=table.version + 1)

    def append_row(self, name: str, table: Stored, row: tuple) -> Stored:
        table = replace(table, rows=(*table.rows, row), version=table.version + 1)
        if len(table.rows) > INLINE_ROWS:
            return replace(table, parts=(*table.parts, *self._part(name, table, self.frame(replace(table, parts=())))), rows=())
        return table

    def compact(self, name: str, table: Stored) -> Stored:
        """The manifest's rows and small files of a table in files of Spark's size, sorted by the first index."""
        sizes = {p: self.fs.getFileStatus(self._path(p)).getLen() for p in table.parts}
        few = tuple(p for p in table.parts if sizes[p] < SMALL_FILE)
        if not table.rows and len(few) < 2:
            return table
        total = sum(sizes[p] for p in few)
        merged = self.frame(replace(table, parts=few)).coalesce(max(1, total // SMALL_FILE))
        return replace(table, parts=(*(p for p in table.parts if p not in few), *self._part(name, table, merged)), rows=())

    def _part(self, name: str, table: Stored, rows: DataFrame) -> tuple[str, ...]:
        """Write rows to files, sorted in each by the first index so that Parquet statistics prune; empty files are not kept."""
        part = f"{name}/v={uuid.uuid4().hex}"
        if table.indexes:
            rows = rows.sortWithinPartitions(*[f"`{c}`" for c in table.indexes[0]])
        rows.write.parquet(f"{self.root}/{part}")
        return tuple(sorted(f"{part}/{n}" for s in self.fs.listStatus(self._path(part)) if (n := s.getPath().getName()).endswith(".parquet")))

    def sweep(self, state: State) -> None:
        """Remove files that the latest state does not name, and old manifests.  Frames of older snapshots can't be read then."""
        live = {p.rsplit("/", 1)[0] for t in state.tables.values() for p in t.parts}
        for top in self.fs.listStatus(self._path("")):
            name = top.getPath().getName()
            if top.isDirectory() and not name.startswith("_"):
                for part in self.fs.listStatus(top.getPath()):
                    if f"{name}/{part.getPath().getName()}" not in live:
                        self.fs.delete(part.getPath(), True)
        old = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path("_manifest")) if s.getPath().getName().endswith(".json"))
        for manifest in old[:-OLD_MANIFESTS]:
            self.fs.delete(self._path(f"_manifest/{manifest}"), False)
