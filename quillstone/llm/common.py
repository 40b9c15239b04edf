"""Shared pieces: table access, scratch tables, word splitting, arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


#: Stands for a null id inside packed arrays.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; others are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fold(text: str | None) -> str:
    """Lower-case A-Z and nothing else; null is empty."""
    if not text:
        return ""
    return text.lower() if text.isascii() else text.encode().lower().decode()  # of bytes, only A-Z have a lower case


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session,
    where driver and executors are one process, may fall back to a temp folder.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="quillstone-")
    return f"file://{_own}"


_own: str | None = None


#: Rows of a narrow table that are worth a file of their own.
ROWS_PER_FILE = 200_000


def files_for(rows: int, spark: SparkSession) -> int:
    """Files for so many narrow rows: as many as the session's partitions, or fewer where these would be tiny."""
    return min(partitions(spark), rows // ROWS_PER_FILE + 1)


def scratch(df: DataFrame, tag: str, *partition_by: str, files: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there.

    ``files``: write at most so many, where the rows are known to be few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillstone/{tag}-{uuid.uuid4().hex}"
    writer = (df.coalesce(files) if files else df).write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove a scratch table's folder once nothing lazily reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def deal(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Send rows to partitions by an integer shard number: shard i to partition i mod n."""
    n = n or partitions(df.sparkSession)
    return df.repartitionById(n, F.col(column).cast("int")) if hasattr(df, "repartitionById") else df.repartition(n, column)


def give_back() -> None:
    """Return freed memory to the system: workers outlive tasks, several share an executor, and the driver outlives all stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What this worker remembers from task to task, by name, and how it is forgotten.
REMEMBERED: dict[str, Callable[[], None]] = {}


def _forget(but: str | None) -> None:
    for name, drop in REMEMBERED.items():
        if name != but:
            drop()


def let_go(shared: Broadcast) -> None:
    """Drop this worker's copy of a broadcast value; the next task that asks for it reads the executor's file again.

    On the driver, and where the value came encrypted and so has no file, it stays.
    """
    if getattr(shared, "_path", None) and getattr(shared, "_sc", None) is None:
        vars(shared).pop("_value", None)


def tidy(run, uses: str | None = None, shared: Broadcast | None = None):
    """A mapInArrow function that gives memory back when its task ends.

    What tasks of other kinds left in this worker is forgotten first, but for what it ``uses``.
    Its copy of ``shared``, with all that was built on it, goes at the end, as
    an executor may have more workers than cores and an idle one would keep it.
    """

    def tidied(batches):
        _forget(uses)
        try:
            yield from run(batches)
        finally:
            if shared is not None:
                let_go(shared)
            give_back()

    return tidied


def tidy_group(run):
    """The same for an applyInArrow function, for groups that are large."""

    def tidied(rows: pa.Table) -> pa.Table:
        out = run(rows)
        if rows.nbytes > 1 << 20:
            give_back()
        return out

    return tidied


def blocks(batches, text_at: int, max_bytes: int = 4 << 20, max_rows: int = 16384):
    """Arrow batches cut to at most ``max_bytes`` of text (one long row may exceed it)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.zeros(n, np.int64)
        lengths = pc.binary_length(batch.column(text_at)).fill_null(0)
        sizes[:] = lengths.to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
            stop = min(n, max(at + 1, stop), at + max_rows)
            yield batch.slice(at, stop - at)
            at = stop


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
