"""Packing by non-negative least squares on the length histogram.

1. Every document is tokenised once into a scratch table (doc_id, n, ids).
2. Whole windows of long documents are sequences of their own.  The remainders
   form a histogram of at most ``window`` lengths, which alone reaches the
   driver.  In units of window / 64, all combinations of at most ``depth``
   lengths that fill a window are enumerated and non-negative least squares
   solves how often each repeats.
3. Each task of the scratch table applies its share of the counts to its own
   documents, a bounded chunk at a time; shares are rounded up or down in turn,
   so that they add up over chunks.  Tasks of few documents are merged, as the
   mix needs enough lengths to choose from.  What rounding leaves is packed
   greedily: residual documents are cut to fill the slack of the sequences,
   then whole windows, and the end of a chunk is cut at powers of two, so that
   nothing is padded.  There is no shuffle of ids.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pretokens import pieces

END_ID = 2
UNITS = 64
#: Bytes of ids that a task holds and plans at once, and the least number of documents of a task.
CHUNK, PER_TASK = 64 << 20, 2048
IDS = "doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_IDS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _tokenise(path: str, end_id: int):
    def run(batches):
        splitter = pieces(path)
        for b in common.blocks(batches, 1):
            ids = splitter.ids_of([t or "" for t in b.column(1).to_pylist()], end_id)
            yield common.record(_IDS, b.column(0), [len(x) // splitter.kind.itemsize for x in ids], ids)

    return run


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids): ids little-endian, 2 bytes each where the vocabulary allows, else 4."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.tidy(_tokenise(tokenizer, end_id), "pieces"), IDS)


@lru_cache(maxsize=8)
def combinations(units: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """Non-increasing tuples of at most ``depth`` positive lengths that add up to ``units``."""
    out = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(left, head[-1] if head else left), 0, -1):
                if x * (depth - len(head)) < left:
                    break
                extend((*head, x), left - x)

    extend((), units)
    return tuple(out)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, active = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    scale = max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(rounds):
        free = np.where(active, -np.inf, gradient)
        j = int(np.argmax(free))
        if free[j] <= 1e-9 * scale or active.sum() >= m:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300))
            x[at] += step * (z - x[at])
            active[at[x[at] <= 1e-12 * (1 + np.abs(x).max())]] = False
            x[~active] = 0
            if not active.any():
                break
        gradient = a.T @ (b - a @ x)
    return x


def solve_mix(histogram: np.ndarray, depth: int = 4) -> tuple[tuple[tuple[int, ...], ...], np.ndarray]:
    """Combinations and repeats that fit a histogram over unit lengths 1..UNITS."""
    combos = combinations(len(histogram), depth)
    a = np.zeros((len(histogram), len(combos)))
    for j, c in enumerate(combos):
        for u in c:
            a[u - 1, j] += 1
    repeats = nnls(a, histogram.astype(float))
    used = np.flatnonzero(repeats > 0)
    return tuple(combos[j] for j in used), repeats[used]


def plan(lengths: np.ndarray, window: int, mix, repeats: np.ndarray, share: float, number: int = 0, seq: int = 0) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) for one chunk's documents, and the next sequence.

    ``number`` is the chunk's: the golden ratio's multiples spread over it decide where a share is rounded up.
    """
    unit = max(1, window // UNITS)
    out = []
    bins: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        for k in range(n // window):
            out.append((i, k * window, window, seq, 0))
            seq += 1
        if n % window:
            bins.setdefault(-(-(n % window) // unit), []).append(i)
    left = lengths % window
    slack = []
    for j, (combo, r) in enumerate(sorted(zip(mix, repeats, strict=True), key=lambda x: -x[1])):
        need = {u: combo.count(u) for u in combo}
        times = int(r * share + (0.5 + 0.6180339887498949 * (number + j)) % 1)
        for _ in range(min(times, *(len(bins.get(u, ())) // k for u, k in need.items())) if need else 0):
            offset = 0
            for u in combo:
                i = bins[u].pop()
                n = int(left[i])
                out.append((i, int(lengths[i]) - n, n, seq, offset))
                offset += n
            if offset < window:
                slack.append((seq, offset))
            seq += 1
    rest = [i for u in sorted(bins, reverse=True) for i in bins[u]]
    total = int(sum(int(left[i]) for i in rest))
    holes = [(s, o, window - o) for s, o in slack]
    room = sum(h[2] for h in holes)
    more = max(0, total - room)
    for _ in range(more // window):
        holes.append((seq, 0, window))
        seq += 1
    tail = more % window
    while tail:
        size = 1 << (tail.bit_length() - 1)
        holes.append((seq, 0, size))
        seq += 1
        tail -= size
    at = 0
    for i in rest:
        start, n = int(lengths[i] - left[i]), int(left[i])
        while n:
            s, o, cap = holes[at]
            take = min(n, cap)
            out.append((i, start, take, s, o))
            start, n = start + take, n - take
            if take == cap:
                at += 1
            else:
                holes[at] = (s, o + take, cap - take)
    return out, seq


def _pack(window: int, mix, repeats, documents: int, narrow: bool):
    size, kind = (2, "<u2") if narrow else (4, "<u4")

    def run(batches):
        task, seq, number = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []

        def packed():
            nonlocal seq, number
            doc_ids = [x for b in held for x in b.column(0).to_pylist()]
            ids = [x.as_buffer() for b in held for x in b.column(2)]
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            got, seq = plan(n, window, mix, repeats, len(n) / max(documents, 1), task * 7919 + number, seq)
            number += 1
            for at in range(0, len(got), 50_000):
                rows = [(doc_ids[i], start, length, zlib.crc32(np.frombuffer(ids[i], kind, length, size * start).astype("<u4")), int(n[i]), (task << 32) | s, offset) for i, start, length, s, offset in got[at : at + 50_000]]
                yield common.record(_PIECES, *zip(*rows, strict=True))
            held.clear()

        for batch in batches:
            for b in common.blocks([batch], 2, CHUNK, 1 << 20):
                if held and sum(x.nbytes for x in held) + b.nbytes > CHUNK:
                    yield from packed()
                held.append(b)
        if held:
            yield from packed()

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, depth: int = 4, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, in sequences of at most ``window`` tokens.

    Null and empty texts are documents of one token (the end id).  Repeated
    rows and null doc_ids are packed like any other; other columns are
    ignored; an empty table gives no pieces.  Sequence ids are unique, not
    gapless: the task stands in their upper bits.
    """
    table = common.scratch(token_ids(docs, tokenizer, end_id), "ids")
    unit = max(1, window // UNITS)
    rest = F.col("n") % window
    counted = table.groupBy(F.ceil(rest / unit).cast("int").alias("u")).agg(F.count(F.lit(1)).alias("c")).collect()
    histogram = np.zeros(-(-window // unit), np.int64)
    for r in counted:
        if r["u"]:
            histogram[r["u"] - 1] = r["c"]
    mix, repeats = solve_mix(histogram, depth) if histogram.any() else ((), np.zeros(0))
    documents = sum(r["c"] for r in counted)
    narrow = pieces(tokenizer).narrow
    return table.coalesce(max(1, documents // PER_TASK)).mapInArrow(common.tidy(_pack(window, mix, repeats, documents, narrow)), PIECES)
