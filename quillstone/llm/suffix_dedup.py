"""Exact substring dedup: bytes covered by a long string that an earlier document holds.

Every window of LENGTH bytes has one anchor, the leftmost least-hashed 16-byte
gram in it, so equal windows have equal anchors at equal places.  Windows of one
anchor are a run; its bytes are a region of 50 to 84 bytes.

1. A first pass deals anchor hashes to shards, once per block of documents.
   Anchors seen in more than one document set bits of a filter of fixed size;
   a filter that fills up keeps more regions but loses none.
2. A second pass folds equal regions of a block to one, settles the later
   documents of the block, and deals what the filter keeps to shards by anchor.
3. A shard that is larger than ``HELD`` bytes goes to the task's disk and is
   parted there by anchor, and the parts are taken one by one.  Equal regions are
   folded again: all but the least document's lose all their windows.  Of anchors
   with several different regions, those that share at least half of what a
   window holds beside the anchor with another one, to its left or to its right,
   go to an external induced suffix sort; no other region can share a window.
   Neighbours in its order with a common prefix of LENGTH bytes share a window,
   and the least document of a run of neighbours keeps it.
4. Removed runs return to their documents, which are cut and digested.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .induced import suffix_array
from .minhash import _ODD, mix

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
#: Bits of the filter of shared anchors: 16 MB, whatever the data.
FILTER_BITS = 1 << 27
#: Bytes of a segment of a long text, of the segments whose scratch is held at once, and of regions that a task holds before they go to disk.
SEGMENT, SCRATCH, HELD = 1 << 20, 2 << 20, 64 << 20


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as one number."""
    raw = data.tobytes()
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for o in range(8):
        part = np.frombuffer(raw, "<u8", max(0, (len(raw) - o) // 8), o) if len(raw) >= o + 8 else np.zeros(0, np.uint64)
        out[o::8] = part[: len(out[o::8])]
    return out


class Block:
    """Documents side by side, long ones in segments that overlap by LENGTH - 1 bytes."""

    def __init__(self, texts: list[bytes]):
        doc, base, parts = [], [], []
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
                part = t[at : at + SEGMENT + LENGTH - 1]
                if len(part) >= LENGTH:
                    doc.append(i)
                    base.append(at)
                    parts.append(part)
        self.doc, self.base = np.array(doc, np.int64), np.array(base, np.int64)
        n = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        # scratch of many words a byte is held for a few segments at a time
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        found, at = [empty], 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SCRATCH, side="right")))
            lo = int(self.starts[at])
            *places, value = self._regions(self.data[lo : int(self.ends[stop - 1])], n[at:stop], self.ends[at:stop] - lo)
            found.append((*(x + lo for x in places), value))
            at = stop
        self.first, self.last, self.anchor, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))
        self.segment = np.searchsorted(self.starts, self.first, side="right") - 1

    @staticmethod
    def _regions(data: np.ndarray, n: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window, anchor and its hash of the regions of segments that lie side by side."""
        w = _words8(data)
        value = w[:-8] * _ODD[0] ^ (w[8:] * _ODD[1] >> np.uint64(29)) ^ w[8:] * _ODD[3]
        value ^= value >> np.uint64(32)
        value *= _ODD[2]
        value ^= value >> np.uint64(29)
        short = (value >> np.uint64(32)).astype(np.uint32)
        low, size = short, 1
        while size < SPAN:
            step = min(size, SPAN - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        # runs of windows with one least hash
        inside = np.ones(len(low) + 2, bool)
        inside[0] = inside[-1] = False
        dead = _ranges(ends - LENGTH + 2, np.full(len(n), LENGTH - 1))
        inside[dead[dead < len(low) + 1]] = False
        fresh = inside[1:-1].copy()
        fresh[1:] &= ~inside[1:-2] | (low[1:] != low[:-1])
        first = np.flatnonzero(fresh)
        fresh = np.append(fresh, True)
        last = np.flatnonzero(inside[1:-1] & (fresh[1:] | ~inside[2:]))
        # the leftmost place of that hash; windows beyond it have the next place
        parts = []
        while len(first):
            anchor = first + (short[first[:, None] + np.arange(SPAN)] == low[first][:, None]).argmax(1)
            upto = np.minimum(last, anchor)
            parts.append((first, upto, anchor))
            more = last > upto
            first, last = upto[more] + 1, last[more]
        first, last, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            order = np.argsort(first, kind="stable")
            first, last, anchor = first[order], last[order], anchor[order]
        return first, last, anchor, mix(value[anchor])

    def _words(self, at: np.ndarray) -> np.ndarray:
        """The 8 bytes from each of some places, as one number."""
        if not len(at):
            return np.zeros(0, np.uint64)
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, 8)[at]).view("<u8").ravel()

    def region_hash(self, keep: np.ndarray) -> np.ndarray:
        """A hash of all bytes of regions of LENGTH to LENGTH + SPAN - 1 bytes."""
        a, b = self.first[keep], self.last[keep] + LENGTH
        out = (b - a).astype(np.uint64) * _ODD[0]
        for k in range(6):
            out = (out ^ self._words(a + 8 * k)) * _ODD[1]
            out ^= out >> np.uint64(31)
        for k in range(1, 6):
            out = (out ^ self._words(b - 8 * k)) * _ODD[2]
            out ^= out >> np.uint64(31)
        return mix(out)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _encoded(batch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]


SEEN = "shard int, hashes binary"
_SEEN = pa.schema([("shard", pa.int32()), ("hashes", pa.binary())])


def _cut(at: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(shards + 1))


def _anchor_rows(shards: int):
    """Per block and shard: 31 bits of each anchor's hash, and whether two documents of the block hold it."""

    def run(batches):
        for b in common.blocks(batches, 1, 2 << 20):
            block = Block(_encoded(b))
            if not len(block.hash):
                continue
            doc = block.doc[block.segment]
            order = np.lexsort((doc, block.hash))
            h, d = block.hash[order], doc[order]
            fresh = np.concatenate(([True], h[1:] != h[:-1]))
            other = np.concatenate(([False], (h[1:] == h[:-1]) & (d[1:] != d[:-1])))
            group = np.cumsum(fresh) - 1
            several = np.bincount(group, other) > 0
            h = h[fresh]
            at = (h % np.uint64(shards)).astype(np.int64)
            value = ((h >> np.uint64(33)).astype(np.uint32) << np.uint32(1)) | several.astype(np.uint32)
            by, cut = _cut(at, shards)
            rows = [(s, value[by[cut[s] : cut[s + 1]]].astype("<u4").tobytes()) for s in range(shards) if cut[s] < cut[s + 1]]
            yield common.record(_SEEN, *zip(*rows, strict=True))

    return run


def _slice_bits(shards: int) -> int:
    return max(8, FILTER_BITS // shards // 8 * 8)


def _shared_anchors(shards: int):
    """Per shard: its slice of the filter."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(s, []).append(np.frombuffer(raw, "<u4"))
        bits = _slice_bits(shards)
        for s, parts in held.items():
            value = np.sort(np.concatenate(parts))
            h = value >> np.uint32(1)
            keep = (value & np.uint32(1)).astype(bool)
            keep[1:] |= h[1:] == h[:-1]
            mark = np.zeros(bits, bool)
            mark[h[keep].astype(np.int64) % bits] = True
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "bits": pa.array([np.packbits(mark).tobytes()])})

    return run


REGIONS = "shard int, block long, ids binary, keys binary, docs binary, starts binary, ends binary, hashes binary, folds binary, offsets binary, lengths binary, owners binary, uses binary, bytes binary"
_REGIONS = pa.schema([("shard", pa.int32()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("ids", "keys", "docs", "starts", "ends", "hashes", "folds", "offsets", "lengths", "owners", "uses", "bytes")])


def _regions(shared, shards: int):
    """Rows of kept regions by shard; and a head row with the block's documents and what it settled itself."""

    def run(batches):
        bits = _slice_bits(shards)
        filters = {s: np.frombuffer(raw, np.uint8) for s, raw in shared.value.items()}
        blank = np.zeros(bits // 8, np.uint8)
        table = np.concatenate([filters.get(s, blank) for s in range(shards)])
        task = TaskContext.get().partitionId()
        for k, b in enumerate(common.blocks(batches, 1, 2 << 20)):
            block = Block(_encoded(b))
            number = (task << 32) | k
            ids = b.column(0).to_numpy()
            shard = (block.hash % np.uint64(shards)).astype(np.int64)
            bit = ((block.hash >> np.uint64(33)) % np.uint64(bits)).astype(np.int64)
            kept = np.flatnonzero(table[shard * (bits // 8) + bit // 8] >> (7 - bit % 8).astype(np.uint8) & 1)
            doc = block.doc[block.segment[kept]]
            own = ids[doc]
            offset = block.base[block.segment[kept]] - block.starts[block.segment[kept]]
            start, end = block.first[kept] + offset, block.last[kept] + LENGTH + offset
            fold, h = block.region_hash(kept), block.hash[kept]
            order = np.lexsort((start, own, fold, h))
            same = np.zeros(len(order), bool)  # no region may be kept
            same[1:] = (h[order][1:] == h[order][:-1]) & (fold[order][1:] == fold[order][:-1])
            group = np.cumsum(~same) - 1
            least = own[order][~same][group]
            later = own[order] != least
            done, send = order[later], order[~later]
            head = (number % shards, number, ids.astype("<i8").tobytes(), b.column(2).to_numpy().astype("<i8").tobytes(), doc[done].astype("<u4").tobytes(), start[done].astype("<i8").tobytes(), end[done].astype("<i8").tobytes(), None, None, None, None, None, None, None)
            rows = [head]
            lead = order[~same]  # one for each distinct region, in the order of groups
            uses = np.bincount(group[~later], minlength=len(lead))
            first_use = np.cumsum(uses) - uses
            by, cut = _cut(shard[kept][lead], shards)
            for s in range(shards):
                g = by[cut[s] : cut[s + 1]]
                if not len(g):
                    continue
                r = lead[g]
                each = send[_ranges(first_use[g], uses[g])]
                a, n = block.first[kept[r]], (end - start)[r]
                rows.append((
                    s, number, None, None, doc[each].astype("<u4").tobytes(), start[each].astype("<i8").tobytes(), None,
                    h[r].tobytes(), fold[r].tobytes(), (block.anchor[kept[r]] - a).astype(np.uint8).tobytes(), n.astype(np.uint8).tobytes(),
                    own[r].astype("<i8").tobytes(), uses[g].astype("<u4").tobytes(), block.data[_ranges(a, n)].tobytes(),
                ))
            yield common.record(_REGIONS, *zip(*rows, strict=True))

    return run


MARKS = "block long, ids binary, keys binary, docs binary, starts binary, ends binary"
_MARKS = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("ids", "keys", "docs", "starts", "ends")])


#: Symbols of one suffix sort.  Anchors are sorted in groups of about this size; one anchor's regions stay together.
SORT_SYMBOLS = 1 << 20


#: Bytes beside the anchor of a window: one that has fewer than LEFT of them to the left has at least RIGHT to the right.
LEFT = (LENGTH - GRAM) // 2
RIGHT = LENGTH - GRAM - LEFT + 1


def _may_share(h: np.ndarray, size: np.ndarray, offset: np.ndarray, base: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether another region of the same anchor has the same LEFT bytes before it or the same RIGHT bytes after it.

    Equal windows have their anchor at the same place, so regions that share a
    window share one of these.  Sides are compared by hashes, which may let more pass.
    """
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    out = np.zeros(len(h), bool)
    for held, start, width in ((offset >= LEFT, offset - LEFT, LEFT), (size - offset - GRAM >= RIGHT, offset + GRAM, RIGHT)):
        i = np.flatnonzero(held)
        at, side = base[i] + start[i], h[i]
        for k in (0, 8, width - 8):
            side = (side ^ np.ascontiguousarray(words[at + k]).view("<u8").ravel()) * _ODD[1]
            side ^= side >> np.uint64(31)
        side = mix(side)
        order = np.argsort(side, kind="stable")
        same = side[order][1:] == side[order][:-1]
        out[i[order[1:][same]]] = out[i[order[:-1][same]]] = True
    return out


def settle(h: np.ndarray, fold: np.ndarray, length: np.ndarray, owner: np.ndarray, offset: np.ndarray | None, data: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, from, to): the bytes of regions under windows that a lesser owner also holds, by region.

    ``data`` has the bytes of all regions, and ``offset`` the place of the anchor
    in each; without it all regions of anchors with several go to the sort.
    """
    base = np.cumsum(length.astype(np.int64)) - length
    order = np.lexsort((owner, fold, h))
    ho = h[order]
    fresh = np.concatenate(([True], (ho[1:] != ho[:-1]) | (fold[order][1:] != fold[order][:-1])))
    group = np.cumsum(fresh) - 1
    lead = order[fresh]
    least = owner[lead][group]
    later = order[owner[order] != least]
    found = [(later, np.zeros(len(later), np.int64), length[later].astype(np.int64))]
    # anchors with several different regions
    lead_hash = h[lead]
    many = np.zeros(len(lead), bool)
    many[1:] |= lead_hash[1:] == lead_hash[:-1]
    many[:-1] |= lead_hash[1:] == lead_hash[:-1]
    chosen = np.flatnonzero(many)
    if offset is not None:
        near = lead[chosen]
        chosen = chosen[_may_share(h[near], length[near].astype(np.int64), offset[near].astype(np.int64), base[near], data)]
    first = order[owner[order] == least]  # regions of the least owner: more than one where it has several blocks
    first_group = group[owner[order] == least]
    upto = np.cumsum(length[lead[chosen]].astype(np.int64) + 1)
    at = 0
    while at < len(chosen):
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SORT_SYMBOLS, side="right"))
        stop = max(stop, at + 1)
        while stop < len(chosen) and lead_hash[chosen[stop]] == lead_hash[chosen[stop - 1]]:
            stop += 1
        part = chosen[at:stop]
        which, lo, hi = _shared_windows(lead[part], length, owner, base, data, memory)
        a, b = np.searchsorted(first_group, part[which]), np.searchsorted(first_group, part[which], side="right")
        found.append((first[_ranges(a, b - a)], np.repeat(lo, b - a), np.repeat(hi, b - a)))
        at = stop
    region, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(region, kind="stable")
    return region[by], lo[by], hi[by]


def _shared_windows(regions: np.ndarray, length: np.ndarray, owner: np.ndarray, held_at: np.ndarray, data: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-sort some regions: (place among them, from, to) of bytes under windows that a lesser owner's region holds."""
    size = length[regions].astype(np.int64)
    windows = size - LENGTH + 1
    base = np.cumsum(size + 1) - (size + 1)
    text = np.full(int(base[-1] + size[-1]) + 2, 1, np.int16)
    text[-1] = 0
    text[_ranges(base, size)] = data[_ranges(held_at[regions], size)].astype(np.int16) + 2
    of = np.full(len(text), -1, np.int32)
    of[_ranges(base, windows)] = np.repeat(np.arange(len(regions)), windows)
    suffixes, shared = suffix_array(text, 258, memory, cap=LENGTH)
    run = np.cumsum(shared < LENGTH) - 1
    held = of[suffixes] >= 0
    suffixes, run = suffixes[held], run[held]
    mine = owner[regions][of[suffixes]]
    fresh = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    least = np.repeat(np.minimum.reduceat(mine, fresh), np.diff(np.append(fresh, len(run))))
    gone = np.sort(suffixes[least < mine])
    if not len(gone):
        return (np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(gone) > 1) | (of[gone[1:]] != of[gone[:-1]]))))
    start, end = gone[cut], gone[np.append(cut[1:], len(gone)) - 1] + LENGTH
    which = of[start].astype(np.int64)
    return which, start - base[which], end - base[which]


_COLUMNS = {"hashes": "<u8", "folds": "<u8", "offsets": "u1", "lengths": "u1", "owners": "<i8", "uses": "<u4", "docs": "<u4", "starts": "<i8", "bytes": "u1"}


class Spool:
    """Rows of a shard's regions: in memory, or beyond ``HELD`` bytes on the task's disk, where they are parted by anchor."""

    def __init__(self):
        self.rows: list[dict] = []
        self.bytes = self.written = 0
        self.file = None

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.bytes += sum(x.nbytes for x in row.values() if isinstance(x, np.ndarray))
        if self.bytes > HELD:
            self.file = self.file or tempfile.TemporaryFile(prefix="regions-")
            self._write(self.file, self.rows)

    def _write(self, file, rows: list[dict]) -> None:
        pickle.dump(rows, file, pickle.HIGHEST_PROTOCOL)
        self.written, self.bytes, self.rows = self.written + self.bytes, 0, []

    @staticmethod
    def _read(file):
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return

    def parts(self):
        """Lists of rows; all regions of an anchor are in one list."""
        if self.file is None:
            if self.rows:
                yield self.rows
            return
        self._write(self.file, self.rows)
        files = [tempfile.TemporaryFile(prefix="regions-") for _ in range(-(-self.written // HELD))]
        for rows in self._read(self.file):
            for row in rows:
                part = ((row["hashes"] >> np.uint64(20)) % np.uint64(len(files))).astype(np.int64)
                for p in np.unique(part).tolist():
                    pickle.dump([_taken(row, np.flatnonzero(part == p))], files[p], pickle.HIGHEST_PROTOCOL)
        self.file.close()
        for f in files:
            yield [row for rows in self._read(f) for row in rows]
            f.close()


def _taken(row: dict, at: np.ndarray) -> dict:
    """Some regions of a row."""
    out = {"block": row["block"]} | {c: row[c][at] for c in ("hashes", "folds", "offsets", "lengths", "owners", "uses") if c in row}
    for sizes, columns in (("uses", ("docs", "starts")), ("lengths", ("bytes",))):
        size = row[sizes].astype(np.int64)
        each = _ranges((np.cumsum(size) - size)[at], size[at])
        out |= {c: row[c][each] for c in columns}
    return out


def _marks(part: list[dict], memory: int) -> list[tuple]:
    """What the regions of some rows lose, by block."""

    def joined(column: str) -> np.ndarray:
        return np.concatenate([r[column] for r in part])

    h, fold, length, owner, data = map(joined, ("hashes", "folds", "lengths", "owners", "bytes"))
    offset = joined("offsets") if all("offsets" in r for r in part) else None
    uses, docs, starts = joined("uses").astype(np.int64), joined("docs"), joined("starts")
    held = np.cumsum([len(r["lengths"]) for r in part])
    region, lo, hi = settle(h, fold, length, owner, offset, data, memory)
    n = uses[region]
    each = _ranges((np.cumsum(uses) - uses)[region], n)
    d, s, e = docs[each], starts[each] + np.repeat(lo, n), starts[each] + np.repeat(hi, n)
    edge = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(region, np.concatenate(([0], held)))]
    return [(r["block"], None, None, d[a:b].astype("<u4").tobytes(), s[a:b].astype("<i8").tobytes(), e[a:b].astype("<i8").tobytes()) for r, a, b in zip(part, edge[:-1].tolist(), edge[1:].tolist(), strict=True) if b > a]


def _search(memory: int):
    """Marks of one shard's regions, by block; head rows pass through."""

    def run(batches):
        spool = Spool()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                heads = []
                for r in batch.slice(at, 64).to_pylist():
                    if r["ids"] is not None:
                        heads.append((r["block"], r["ids"], r["keys"], r["docs"], r["starts"], r["ends"]))
                    else:
                        spool.add({"block": r["block"]} | {c: np.frombuffer(r[c], k) for c, k in _COLUMNS.items()})
                if heads:
                    yield common.record(_MARKS, *zip(*heads, strict=True))
        for part in spool.parts():
            if out := _marks(part, memory):
                yield common.record(_MARKS, *zip(*out, strict=True))

    return run


SPANS = "doc_id long, key long, spans binary"
_SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("spans", pa.binary())])


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of ranges."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate(([True], start[1:] > end[:-1]))
    return start[fresh], end[np.append(np.flatnonzero(fresh)[1:], len(end)) - 1]


def _by_document(rows: pa.Table) -> pa.Table:
    got = rows.to_pylist()
    head = next(r for r in got if r["ids"] is not None)
    ids, keys = np.frombuffer(head["ids"], "<i8"), np.frombuffer(head["keys"], "<i8")
    doc = np.concatenate([np.frombuffer(r["docs"], "<u4") for r in got])
    start, end = (np.concatenate([np.frombuffer(r[c], "<i8") for r in got]) for c in ("starts", "ends"))
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))).tolist() if len(doc) else []
    out = []
    for lo, hi in zip(cut, [*cut[1:], len(doc)][: len(cut)], strict=True):
        a, b = union(start[lo:hi], end[lo:hi])
        out.append((ids[doc[lo]], keys[doc[lo]], np.stack([a, b], 1).astype("<i8").tobytes()))
    return pa.Table.from_batches([common.record(_SPANS, *(zip(*out, strict=True) if out else ([], [], [])))], schema=_SPANS)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut_out(with_bytes: bool):
    def run(batches):
        for batch in batches:
            for b in common.blocks([batch], 1):
                out = []
                for doc_id, text, spans in zip(b.column(0).to_pylist(), _encoded(b), b.column(2).to_pylist(), strict=True):
                    kept, removed, runs = text, 0, 0
                    if spans:
                        pairs = np.concatenate([np.frombuffer(s, "<i8") for s in spans]).reshape(-1, 2)
                        start, end = union(pairs[:, 0], pairs[:, 1])
                        removed, runs = int((end - start).sum()), len(start)
                        edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
                        kept = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                    out.append((doc_id, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
                yield common.record(_CUT, *zip(*out, strict=True))

    return run


def remove_repeats(docs: DataFrame, with_bytes: bool = False, memory: int = 1 << 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept).

    A byte goes if a string of LENGTH bytes covers it that also starts in a
    document with a smaller doc_id.  Null texts are empty.  Rows that share a
    doc_id are one document for this: they take nothing from each other.  A row
    without doc_id has no place in the order; it loses nothing and takes
    nothing.  ``memory`` bounds the queues of a suffix sort before they go to
    the task's disk.  Other columns are ignored.
    """
    spark = docs.sparkSession
    shards = common.partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.encode(text, "UTF-8").alias("text"), F.xxhash64(text).alias("key"))
    ordered = rows.where("doc_id IS NOT NULL")
    seen = common.deal(ordered.select("doc_id", "text").mapInArrow(common.tidy(_anchor_rows(shards)), SEEN), "shard")
    filters = {r["shard"]: bytes(r["bits"]) for r in seen.mapInArrow(common.tidy(_shared_anchors(shards)), "shard int, bits binary").toLocalIterator()}
    dealt = common.deal(ordered.mapInArrow(common.tidy(_regions(spark.sparkContext.broadcast(filters), shards)), REGIONS), "shard")
    marks = dealt.mapInArrow(common.tidy(_search(memory)), MARKS)
    spans = marks.groupBy("block").applyInArrow(common.tidy_group(_by_document), SPANS)
    spans = common.scratch(spans.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans")), "spans")
    joined = rows.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(common.tidy(_cut_out(with_bytes)), CUT)
    return out if with_bytes else out.drop("kept")
