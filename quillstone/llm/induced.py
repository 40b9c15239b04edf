"""External suffix sorting by induction, one shard at a time.

A suffix is S if it is less than the next one and L otherwise; the leftmost S
suffixes of runs (LMS) induce all others.  Tuples move through one monotone
priority queue per pass: 256-odd first-in first-out buckets by leading symbol,
kept in memory up to a limit and on the task's disk beyond it.  A whole bucket
generation is taken at a time, so that the induction runs on arrays.  LMS
substrings are sorted by a first induction and named; the string of names is
sorted by the same routine, again and again until all names differ; a second
induction gives the order of all suffixes.  Where names are many, the buckets of
the queue are ranges of names, and a range is put in order as a whole.

A tuple carries, beside its suffix, the prefix (up to a cap) that it shares with
the tuple before it in its bucket.  When suffixes induce their predecessors, two
that follow each other in a bucket share one symbol more than the least of the
values between their sources; what lies between is kept as one minimum per
bucket from batch to batch.  Only LMS suffixes and the seams between the L and
the S part of a bucket are compared with the text.
"""

from __future__ import annotations

import tempfile

import numpy as np


class BucketQueue:
    """A monotone priority queue: FIFO buckets by symbol, spilled to a temporary file."""

    def __init__(self, buckets: int, memory: int = 64 << 20):
        self.held: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.on_disk: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]
        self.memory, self.bytes, self.spilled, self.file = memory, 0, 0, None

    def push(self, values: np.ndarray, symbols: np.ndarray) -> None:
        """Append values to the buckets of their symbols, in the order given."""
        if not len(values):
            return
        order = np.argsort(symbols, kind="stable")
        values, symbols = values[order], symbols[order]
        cut = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(values)], strict=True):
            self.held[symbols[lo]].append(values[lo:hi])
        self.bytes += values.nbytes
        if self.bytes > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="queue-")
        self.file.seek(0, 2)
        for c, chunks in enumerate(self.held):
            if chunks:
                part = np.concatenate(chunks).astype("<i8")
                self.on_disk[c].append((self.file.tell(), len(part)))
                self.file.write(part.tobytes())
                self.held[c] = []
        self.spilled += self.bytes
        self.bytes = 0

    def take(self, c: int) -> np.ndarray:
        """All that waits in a bucket, first come first."""
        parts = []
        for at, n in self.on_disk[c]:
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(8 * n), "<i8"))
        parts += self.held[c]
        self.bytes -= sum(p.nbytes for p in self.held[c])
        self.on_disk[c], self.held[c] = [], []
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S.  The last symbol must be the least and unique."""
    n = len(text)
    rising = np.zeros(n, np.int8)
    rising[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    rising[-1] = 1
    at = np.where(rising != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return rising[nearest] > 0


#: Bits of a tuple that hold its common prefix.
BITS = 6
CAP = (1 << BITS) - 1


class _Prefixes:
    """Common prefixes of what a pass pushes, from those of what it takes."""

    def __init__(self, symbols: int, cap: int):
        self.cap = cap
        self.between = np.full(symbols, cap, np.int64)  # least value since the last push to each bucket

    def pushed(self, prefix: np.ndarray, at: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """For sources at places ``at`` of a batch, pushed to buckets ``lead``: the values of the pushed tuples.

        ``prefix`` has those of the batch, each with the one taken before it.
        """
        order = np.argsort(lead, kind="stable")
        i, c = at[order], lead[order]
        fresh = np.concatenate(([True], c[1:] != c[:-1]))
        start = np.where(fresh, 0, np.concatenate(([0], i[:-1] + 1)))
        tables = [prefix.astype(np.int8)]
        most = int((i - start).max(initial=0)) + 1
        while 2 << (len(tables) - 1) <= most:
            half = 1 << (len(tables) - 1)
            tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
        low = np.empty(len(i), np.int64)
        size = np.frexp((i - start + 1).astype(float))[1] - 1
        for k, table in enumerate(tables):
            q = np.flatnonzero(size == k)
            low[q] = np.minimum(table[start[q]], table[i[q] - (1 << k) + 1])
        low[fresh] = np.minimum(low[fresh], self.between[c[fresh]])
        np.minimum(self.between, int(prefix.min(initial=self.cap)), out=self.between)
        last = np.flatnonzero(np.append(fresh[1:], True))
        rest = np.minimum.accumulate(prefix[::-1])[::-1]
        after = i[last] + 1
        self.between[c[last]] = np.where(after < len(prefix), rest[np.minimum(after, len(prefix) - 1)], self.cap)
        out = np.empty(len(i), np.int64)
        out[order] = np.minimum(low + 1, self.cap)
        return out

    def passed(self, prefix: np.ndarray) -> None:
        """A batch that pushes nothing."""
        np.minimum(self.between, int(prefix.min(initial=self.cap)), out=self.between)


def _seam(text: np.ndarray, a: int, b: int, cap: int) -> int:
    n = 0
    while n < cap and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
        n += 1
    return n


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int, memory: int, shared: np.ndarray | None = None, cap: int = 0, trace: list | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes, from LMS suffixes in order (of their leading symbols at least).

    With ``shared``, the common prefixes of neighbouring LMS suffixes, also
    those of all neighbours.  Bytes that went to disk are added to ``trace``.
    """
    carry = shared is not None
    if symbols > FEW and not carry:
        return _induce_ranges(text, small, lms, symbols, memory, trace), None

    def step(now: np.ndarray, prefix: np.ndarray | None, queue: BucketQueue, prefixes: _Prefixes | None, of_type: bool) -> None:
        """Push the predecessors of a batch that have the type."""
        at = np.flatnonzero(now > 0)
        before = now[at] - 1
        keep = small[before] == of_type
        at, before = at[keep], before[keep]
        lead = text[before]
        if not carry:
            queue.push(before, lead)
        elif len(before):
            queue.push(before << BITS | prefixes.pushed(prefix, at, lead.astype(np.int64)), lead)
        elif len(prefix):
            prefixes.passed(prefix)

    def taken(queue: BucketQueue, c: int) -> tuple[np.ndarray, np.ndarray | None]:
        got = queue.take(c)
        return (got >> BITS, got & CAP) if carry else (got, None)

    starts = np.searchsorted(text[lms], np.arange(symbols + 1))
    queue, prefixes = BucketQueue(symbols, memory), _Prefixes(symbols, cap) if carry else None
    none = np.zeros(0, np.int64)
    large: list[np.ndarray] = []
    large_shared: list[np.ndarray] = []
    for c in range(symbols):
        parts, values = [], []
        now, prefix = taken(queue, c)
        while len(now):
            if carry and not parts:
                prefix[0] = 0
            parts.append(now)
            values.append(prefix)
            step(now, prefix, queue, prefixes, False)
            now, prefix = taken(queue, c)
        large.append(np.concatenate(parts) if parts else none)
        stars = lms[starts[c] : starts[c + 1]]
        if carry:
            large_shared.append(np.concatenate(values) if values else none)
            prefix = shared[starts[c] : starts[c + 1]].copy()
            if len(stars):
                prefix[0] = _seam(text, int(large[c][-1]), int(stars[0]), cap) if parts else 0
        step(stars, prefix if carry else None, queue, prefixes, False)
    _close(queue, trace)
    queue, prefixes = BucketQueue(symbols, memory), _Prefixes(symbols, cap) if carry else None
    end = np.array([len(text) - 1])
    queue.push(end << BITS if carry else end, text[-1:].astype(np.int64))
    out: list[np.ndarray] = []
    out_shared: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        parts, values = [], []
        now, prefix = taken(queue, c)
        while len(now):
            if carry and not parts:
                prefix[0] = 0
            parts.append(now)
            values.append(prefix)
            step(now, prefix, queue, prefixes, True)
            now, prefix = taken(queue, c)
        up = np.concatenate(parts)[::-1] if parts else none
        down = large[c][::-1]
        if carry:
            seam = _seam(text, int(large[c][-1]), int(up[0]), cap) if len(up) and len(down) else 0
            rising = large_shared[c]
            prefix = np.append(seam, rising[:0:-1]) if len(down) else none
            of_up = np.concatenate(values) if parts else none
            out_shared += [np.append(seam, of_up[:0:-1]) if len(up) else none, rising]
            large_shared[c] = none
        step(down, prefix if carry else None, queue, prefixes, True)
        out += [up, large[c]]
        large[c] = none
    _close(queue, trace)
    return np.concatenate(out[::-1]), np.concatenate(out_shared[::-1]) if carry else None


def _same_substrings(text: np.ndarray, small: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the LMS substrings at a and b, with lengths by position, are equal."""
    equal = length[a] == length[b]
    at = np.flatnonzero(equal)
    k = 0
    while len(at):
        ok = (text[a[at] + k] == text[b[at] + k]) & (small[a[at] + k] == small[b[at] + k])
        equal[at[~ok]] = False
        k += 1
        at = at[ok]
        at = at[length[a[at]] > k]
    return equal


#: Symbols beyond which a queue's buckets are ranges of symbols; ranges at most, and suffixes that are worth a range.
FEW, RANGES, WORTH = 2048, 64, 4096


def _close(queue: BucketQueue, trace: list | None) -> None:
    queue.close()
    if trace is not None:
        trace[-1]["spilled"] += queue.spilled


def _in_order(symbol: np.ndarray, seed: np.ndarray, base: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The order of a range's suffixes by symbol, induced ones before seeds, then by base or, where that is -1, as their parents stand.

    Ranks double the distance over which parents are looked at; who has a base
    has a rank of its own, so chains of any length end.
    """
    key = symbol * 2 + seed
    order = np.lexsort((base, base < 0, key))
    rank = np.empty(len(key), np.int64)

    def number(order: np.ndarray, *columns: np.ndarray) -> None:
        fresh = np.zeros(len(order), bool)
        for x in columns:
            fresh[1:] |= x[order][1:] != x[order][:-1]
        rank[order] = np.cumsum(fresh)

    number(order, key, base)
    above = np.where(base < 0, parent, np.arange(len(key)))
    while len(key) and rank[order[-1]] < len(key) - 1:
        next_rank = rank[above]
        order = np.lexsort((next_rank, rank))
        number(order, rank.copy(), next_rank)
        above = above[above]
    return order


def _induce_ranges(text: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int, memory: int, trace: list | None = None) -> np.ndarray:
    """The same for many symbols: buckets are ranges of symbols of about equally many suffixes.

    What a range's suffixes induce inside it is found by following predecessors
    until none is left; the range is then put in order as a whole.
    """
    n = len(text)
    count = max(1, min(RANGES, n // WORTH))
    upto = np.cumsum(np.bincount(text, minlength=symbols))
    edge = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(1, count) * n // count) + 1, [symbols])))
    edge = edge[edge <= symbols]
    of_symbol = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    here = np.full(n, -1, np.int64)

    def settle(r: int, arrived: np.ndarray, seeds: np.ndarray, of_type: bool, sign: int, queue: BucketQueue) -> np.ndarray:
        """A range's suffixes in the order in which the pass meets them; predecessors in later ranges are pushed."""
        found, front, lo, hi = [arrived], np.concatenate([arrived, seeds]), edge[r], edge[r + 1]
        while len(front):
            front = front[front > 0] - 1
            front = front[(small[front] == of_type) & (text[front] >= lo) & (text[front] < hi)]
            found.append(front)
        induced = np.concatenate(found)
        every = np.concatenate([induced, seeds])
        here[every] = np.arange(len(every))
        base = np.full(len(every), -1, np.int64)
        base[: len(arrived)] = np.arange(len(arrived))
        base[len(induced) :] = np.arange(len(seeds))
        parent = here[np.minimum(every + 1, n - 1)]
        order = _in_order(sign * text[every].astype(np.int64), np.arange(len(every)) >= len(induced), base, parent)
        here[every] = -1
        every = every[order]
        before = every[every > 0] - 1
        before = before[(small[before] == of_type) & ((text[before] >= hi) | (text[before] < lo))]
        queue.push(before, of_symbol[text[before]])
        return every

    queue = BucketQueue(len(edge) - 1, memory)
    starts = np.searchsorted(text[lms], edge)
    large = []
    for r in range(len(edge) - 1):
        every = settle(r, queue.take(r), lms[starts[r] : starts[r + 1]], False, 1, queue)
        large.append(every[~small[every]])
    _close(queue, trace)
    queue = BucketQueue(len(edge) - 1, memory)
    queue.push(np.array([n - 1]), of_symbol[text[-1:]])
    out = []
    for r in range(len(edge) - 2, -1, -1):
        out.append(settle(r, queue.take(r), large[r][::-1], True, -1, queue))
        large[r] = large[r][:0]
    _close(queue, trace)
    return np.concatenate(out)[::-1]


def suffix_array(text: np.ndarray, symbols: int, memory: int = 64 << 20, cap: int = 0, trace: list | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """The suffixes of a text in order.  Its last symbol must be 0, which occurs nowhere else.

    With a ``cap`` (at most CAP) also the symbols, up to it, that each suffix
    shares with the one before it.  ``trace`` gets a row for each level of the
    recursion: suffixes, symbols, and bytes of tuples that went to disk.
    """
    if trace is not None:
        trace.append({"suffixes": len(text), "symbols": symbols, "spilled": 0})
    if len(text) == 1:
        one = np.zeros(1, np.int64)
        return (one, one) if cap else one
    small = _types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first, _ = _induce(text, small, stars[np.argsort(text[stars], kind="stable")], symbols, memory, trace=trace)
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    ordered = first[is_star[first]]
    length = np.zeros(len(text), np.int64)
    length[stars] = np.diff(np.append(stars, len(text) - 1)) + 1
    length[stars[-1]] = 1
    fresh = np.concatenate(([True], ~_same_substrings(text, small, ordered[1:], ordered[:-1], length)))
    name = np.cumsum(fresh) - 1
    if name[-1] < len(stars) - 1:
        at = np.zeros(len(text), np.int64)
        at[ordered] = name
        reduced = at[stars]
        deeper = None if trace is None else []
        ordered = stars[suffix_array(reduced, int(name[-1]) + 1, memory, trace=deeper)]
        if deeper:
            trace[:0] = deeper  # the row of this level stays last
    shared = common_prefixes(text, ordered, cap) if cap else None
    out, prefix = _induce(text, small, ordered, symbols, memory, shared, cap, trace)
    return (out, prefix) if cap else out


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Symbols, at most ``cap``, that each suffix shares with the one before it in order."""
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    n = len(text)
    for k in range(cap):
        a, b = order[at] + k, order[at - 1] + k
        inside = (a < n) & (b < n)
        at, a, b = at[inside], a[inside], b[inside]
        at = at[text[a] == text[b]]
        if not len(at):
            break
        out[at] = k + 1
    return out
