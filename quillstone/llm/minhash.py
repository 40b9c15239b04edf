"""MinHash near-duplicates with tensored banding.

Two collections of ``m`` keys, each of two minhashes, are taken per set; table
(i, j) is keyed by the pair (left key i, right key j).  So 4 m minhashes serve
m * m tables of four.  A pair of similarity s shares a table unless all left or
all right keys differ: at s = 0.8 and m = 10 that is below (1 - 0.64) ** 10 * 2,
or 1 in 13,000, for a single pair.

1. Sets are hashed to 64 bits; equal sets are folded to one node.
2. The tables are asked in rounds.  A block of nodes sends each of its keys once
   to a shard, with its least node in the round's random order; the shard names
   one leader per bucket and answers blocks whose bucket holds several
   components.  A node is paired with leaders of components other than its own:
   in buckets of two with all, of larger ones with the first in the round's
   order.  A hot bucket so costs a shard one entry per block and a round makes
   about one pair per node of a group, however large the group.
3. Pairs are confirmed on full sets, which only candidates carry, and links are
   united to components before the next round.  The first round asks m tables,
   the second all m * m, later ones only the buckets that are still open.
4. Buckets that stay open are finished exactly in bounded pairs of blocks, whose
   intersections are counted by matrix products; only links leave a task.
5. Links are united again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components, refine

M = 10
BLOCK, SALTS = 512, 16
#: Rounds at most, and the share (1 / FEW) of tried pairs that must be links for another, before the exact step.
ROUNDS, FEW = 4, 10
#: Odd 64-bit multipliers of public mixing functions.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_S32 = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> _S32)) * _ODD[3]
    return x ^ (x >> _S32)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _ODD[0])
    return seeds[:n], seeds[n:] | np.uint64(1)


_XOR, _MUL = _constants(4 * M)


def shingle_sets(texts: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, one after the other and sorted in each, and their counts."""
    lists = [common.SPACED_WORD.findall(common.fold(t)) for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    flat = [w for x in lists for w in x]
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    coded = pa.array(flat, pa.string()).dictionary_encode()
    hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    w = hashed[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(texts)), n)
    total = len(w)
    value = np.zeros(total, np.uint64)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * _ODD[1]) | np.uint64(1)
    for k in range(min(size, total)):
        value[: total - k] += mix(w[k:]) * weights[k]
    ends = np.cumsum(n)
    start = ends - n
    whole = (np.arange(total) - start[doc]) <= (n[doc] - size)
    sets, sets_doc = mix(value[whole]), doc[whole]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = [mix((mix(w[start[i] : ends[i]]) * weights[: n[i]]).sum(keepdims=True) + np.uint64(n[i]) * _ODD[2])[0] for i in short]
        sets, sets_doc = np.concatenate([sets, np.array(extra, np.uint64)]), np.concatenate([sets_doc, short])
    order = np.lexsort((sets, sets_doc))
    sets, sets_doc = sets[order], sets_doc[order]
    first = np.ones(len(sets), bool)
    first[1:] = (sets[1:] != sets[:-1]) | (sets_doc[1:] != sets_doc[:-1])
    sets, sets_doc = sets[first], sets_doc[first]
    return sets, np.bincount(sets_doc, minlength=len(texts))


def keys_of(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """2 m keys of each non-empty set: left keys, then right keys."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    low = [np.minimum.reduceat((sets ^ x) * a, starts) for x, a in zip(_XOR, _MUL, strict=True)]
    return np.stack([mix(low[2 * i] + mix(low[2 * i + 1])) for i in range(2 * M)], 1) if len(starts) else np.zeros((0, 2 * M), np.uint64)


SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, keys binary"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.binary())])


def _sign(size: int):
    def run(batches):
        for b in common.blocks(batches, 1):
            sets, counts = shingle_sets(b.column(1).to_pylist(), size)
            full = counts > 0
            starts = (np.cumsum(counts) - counts)[full]
            s1, s2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
            if len(starts):
                s1[full], s2[full] = np.add.reduceat(sets, starts), np.add.reduceat(mix(sets), starts)
            keys = iter(keys_of(sets, counts))
            packed = [next(keys).astype("<u8").tobytes() if f else None for f in full]
            yield common.record(_SIGNED, b.column(0), counts, s1.view(np.int64), s2.view(np.int64), packed)

    return run


#: Tables (i, j) by number, and those of the first round.
ALL = [(i, j) for i in range(M) for j in range(M)]
DIAGONAL = [M * i + i for i in range(M)]

ASKED = "shard int, block long, keys binary, leads binary, of binary, sizes binary, counts binary, mixed binary, opens binary"
_ASKED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "leads", "of", "sizes", "counts", "mixed", "opens"))])


def table_keys(sig: np.ndarray, tables: list[int]) -> np.ndarray:
    """Keys of the numbered tables, one column each."""
    return np.stack([mix(sig[:, i] * _ODD[0] + sig[:, M + j] * _ODD[1] + np.uint64(i * M + j)) for i, j in (ALL[t] for t in tables)], 1)


def _rank(node: np.ndarray, seed: int) -> np.ndarray:
    """A random order of nodes, another in each round and the same in all of its tables, so that leaders agree."""
    return mix(node.view(np.uint64) ^ mix(np.array([seed + 1], np.uint64) * _ODD[2]))


def _entries(sig: np.ndarray, opens: np.ndarray | None, tables: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of the open buckets of a block."""
    keys = table_keys(sig, tables)
    if opens is None:
        return keys.ravel(), np.repeat(np.arange(len(sig)), len(tables))
    row, column = np.nonzero(np.unpackbits(opens, axis=1, count=M * M)[:, tables])
    return keys[row, column], row


def _ask_rows(batches, tables: list[int], seed: int, shards: int, task: int):
    """Blocks of (node, component, n, keys, open): one row with the block's own nodes, and its distinct keys by shard."""
    k = 0
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            node, of, n = (part.column(i).to_numpy() for i in range(3))
            raw = b"".join(part.column(3).to_pylist())
            opens = None if part.column(4).null_count else b"".join(part.column(4).to_pylist())
            block = (task << 32) | k
            k += 1
            sig = np.frombuffer(raw, "<u8").reshape(-1, 2 * M)
            key, row = _entries(sig, None if opens is None else np.frombuffer(opens, np.uint8).reshape(len(sig), -1), tables)
            order = np.lexsort((_rank(node, seed)[row], key))
            key, row = key[order], row[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            rows = [(block % shards, block, raw, node.astype("<i8").tobytes(), of.astype("<i8").tobytes(), n.astype("<i4").tobytes(), None, None, opens)]
            if len(start):
                many = np.diff(np.append(start, len(key)))
                mixed = np.minimum.reduceat(of[row], start) != np.maximum.reduceat(of[row], start)
                key, lead = key[start], row[start]
                at = (key % np.uint64(shards)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[order], np.arange(shards + 1))
                for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                    i = order[cut[s] : cut[s + 1]]
                    x = lead[i]
                    rows.append((s, block, key[i].astype("<u8").tobytes(), node[x].astype("<i8").tobytes(), of[x].astype("<i8").tobytes(), n[x].astype("<i4").tobytes(), np.minimum(many[i], 3).astype("u1").tobytes(), mixed[i].astype("u1").tobytes(), None))
            yield common.record(_ASKED, *zip(*rows, strict=True))


def _ask(tables: list[int], seed: int, shards: int):
    return lambda batches: _ask_rows(batches, tables, seed, shards, TaskContext.get().partitionId())


def _lead(seed: int):
    """Of each bucket that holds several components: its leader, to every block that asked; heads pass."""

    def run(batches):
        held: list[list[np.ndarray]] = [[] for _ in range(7)]
        for b in batches:
            head = pc.is_null(b.column(6))
            if heads := b.filter(head):
                yield heads
            rows = b.filter(pc.invert(head))
            if rows.num_rows:
                got = [np.frombuffer(b"".join(rows.column(i).to_pylist()), t) for i, t in ((2, "<u8"), (3, "<i8"), (4, "<i8"), (5, "<i4"), (6, "u1"), (7, "u1"))]
                sizes = pc.binary_length(rows.column(2)).to_numpy() // 8
                for x, y in zip(held, [*got, np.repeat(rows.column(1).to_numpy(), sizes)], strict=True):
                    x.append(y)
        if not held[0]:
            return
        key, lead, of, n, many, mixed, block = (np.concatenate(x) for x in held)
        del held
        order = np.lexsort((_rank(lead, seed), key))
        key, lead, of, n, many, mixed, block = (x[order] for x in (key, lead, of, n, many, mixed, block))
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        several = np.repeat(np.maximum.reduceat(mixed, start).astype(bool) | (np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)), size)
        more = np.repeat(np.add.reduceat(many.astype(np.int64), start) > 2, size)
        first = np.repeat(start, size)
        at = np.flatnonzero(several)
        at = at[np.argsort(block[at], kind="stable")]
        edge = np.flatnonzero(np.concatenate(([True], block[at][1:] != block[at][:-1], [True]))) if len(at) else [0]
        for lo in range(0, len(edge) - 1, 256):
            rows = []
            for a, z in zip(edge[lo : lo + 256], edge[lo + 1 : lo + 257], strict=False):
                i, f = at[a:z], first[at[a:z]]
                rows.append((0, int(block[i[0]]), key[i].tobytes(), lead[f].tobytes(), of[f].tobytes(), n[f].tobytes(), more[i].astype("u1").tobytes(), None, None))
            yield common.record(_ASKED, *zip(*rows, strict=True))

    return run


TRIED = "a long, b long, n int, keys binary, open binary"
_TRIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("open", pa.binary())])


def _tries(tables: list[int], seed: int, percent: int):
    """Pairs of a block's nodes with leaders of other components; and, with b null, nodes of buckets of three or more that are open.

    A pair too unlike in size is dropped at once.  A bucket of two is settled by its pair.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        head = pc.is_null(rows["counts"])
        answers, own = rows.filter(pc.invert(head)), rows.filter(head).to_pylist()
        if not answers.num_rows or not own:
            return _TRIED.empty_table()
        own = own[0]
        node, of, n = (np.frombuffer(own[c], t) for c, t in (("leads", "<i8"), ("of", "<i8"), ("sizes", "<i4")))
        opens = own["opens"] and np.frombuffer(own["opens"], np.uint8).reshape(len(node), -1)
        key, row = _entries(np.frombuffer(own["keys"], "<u8").reshape(len(node), 2 * M), opens, tables)
        asked, lead, lead_of, lead_n, more = (np.frombuffer(b"".join(answers[c].to_pylist()), t) for c, t in (("keys", "<u8"), ("leads", "<i8"), ("of", "<i8"), ("sizes", "<i4"), ("counts", "u1")))
        order = np.argsort(asked, kind="stable")
        at = np.minimum(np.searchsorted(asked[order], key), len(asked) - 1)
        hit = asked[order][at] == key
        row, at, where = row[hit], order[at[hit]], np.flatnonzero(hit)
        new = np.flatnonzero((of[row] != lead_of[at]) & (100 * np.minimum(n[row], lead_n[at]).astype(np.int64) >= percent * np.maximum(n[row], lead_n[at]).astype(np.int64)))
        # of larger buckets' leaders, which later rounds or the exact step stand in for, a node meets the first in the round's order
        new = new[np.lexsort((_rank(lead[at[new]], seed), more[at[new]], row[new]))]
        before = np.zeros(len(new), bool)  # none may be new: all too unlike in size, or of the leader's component
        before[1:] = (row[new][1:] == row[new][:-1]) & (more[at[new]][:-1] > 0)
        new = new[~before]
        a, c = node[row[new]], lead[at[new]]
        pairs = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], 1), axis=0)
        bits = np.zeros((len(node), M * M), np.uint8)
        if opens is None:
            column = np.asarray(tables)[where % len(tables)]
        else:
            column = np.asarray(tables)[np.nonzero(np.unpackbits(opens, axis=1, count=M * M)[:, tables])[1][where]]
        still = more[at] > 0
        bits[row[still], column[still]] = 1
        left = np.flatnonzero(bits.any(1))
        packed = np.packbits(bits[left], axis=1)
        raw, width = own["keys"], 16 * M
        nothing = [None] * len(pairs)
        return pa.Table.from_batches(
            [
                common.record(_TRIED, pairs[:, 0], pairs[:, 1], nothing, nothing, nothing),
                common.record(_TRIED, node[left], [None] * len(left), n[left], [raw[width * i : width * (i + 1)] for i in left.tolist()], [x.tobytes() for x in packed]),
            ]
        )

    return run


def ask(state: DataFrame, tables: list[int], seed: int, percent: int) -> DataFrame:
    """One round over ``state`` (node, component, n, keys, open): pairs to confirm (a, b), and open nodes (a, n, keys, open) with b null."""
    shards = common.partitions(state.sparkSession)
    asked = state.select("node", "component", "n", "keys", "open").mapInArrow(common.tidy(_ask(tables, seed, shards)), ASKED)
    told = common.deal(asked, "shard").mapInArrow(common.tidy(_lead(seed)), ASKED)
    return told.groupBy("block").applyInArrow(common.tidy_group(_tries(tables, seed, percent)), TRIED)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: Bits of the filter of candidate nodes: 4 MB, whatever the data.
FILTER_BITS = 1 << 25


def _bit(node: np.ndarray) -> np.ndarray:
    return (mix(node.view(np.uint64) * _ODD[1]) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter_words(batches):
    at = [np.unique(_bit(b.column(0).to_numpy()) >> 3) for b in batches]  # bytes that are set
    if at:
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.unique(np.concatenate(at)), pa.int64())})


SETS = "node long, n int, shingles binary"
_SETS = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("shingles", pa.binary())])


def _full_sets(shared, size: int):
    def run(batches):
        held = np.frombuffer(shared.value, bool)  # by bytes of the filter
        for b in common.blocks(batches, 1):
            ids = b.column(0).fill_null(common.NULL_ID).to_numpy()
            b = b.filter(pa.array(held[_bit(ids) >> 3]))
            if b.num_rows:
                sets, counts = shingle_sets(b.column(1).to_pylist(), size)
                ends = np.cumsum(counts)
                yield common.record(_SETS, b.column(0), counts.astype(np.int32), [sets[e - c : e].astype("<u8").tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)])

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = np.sort(np.concatenate([p, q]), kind="stable")
                    n = int((both[1:] == both[:-1]).sum())
                    if 100 * n >= percent * (len(p) + len(q) - n):
                        keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=_PAIRS).take(pa.array(keep))

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(common.tidy(_confirm(percent)), "a long, b long")


def _block_links(group: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links across components in one pair of blocks, thinned to a forest."""
    node, component, side = (np.array([r[c] for r in group]) for c in ("node", "component", "block"))
    sig = np.frombuffer(b"".join(r["keys"] for r in group), "<u8").reshape(len(node), -1)[:, :M]
    sets = [np.frombuffer(r["shingles"], "<u8") for r in group]
    n = np.array([len(s) for s in sets])
    table, low = group[0]["table"], group[0]["low"]
    first = np.flatnonzero(side == low)
    second = first if low == group[0]["high"] else np.flatnonzero(side != low)
    root = {c: c for c in set(component.tolist())}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    step = 128
    for lo in range(0, len(first), step):
        f = first[lo : lo + step]
        for hi in range(0, len(second), step):
            s = second[hi : hi + step]
            wanted = component[f][:, None] != component[s][None, :]
            for earlier in range(table):
                wanted &= sig[f, earlier][:, None] != sig[s, earlier][None, :]
            wanted &= 100 * np.minimum(n[f][:, None], n[s][None, :]) >= percent * np.maximum(n[f][:, None], n[s][None, :])
            if not wanted.any():
                continue
            f_at, s_at = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
            common_ids = np.intersect1d(np.concatenate([sets[i] for i in f[f_at]]), np.concatenate([sets[i] for i in s[s_at]]))
            shared_by = np.zeros((len(f_at), len(s_at)), np.float32)
            for c0 in range(0, len(common_ids), 20_000):
                ids = common_ids[c0 : c0 + 20_000]

                def incidence(rows, ids=ids):
                    out = np.zeros((len(rows), len(ids)), np.float32)
                    for r, i in enumerate(rows):
                        k = np.minimum(np.searchsorted(ids, sets[i]), len(ids) - 1)
                        out[r, k[ids[k] == sets[i]]] = 1
                    return out

                shared_by += incidence(f[f_at]) @ incidence(s[s_at]).T
            union = n[f[f_at]][:, None] + n[s[s_at]][None, :] - shared_by
            for x, y in zip(*np.nonzero(wanted[np.ix_(f_at, s_at)] & (100 * shared_by >= percent * union)), strict=True):
                a, b = find(component[f[f_at[x]]]), find(component[s[s_at[y]]])
                if a != b:
                    root[a] = b
                    links.append((int(node[f[f_at[x]]]), int(node[s[s_at[y]]])))
    return links


_GROUP = ("table", "left", "low", "high")


def _sorted_groups(percent: int):
    """Rows sorted by pair of blocks: one pair, of at most about 2 * BLOCK nodes, is held at a time."""

    def run(batches):
        at, held = None, []
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                own = tuple(r[c] for c in _GROUP)
                if own != at:
                    if len(held) > 1 and (links := _block_links(held, percent)):
                        yield common.record(_PAIRS, *zip(*links, strict=True))
                    at, held = own, []
                held.append(r)
        if len(held) > 1 and (links := _block_links(held, percent)):
            yield common.record(_PAIRS, *zip(*links, strict=True))

    return run


def _leftover(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components among nodes of open buckets (node, component, keys).

    Open nodes are grouped by each left key, so every pair of a bucket meets.
    The size of a group goes to its rows by a salted join; a group of more than
    ``BLOCK`` nodes is compared in pairs of blocks.
    """
    tables = left.select("node", "component", F.posexplode(F.array(*[F.substring("keys", 8 * i + 1, 8) for i in range(M)])).alias("table", "left"))
    counts = tables.groupBy("table", "left").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    counts = counts.select("table", "left", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = tables.withColumn("salt", F.pmod(F.xxhash64("node", "table"), F.lit(SALTS)).cast("int")).join(counts, ["table", "left", "salt"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("table", "left", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = dealt.join(left, "node").join(sets.select("node", "shingles"), "node")
    rows = rows.repartition(common.partitions(left.sparkSession), *_GROUP).sortWithinPartitions(*_GROUP)
    return rows.select("table", "left", "low", "high", "block", "node", "component", "keys", "shingles").mapInArrow(common.tidy(_sorted_groups(percent)), "a long, b long")


def _wanted(nodes: DataFrame) -> np.ndarray:
    """The filter of these nodes, by bytes."""
    held = np.zeros(FILTER_BITS >> 3, bool)
    for part in nodes.mapInArrow(common.tidy(_filter_words), "at long").dropDuplicates().toArrow().to_batches():
        held[part.column(0).to_numpy()] = True
    return held


def near_duplicates(docs: DataFrame, size: int, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked whose sets of ``size``-word shingles have
    100 * intersection >= ``percent`` * union.  Null, empty and wordless texts
    have an empty set and link with nothing; fewer words than ``size`` make one
    shingle.  Rows that share a doc_id are one node of the graph; a row without
    doc_id has no component and is kept.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = common.scratch(texts.mapInArrow(common.tidy(_sign(size)), SIGNED), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = common.scratch(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "groups")
    nodes = full.select(F.col("doc_id").alias("node"), "s1", "s2", "keys", F.col("n_shingles").cast("int").alias("n")).join(groups, ["node", "s1", "s2"]).select("node", "keys", "n").dropDuplicates(["node"])
    nodes = common.scratch(nodes, "nodes")
    named = texts.where("doc_id IS NOT NULL")

    def full_sets(held: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(held.tobytes())
        return common.scratch(named.mapInArrow(common.tidy(_full_sets(shared, size)), SETS).join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")

    components, sets, held, left = None, None, None, None
    state = nodes.withColumn("open", F.lit(None).cast("binary"))
    for seed in range(ROUNDS):
        if components is None:
            labelled = state.withColumn("component", F.col("node"))
        else:
            labelled = state.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        asked = common.scratch(ask(labelled, DIAGONAL if not seed else list(range(M * M)), seed, percent), "asked")
        pairs = asked.where("b IS NOT NULL").select("a", "b")
        left = asked.where("b IS NULL").select(F.col("a").alias("node"), "n", "keys", "open")
        if seed < 2:
            wanted = _wanted(pairs.select(F.explode(F.array("a", "b")).alias("node")))
            if seed:
                wanted = (wanted | _wanted(left.select("node"))) & ~held
                sets, held = sets.unionByName(full_sets(wanted)), None
            else:
                sets, held = full_sets(wanted), wanted
        tried = common.scratch(pairs.dropDuplicates(), "tried", files=common.files_for(pairs.count(), spark))
        links = common.scratch(confirm(tried, sets, percent), "confirmed")
        found, most = links.count(), tried.count()
        if found:
            components = connected_components(links) if components is None else refine(components, links)
        if seed:
            if FEW * found < most or left.isEmpty():
                break
            state = left
    if components is None:
        components = connected_components(links)
    if not left.isEmpty():
        left = left.join(components, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "keys")
        rest = common.scratch(_leftover(common.scratch(left, "left"), sets, percent), "confirmed")
        if not rest.isEmpty():
            components = refine(components, rest)
    # folded copies: a doc_id may stand for several sets, so the groups are links as well
    found = groups.join(components, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("found"))
    # texts without shingles match no group; their keys are spread so that they share no task
    keyed = signed.withColumn("s2", F.when(F.col("n_shingles") > 0, F.col("s2")).otherwise(F.xxhash64("doc_id")))
    out = keyed.join(found, ["s1", "s2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component_id", "doc_id"), "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
