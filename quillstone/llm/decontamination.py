"""Benchmark decontamination with a distributed positional inverted index.

1. The benchmark's windows (13 words, or a whole shorter item) give the test
   vocabulary.  Its size is checked: beyond ``max_bytes`` of benchmark text, so
   about as many bytes over six in windows, the windows are taken in slices that
   are broadcast one after the other.
2. Each task indexes the postings (term, position) of the test vocabulary in
   blocks of documents; blocks are written as index shards to the shared
   folder.  All positions of a document lie in one shard, so nothing is
   shuffled, whatever words or passages are frequent.
3. Frequencies of all terms over the whole index order each window's terms.
   Postings of the rarest term, less its offset, are the first candidates;
   the offset-adjusted lists of the next rarest terms are intersected until all
   have been, which leaves the exact occurrences.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
_SHARD = pa.schema([("ids", pa.binary()), ("n_words", pa.binary()), ("bases", pa.binary()), ("terms", pa.binary()), ("spread", pa.binary()), ("places", pa.binary())])
SHARD = "ids binary, n_words binary, bases binary, terms binary, spread binary, places binary"
_FOUND = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
FOUND = "row long, n_words long, hits binary, items array<string>, near array<string>"


def words(text: str | None) -> list[str]:
    return common.ALNUM_WORD.findall(common.fold(text))


@dataclass
class Windows:
    """Distinct windows of one slice of the benchmark, over a vocabulary of term numbers."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    terms: list[tuple[int, ...]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)
    whole: dict[str, list[tuple[int, ...]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, str]], size: int) -> Windows:
        out = cls()
        seen: dict[tuple[int, ...], int] = {}
        for item, text in rows:
            ids = [out.vocabulary.setdefault(w, len(out.vocabulary)) for w in words(text)]
            if not ids:
                continue
            out.whole.setdefault(item, []).append(tuple(ids))
            for a in range(max(1, len(ids) - size + 1)):
                w = tuple(ids[a : a + size])
                at = seen.setdefault(w, len(seen))
                if at == len(out.items):
                    out.terms.append(w)
                    out.items.append([])
                if item not in out.items[at]:
                    out.items[at].append(item)
        return out


def _index(shared, gap: int):
    def run(batches):
        vocabulary = shared.value
        get = vocabulary.get
        for b in common.blocks(batches, 1):
            lists = [words(t) for t in b.column(1).to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            bases = np.concatenate(([0], np.cumsum(n + gap)))[:-1]
            ids = np.array([get(w, -1) for x in lists for w in x], np.int64)
            place = np.repeat(bases - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(len(ids))
            keep = ids >= 0
            ids, place = ids[keep], place[keep]
            order = np.argsort(ids, kind="stable")
            terms, spread = np.unique(ids, return_counts=True)
            row = b.column(0)
            yield common.record(
                _SHARD,
                [row.fill_null(common.NULL_ID).to_numpy().astype("<i8").tobytes()], [n.astype("<i8").tobytes()], [bases.astype("<i8").tobytes()],
                [terms.astype("<i4").tobytes()], [spread.astype("<i4").tobytes()], [place[order].astype("<i4").tobytes()],
            )

    return run


def _frequencies(terms: int):
    def run(batches):
        total = np.zeros(terms, np.int64)
        for b in batches:
            for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[np.frombuffer(t, "<i4")] += np.frombuffer(s, "<i4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    return run


@dataclass
class Plan:
    """For each rank: the term and offset of every window, from its rarest term on."""

    rank_terms: np.ndarray
    rank_offsets: np.ndarray
    lengths: np.ndarray
    first: dict[int, np.ndarray]
    items: list[list[str]]
    near: list[tuple[str, tuple[int, ...]]]
    slop: int

    @classmethod
    def of(cls, windows: Windows, frequency: np.ndarray, slop: int) -> Plan:
        size = max(map(len, windows.terms), default=0)
        n = len(windows.terms)
        rank_terms, rank_offsets = np.full((n, size), -1, np.int32), np.zeros((n, size), np.uint8 if size <= 256 else np.int32)
        first: dict[int, list[int]] = {}
        for i, w in enumerate(windows.terms):
            order = sorted(range(len(w)), key=lambda o: (frequency[w[o]], o))
            rank_terms[i, : len(w)] = [w[o] for o in order]
            rank_offsets[i, : len(w)] = order
            if frequency[w[order[0]]]:
                first.setdefault(w[order[0]], []).append(i)
        near, names = [], list(windows.vocabulary)
        for item, texts in windows.whole.items():
            for ids in texts:
                rare = sorted(set(ids), key=lambda t: (frequency[t], names[t]))[:4]
                if len(rare) == 4 and all(frequency[t] for t in rare):
                    near.append((item, tuple(rare)))
        return cls(rank_terms, rank_offsets, np.array([len(w) for w in windows.terms]), {t: np.array(v) for t, v in first.items()}, windows.items, near, slop)

    def occurrences(self, terms: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, windows) of all exact occurrences in one index shard."""
        key = (np.repeat(terms, np.diff(ends)) << 32) | places
        starts, which = [], []
        for k, t in enumerate(terms.tolist()):
            if (w := self.first.get(t)) is not None:
                p = places[ends[k] : ends[k + 1]]
                starts.append((p[:, None] - self.rank_offsets[w, 0][None, :]).ravel())
                which.append(np.broadcast_to(w, (len(p), len(w))).ravel())
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, window = np.concatenate(starts), np.concatenate(which)
        keep = start >= 0
        start, window = start[keep], window[keep]
        for r in range(1, self.rank_terms.shape[1]):
            wanted = self.rank_terms[window, r].astype(np.int64)
            probe = (wanted << 32) | (start + self.rank_offsets[window, r])
            at = np.searchsorted(key, probe)
            ok = (wanted < 0) | (key[np.minimum(at, len(key) - 1)] == probe)
            start, window = start[ok], window[ok]
        return start, window

    def proximity(self, terms: np.ndarray, ends: np.ndarray, places: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Items whose four rarest terms all occur within ``slop`` words of the rarest, and where."""
        at = {t: k for k, t in enumerate(terms.tolist())}
        out = []
        for item, rare in self.near:
            if not all(t in at for t in rare):
                continue
            p = places[ends[at[rare[0]]] : ends[at[rare[0]] + 1]]
            for t in rare[1:]:
                q = places[ends[at[t]] : ends[at[t] + 1]]
                i = np.searchsorted(q, p - self.slop)
                p = p[(i < len(q)) & (q[np.minimum(i, len(q) - 1)] <= p + self.slop)]
                if not len(p):
                    break
            if len(p):
                out.append((item, p))
        return out


def _intersect(shared):
    def run(batches):
        plan: Plan = shared.value
        for b in batches:
            for r in b.to_pylist():
                ids, n, bases = (np.frombuffer(r[c], "<i8") for c in ("ids", "n_words", "bases"))
                terms = np.frombuffer(r["terms"], "<i4").astype(np.int64)
                places = np.frombuffer(r["places"], "<i4").astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.frombuffer(r["spread"], "<i4"))))
                hits: dict[int, list] = {}
                items: dict[int, set] = {}
                near: dict[int, set] = {}
                if len(terms):
                    start, window = plan.occurrences(terms, ends, places)
                    doc = np.searchsorted(bases, start, side="right") - 1
                    stop = start + plan.lengths[window] if len(window) else start
                    for d, s, e, w in zip(doc.tolist(), start.tolist(), stop.tolist(), window.tolist(), strict=True):
                        hits.setdefault(d, []).append((s - int(bases[d]), e - int(bases[d])))
                        items.setdefault(d, set()).update(plan.items[w])
                    for item, p in plan.proximity(terms, ends, places):
                        for d in np.unique(np.searchsorted(bases, p, side="right") - 1).tolist():
                            near.setdefault(d, set()).add(item)
                packed = [np.array(sorted(set(hits[d])), "<i4").tobytes() if d in hits else b"" for d in range(len(ids))]
                yield common.record(_FOUND, ids, n, packed, [sorted(items.get(d, ())) for d in range(len(ids))], [sorted(near.get(d, ())) for d in range(len(ids))])

    return run


RESULT = "row long, n_words long, n_hit long, n_items long, items_sha256 string, n_near long"
_RESULT = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("n_near", pa.int64())])


def covered(spans: np.ndarray) -> int:
    """Words in a union of spans (start, end), sorted by start."""
    total, upto = 0, 0
    for s, e in spans.tolist():
        total += max(0, e - max(s, upto))
        upto = max(upto, e)
    return total


def _digest(rows: list[dict]) -> tuple:
    spans = np.concatenate([np.frombuffer(r["hits"], "<i4").reshape(-1, 2) for r in rows])
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    items = sorted({i for r in rows for i in r["items"]})
    near = {i for r in rows for i in r["near"]} - set(items)
    return rows[0]["row"], rows[0]["n_words"], covered(spans), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(near)


def _digests(batches):
    for b in batches:
        if b.num_rows:
            yield common.record(_RESULT, *zip(*[_digest([r]) for r in b.to_pylist()], strict=True))


def _merge(rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches([common.record(_RESULT, *zip(_digest(rows.to_pylist()), strict=True))])


def build_index(docs: DataFrame, windows: Windows, gap: int) -> DataFrame:
    """Index shards of (row, text) over a vocabulary, written to the shared folder; ``gap`` places part two documents."""
    shared = docs.sparkSession.sparkContext.broadcast(windows.vocabulary)
    return common.scratch(docs.mapInArrow(common.tidy(_index(shared, gap)), SHARD), "postings")


def search(index: DataFrame, windows: Windows, slop: int) -> DataFrame:
    """Exact window occurrences and proximity matches: (row, n_words, hits, items, near)."""
    terms = max(1, len(windows.vocabulary))
    counted = index.select("terms", "spread").mapInArrow(common.tidy(_frequencies(terms)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(terms, np.int64)
    for r in counted:
        frequency[r["term"]] = r["n"]
    plan = Plan.of(windows, frequency, slop)
    return index.mapInArrow(common.tidy(_intersect(index.sparkSession.sparkContext.broadcast(plan))), FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 26, max_bytes: int = 8 << 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``benchmark`` has item_id and text.  Null or wordless texts have no words,
    no hits and the digest of no items; items without id or words are ignored;
    items of one id count once; repeated documents are answered each.
    ``n_near`` counts items that come near without an exact window: all of their
    four words that are rarest in ``docs`` (ties by word) stand within ``slop``
    words of one place of the rarest; an item of fewer different words, or with
    one of the four in no document, comes near nowhere.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    slices = max(1, -(-total // max_bytes))
    numbered = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string"))
    if slices > 1:
        source = common.scratch(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text"), "numbered")
        numbered = source.select("row", "text")
    found = None
    for i in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == i)
        windows = Windows.of(sorted((r["item"], r["text"]) for r in part.collect()), size)
        got = search(build_index(numbered, windows, max(size, slop) + 1), windows, slop)
        found = got if found is None else found.unionByName(got)
    if slices == 1:
        out = found.mapInArrow(common.tidy(_digests), RESULT).withColumnRenamed("row", "doc_id")
        out = out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(common.NULL_ID), F.col("doc_id")))
    else:
        merged = found.groupBy("row").applyInArrow(common.tidy_group(_merge), RESULT)
        out = source.select("row", "doc_id").join(merged, "row").drop("row")
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contaminated.alias("contaminated"), "n_near")
