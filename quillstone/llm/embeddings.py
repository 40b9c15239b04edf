"""Embedding near-duplicates by hierarchical navigable small-world graphs.

1. Usable vectors (finite, not zero, labelled) are folded: equal vectors of a
   label are one node with a multiplicity.
2. The nodes of a label are dealt to shards of about ``shard_size`` by a hash;
   one graph is built per shard and stored with its vectors.
3. Each shard's nodes query every shard of the label (a pair of shards is
   searched once, links count for both).  A graph is sent once, to the task that
   searches it; blocks of queries stream through that task.  A beam that is full
   of links is widened for its query; audits compare sampled queries with a full
   scan of the shard and widen all beams until every sampled link is found.  A
   beam as wide as the shard holds all that the graph reaches; only if an audit
   fails even there is the shard scanned.  Other sampled queries, which widen
   nothing, measure the recall that is left.
4. Candidates are verified by cosine in double precision.  A task sends one row
   per node, its links and the least node it reaches there; components of these
   stars are the components of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .minhash import mix

DEGREE, BATCH = 12, 96


class Graph:
    """One shard's graph.  Level 0 holds all nodes with up to 2 * DEGREE links, upper levels fewer."""

    def __init__(self, unit: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.unit = unit  # rows of length 1, float32
        self.levels = levels  # (members, links): links[k] are those of members[k], -1 where none

    @classmethod
    def build(cls, unit: np.ndarray, ids: np.ndarray, ef: int = 48) -> Graph:
        n = len(unit)
        u = (mix(ids.view(np.uint64) + np.uint64(7)) >> np.uint64(11)).astype(float) / float(1 << 53)
        top = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(DEGREE)).astype(int), 6)
        order = np.argsort(-top, kind="stable")
        unit, top = unit[order], top[order]
        graph = cls(unit, [])
        for level in range(int(top.max(initial=0)), -1, -1):
            size = int((top >= level).sum())
            graph._grow(level, size, 2 * DEGREE if level == 0 else DEGREE, ef)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        graph.order, graph.back = order, back
        return graph

    def _grow(self, level: int, size: int, degree: int, ef: int) -> None:
        """Insert the first ``size`` nodes into a fresh level, batch by batch."""
        links = np.full((size, degree), -1, np.int64)
        done = min(size, max(BATCH, degree + 1))
        self._connect(links, np.arange(done), self.unit[:done] @ self.unit[:done].T, np.broadcast_to(np.arange(done), (done, done)), degree)
        while done < size:
            batch = np.arange(done, min(size, done + BATCH))
            sims, found = self._beam(self.unit[batch], links[:done], self._enter(self.unit[batch], done), ef)
            inside = self.unit[batch] @ self.unit[batch].T
            np.fill_diagonal(inside, -2)
            self._connect(links, batch, np.concatenate([sims, inside], 1), np.concatenate([found, np.broadcast_to(batch, inside.shape)], 1), degree)
            done += len(batch)
        self.levels.append((np.arange(size), links))

    def _enter(self, queries: np.ndarray, limit: int) -> np.ndarray:
        """Entry points for a lower level: the best nodes of a walk down the upper ones."""
        at = np.zeros((len(queries), 1), np.int64)
        for _, links in self.levels:
            sims, found = self._beam(queries, links[:limit] if len(links) > limit else links, at, 4)
            at = np.where(found[:, :2] >= 0, found[:, :2], 0)
        return at

    def _connect(self, links: np.ndarray, nodes: np.ndarray, sims: np.ndarray, found: np.ndarray, degree: int) -> None:
        """Diverse nearest links for new nodes, and links back to them."""
        half = max(2, degree // 2)
        for k, v in enumerate(nodes.tolist()):
            ok = (found[k] >= 0) & (found[k] != v)
            near = found[k][ok][np.argsort(-sims[k][ok], kind="stable")][: 4 * degree]
            chosen = self._diverse(v, near, half)
            links[v, : len(chosen)] = chosen
        for v in nodes.tolist():
            for w in links[v][links[v] >= 0].tolist():
                row = links[w]
                if v in row:
                    continue
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = v
                else:
                    every = np.append(row, v)
                    s = self.unit[every] @ self.unit[w]
                    kept = self._diverse(w, every[np.argsort(-s, kind="stable")], degree)
                    row[:] = -1
                    row[: len(kept)] = kept

    def _diverse(self, v: int, near: np.ndarray, most: int) -> np.ndarray:
        """Of candidates sorted by nearness: those nearer to v than to a chosen one; then the nearest others."""
        if len(near) <= most:
            return near
        part = self.unit[near]
        between, to_v = part @ part.T, part @ self.unit[v]
        chosen: list[int] = []
        for i in range(len(near)):
            if len(chosen) == most:
                break
            if not chosen or to_v[i] >= between[i, chosen].max():
                chosen.append(i)
        rest = [i for i in range(len(near)) if i not in set(chosen)][: most - len(chosen)]
        return near[sorted(chosen + rest)]

    def _beam(self, queries: np.ndarray, links: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``ef`` (similarities, nodes) of all queries at once; -1 where none is found."""
        n, q = len(links), len(queries)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)
        entries = np.where(entries < n, entries, 0)
        first = np.full((q, ef), -1, np.int64)
        width = min(ef, entries.shape[1])
        first[:, :width] = entries[:, :width]
        for c in range(1, width):
            first[:, c] = np.where((first[:, :c] == first[:, c : c + 1]).any(1), -1, first[:, c])
        node = first
        seen[rows, node] = True
        sim = np.where(node >= 0, np.einsum("qd,qed->qe", queries, self.unit[np.maximum(node, 0)]), -2.0).astype(np.float32)
        open_ = node >= 0
        steps = max(1, ef // 12)
        while True:
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                break
            score = np.where(open_[live], sim[live], -3.0)
            pick = np.argsort(-score, axis=1, kind="stable")[:, :steps]
            good = np.take_along_axis(score, pick, 1) > -2.5
            from_ = np.where(good, np.take_along_axis(node[live], pick, 1), -1)
            mark = open_[live]
            np.put_along_axis(mark, pick, False, 1)
            open_[live] = mark
            fresh = np.where(from_[:, :, None] >= 0, links[np.maximum(from_, 0)], -1).reshape(len(live), -1)
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[fresh >= n] = -1
            fresh[seen[live[:, None], fresh]] = -1
            seen[live[:, None], fresh] = True
            seen[:, n] = False
            keep = np.flatnonzero((fresh >= 0).any(0))
            if not len(keep):
                continue
            fresh = fresh[:, keep]
            got = np.where(fresh >= 0, np.einsum("qd,qed->qe", queries[live], self.unit[np.maximum(fresh, 0)]), -2.0).astype(np.float32)
            all_sim, all_node = np.concatenate([sim[live], got], 1), np.concatenate([node[live], fresh], 1)
            all_open = np.concatenate([open_[live], fresh >= 0], 1)
            best = np.argsort(-all_sim, axis=1, kind="stable")[:, :ef]
            sim[live], node[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (all_sim, all_node, all_open))
        return sim, node

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``ef`` nodes of each query, numbered as the rows given to ``build``."""
        bottom = self.levels[-1]
        upper, self.levels = self.levels, self.levels[:-1]
        entries = self._enter(queries, len(self.unit))
        self.levels = upper
        sim, node = self._beam(queries, bottom[1], entries, ef)
        return sim, np.where(node >= 0, self.order[np.maximum(node, 0)], -1)

    def pack(self) -> list[bytes]:
        return [self.order.astype("<i4").tobytes(), *(links.astype("<i4").tobytes() for _, links in self.levels)]

    @classmethod
    def unpack(cls, unit: np.ndarray, packed: list[bytes]) -> Graph:
        order = np.frombuffer(packed[0], "<i4").astype(np.int64)
        levels = []
        for k, raw in enumerate(packed[1:], 1):
            links = np.frombuffer(raw, "<i4").astype(np.int64).reshape(-1, 2 * DEGREE if k == len(packed) - 1 else DEGREE)
            levels.append((np.arange(len(links)), links))
        graph = cls(unit[order], levels)
        graph.order = order
        return graph


SHARD = "label string, dim int, slice int, slices int, nodes binary, copies binary, vectors binary, graph array<binary>"
_SHARD = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("slice", pa.int32()), ("slices", pa.int32()), ("nodes", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("graph", pa.list_(pa.binary()))])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks().sort_by("node")
    node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
    dim = rows["dim"][0].as_py()
    vectors = np.stack(rows["vector"].to_numpy()).reshape(len(node), dim).astype("<f8")
    graph = Graph.build(_unit(vectors), node).pack()
    one = [rows[c][:1].to_pylist() for c in ("label", "dim", "slice", "slices")]
    return pa.Table.from_batches([common.record(_SHARD, *one, [node.astype("<i8").tobytes()], [copies.astype("<i8").tobytes()], [vectors.tobytes()], [graph])])


def local_roots(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name that each of n nodes reaches by links (a, b)."""
    low = names.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        if (low == before).all():
            return low


def _sample(n: int, size: int, shift: int) -> np.ndarray:
    """Numbers below n, spread evenly; another ``shift`` gives others where n allows."""
    return np.unique((np.arange(min(size, n)) * n // max(1, min(size, n)) + shift) % max(1, n))


def _links(graph: Graph, queries: np.ndarray, unit: np.ndarray, threshold: float, ef: int, audit: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query, node) candidates at or just below the threshold; and [links of the final audit, those found, queries searched, queries scanned]."""
    n, margin, step = len(unit), np.float32(threshold - 1e-5), 256

    def scan(at: np.ndarray):
        for lo in range(0, len(at), step):
            i, j = np.nonzero(queries[at[lo : lo + step]] @ unit.T >= margin)
            yield at[lo : lo + step][i], j

    def codes(pairs, sample: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(i[np.isin(i, sample)] * n + j[np.isin(i, sample)] for i, j in pairs)])

    sample = _sample(len(queries), audit, 0)
    truth = codes(scan(sample), sample)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo, searched, scanned = np.arange(len(queries)), 0, 0
    while len(todo):
        ef = min(ef, n)
        again, got = [], []
        for lo in range(0, len(todo), step):
            at = todo[lo : lo + step]
            sim, node = graph.search(queries[at], ef)
            full = (sim[:, -1] >= margin) & (node[:, -1] >= 0) & (ef < n)
            again.append(at[full])
            i, j = np.nonzero((sim >= margin) & (node >= 0) & ~full[:, None])
            got.append((at[i], node[i, j]))
        searched += len(todo)
        again = np.concatenate(again)
        checked = np.setdiff1d(np.intersect1d(sample, todo), again)
        if np.isin(truth[np.isin(truth // n, checked)], codes(got, checked)).all():
            found += got
            todo = again
        elif ef == n:  # the graph does not reach all that an audit found
            found += scan(todo)
            scanned += len(todo)
            break
        ef *= 2
    last = _sample(len(queries), audit, 1)
    want = codes(scan(last), last)
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
    return i, j, [len(want), int(np.isin(want, codes([(i, j)], last)).sum()), searched, scanned]


#: Of a node: its links to one shard and the least node it reaches there.  With node null: the numbers of an audit of ``label``.
FOUND = "node long, links long, root long, label string, audit array<long>"
_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("label", pa.string()), ("audit", pa.list_(pa.int64()))])


def _compare(threshold: float, ef: int, audit: int):
    """Links of each shard with itself and with the blocks of queries that follow it."""

    def read(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = np.frombuffer(r["nodes"], "<i8")
        return node, np.frombuffer(r["copies"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(len(node), r["dim"])

    def verified(qv: np.ndarray, sv: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        qs, ss = qv / np.abs(qv).max(1, keepdims=True), sv / np.abs(sv).max(1, keepdims=True)
        q_norm, s_norm = np.sqrt((qs * qs).sum(1)), np.sqrt((ss * ss).sum(1))
        ok = [np.zeros(0, bool)]
        for lo in range(0, len(i), 50_000):
            a, b = i[lo : lo + 50_000], j[lo : lo + 50_000]
            ok.append(np.einsum("nd,nd->n", qs[a], ss[b]) / (q_norm[a] * s_norm[b]) >= threshold)
        ok = np.concatenate(ok)
        return i[ok], j[ok]

    def run(batches):
        at = None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                own = r["graph"] is not None
                if own:
                    at, (sn, sc, sv) = (r["label"], r["dim"], r["target"]), read(r)
                    unit = _unit(sv)
                    graph = Graph.unpack(unit, r["graph"])
                if at != (r["label"], r["dim"], r["target"]):
                    raise RuntimeError("queries without their shard")
                qn, qc, qv = (sn, sc, sv) if own else read(r)
                i, j, numbers = _links(graph, unit if own else _unit(qv), unit, threshold, ef, audit)
                i, j = verified(qv, sv, i, j)
                if own:
                    pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1)[i != j], axis=0)
                    a, b = pairs[:, 0], pairs[:, 1]
                    names, counts = sn, np.bincount(a, sc[b], len(sn)) + np.bincount(b, sc[a], len(sn))
                else:
                    pairs = np.unique(np.stack([i, j], 1), axis=0)
                    a, b = pairs[:, 0], pairs[:, 1] + len(qn)
                    names, counts = np.concatenate([qn, sn]), np.concatenate([np.bincount(a, sc[pairs[:, 1]], len(qn)), np.bincount(pairs[:, 1], qc[a], len(sn))])
                root, has = local_roots(len(names), a, b, names), counts > 0
                m = int(has.sum())
                yield common.record(_FOUND, names[has], counts[has].astype(np.int64), root[has], [None] * m, [None] * m)
                yield common.record(_FOUND, [None], [None], [None], [r["label"]], [numbers])

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector, k1, k2): two hashes stand for the vector of a usable row; other rows have keys of their own."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("vector"))
    v = F.col("vector")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))) | ~F.exists(v, lambda e: e != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad, F.lit(False))
    return rows.select("vec_id", "label", "vector", good.alias("good"), F.when(good, F.xxhash64("vector")).otherwise(F.xxhash64("vec_id")).alias("k1"), F.when(good, F.xxhash64(F.lit(1), "vector")).alias("k2"))


def _found(rows: DataFrame, threshold: float, shard_size: int, ef: int, audit: int) -> tuple[DataFrame, DataFrame]:
    """The folded vectors (label, k1, k2, node, copies), and what the searches found."""
    nodes = rows.where("good").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    nodes = common.scratch(nodes, "vectors")
    dims = nodes.select("label", "node", "copies", "vector", F.size("vector").alias("dim"))
    sizes = dims.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_size).cast("int").alias("slices"))
    dealt = dims.join(sizes, ["label", "dim"]).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    n = common.partitions(rows.sparkSession)  # said outright: few bytes, much work
    shards = common.scratch(dealt.repartition(n, "label", "dim", "slice").groupBy("label", "dim", "slice").applyInArrow(common.tidy_group(_build), SHARD), "graphs")
    # each shard queries the half of the others that follow it in a ring, so that a pair meets once and work is even
    plain = ["label", "dim", "slice", "nodes", "copies", "vectors"]
    far = (F.col("slices") - F.when((F.col("slices") % 2 == 0) & (F.col("slice") >= F.col("slices") / 2), 2).otherwise(1)) / 2
    steps = F.when(F.ceil(far) > 0, F.sequence(F.lit(1), F.ceil(far).cast("int"))).otherwise(F.array().cast("array<int>"))
    queries = shards.withColumn("step", F.explode(steps)).select(*plain, F.pmod(F.col("slice") + F.col("step"), F.col("slices")).alias("target"), F.lit(None).cast("array<binary>").alias("graph"))
    sent = shards.select(*plain, F.col("slice").alias("target"), "graph").unionByName(queries)
    sent = sent.repartition(n, "label", "dim", "target").sortWithinPartitions("label", "dim", "target", F.col("graph").isNull(), "slice")
    return nodes.drop("vector"), common.scratch(sent.mapInArrow(common.tidy(_compare(threshold, ef, audit)), FOUND), "links")


def audits(vectors: DataFrame, threshold: float = 0.93, shard_size: int = 2048, ef: int = 64, audit: int = 64) -> DataFrame:
    """Per label: links of the sampled queries of the final audits, those that were found, and queries answered by graphs and by scans."""
    _, found = _found(_usable(vectors), threshold, shard_size, ef, audit)
    return found.where("node IS NULL").groupBy("label").agg(*[F.sum(F.col("audit")[i]).alias(c) for i, c in enumerate(("links", "found", "searched", "scanned"))])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, shard_size: int = 2048, ef: int = 64, audit: int = 64) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are compared only within equal, non-null labels and equal dimensions.
    Null, empty or zero vectors, and those with null or non-finite components,
    link with nothing.  Equal vectors of a label are linked with each other.
    Rows that share a vec_id count as vectors of their own but are one node of
    the graph; a row without vec_id is not compared and is kept.
    """
    rows = _usable(vectors)
    nodes, found = _found(rows, threshold, shard_size, ef, audit)
    found = found.where("node IS NOT NULL")
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("others"))
    known = nodes.join(links, "node", "left").join(components, "node", "left")
    known = known.select("label", "k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    # rows that are not usable have no k2 and match nothing; k1 spreads them
    out = rows.select("vec_id", "label", "k1", F.coalesce("k2", F.lit(0)).alias("k2"), "good").join(known, ["label", "k1", "k2"], "left")
    known_row = F.col("good") & F.col("n_links").isNotNull()
    component = F.when(known_row, F.least("component", "vec_id")).otherwise(F.col("vec_id"))
    has = F.col("vec_id").isNotNull()
    return out.select("vec_id", F.when(has & known_row, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(has, component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
