"""Connected components by hooking to least neighbours and contraction, on DataFrames; what one task can hold is finished there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that are one task's work: a round's tables would be one file each.
ONE_TASK = common.ROWS_PER_FILE
_LABELS = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def _united(batches):
    """The least connected node of each node of some links, by the same rounds on arrays."""
    parts = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches]
    if not parts:
        return
    ends = np.concatenate(parts, axis=1)
    node, at = np.unique(ends, return_inverse=True)
    label = np.arange(len(node))
    low, high = at.reshape(ends.shape)
    while len(low):
        np.minimum.at(label, np.maximum(low, high), np.minimum(low, high))
        while (label[label] != label).any():
            label = label[label]
        low, high = label[low], label[high]
        low, high = low[low != high], high[low != high]
    yield common.record(_LABELS, node, node[label])


def connected_components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, component) of every node of an edge (a, b); component is its least node.

    A round points each node to the least of itself and its neighbours (found by
    partial minima, so a node of very many links is no task's burden), follows
    two pointers, and contracts the edges to what still joins different nodes.
    At most ``ONE_TASK`` edges are finished in one task, as each round of so few
    would be one task's work with many small plans for the driver to hold.
    At least half of the nodes that have edges vanish in a round.  Each round is
    written to the shared folder, so lineage stays short.  Loops and repeated or
    reversed edges are allowed; edges with a null end are dropped; no edges give
    no rows.
    """
    links = common.scratch(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").dropDuplicates(), "links")
    known = None
    for _ in range(most):
        rows = links.count()
        if not rows:
            break
        files = common.files_for(2 * rows, links.sparkSession)
        if rows <= ONE_TASK:
            labels = common.scratch(links.select(F.col("low").cast("long"), F.col("high").cast("long")).coalesce(1).mapInArrow(common.tidy(_united), "node long, component long"), "labels")
            common.drop_scratch(links)
            if known is None:
                return labels
            moved = common.scratch(follow(known, labels), "labels", files=most_files)
            common.drop_scratch(known)
            common.drop_scratch(labels)
            return moved
        hooked = links.union(links.select("high", "low")).groupBy("low").agg(F.min("high").alias("least")).select(F.col("low").alias("node"), F.least("low", "least").alias("to"))
        hooked = common.scratch(hooked, "hooks", files=files)
        further = hooked.select(F.col("node").alias("to"), F.col("to").alias("next"))
        labels = common.scratch(hooked.join(further, "to").select("node", F.col("next").alias("component")), "labels", files=files)
        common.drop_scratch(hooked)
        fresh = links.join(labels.select(F.col("node").alias("low"), F.col("component").alias("p")), "low").join(labels.select(F.col("node").alias("high"), F.col("component").alias("q")), "high")
        fresh = common.scratch(fresh.where("p <> q").select(F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).dropDuplicates(), "links", files=files)
        common.drop_scratch(links)
        links = fresh
        if known is None:
            known, most_files = labels, files
        else:
            moved = common.scratch(follow(known, labels), "labels", files=most_files)
            common.drop_scratch(known)
            known = moved
    else:
        raise RuntimeError("components did not settle")
    return known if known is not None else links.select(F.col("low").alias("node"), F.col("high").alias("component"))


def follow(known: DataFrame, labels: DataFrame) -> DataFrame:
    """Components moved on by labels of components; every node of ``labels`` must be a component of ``known``."""
    moves = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
    return known.join(moves, "component", "left").select("node", F.coalesce("next", "component").alias("component"))


def refine(known: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after more edges (a, b): only the edges between components are looked at again."""

    def renamed(name: str) -> DataFrame:
        return known.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))

    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    named = edges.join(renamed("a"), "a", "left").join(renamed("b"), "b", "left")
    added = named.select("a", "b").select(F.explode(F.array("a", "b")).alias("node")).dropDuplicates().join(known, "node", "left_anti")
    every = known.unionByName(added.select("node", F.col("node").alias("component")))
    moved = connected_components(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    return follow(every, moved)
