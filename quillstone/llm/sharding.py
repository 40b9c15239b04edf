"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard levels.  At a node every child
draws ``-ln(u) / weight`` from a hash of (doc_id, child), and the least draw
wins, so a child gets its share of the weight and a changed weight moves rows
only to or from the child that has it.  Below an unchanged subtree nothing
moves.  A new shard in a region of its own takes rows only into itself.
Everything is built of DataFrame expressions; each row is placed on its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A region, rack or shard.  A leaf holds a shard number and its weight."""

    name: str
    shard: int | None = None
    own: float = 0.0
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return self.own if self.shard is not None else sum(c.weight for c in self.children)


def even_tree(shards: int, racks: int = 2, per_rack: int = 4) -> Node:
    """Shards 0..n-1 of weight 1, ``per_rack`` in a rack, ``racks`` in a region.

    ``grow`` adds shards to it one by one so that rows move only into the new one.
    """
    regions = []
    size = racks * per_rack
    for g in range(0, shards, size):
        inside = [
            Node(f"{g // size}/{k}", children=tuple(Node(f"{g // size}/{k}/{s}", s, 1.0) for s in range(g + k * per_rack, min(shards, g + size, g + (k + 1) * per_rack))))
            for k in range(racks)
            if g + k * per_rack < shards
        ]
        regions.append(Node(str(g // size), children=tuple(inside)))
    return Node("root", children=tuple(regions))


def grow(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree and one more shard in a region of its own, so that it takes rows only into itself, whatever the tree."""
    name = str(len(tree.children))
    while name in {c.name for c in tree.children}:
        name += "+"
    fresh = Node(name, children=(Node(f"{name}/0", children=(Node(f"{name}/0/{shard}", shard, weight),)),))
    return Node(tree.name, children=(*tree.children, fresh))


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash of the key and the child."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 12)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(node.weight)


def place(key: Column, node: Node) -> Column:
    """The shard number at which a key ends in the tree."""
    if node.shard is not None:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if not children:
        raise ValueError(f"no weight under {node.name}")
    if len(children) == 1:
        return place(key, children[0])
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(children)]))["child"]
    out = place(key, children[-1])
    for i, c in reversed(list(enumerate(children[:-1]))):
        out = F.when(best == i, place(key, c)).otherwise(out)
    return out


def assign(docs: DataFrame, tree: Node, grown: Node | None = None, buckets: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in a shard), grown_shard.

    size is the UTF-8 bytes of the text plus 8; a null text has none and the
    checksum of an empty one.  A null doc_id is a key like any other; repeated
    rows meet in one shard and take a slot each.  Slots are numbered inside
    (shard, hash bucket) and shifted by the buckets before, so that no task
    ever holds a whole shard; ``buckets`` should grow with the rows.
    """
    key = F.col("doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        place(key, tree).cast("int").alias("shard"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    # by all that a row is, so that rows of one doc_id are spread
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), "grown_shard")


def shard_documents(docs: DataFrame, shards: int, rows_per_bucket: int = 50_000) -> DataFrame:
    """The ``key`` law: doc_id and the number of shards decide where a row goes.

    ``grown_shard`` is the place in ``grow(even_tree(shards))``, the tree with
    one more shard; it differs only for rows that move into that shard, for
    every number of shards.
    """
    rows = docs.select("doc_id").count()
    buckets = max(64, -(-rows // (rows_per_bucket * shards)))
    return assign(docs, even_tree(shards), grow(even_tree(shards), shards), buckets).withColumn("law", F.lit("key"))
