"""Hierarchical weighted hash tree: place documents by draws at region, rack and shard level.

At each node every child draws an exponential variate from (node, child, key)
with its weight as rate; the smallest wins. A child's own draw does not depend
on its siblings, so a changed weight moves keys only into or out of that
child's subtree. A node's weight is the sum of the shards below it.

Defined results: a null key is one more key value; a null text is empty;
repeated rows get the same shard and slots of their own; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featureforge.llm.common import id_text, uniform, whole_text
from featureforge.staging import stage

#: Rows of one shard are numbered within so many hash buckets, then shifted by the buckets before.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard with a number and a weight of its own."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 0.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def even_tree(regions: int, racks: int, shards: int, weight: float = 1.0) -> Node:
    """A tree of regions x racks x shards with equal shards, numbered in order."""
    n = iter(range(regions * racks * shards))
    return Node("root", tuple(
        Node(f"region{i}", tuple(
            Node(f"region{i}.rack{j}", tuple(Node(f"shard{k}", shard=k, own_weight=weight) for k in (next(n) for _ in range(shards))))
            for j in range(racks)))
        for i in range(regions)))


def with_region(tree: Node, shards: int, first: int, weight: float = 1.0) -> Node:
    """The tree with one more region of one rack; keys only move into its shards."""
    name = f"region{len(tree.children)}"
    rack = Node(f"{name}.rack0", tuple(Node(f"shard{first + k}", shard=first + k, own_weight=weight) for k in range(shards)))
    return Node(tree.name, (*tree.children, Node(name, (rack,))))


def place(key: Column, node: Node) -> Column:
    """Shard of a key (text), by descending from ``node``."""
    if not node.children:
        return F.lit(node.shard)
    open_children = [c for c in node.children if c.weight > 0]
    if not open_children:
        raise ValueError(f"{node.name} has no child with a weight")
    if len(open_children) == 1:
        return place(key, open_children[0])
    draws = [
        F.struct((-F.log(uniform(F.lit(f"{node.name}>{c.name}"), key)) / F.lit(float(c.weight))).alias("time"), F.lit(i).alias("child"))
        for i, c in enumerate(open_children)
    ]
    won = F.array_min(F.array(*draws))["child"]
    if all(not c.children for c in open_children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in open_children]), won + 1)
    out = F.when(won == 0, place(key, open_children[0]))
    for i, c in enumerate(open_children[1:], 1):
        out = out.when(won == i, place(key, c))
    return out


def shard_documents(docs: DataFrame, tree: Node, grown: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per document.

    The key and the tree decide the shard (law ``key``). Slots count the rows of
    a shard from 0 without gaps: ordered within hash buckets, which are windows
    of their own, and shifted by the rows of the buckets before.
    """
    text = whole_text(F.col(text_col))
    key = id_text(F.col(id_col))
    data = text.cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(data).alias("text_crc32"), F.sha2(data, 256).alias("_digest"),
        place(key, tree).alias("shard"), place(key, grown).alias("grown_shard"),
    ).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_digest"), F.lit(SLOT_BUCKETS)).cast("int"))
    rows = stage(rows, "shards")
    buckets = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = stage(buckets.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "slots")
    within = W.partitionBy("shard", "_bucket").orderBy("doc_id", "_digest")
    return (
        rows.withColumn("_in", F.row_number().over(within) - 1)
        .join(first, ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_in")).cast("long").alias("slot"), "grown_shard")
    )
