"""Connected components of a table of links, in rounds over staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featureforge.staging import stage

#: Most nodes that a task keeps while it joins its links, and links that the tasks of the second pass get each.
HELD_NODES, LINKS = 500_000, 200_000


def star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) to (u, v) with the smallest node v that u reaches by the links that the task holds."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (above := parent.setdefault(root, root)) != root:
            root = above
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        found = [(n, find(n)) for n in list(parent)]
        parent.clear()
        u, v = [n for n, r in found if n != r], [r for n, r in found if n != r]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        if len(parent) > HELD_NODES:
            yield stars()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Alternating star rounds: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows, until the links are stars. The
    rounds grow with the logarithm of the longest chain. Before each round every
    task makes stars of the links it holds, which leaves few rounds.
    """
    edges = starred(links.select("a", "b"))
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = starred(small)
    return edges.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("component")).distinct()


def starred(edges: DataFrame) -> DataFrame:
    """Stars of what each task holds, first as the links lie, then with about ``LINKS`` of them a task; staged."""
    edges = stage(edges.mapInArrow(star_rows, "u long, v long"), "links")
    tasks = edges.count() // LINKS + 1
    return stage(edges.coalesce(tasks).mapInArrow(star_rows, "u long, v long"), "links")


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges(u, v)`` has edges to one smaller node ``v`` or to larger nodes ``u`` only; edges may repeat."""
    ends = edges.select(F.col("u").alias("n"), F.col("v").alias("up"), F.lit(False).alias("down")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(None).cast("long").alias("up"), F.lit(True).alias("down")))
    found = ends.groupBy("n").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max("down").alias("down"))
    return found.where((F.col("least") != F.col("most")) | (F.col("down") & F.col("least").isNotNull())).isEmpty()
