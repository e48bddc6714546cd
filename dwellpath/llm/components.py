"""Connected components of a table of links, by alternating large-star and small-star steps.

The method is that of Kiveris et al., "Connected Components in MapReduce and Beyond"
(2014).  Links that meet in one partition are contracted there beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.session import cut_lineage


# Links that a task contracts together; what it holds has this bound, and more links take more tasks.
TASK_LINKS = 50_000


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for every node with a smaller one in reach.

    ``links`` has two long columns ``a`` and ``b``; both orders, repeats and loops are fine.
    It is read twice.
    """
    links, tasks = _contracted(links)
    before = None
    while tasks > 1 and (after := _fingerprint(links)) != before:
        before = after
        links = cut_lineage(_star(_star(links, large=True), large=False))
    return links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))


def _contracted(links: DataFrame) -> tuple[DataFrame, int]:
    """What each task makes of its links, and how many tasks there were; what one task has contracted is settled."""
    tasks = max(1, -(-links.count() // TASK_LINKS))
    return cut_lineage(links.coalesce(tasks).mapInArrow(_contract, "a long, b long")), tasks


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars around the smallest node of what they connect."""
    parent: dict[int, int] = {}

    def top(node: int) -> int:
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    def stars() -> pa.RecordBatch:
        nodes = [node for node in parent if top(node) != node]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([top(node) for node in nodes], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            low, high = sorted((top(a), top(b)))
            parent[high] = low
        if len(parent) > 4 * TASK_LINKS:  # more than twice as many nodes as a lone task's links have, so this is not one
            yield stars()
            parent.clear()
    yield stars()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours (larger ones, or it and its smaller ones) on the lowest of them."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if large:
        ordered = ordered.unionByName(ordered.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = ordered.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = ordered.join(lowest, "a")
    if large:
        hung = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")))).first()
    return tuple(row)
