"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import cut, discard


#: Links that one task joins alone (about 100 MB); more are joined in rounds over all tasks.
ALONE = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for each node that has a link.

    A counted small table is one task's work. Beyond that, each round joins every node's smallest neighbour to its links; a node with very many links is
    one that adaptive execution splits, and no node's links are gathered in one row.
    """
    if links.count() <= ALONE:
        return cut(links.select("a", "b").coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
    edges, state, last = links.select("a", "b").where("a <> b").distinct(), None, []
    while True:
        edges = cut(_star(_star(edges, large=True), large=False), "edges")
        discard(*last)
        last = [edges]
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    own = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return own.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest neighbours' labels and their labels, until nothing changes."""
    parts = [np.stack([batch.column(k).to_numpy() for k in (0, 1)]) for batch in batches]
    links = np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.int64)
    nodes, place = np.unique(links, return_inverse=True)
    a, b = place.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], ["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each node go to the smallest of it and its neighbours: those to larger nodes, or those to smaller ones.

    Edges have a < b before and after.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = edges.select(low.alias("a"), high.alias("b"))
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = edges.join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        moved = edges.join(least, "b")
        out = moved.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), "b")
        )
    return out.where("a <> b").distinct()
