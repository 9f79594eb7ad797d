"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.rows import ship
from lanewise.session import write_table

FINISH_EDGES = 100_000  # so many edges, 16 bytes each, are finished by one task


def _least_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (hi, lo) of these batches: roots hook to lesser ones, then every node looks up its root."""
    held = [(batch["hi"].to_numpy(), batch["lo"].to_numpy()) for batch in batches]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([np.concatenate(side) for side in zip(*held)]), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; a root is its component's least node.

    Alternates the published large-star and small-star steps until nothing changes. Each step
    is two shuffles of the remaining edges, written to the shared folder, so lineage stays
    short and a lost executor costs one step. A node with very many edges meets only a partial
    minimum and a join that adaptive execution can split. At most FINISH_EDGES edges are finished
    by one task, which gives the same rows without these steps. No edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    current = write_table(pairs.where("hi <> lo").distinct(), "edges")
    before = None
    while True:
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if 0 < now[0] <= FINISH_EDGES:
            return write_table(current.coalesce(1).mapInArrow(_least_nodes, "node long, root long"), "roots")
        if now == before or not now[0]:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(current.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = large.join(low, "hi")
        small = near.select("lo", "m").where("lo <> m").unionAll(near.select("hi", "m"))
        current = write_table(small.toDF("hi", "lo").distinct(), "edges")


ship(__name__)
