"""Connected components of a graph given by its links, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each batch of links: every node with its root."""
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = list(range(len(nodes)))
        for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            parent[max(x, y)] = min(x, y)
        root = np.array(parent)
        while (root != root[root]).any():
            root = root[root]
        deep = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[deep]), pa.array(nodes[root[deep]])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node that has a link and isn't a root itself.

    ``links``: u, v longs. Union-find in each task first; then rounds of large-star and small-star (each node's
    neighbours are linked to the least of them) until nothing changes, every round written to the shared folder.
    """
    edges = keep(links.select("u", "v").filter("u != v").mapInArrow(_roots, "u long, v long").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(edges)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
