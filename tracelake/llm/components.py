"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _forest(batches):
    """Replace a task's edges by a spanning forest with each tree as a star on its smallest node; batch by batch, so memory stays bounded."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = np.arange(len(nodes))
        left, right = ends[: len(a)], ends[len(a) :]
        while True:  # hook the larger root under the smaller, then halve the paths
            ra, rb = up[left], up[right]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(up, high, low)
            while (up[up] != up).any():
                up = up[up]
            if (up[left] == up[right]).all():
                break
        keep = up != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[up[keep]])], names=["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (two long columns): root is the smallest node that it reaches.

    Each round has joins on nodes only, which adaptive execution splits where a node is hot, and ends in checkpoint().
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").mapInArrow(_forest, "a long, b long")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    last = None
    for _ in range(max_rounds):
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of a node, and the node, go to its smallest neighbour
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array("b", "a")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        pairs = small.checkpoint()
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now
    raise RuntimeError(f"the components still change after {max_rounds} rounds")
