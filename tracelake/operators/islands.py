"""Ordered folds that no SQL window expresses, run island by island.

Where two neighbours are so far apart that a new group has to start whatever went before, the rows are cut into islands by a
window; each island is then folded in one pass over sorted rows, of which only the fold's state is held in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def number_islands(df: DataFrame, keys: Sequence[str], order: Sequence, new: Column, name: str = "island") -> DataFrame:
    """``df`` with a running number that grows where ``new`` holds; ``new`` may use window functions over the same order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("__new", F.when(new, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _fold(columns: list[str], step, names: list[str]):
    """Run ``step(state, row values) -> (state, out)`` over rows sorted by their island; the state is None at each island's start.

    Islands are told apart by the columns ``names``; their hash only deals them out.
    """

    def fold(batches):
        at, state = None, None
        for batch in batches:
            isle = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            values = [batch.column(c).to_pylist() for c in columns]
            out = []
            for k, row in enumerate(zip(*values, strict=True)):
                if isle[k] != at:
                    at, state = isle[k], None
                state, found = step(state, *row)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], names=[*batch.schema.names[:-1], "__out"])

    return fold


def fold_islands(df: DataFrame, keys: Sequence[str], order: Sequence, island: str, columns: list[str], step, name: str) -> DataFrame:
    isle = F.xxhash64(*keys, island)
    rows = df.withColumn("__isle", isle).repartition("__isle").sortWithinPartitions("__isle", *keys, island, *order)
    shape = T.StructType([*df.schema, T.StructField("__out", T.LongType())])
    return rows.mapInArrow(_fold(columns, step, [*keys, island]), shape).withColumnRenamed("__out", name)


def anchored_groups(df: DataFrame, keys: Sequence[str], value: str, width: int, ties: Sequence[str] = (), name: str = "anchor") -> DataFrame:
    """``df`` with the anchor of each row's group: a group starts at its anchor and takes rows up to ``width`` after it."""
    w = Window.partitionBy(*keys).orderBy(value, *ties)
    cut = F.lag(value).over(w).isNull() | (F.col(value) - F.lag(value).over(w) > width)
    rows = number_islands(df, keys, [value, *ties], cut, "__island")

    def step(anchor, v):
        return (v, v) if anchor is None or v - anchor > width else (anchor, anchor)

    return fold_islands(rows, keys, [value, *ties], "__island", [value], step, name).drop("__island")


def greedy_non_overlap(df: DataFrame, keys: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """The ranges (offset, length) that a pass in order of offset keeps: each that starts at or behind the end of the last kept one."""
    order = ["offset", *ties]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("offset") + F.col("length")).over(w)
    rows = number_islands(df.withColumn("__reach", reach), keys, order, F.col("__reach").isNull() | (F.col("offset") >= F.col("__reach")), "__island").drop("__reach")

    def step(end, offset, length):
        return (offset + length, 1) if end is None or offset >= end else (end, 0)

    return fold_islands(rows, keys, order, "__island", ["offset", "length"], step, "__kept").where("__kept = 1").drop("__island", "__kept")
