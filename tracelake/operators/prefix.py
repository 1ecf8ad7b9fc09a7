"""Running sums in an order of any columns, worked on by many tasks however many rows one key has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.sources.scratch import stored


def by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``df`` dealt out by ranges of (keys, order) and written once, with the number of each row's range as ``__range``, since another run would cut the ranges elsewhere."""
    return stored(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def sums_in_ranges(dealt: DataFrame, keys: Sequence[str], order: Sequence, values: Mapping[str, Column]) -> DataFrame:
    """The rows of ``by_ranges`` with their running sums, and as ``__all_*`` the sums over their key.

    Sums run inside each range; of each range and key one row goes to the pass over the key, and from there among the rows of its range
    and key, so that they meet without a join, however many keys there are.
    """
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "__range").agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    known = [F.sum(f"__t_{n}").over(earlier).alias(f"b_{n}") for n in values] + [F.sum(f"__t_{n}").over(whole).alias(f"all_{n}") for n in values]
    met = dealt.unionByName(totals.select(*keys, "__range", F.struct(*known).alias("__known")), allowMissingColumns=True)
    each = Window.partitionBy(*keys, "__range")
    w = each.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = met.withColumns({**{n: F.sum(F.when(F.col("__known").isNull(), v)).over(w) for n, v in values.items()}, "__told": F.max("__known").over(each)}).where("__known is null")
    before = {n: F.col("__told")[f"b_{n}"] for n in values}
    sums = {n: F.coalesce(F.col(n) + before[n], F.col(n), before[n]) for n in values}
    return rows.withColumns({**sums, **{f"__all_{n}": F.col("__told")[f"all_{n}"] for n in values}}).drop("__known", "__told")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence, values: Mapping[str, Column]) -> DataFrame:
    """``df`` with the sum of each value over the rows of its key up to and with its own, in ``order``; nulls add nothing.

    Rows are dealt out by ranges of (keys, order) and written once, with the number of their range, since another run would cut
    the ranges elsewhere. Sums run inside each range; of each range and key one row goes to the pass over the key. What comes back
    are the sums of keys that began in an earlier range, fewer rows than there are ranges, so they are broadcast. ``order`` has
    to be a full one: rows that tie in all of it get their sums in any order. A sum is null up to the first value that isn't.
    """
    dealt = by_ranges(df.withColumns({f"__v_{n}": v for n, v in values.items()}), keys, order)
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "__range").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__at"), *[F.sum(f"__t_{n}").over(earlier).alias(f"__b_{n}") for n in values])
    begun = F.lit(False)
    for n in values:
        begun |= F.col(f"__b_{n}").isNotNull()
    before = F.broadcast(before.where(begun))
    same = F.col("__range") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    w = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({n: F.sum(f"__v_{n}").over(w) for n in values}).join(before, same, "left")
    sums = {n: F.coalesce(F.col(n) + F.col(f"__b_{n}"), F.col(n), F.col(f"__b_{n}")) for n in values}
    return rows.withColumns(sums).select(*df.columns, *values)
