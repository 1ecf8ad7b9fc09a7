"""Scans over one image that holds all rows: results against plain loops, and how many tasks share the work."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import prefix, ranges, recovery

SHAPE = "image_id long, offset long, length long"


def spread(seed, n=400, top=20_000):
    """Ranges of one image, most short, some across many bins, some repeated."""
    rng = random.Random(seed)
    rows = [(1, rng.randrange(top), rng.choice([1, 7, 64, 500])) for _ in range(n)]
    return rows + rows[:9] + [(1, 700, 2_000), (1, 2_700, 1), (1, 9_000, 1_500), (None, 5, 5), (None, 10, 900)]


def plain_merge(rows):
    out = []
    for i, lo, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if out and out[-1][0] == i and lo <= out[-1][2]:
            out[-1][2] = max(out[-1][2], lo + n)
        else:
            out.append([i, lo, lo + n])
    return [(i, lo, hi - lo) for i, lo, hi in out]


def taken(df):
    return [tuple(r) for r in df.select("image_id", "offset", "length").collect()]


@pytest.mark.parametrize(("seed", "n", "bin_bytes"), [(1, 400, 100), (2, 60, 64), (3, 60, 7), (4, 20, 1000), (5, 400, 1 << 20)])
def test_merge_and_holes(spark, seed, n, bin_bytes):
    rows = spread(seed, n)
    frame = spark.createDataFrame(rows, SHAPE)
    merged = plain_merge(rows)
    assert sorted(map(str, taken(ranges.merge_ranges(frame, bin_bytes=bin_bytes)))) == sorted(map(str, merged))
    lo, hi = 50, 21_000
    want, at = [], lo
    for _, a, length in (m for m in merged if m[0] == 1):
        if a > at:
            want.append((1, at, min(a, hi) - at))
        at = max(at, a + length)
    if at < hi:
        want.append((1, at, hi - at))
    universe = spark.createDataFrame([(1, lo, hi - lo), (2, 3, 4), (3, 0, 0)], SHAPE)
    assert sorted(taken(ranges.complement_ranges(frame, universe, bin_bytes=bin_bytes))) == sorted([*want, (2, 3, 4)])


@pytest.mark.parametrize(("tolerance", "bin_bytes"), [(0, 50), (30, 50), (300, 50), (10**9, 50), (300, 1 << 20)])
def test_asof(spark, tolerance, bin_bytes):
    rng = random.Random(tolerance)
    left = sorted({rng.randrange(5_000) for _ in range(200)})
    right = sorted({rng.randrange(100, 5_000) for _ in range(40)})
    got = ranges.asof_before(spark.createDataFrame([(1, x) for x in left] + [(2, 7), (None, 3)], "image_id long, offset long"), spark.createDataFrame([(1, x) for x in right] * 2, "image_id long, offset long"), tolerance, bin_bytes=bin_bytes)
    want = {(1, x): max((m for m in right if x - tolerance <= m <= x), default=None) for x in left} | {(2, 7): None, (None, 3): None}
    assert sorted(map(str, ((r.image_id, r.offset, r.marker) for r in got.collect()))) == sorted(str((*k, m)) for k, m in want.items())


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 1, 2]), k, rng.choice([None, 1, 5, -3])) for k in range(500)]
    got = {(r.k, r.at): (r.total, r.place) for r in prefix.running_sums(spark.createDataFrame(rows, "k long, at long, v long").repartition(7), ["k"], ["at"], {"total": F.col("v"), "place": F.lit(1)}).collect()}
    totals, places, want = {}, {}, {}
    for k, at, v in rows:
        places[k] = places.get(k, 0) + 1
        if v is not None:
            totals[k] = totals.get(k, 0) + v
        want[k, at] = (totals.get(k), places[k])
    assert got == want
    assert prefix.running_sums(spark.createDataFrame([], "k long, at long, v long"), ["k"], ["at"], {"total": F.col("v")}).collect() == []


@pytest.mark.parametrize(("most", "regions"), [(0, 9), (500, 9), (500, 1000), (10**9, 10**9)])
def test_budget(spark, most, regions):
    rng = random.Random(most)
    rows = [(i, k, rng.choice([1, 20, 90])) for i, n in ((1, 200), (2, 3)) for k in range(n)]
    got = recovery.budget_prefix(spark.createDataFrame(rows, SHAPE).repartition(5), ["image_id"], ["offset"], most, regions).collect()
    want = []
    for i in (1, 2):
        upto, kept, cut = 0, [], False
        for place, (_, k, n) in enumerate((r for r in rows if r[0] == i), 1):
            upto += n
            if upto > most or place > regions:
                cut = True
                break
            kept.append((i, k, n, upto, place))
        want += [(*r, cut) for r in kept]
    assert sorted((r.image_id, r.offset, r.length, r.bytes_upto, r.place, r.truncated) for r in got) == want


def test_one_image_is_shared_by_tasks(spark):
    """A million ranges of one image: the second pass and the search for holes have rows in all partitions, not in one."""
    rows = spark.range(1_000_000).select(F.lit(1).cast("long").alias("image_id"), (F.col("id") * 4096).alias("offset"), F.when(F.col("id") % 3 == 0, 4096).otherwise(100).cast("long").alias("length"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        universe = spark.createDataFrame([(1, 0, 4096 * 1_000_000)], SHAPE)
        for found, n in ((ranges.merge_ranges(rows), 666_667), (ranges.complement_ranges(rows, universe), 666_666)):
            sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(sizes) == n and len(sizes) >= 4 and max(sizes) < n / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    laid = ranges.map_logical(spark.createDataFrame([(1, 5, 4096, 1000)], "image_id long, range_id long, offset long, length long"), rows.select("*", (F.col("offset") * -1).alias("seq")))
    assert {(r.seq, r.length) for r in laid.collect()} <= {(-k * 4096, n) for k in range(999_000, 1_000_000) for n in range(1, 4097)}
    assert laid.agg(F.sum("length")).first()[0] == 1000
