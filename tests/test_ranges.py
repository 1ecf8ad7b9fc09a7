"""Interval algebra against a model with one flag for each byte."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import islands, ranges

SHAPE = "image_id long, offset long, length long"


def some(seed, n=60):
    rng = random.Random(seed)
    return [(rng.randrange(3), rng.randrange(1000), rng.choice([0, 1, 5, rng.randrange(200)])) for _ in range(n)]


def cells(rows):
    return {(i, p) for i, o, n in rows for p in range(o, o + n)}


def taken(df):
    return [(r.image_id, r.offset, r.length) for r in df.select("image_id", "offset", "length").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_algebra(spark, seed):
    a, b = some(seed), some(seed + 10)
    fa, fb = spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE)
    universe = spark.createDataFrame([(k, 100, 900) for k in range(3)], SHAPE)
    inside = {(k, p) for k in range(3) for p in range(100, 1000)}
    for found, want in (
        (ranges.merge_ranges(fa, bin_bytes=64), cells(a)),
        (ranges.union_ranges(fa, fb), cells(a) | cells(b)),
        (ranges.intersect_ranges(fa, fb), cells(a) & cells(b)),
        (ranges.subtract_ranges(fa, fb), cells(a) - cells(b)),
        (ranges.complement_ranges(fa, universe), inside - cells(a)),
    ):
        rows = sorted(taken(found))
        assert cells(rows) == want and sum(r[2] for r in rows) == len(want)
        assert all(x[0] != y[0] or x[1] + x[2] < y[1] for x, y in zip(rows, rows[1:]))  # disjoint, not even adjacent
    pairs = ranges.overlap_join(fa, fb, bin_bytes=50).collect()
    want = sorted((x[0], x[1], x[2], y[1], y[2]) for x in a for y in b if x[0] == y[0] and x[2] and y[2] and x[1] < y[1] + y[2] and y[1] < x[1] + x[2])
    assert sorted((r.image_id, r.a_offset, r.a_length, r.b_offset, r.b_length) for r in pairs) == want


def test_no_ranges_and_overflow(spark):
    rows = spark.createDataFrame([(1, 2**63 - 5, 10), (1, None, 5), (1, 5, 0), (1, -3, 5), (None, 1, 2)], SHAPE)
    assert taken(ranges.merge_ranges(rows)) == [(None, 1, 2)]
    empty = spark.createDataFrame([], SHAPE)
    assert taken(ranges.merge_ranges(empty)) == []
    assert taken(ranges.complement_ranges(empty, spark.createDataFrame([(1, 0, 9)], SHAPE))) == [(1, 0, 9)]


def test_folds(spark):
    rng = random.Random(4)
    times = sorted({(rng.randrange(2), rng.randrange(300)) for _ in range(120)})
    got = {(r.k, r.t): r.anchor for r in islands.anchored_groups(spark.createDataFrame(times, "k long, t long"), ["k"], "t", 5).collect()}
    at = {}
    for k, t in times:
        if k not in at or t - at[k] > 5:
            at[k] = t
        assert got[k, t] == at[k]
    hits = sorted({(0, o): n for o, n in ((rng.randrange(500), rng.randrange(1, 30)) for _ in range(80))}.items())
    kept, end = [], 0
    for (k, o), n in hits:
        if o >= end:
            kept.append((k, o, n))
            end = o + n
    frame = spark.createDataFrame([(k, o, n) for (k, o), n in hits], SHAPE)
    assert sorted(taken(islands.greedy_non_overlap(frame, ["image_id"]))) == kept


def test_partitions_do_not_matter(spark):
    rows = spark.createDataFrame(some(7, 200), SHAPE)
    one, many = ranges.merge_ranges(rows.coalesce(1)), ranges.merge_ranges(rows.repartition(13, F.rand(1)), bin_bytes=17)
    assert sorted(taken(one)) == sorted(taken(many))


def test_islands_are_told_apart_by_their_keys():
    """Two islands dealt out under one hash start anew each."""
    import pyarrow as pa

    from tracelake.operators.islands import _fold

    batch = pa.RecordBatch.from_pydict({"image_id": [1, 1, 2, 2, 2], "island": [1, 1, 1, 1, 2], "v": [1, 1, 1, 1, 1], "__isle": [7, 7, 7, 7, 7]})
    (out,) = _fold(["v"], lambda state, v: ((state or 0) + v,) * 2, ["image_id", "island"])([batch])
    assert out.column("__out").to_pylist() == [1, 2, 1, 2, 1] and out.schema.names == ["image_id", "island", "v", "__out"]
