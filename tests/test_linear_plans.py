"""Plans that read each input a bounded number of times, and fields as wide as their numbers."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import fields
from tracelake.operators import pipeline, ranges, recovery

SHAPE = "image_id long, offset long, length long"


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merges_read_their_input_once(spark):
    rows = spark.createDataFrame([(1, 0, 5)], SHAPE)
    records = rows.withColumn("accessible", F.lit(True))
    assert leaves(ranges.merge_ranges(ranges.merge_ranges(rows))) == 1
    assert leaves(ranges.complement_ranges(rows, rows)) == 2
    assert leaves(ranges.subtract_ranges(rows, rows)) == 2
    unclaimed = ranges.claim_map(records, rows).where("kind = 'unclaimed'")
    assert leaves(ranges.split_by_scope(unclaimed, rows)) <= 5


@pytest.mark.parametrize("seed", [3, 4])
def test_ranges_over_many_bins(spark, seed):
    rng = random.Random(seed)
    cells = lambda x: {(i, p) for i, o, n in x for p in range(o, o + n)}
    a, b = ([(rng.randrange(3), rng.randrange(900), rng.choice([0, 1, 16, rng.randrange(300)])) for _ in range(n)] for n in (50, 15))
    fa, fb = (spark.createDataFrame(x, SHAPE) for x in (a, b))
    parts = ranges._divided(fa, fb, ["image_id"], 16).collect()
    for inside, want in ((True, cells(a) & cells(b)), (False, cells(a) - cells(b))):
        rows = sorted((r.image_id, r.offset, r.length) for r in parts if r.inside == inside)
        assert cells(rows) == want and sum(r[2] for r in rows) == len(want)
        assert all(x[0] != y[0] or x[1] + x[2] < y[1] for x, y in zip(rows, rows[1:]))
    universe = spark.createDataFrame([(k, 50, 1500) for k in range(4)], SHAPE)
    holes = sorted((r.image_id, r.offset, r.length) for r in ranges.complement_ranges(fa, universe, bin_bytes=16).collect())
    assert cells(holes) == {(k, p) for k in range(4) for p in range(50, 1550)} - cells(a)
    assert all(x[0] != y[0] or x[1] + x[2] < y[1] for x, y in zip(holes, holes[1:]))


def test_merges_hold_few_rows_in_a_task(spark):
    """However few partitions the session has, rows are dealt out over more of them, and none is held in a hash."""
    rows = spark.createDataFrame([(k, o, 40) for k in range(3) for o in range(0, 4000, 37 + k)], SHAPE)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        for found in (ranges.merge_ranges(rows, bin_bytes=64), ranges._divided(rows, rows.where("offset < 50"), ["image_id"], 64)):
            assert "Aggregate" not in plan(found)
            assert found.rdd.getNumPartitions() >= ranges.PARTS > int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(name)


def test_adaptive_execution_leaves_passes_dealt_out(spark):
    """Partitions of a pass over bins aren't put together for the cores at hand, under sums over the ranges neither."""
    rows = spark.range(200_000).select((F.col("id") % 50).alias("image_id"), (F.col("id") * 640).alias("offset"), F.lit(320).cast("long").alias("length"))
    merged = ranges.merge_ranges(rows)
    assert merged.rdd.getNumPartitions() >= ranges.PARTS
    sizes = [r["count"] for r in merged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 20_000
    stats = ranges.range_stats(rows)
    assert "Rebalance" not in plan(stats) and plan(stats).count(f", {ranges.PARTS}\n") == 3
    assert sorted(map(tuple, stats.collect())) == [(k, 4000, 4000 * 320, k * 640, (199_950 + k) * 640 + 320) for k in range(50)]


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_ranges_that_cross_bins_are_closed_once(spark, seed):
    """What one bin opens is closed by the next bin with a new start, or by the key's last one, also if that has no start of its own."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(400), rng.choice([1, 2, 7, 8, 9, 90])) for _ in range(45)]
    rows += [(9, 0, 100), (9, 20, 3), (9, 96, 2), (8, 0, 8), (8, 8, 8), (8, 17, 1), (7, 5, 40), (7, 44, 9), (7, 60, 1)]
    want = []
    for key in {r[0] for r in rows}:
        open_, reach = None, None
        for o, n in sorted(r[1:] for r in rows if r[0] == key):
            if reach is None or o > reach:
                if reach is not None:
                    want.append((key, open_, reach - open_))
                open_, reach = o, o + n
            reach = max(reach, o + n)
        want.append((key, open_, reach - open_))
    got = [(r.image_id, r.offset, r.length) for r in ranges.merge_ranges(spark.createDataFrame(rows, SHAPE), bin_bytes=8).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    stats = {r.image_id: (r.n_ranges, r.total_bytes, r.min_offset, r.max_end) for r in ranges.range_stats(spark.createDataFrame(rows, SHAPE)).collect()}
    for key in {r[0] for r in rows}:
        mine = [w for w in want if w[0] == key]
        assert stats[key] == (len(mine), sum(w[2] for w in mine), min(w[1] for w in mine), max(w[1] + w[2] for w in mine))


def test_unanimity_and_order_count_no_distinct_values(spark):
    rows = [(1, 10, "a", 5, 7, 0, 4, 1), (1, 10, "a", 6, 7, 9, 4, 2), (2, None, "a", 5, 8, 0, 4, 3), (2, 3, "b", 5, 9, 2, 4, 4), (3, None, None, None, None, 8, 1, 5), (4, 1, "a", None, 3, 9, 1, 6), (4, 1, "a", 2, 1, 0, 1, 7)]
    df = spark.createDataFrame(rows, "group_id long, channel long, state string, sequence long, ts long, offset long, length long, fragment_id long")
    found = df.groupBy("group_id").agg(*[recovery.unanimous(c).alias(c) for c in ("channel", "state")])
    assert "Expand" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 10, "a"), (2, None, None), (3, None, None), (4, 1, "a")]
    ordered = recovery.establish_order(df)
    assert "Expand" not in plan(ordered) and leaves(ordered) == 1
    got = {r.fragment_id: (r.basis, r.place) for r in ordered.collect()}
    none = "unknown: no ordering evidence"
    assert got == {1: ("sequence", 1), 2: ("sequence", 2), 3: ("unknown: duplicate sequence numbers", 1), 4: ("unknown: duplicate sequence numbers", 2), 5: (none, 1), 6: ("time", 2), 7: ("time", 1)}


def test_fields_hold_their_numbers(spark):
    """Part keys of larger tables go beyond four bytes in the signed field of p10_le_fields."""
    import __spark_entry__

    values = [0, -1, -5000000, 2**31, 1_200_000 * 40503 - 5000000, -(2**55), 2**55 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("d", fields.le_bytes(F.col("v"), 7))
    got = df.select("d", fields.le_int(F.col("d"), 0, 7).alias("back"), fields.le_int(fields.le_bytes(F.col("v"), 4), 0, 4).alias("low")).collect()
    assert [r.back for r in got] == values and [bytes(r.d) for r in got] == [v.to_bytes(7, "little", signed=True) for v in values]
    assert [r.low for r in got] == [(v + 2**31) % 2**32 - 2**31 for v in values]
    import os
    import tempfile

    folder = tempfile.mkdtemp(prefix="part-")
    spark.createDataFrame([(1_200_000, 7)], "p_partkey long, p_size int").write.parquet(os.path.join(folder, "part.parquet"))
    (row,) = __spark_entry__.queries()["p10_le_fields"](spark, folder).collect()
    assert row.i32 == 1_200_000 * 40503 - 5000000 and row.u48 == 1_200_000 * 1000003 and row.beyond is None


def test_holes_and_divided_ranges_take_three_exchanges(spark):
    """Neither merges what it takes first, and universes come along with the passes, so no row meets them in a join."""
    rows = spark.createDataFrame([(1, 0, 5)], SHAPE)
    records = rows.withColumn("accessible", F.lit(True))
    claims = ranges.claim_map(records, rows)
    for found, n in ((ranges.complement_ranges(rows, rows), 3), (ranges.subtract_ranges(rows, rows), 3), (claims, 3), (ranges.split_by_scope(claims.where("kind = 'unclaimed'"), rows), 6)):
        assert plan(found).count("RepartitionByExpression") == n and "Join" not in plan(found)


def test_universes_of_other_keys(spark):
    """Keys without ranges, without a universe, null keys, universes that begin behind all ranges or end ahead of them; sides that overlap themselves."""
    rows = spark.createDataFrame([(1, 0, 30), (1, 20, 30), (2, 5, 5), (3, 100, 10), (4, 7, 1), (None, 1, 5)], SHAPE)
    universe = spark.createDataFrame([(1, 10, 100), (3, 0, 50), (4, 20, 10), (5, 3, 4), (6, 9, 0), (None, 0, 9)], SHAPE)
    holes = sorted(map(tuple, ranges.complement_ranges(rows, universe, bin_bytes=8).collect()), key=str)
    assert holes == [(1, 50, 60), (3, 0, 50), (4, 20, 10), (5, 3, 4), (None, 0, 9)]
    known = rows.withColumn("accessible", F.col("offset") != 20)
    got = sorted(map(tuple, ranges.claim_map(known, universe).collect()), key=str)
    assert got == sorted([(1, "claimed", 10, 20), (1, "available", 20, 30), *[(k, "unclaimed", o, n) for k, o, n in holes]], key=str)
    cut = spark.createDataFrame([(1, 8, 8), (1, 12, 10), (1, 12, 10), (2, 0, 6)], SHAPE)
    parts = sorted((r.image_id or 0, r.inside, r.offset, r.length) for r in ranges._divided(rows, cut, ["image_id"], 8).collect())
    assert parts == [(0, False, 1, 5), (1, False, 0, 8), (1, False, 22, 28), (1, True, 8, 14), (2, False, 6, 4), (2, True, 5, 1), (3, False, 100, 10), (4, False, 7, 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_claims_and_what_is_left(spark, seed):
    """Both kinds and what neither claims, over many bins, against bytes one by one."""
    rng = random.Random(seed)
    rows = [(rng.randrange(4), rng.random() < 0.5, rng.randrange(500), rng.choice([1, 3, 7, 8, 9, 60])) for _ in range(60)]
    limits = {0: (20, 450), 1: (0, 900), 2: (300, 10), 5: (3, 40)}
    records = spark.createDataFrame(rows, "image_id long, accessible boolean, offset long, length long")
    universe = spark.createDataFrame([(k, *v) for k, v in limits.items()], SHAPE)
    got = [tuple(r) for r in ranges.claim_map(records, universe, bin_bytes=8).collect()]
    cells = {(i, p) for i, (o, n) in limits.items() for p in range(o, o + n)}
    held = {a: {(i, p) for i, x, o, n in rows if x == a for p in range(o, o + n)} & cells for a in (True, False)}
    for kind, want in (("claimed", held[True]), ("available", held[False]), ("unclaimed", cells - held[True] - held[False])):
        mine = sorted((i, o, n) for i, k, o, n in got if k == kind)
        assert {(i, p) for i, o, n in mine for p in range(o, o + n)} == want and sum(r[2] for r in mine) == len(want)
        assert all(x[0] != y[0] or x[1] + x[2] < y[1] for x, y in zip(mine, mine[1:]))


def test_budgets_need_no_join(spark):
    """Keys are told of their cut among their own rows; a negative length, behind which bounds may hold again, still ends at the first break."""
    rows = [(i, k, 10) for i, n in ((1, 30), (2, 3), (None, 12)) for k in range(n)]
    found = recovery.budget_prefix(spark.createDataFrame(rows, SHAPE).repartition(3), ["image_id"], ["offset"], 80, 100)
    assert "Join" not in plan(found) and found.columns == ["image_id", "offset", "length", "bytes_upto", "place", "truncated"]
    assert sorted((r.image_id or 0, r.bytes_upto, r.place, r.truncated) for r in found.collect()) == [(0, 10 * k, k, True) for k in range(1, 9)] + [(1, 10 * k, k, True) for k in range(1, 9)] + [(2, 10 * k, k, False) for k in range(1, 4)]
    odd = [(1, 0, 50), (1, 1, 40), (1, 2, -60), (1, 3, 5), (2, 0, None), (2, 1, 7)]
    got = recovery.budget_prefix(spark.createDataFrame(odd, SHAPE), ["image_id"], ["offset"], 80, 100).collect()
    assert sorted((r.image_id, r.place, r.bytes_upto, r.truncated) for r in got) == [(1, 1, 50, True), (2, 1, None, False), (2, 2, 7, False)]


def test_targets_are_planned_in_one_go(spark):
    """Probes and sweeps come out of one reading of the claims, and findings go to their bins as they are."""
    records = spark.createDataFrame([(1, True, 100, 600), (1, False, 650, 20)], "image_id long, accessible boolean, offset long, length long")
    planned = recovery.plan_recovery(records, spark.createDataFrame([(1, 2000)], "image_id long, size_bytes long"), 200, 500)
    assert leaves(planned) == 2
    assert [tuple(r)[:4] for r in planned.orderBy("place").select("kind", "offset", "length", "place").collect()] == [("unclaimed", 0, 100, 1), ("claimed", 100, 200, 2), ("available", 650, 20, 3), ("unclaimed", 700, 500, 4), ("unclaimed", 1200, 500, 5), ("unclaimed", 1700, 300, 6)]
    shape = "image_id long, region_id long, offset long, claim string, allocation string, present boolean, signature boolean, valid boolean"
    findings = spark.createDataFrame([(1, 7, 150, "indexed", "free", True, True, True)] * 3 + [(1, 8, 1999, "no index", "allocated", True, True, False), (1, 9, 1999, "indexed", "free", False, True, True)], shape)
    (row,) = pipeline.run_recovery(records, spark.createDataFrame([(1, 2000)], "image_id long, size_bytes long"), findings, recovery.ALL_BYTES, recovery.ALL_REGIONS).collect()
    assert (row.n_candidates, row.n_deleted, row.n_corrupted, row.n_active) == (2, 1, 1, 0)
