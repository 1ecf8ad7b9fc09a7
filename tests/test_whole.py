"""Queries over whole tables: no row of the inputs is left out, at any size of the keys."""

import pytest

import __spark_entry__
from tracelake.plans import registry

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
ROWS = [(1 + k // 3, 3 + k % 5, 1 + k % 2, k % 7, 20.0 + k % 30, "ANR"[k % 3], "OF"[k % 4 // 3]) for k in range(90)]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, LINES).write.parquet(str(at / "lineitem.parquet"))
    orders = spark.createDataFrame([(k, k % 40, "F") for k in range(1, 400)], "o_orderkey long, o_custkey long, o_orderstatus string")
    orders.write.parquet(str(at / "orders.parquet"))
    spark.createDataFrame([(k, k % 25) for k in (1, 19, 999, 1000, 1045, 19000, 1234567)], "c_custkey long, c_nationkey int").write.parquet(str(at / "customer.parquet"))
    return str(at)


def placed():
    return [(s, o * 64 + n * 8, int(q) * 32, f, st, o, n, p) for o, p, s, n, q, f, st in ROWS]


def run(spark, name, at):
    return __spark_entry__.queries()[name](spark, at).collect()


def test_overlap_join(spark, lines):
    a, b = [r for r in placed() if r[4] == "O"], [r for r in placed() if r[3] == "R"]
    want = sorted((x[0], x[1], x[2], x[5], y[1], y[2], y[5]) for x in a for y in b if x[0] == y[0] and x[1] < y[1] + y[2] and y[1] < x[1] + x[2])
    got = sorted((r.image_id, r.a_offset, r.a_length, r.a_l_orderkey, r.b_offset, r.b_length, r.b_l_orderkey) for r in run(spark, "j02_overlap_join", lines))
    assert got == want and want


def test_map_logical(spark, lines):
    pieces, laid = {}, {}
    for i, o, n, f, _, order, line, p in placed():
        if f == "A":
            old = pieces.get((i, (order * 10 + line) * 1000000 + p), (o, n))
            pieces[i, (order * 10 + line) * 1000000 + p] = min(old[0], o), min(old[1], n)
    want, ends = [], {}
    for (i, seq), (disk, n) in sorted(pieces.items()):
        laid[i, seq] = ends.get(i, 0), disk, n
        ends[i] = ends.get(i, 0) + n
    for i, p in {(r[0], r[7]) for r in placed()}:
        for (j, seq), (at, disk, n) in laid.items():
            lo, hi = max(at, p * 13), min(at + n, p * 13 + 2000)
            if i == j and lo < hi:
                want.append((i, p, seq, disk + lo - at, hi - lo))
    got = sorted((r.image_id, r.range_id, r.seq, r.offset, r.length) for r in run(spark, "j14_map_logical", lines))
    assert got == sorted(want) and want


def test_partition_entries(spark, lines):
    got = {r.image_id: r for r in run(spark, "x09_partition_entries", lines)}
    assert set(got) == {1, 19, 999, 1000, 1045, 19000, 1234567}
    assert got[1045].finding == "unused with geometry" and got[19].finding == "overflow" and got[1234567].finding == "out of bounds"


def test_pointers_and_entries(spark, lines):
    assert sorted(r.hit_id for r in run(spark, "x03_follow_pointers", lines)) == list(range(1, 400))
    odd = [r for r in run(spark, "j04_match_entries", lines) if r.clip_id % 2 and r.clip_id % 3 == 0]
    assert odd and all((r.entry_id, r.basis) == (r.clip_id * 7, "offset") for r in odd)


def test_uncut_names_its_filters():
    with pytest.raises(ValueError):
        registry.uncut("j02_overlap_join", (" WHERE nothing", ""))
