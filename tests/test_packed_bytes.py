"""Bytes that queries pack are packed once and by all tasks, and fields are read without looking at the bytes around them."""

import struct

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracelake.functions import fields
from tracelake.operators import layouts

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["x06_leaf_entries", "x07_footer_slots"])
def test_bytes_are_packed_once_behind_the_exchange(spark, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    packing = [k for k, line in enumerate(lines) if "unhex(" in line]
    dealt = [k for k, line in enumerate(lines) if "RepartitionByExpression" in line]
    assert len(packing) == 1 and lines[packing[0]].lstrip(" :+-").startswith("Project") and lines[packing[0]].count("transform(") == 1
    assert len(dealt) == 1 and dealt[0] > packing[0]
    assert not any("regexp_extract_all" in line for line in lines)


def test_numbers_of_each_width(spark):
    values = [0, 1, -1, 127, 128, -128, 255, 1 << 31, -(1 << 31), (1 << 55) - 1, -(1 << 55), (1 << 63) - 1, -(1 << 63), 0x0123456789ABCDEF]
    df = spark.createDataFrame([(v, bytearray(struct.pack("<q", v))) for v in values], "v long, d binary")
    d = F.col("d")
    picked = [fields.le_bytes(F.col("v"), n).alias(f"b{n}") for n in range(1, 9)] + [fields.le_uint(d, 8 - n, n).alias(f"u{n}") for n in range(1, 8)] + [fields.le_int(d, 8 - n, n).alias(f"i{n}") for n in range(1, 8)]
    shape = layouts.Layout("t", 0, 8, 9, {}, {**{f"f{n}": (8 - n, n) for n in range(1, 9)}, **{f"s{n}": (8 - n, n, "signed") for n in range(1, 9)}})
    read = layouts.explode_entries(df.withColumnRenamed("d", "data"), shape, F.lit(1))
    got = df.select("v", *picked, fields.le_uint(d, 5, 4).alias("short"), fields.le_uint(d, -1, 2).alias("ahead")).collect()
    for row, v in zip(got, values, strict=True):
        raw = struct.pack("<q", v)
        assert row.v == v and row.short is None and row.ahead is None
        for n in range(1, 9):
            assert bytes(row[f"b{n}"]) == raw[:n]
        for n in range(1, 8):
            assert row[f"u{n}"] == int.from_bytes(raw[8 - n :], "little") and row[f"i{n}"] == int.from_bytes(raw[8 - n :], "little", signed=True)
    for row, v in zip(read.collect(), values, strict=True):
        raw = struct.pack("<q", v)
        assert row.f8 == row.s8 == v and row.blank == (v == 0)
        for n in range(1, 8):
            assert row[f"f{n}"] == int.from_bytes(raw[8 - n :], "little") and row[f"s{n}"] == int.from_bytes(raw[8 - n :], "little", signed=True)


def test_windows_side_by_side_are_read_at_once(spark, monkeypatch):
    """One read for the windows of an image, several only around a hole; the same windows as before."""
    from tracelake.sources import images

    whole = [(i, 0, bytearray(bytes(range(200)))) for i in range(3)]
    cut = [(7, 0, bytearray(b"a" * 40)), (7, 50, bytearray(b"b" * 50)), (8, 0, None)]
    files = images.FileImages.written(spark.createDataFrame(whole + cut, "image_id long, start long, data binary"), 16)
    got = {(r.image_id, r.base_offset): (r.owned_len, r.data and bytes(r.data)) for r in files.chunks(3).collect()}
    assert {k: v for k, v in got.items() if k[0] < 7} == {(i, b): (min(16, 200 - b), bytes(range(b, min(b + 19, 200)))) for i in range(3) for b in range(0, 200, 16)}
    assert [got[7, b][1] and len(got[7, b][1]) for b in range(0, 100, 16)] == [19, 19, None, None, 19, 19, 4]
    assert sorted((r.image_id, r.size_bytes) for r in files.sizes().collect()) == [(0, 200), (1, 200), (2, 200), (7, 100)]
    touching = spark.createDataFrame([(0, 20, 30), (0, 40, 1), (0, 190, 50), (1, 500, 9)], "image_id long, offset long, length long")
    assert sorted((r.image_id, r.base_offset) for r in files.chunks(3, touching).collect()) == [(0, 16), (0, 32), (0, 48), (0, 176), (0, 192)]
    joined = sorted((r.image_id, r.base_offset, r.owned_len, bytes(r.data)) for r in files.chunks(3, touching, joined=True).collect())
    assert b"".join(d[:n] for _, _, n, d in joined) == bytes(range(16, 64)) + bytes(range(176, 200))
    reads, own = [], images._Files.read
    monkeypatch.setattr(images._Files, "read", lambda self, *a: reads.append(a) or own(self, *a))
    path = files.catalog.where("image_id = 1").first()
    found = list(images._Files().windows([(0, 200, path.path, path.at)], 200, 16, 3, 0, 12, False))
    assert len(found) == 13 and len(reads) == 1
    assert [x[:2] for x in images._Files().windows([(0, 200, path.path, path.at)], 200, 16, 3, 0, 12, True)] == [(0, 200)]


def test_sums_come_back_by_broadcast(spark):
    """Rows aren't dealt out again to meet the sums of earlier ranges."""
    from tracelake.operators.prefix import running_sums

    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("one"))
    df = running_sums(rows, ["k"], ["id"], {"n": F.col("one")})
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert all(r.n == r.id // 3 + 1 for r in df.collect())
