"""Structures written byte by byte at their real places, and profiles that move a field."""

import struct

from pyspark.sql import functions as F

from tracelake.operators import decode, layouts, records


def at(size, **fields):
    """``size`` zero bytes with values put at places: p<place>=(format, value)."""
    out = bytearray(size)
    for name, (form, value) in fields.items():
        struct.pack_into("<" + form, out, int(name[1:]), value)
    return bytes(out)


def rows(spark, data, shape, *more):
    return spark.createDataFrame([(1, *more, bytearray(data))], shape)


def test_block_entries(spark):
    clock = 26 << 26 | 3 << 22 | 9 << 17 | 10 << 12 | 11 << 6 | 12
    table = b"".join([
        at(32, p0=("B", 1), p1=("B", 0x33), p4=("I", clock), p8=("I", clock + 1), p12=("i", 1), p16=("h", 9), p20=("i", -1), p24=("i", 0)),
        at(32, p0=("B", 1), p1=("B", 2), p12=("i", -1), p16=("h", 4), p20=("i", 7), p24=("i", 5), p29=("B", 1), p31=("B", 0xE5)),
        at(32, p0=("B", 0xFE), p12=("i", 9)),
        at(32, p0=("B", 1), p12=("i", -7), p16=("h", -1), p20=("i", -2), p24=("i", -3)),
    ])
    got = decode.block_entries(rows(spark, table, "image_id long, size_bytes long, data binary", 100_000), 8192).orderBy("entry").collect()
    assert [(r.channel, r.next, r.prev, r.first, r.sectors, r.state, r.offset, r.length, r.problems) for r in got] == [
        (4, 1, -1, 0, 9, "Occupied", 0, 8192, None),
        (5, 0, 7, 5, 4, "Occupied", 8192, 2048, None),
        (1, 9, 0, 0, 0, "Empty", None, None, None),
        (1, 0, -2, -3, -1, "Malformed", 24576, None, "next, previous, first, no sectors"),
    ]
    assert str(got[0].start_time) == "2026-03-09 10:11:12" and str(got[0].end_time) == "2026-03-09 10:11:13"
    assert decode.block_entries(rows(spark, table, "image_id long, size_bytes long, data binary", 10_000), 8192).where("entry < 2").orderBy("entry").select("length", "problems").collect()[1] == (1808, "cut by the image's end")


def test_leaf_entries(spark):
    entry = lambda sentinel, **more: at(48, p8=("q", sentinel), p17=("B", 3), p24=("i", 1_700_000_000), p28=("i", 1_700_000_060), p32=("q", 1 << 40), p40=("i", 6), **more)
    page = at(96, p16=("i", 4)) + entry(0) + entry(-1) + entry(5) + entry(0, p0=("q", 4096))
    got = decode.leaf_entries(rows(spark, page, "page_id long, page_offset long, data binary", 8192)).orderBy("entry").collect()
    assert [(r.state, r.data_offset, r.channel, r.start, r.end, r.status, r.notes, r.truncated) for r in got] == [
        ("populated", 1 << 40, 4, 1_700_000_000, 1_700_000_060, 6, None, False),
        ("blank", None, None, None, None, None, None, False),
        ("malformed", None, None, None, None, None, None, False),
        ("populated", 1 << 40, 4, 1_700_000_000, 1_700_000_060, 6, "other page", False),
    ]
    long = at(96, p16=("i", 1000)) + entry(0) * 90
    got = decode.leaf_entries(rows(spark, long, "page_id long, data binary"))
    assert got.count() == 83 and got.where("not truncated").isEmpty()
    assert decode.leaf_entries(rows(spark, at(96, p16=("i", -1)) + entry(0), "page_id long, data binary")).isEmpty()


def test_footer_slots(spark):
    slot = at(512, p13=("B", 2), p40=("I", 1_700_000_000), p48=("I", 1_700_000_100), p56=("I", 0), p72=("I", 64), p76=("I", 9000), p88=("B", 25))
    footer = lambda count, marker=0: at(512, p13=("B", marker), p20=("H", count)) + slot * 2
    (one, _) = decode.footer_slots(rows(spark, footer(2), "block_id long, data binary")).orderBy("entry").collect()
    assert (one.channel, one.start, one.from_fallback, one.end, one.first, one["last"], one.frame_rate) == (3, 1_700_000_000, True, 1_700_000_100, 64, 9000, 25)
    for count, marker in ((0, 0), (3, 0), (2, 255)):
        assert decode.footer_slots(rows(spark, footer(count, marker), "block_id long, data binary")).isEmpty()
    judged = records.clip_slots(decode.footer_slots(rows(spark, footer(2), "block_id long, data binary")), 9000)
    assert [r.rejected for r in judged.collect()] == [None, None]


def test_frame_references_of_two_arrays(spark):
    ref = lambda o, n, t=0: at(12, p0=("I", o), p4=("i", n), p8=("I", t))
    clock = 26 << 26 | 3 << 22 | 9 << 17
    head = at(12, p0=("4s", b"DHII"), p4=("I", 96), p8=("i", 3))
    arrays = at(12, p0=("I", 1), p4=("I", 548), p8=("I", 30)) + at(12, p0=("I", 3), p4=("I", 572), p8=("I", 12)) + at(12, p0=("I", 6), p4=("I", 10), p8=("I", 12))
    data = head + arrays + ref(100, 50, clock) + ref(0xFFFFFFFF, 5) + ref(600, 20)
    clip = rows(spark, data, "clip_id long, clip_length long, index_offset long, data binary", 1000, 500)
    got = records.frame_index(decode.frame_references(clip)).orderBy("array", "entry").collect()
    assert [(r.array, r.kind, r.entry, r.offset, r.length, r.rejected) for r in got] == [(0, 1, 0, 100, 50, None), (0, 1, 1, 0xFFFFFFFF, 5, "sentinel"), (1, 3, 0, 600, 20, None)]
    assert str(got[0].time) == "2026-03-09 00:00:00" and got[1].time is None
    inside = records.frame_index(decode.frame_references(rows(spark, head + arrays + ref(480, 30) + ref(595, 10) + ref(596, 10), "clip_id long, clip_length long, index_offset long, data binary", 1000, 500)))
    assert [r.rejected for r in inside.orderBy("array", "entry").collect()] == ["overlaps index", "overlaps index", None]


def test_directory_of_wide_places(spark):
    entry = lambda o, n, t=0: at(32, p0=("B", 1), p1=("B", 0xFD), p4=("Q", o), p12=("Q", n), p20=("Q", t), p28=("I", 0xDEADBEEF))
    data = at(16, p0=("4s", b"DIDX"), p4=("I", 9)) + entry(65536, 4096, 1_700_000_000) + entry(1 << 63, 5) + entry((1 << 64) - 2, 5) + entry(8, 0)
    images = rows(spark, data, "image_id long, size_bytes long, data binary", 1 << 20)
    frames = spark.createDataFrame([(1, 65536, "p")], "image_id long, offset long, payload string")
    got = records.directory_entries(decode.directory(images), frames).orderBy("entry").collect()
    assert [(r.entry, r.channel, r.offset, r.length, r.rejected, r.payload, r.start, r.truncated) for r in got] == [
        (0, 2, 65536, 4096, None, "p", 1_700_000_000, True), (1, 2, None, None, "past end", None, None, True), (2, 2, None, None, "overflow", None, None, True), (3, 2, None, None, "zero length", None, None, True)]
    assert got[1].declared_offset == 1 << 63 and got[0].crc == 0xDEADBEEF


def test_each_row_by_its_own_profile(spark):
    usual = at(32, p0=("B", 1), p12=("i", 1), p16=("h", -3), p20=("i", 4), p24=("i", 2))
    moved = at(40, p0=("B", 1), p12=("i", 1), p30=("i", 70_000), p20=("i", 4), p24=("i", 2), p36=("I", 0xFFFFFFF0))
    profile = {"block_entry.sectors": "30:4:signed", "block_entry.size": "40", "block_entry.prev": "36:4", "block_entry.first": "24", "block_entry.end": "x"}
    shape = "image_id long, size_bytes long, data binary, layout map<string,string>"
    images = spark.createDataFrame([(1, 1 << 30, bytearray(usual * 2), None), (2, 1 << 30, bytearray(moved * 2), profile), (3, 1 << 30, bytearray(usual), {"other.sectors": "0:1"})], shape)
    got = decode.block_entries(images, 4096, count=F.lit(2)).orderBy("image_id", "entry").collect()
    assert [(r.image_id, r.entry, r.sectors, r.prev, r.first, r.truncated) for r in got] == [(1, 0, -3, 4, 2, False), (1, 1, -3, 4, 2, False), (2, 0, 70_000, 0xFFFFFFF0, 2, False), (2, 1, 70_000, 0xFFFFFFF0, 2, False), (3, 0, -3, 4, 2, True)]
    page = spark.createDataFrame([(1, bytearray(at(20, p16=("i", 1), p4=("B", 1)) + at(48, p8=("q", 0), p20=("B", 9), p32=("q", 77))), {"leaf_entry.header": "20", "leaf_entry.count": "4:1", "leaf_entry.raw_channel": "20"})], "page_id long, data binary, layout map<string,string>")
    assert [(r.channel, r.data_offset) for r in decode.leaf_entries(page).collect()] == [(10, 77)]


def test_numbers_of_eight_bytes_and_missing_bytes(spark):
    row = spark.createDataFrame([(bytearray(struct.pack("<Qb", (1 << 64) - 5, -4)),)], "data binary")
    back = layouts.backwards(F.col("data"))
    n = lambda place, width, signed: layouts.number(back, F.lit(place), F.lit(width), F.lit(signed))
    assert tuple(row.select(n(0, 8, True), layouts.unsigned(n(0, 8, False)), n(8, 1, True), n(8, 1, False), n(8, 2, False), n(0, 4, True)).first()) == (-5, (1 << 64) - 5, -4, 252, None, -5)


def test_empty_tables_and_empty_bytes(spark):
    none = spark.createDataFrame([], "image_id long, size_bytes long, data binary")
    assert decode.block_entries(none, 4096).isEmpty() and decode.directory(none).isEmpty()
    odd = spark.createDataFrame([(1, 5, None), (2, 5, bytearray(b"DIDX")), (3, 5, bytearray())], "image_id long, size_bytes long, data binary")
    assert decode.block_entries(odd, 4096).isEmpty() and decode.directory(odd).isEmpty()
