"""Frames, unit indexes and headers written byte by byte at their real places."""

import struct

import pytest
from pyspark.sql import functions as F

from tracelake.operators import frames, headers, units
from tracelake.sources.images import FileImages

CLOCK = 26 << 26 | 3 << 22 | 9 << 17 | 10 << 12 | 11 << 6 | 12


def on_disk(spark, pieces):
    """Images by {image_id: [(start, bytes)]}."""
    rows = [(i, at, bytearray(d)) for i, parts in pieces.items() for at, d in parts]
    return FileImages.written(spark.createDataFrame(rows, "image_id long, start long, data binary"), 64)


def frame(extra=b"", payload=b"abc", kind=0xFD, clock=CLOCK, back=None, trailer=b"dhav", declared=None, room=None):
    total = 24 + len(extra) + len(payload) + 8
    head = struct.pack("<4sBBHIiIHBB", b"DHAV", kind, 0, 3, 7, declared or total, clock, 500, len(extra) if room is None else room, 0xAB)
    return head + extra + payload + trailer + struct.pack("<I", total - 8 if back is None else back)


def read(spark, data):
    b = spark.createDataFrame([(bytearray(data) if data is not None else None,)], "d binary")
    return b.select(frames.extra_header(F.col("d")).alias("x")).select("x.*").first()


def test_extra_header_walk(spark):
    none = (None, None, None, None)
    assert tuple(read(spark, b"\x80\0\x50\x2d\x81\0\x0c\x19")) == ([0x80, 0x81], 640, 360, 12, 25, None)
    assert tuple(read(spark, b"\x80\0\x50\x2d\x82\0\0\0" + struct.pack("<HH", 1920, 1080))) == ([0x80, 0x82], 1920, 1080, None, None, None)
    assert tuple(read(spark, b"\x81\0\x02\0\xb3" + bytes(7) + b"\xb4\0\0\0")) == ([0x81, 0xB3, 0xB4], None, None, 2, None, None)
    assert tuple(read(spark, b"\x81\0\x02\x05\x77\x80\0\x50\x2d")) == ([0x81, 0x77], None, None, 2, 5, "unknown tag")
    assert tuple(read(spark, b"\x88\0\0\0\0\0\0")) == ([0x88], *none, "cut record")
    assert tuple(read(spark, b"\x80\0\x50")) == ([0x80], *none, "cut record")
    assert tuple(read(spark, b"")) == tuple(read(spark, None)) == ([], *none, None)
    most = b"\x84\0\0\0" * 62 + b"\x80\0\x01\x02" + b"\x99\0\0"
    assert read(spark, most).width == 8 and len(read(spark, most).tags) == 64 and read(spark, most).problem == "unknown tag"


def test_frames_are_described(spark):
    made = [
        frame(b"\x81\0\x0c\x19"), frame(back=35), frame(trailer=b"nope"), frame(clock=0), frame(payload=b""), frame(payload=b"", kind=0xF1),
        frame(kind=5), frame(room=200), frame(declared=1 << 20), frame(payload=frame()),
    ]
    found = frames.carve_described(on_disk(spark, {1: [(0, b"..".join(made))]}), 64, 100).orderBy("offset").collect()
    starts = [sum(len(m) + 2 for m in made[:k]) for k in range(len(made))]
    by = {r.offset: r for r in found}
    assert sorted(by) == sorted([*starts, starts[-1] + 24])
    got = [(by[s].rejected, by[s].state, by[s].problems) for s in starts]
    assert got == [
        (None, "PASS", None), (None, "REVIEW", "back length"), (None, "REVIEW", "no trailer"), (None, "REVIEW", "no time"), (None, "REVIEW", "no payload"), (None, "PASS", None),
        (None, "REVIEW", "unknown type"), ("no room", None, None), ("past end", None, None), (None, "PASS", None),
    ]
    assert by[starts[-1] + 24].rejected == "inside a frame"
    first = by[0]
    assert (first.codec, first.frame_rate, first.payload_offset, first.payload_length, first.sub_time, first.checksum, first.tags) == ("H.265", 25, 28, 3, 500, 0xAB, ["81"])
    assert str(first.time) == "2026-03-09 10:11:12"


def entry(year, month, day, hour, minute, second, field, pointer):
    """An entry by the bytes that the fields cross."""
    b = [year & 255, year >> 8 | month << 4, day | (hour & 7) << 5, hour >> 3 | minute << 2, second, field & 255, field >> 8 | (pointer & 63) << 2, pointer >> 6]
    return bytes(b) + bytes(8)


@pytest.mark.parametrize("generation, base", [("old", 0x14000), ("new", 0x10014000)])
def test_unit_index(spark, generation, base):
    body = struct.pack("<iI8s", -5, 4, b"") + entry(2024, 5, 31, 23, 59, 58, 1023, 16) + entry(1999, 1, 1, 0, 0, 0, 1, 15) + entry(2024, 13, 1, 0, 0, 0, 0, 16383) + entry(2025, 2, 28, 1, 2, 3, 512, 17) + bytes(16) + entry(2025, 2, 30, 0, 0, 0, 0, 17)
    images = on_disk(spark, {1: [(base, body + bytes(0x40000 + 2 * 0x4000 - len(body)))]})
    sized = images.sizes().withColumn("generation", F.lit(generation))
    places = units.unit_places(sized)
    assert [tuple(r) for r in places.select("unit", "base").collect()] == [(1, base)]
    indexes = units.read_units(images, places, 64)
    head = units.unit_headers(indexes).first()
    assert (head.write_bytes, head.declared, head.n_entries, head.n_readable, head.header_state) == (-5, 4, 3, 16383, "valid")
    got = units.unit_index(indexes).orderBy("entry").collect()
    assert [(r.entry, r.field_a, r.pointer, r.pointer_class, r.time_state, r.standing, r.usable) for r in got] == [
        (1, 1023, 16, "data", "Valid", "declared", True), (2, 1, 15, "index", "Implausible", "declared", False),
        (3, 0, 16383, "outside", "Invalid", "declared", False), (4, 512, 17, "data", "Valid", "residual", True),
    ]
    assert str(got[0].time) == "2024-05-31 23:59:58" and got[0].data_offset == base + 16 * 0x4000 and got[0].entry_offset == base + 16
    # as an export counts, all four are declared
    assert units.unit_index(indexes, counts_header=False).where("standing = 'declared'").count() == 4


def test_unit_states(spark):
    small = units.Units((("old", 0),), 1 << 20, 64, 16, 9)
    rows = [(1, None), (2, b""), (3, b"\1"), (4, bytes(64)), (5, struct.pack("<II", 1, 10) + bytes(24) + b"\1" * 32), (6, struct.pack("<II", 1, 4) + bytes(24)), (7, struct.pack("<II", 1, 0) + bytes(56))]
    indexes = spark.createDataFrame([(i, 1, 0, 64, bytearray(d) if d is not None else None) for i, d in rows], "image_id long, unit long, base long, size_bytes long, data binary")
    assert {r.image_id: r.header_state for r in units.unit_headers(indexes, small).collect()} == {1: "absent", 2: "absent", 3: "truncated", 4: "empty", 5: "abnormal", 6: "truncated", 7: "valid"}
    assert {(r.image_id, r.entry) for r in units.unit_index(indexes, small).collect()} == {(5, 2), (5, 3), (6, 1)}
    moved = indexes.where("image_id = 5").withColumn("layout", F.create_map(F.lit("unit_entry.bits"), F.lit("6:2")))
    assert [r.pointer for r in units.unit_index(moved, small).collect()] == [0, 0]
    assert units.unit_places(spark.createDataFrame([(1, "old", 10), (2, "other", 10)], "image_id long, generation string, size_bytes long"), small).count() == 1


def boot(**fields):
    out = bytearray(512)
    out[16:48] = b"HIKVISION@HANGZHOU".ljust(32, b"x")
    for name, (form, value) in fields.items():
        struct.pack_into("<" + form, out, int(name[1:]), value)
    return bytes(out)


def test_headers(spark):
    good = boot(p120=("q", 4096), p136=("q", 1 << 21), p144=("i", 9), p152=("q", 2048), p160=("q", 77))
    images = on_disk(spark, {
        1: [(0, bytes(512) + good + bytes(8192))],
        2: [(0, bytes(2048)), (80044032, boot(p120=("q", 0), p144=("i", -1), p152=("q", -8), p160=("q", 1)) + bytes(80000))],
        3: [(0, bytes(4096))], 4: [(0, bytes(530))], 5: [(0, bytes(512) + boot() + bytes(9))], 6: [(0, bytes(512) + good[:150])],
    })
    by = {r.image_id: r for r in headers.decode_headers(images, 64).collect()}
    assert [(by[i].recognition, by[i].state, by[i].header_offset) for i in range(1, 7)] == [("recognised", "PASS", 512), ("recognised", "REVIEW", 80044032), ("mismatch", "UNKNOWN", None), ("not found", "UNKNOWN", None), ("malformed", "REVIEW", 512), ("malformed", "REVIEW", 512)]
    assert (by[1].video_start, by[1].block_size, by[1].blocks, by[1].tree_offset, by[1].tree_size, by[1].backup_tree_offset, by[1].problems) == (4096, 1 << 21, 9, 2048, 77, None, None)
    assert (by[2].video_start, by[2].video_start_origin, by[2].block_size, by[2].blocks, by[2].blocks_raw, by[2].tree_offset_origin) == (80117760, "fallback", 1 << 30, None, -1, "malformed")
    assert by[2].problems == "video_start fallback, block_size fallback, blocks malformed, tree_offset malformed"
    # the image ends inside the header: what lies behind is absent, what is declared lies behind the image
    assert (by[6].video_start_origin, by[6].block_size_origin, by[6].blocks_origin, by[6].tree_offset_origin) == ("malformed", "declared", "declared", "absent")
    moved = spark.createDataFrame([(1, {"boot_header.video_start": "152:8:signed"})], "image_id long, layout map<string,string>")
    assert headers.decode_headers(images, 64, layouts=moved).where("image_id = 1").first().video_start == 2048
