"""Container walks against a walk byte by byte: any window, with and without resynchronising, giant and overlapping regions."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import containers
from tracelake.sources.images import FileImages

KINDS = containers.KINDS


def parse(data, at, end):
    """(kind, length, reason) of a part at a place."""
    d = data[at : min(end, at + 20)]
    if len(d) < 4:
        return None, None, "truncated"
    if d.startswith(b"OFNI"):
        if len(d) < 8:
            return "info", None, "truncated"
        n = int.from_bytes(d[4:8], "little", signed=True)
        return ("info", None, "length") if not 0 <= n <= 65536 else ("info", None, "beyond region") if n + 8 > end - at else ("info", n + 8, None)
    kind = KINDS.get(d[3])
    if kind is None:
        return None, None, "unknown stream"
    if kind == "pack":
        return (kind, None, "beyond region") if end - at < 20 else (kind, 20, None)
    if len(d) < 6:
        return kind, None, "truncated"
    n = int.from_bytes(d[4:6], "big") + 6
    if n > end - at:
        return kind, None, "beyond region"
    if len(d) >= 9 and (int.from_bytes(d[7:9], "big") & 0xFFF) + 9 >= n:
        return kind, None, "payload outside"
    return kind, n, None


def by_hand(data, begin, end, resync):
    end, at, out, before = min(end, len(data)), begin, [], begin
    while at < end:
        if data[at : at + 3] == b"\0\0\1" or data[at : at + 4] == b"OFNI":
            kind, length, reason = parse(data, at, end)
            if not resync and (reason or at != before):
                break
            out.append((at, kind, length, reason, at - before))
            before = at + (length or 0)
            if length:
                at += length
                continue
        elif not resync:
            break
        at = data.find(b"\0\0\1", at + 1)
        if at < 0:
            break
    return out


def made(seed, n):
    """Good parts ahead of random ones, damaged ones among them."""
    rng, out = random.Random(seed), (b"\0\0\1\xba" + bytes(16) + b"\0\0\1\xe0\0\5\x80\0\0\0\1" + b"OFNI\1\0\0\0z") * (seed + 1)
    for _ in range(n):
        body = bytes(rng.choice([0, 0, 1, 0x4F, 0xE0]) for _ in range(rng.randrange(12)))
        what = rng.randrange(6)
        if what == 0:
            out += b"\0\0\1\xba" + bytes(rng.randrange(256) for _ in range(16))
        elif what == 1:
            out += b"OFNI" + rng.choice([len(body), -1, 1 << 20, len(body)]).to_bytes(4, "little", signed=True) + body
        elif what == 2:
            out += body
        else:
            out += b"\0\0\1" + rng.choice([0xE0, 0xC0, 0xBD, 0xF9]).to_bytes(1) + (len(body) + 3 + rng.choice([0, 0, 0, 30])).to_bytes(2, "big") + b"\x80\x00\x00" + body
    return out


@pytest.mark.parametrize("bin_bytes", [64, 1 << 20])
def test_against_by_hand(spark, monkeypatch, bin_bytes):
    monkeypatch.setattr(containers, "BIN", bin_bytes)
    monkeypatch.setattr(containers.reached_before, "__defaults__", (bin_bytes,))
    data = {i: made(i, 60) for i in range(3)}
    regions = [(i, r, lo, n) for i, d in data.items() for r, (lo, n) in enumerate([(0, len(d)), (0, len(d) + 500), (7, 200), (200, 400), (len(d) - 2, 2), (5, 0), (len(d) + 9, 5)])]
    rows = spark.createDataFrame([(i, 0, bytearray(d)) for i, d in data.items()], "image_id long, start long, data binary")
    wanted = spark.createDataFrame([*regions, (0, None, 0, 5), (9, 1, 0, 5)], "image_id long, region_id int, offset long, length long")
    for window, resync in ((64, True), (1000, False), (1 << 20, True)):
        got = {}
        for r in containers.walk_containers(FileImages.written(rows, window), wanted, window, resync).orderBy("offset").collect():
            got.setdefault((r.image_id, r.region_id), []).append((r.offset, r.kind, r.length, r.rejected, r.skipped))
        want = {(i, r): w for i, r, lo, n in regions if (w := by_hand(data[i], lo, lo + n, resync))}
        assert got == want and max(map(len, want.values())) > 6 and len(want) >= (12 if resync else 6)


def test_table_of_windows_and_payloads(spark):
    data = b"\0\0\1\xba" + bytes(12) + b"\0\0\1\2" + b"\0\0\1\xe1\0\x0a\x80\x00\x02\xaa\xaaBBBBB" + b"OFNI\3\0\0\0xyz"
    rows = [(1, at, min(16, len(data) - at), bytearray(data[at : at + 16])) for at in range(0, len(data), 16)]
    chunks = spark.createDataFrame(rows, "image_id long, base_offset long, owned_len long, data binary")
    regions = spark.createDataFrame([(1, "a", 0, 1 << 40)], "image_id long, region_id string, offset long, length long")
    found = containers.walk_containers(chunks, regions, 16).orderBy("offset").collect()
    assert [(r.offset, r.kind, r.length, r.serial, r.payload_offset, r.payload_length, r.rejected) for r in found][:2] == [(0, "pack", 20, 258, None, None, None), (20, "video-1", 16, None, 31, 5, None)]
    assert found[2].kind == "info" and (found[2].offset, found[2].payload_length) == (36, 3)
    assert containers.walk_containers(chunks.limit(0), regions.where(F.lit(False)), 16).count() == 0
