"""Queries of headers, unit indexes and whole frames: bytes are packed from the given tables, written to files and decoded."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import containers as X
from ..operators import frames as M
from ..operators import headers as H
from ..operators import units as U
from .q_decode import WINDOW, filled, on_files, pack
from .registry import query
from .views import table


@query("x10_described_frames", """WITH f AS (SELECT o_orderkey AS k, o_orderkey % 6 AS c, o_orderkey % 5 AS n, o_orderkey % 17 = 0 AS bad, [0, 8, 12, 3, 3, 12][o_orderkey % 6 + 1] AS e FROM orders),
p AS (SELECT *, nullif(concat_ws(', ', CASE WHEN n = 0 AND k % 4 < 3 THEN 'no payload' END, CASE WHEN c = 3 THEN 'unknown tag' END, CASE WHEN c = 4 THEN 'cut record' END, CASE WHEN c = 1 AND k % 100 = 1 THEN 'no size' END, CASE WHEN k % 11 = 0 THEN 'no trailer' END, CASE WHEN k % 13 = 0 THEN 'back length' END, CASE WHEN k % 9 = 0 THEN 'no time' END), '') AS said FROM f)
SELECT k AS image_id, CASE WHEN NOT bad THEN 24 + e END::BIGINT AS payload_offset, CASE WHEN NOT bad THEN n END::BIGINT AS payload_length, k % 1000 AS sub_time, k % 256 AS checksum,
  CASE WHEN NOT bad THEN ['', '81,80', '82,81', '99', '82', '84,83'][c + 1] END AS tags, CASE WHEN bad THEN NULL WHEN c = 1 AND k % 100 <> 1 THEN 8 * (k % 100 - 1) WHEN c = 2 THEN k % 4000 + 1 END::INTEGER AS width,
  CASE WHEN bad THEN NULL WHEN c = 1 AND k % 100 <> 1 THEN 360 WHEN c = 2 THEN 1080 END::INTEGER AS height, CASE WHEN bad THEN NULL WHEN c = 1 THEN 'H.265' WHEN c = 2 THEN 'unrecognised-codec-id-0x07' END AS codec,
  CASE WHEN NOT bad AND c = 1 THEN 25 END::INTEGER AS frame_rate, CASE WHEN NOT bad THEN said END AS problems, CASE WHEN NOT bad THEN CASE WHEN said IS NULL THEN 'PASS' ELSE 'REVIEW' END END AS state, CASE WHEN bad THEN 'no room' END AS rejected FROM p""")  # fmt: skip
def x10c(spark, sf_dir):
    """A frame an image, with extra headers of six kinds; some that claim more extra header than they have room for."""
    k = F.col("o_orderkey")
    coarse = pack(b"\x81\0\x0c\x19\x80\0", ((k - 1) % 100, 1), (45, 1))
    exact = pack(b"\x82\0\0\0", (k % 4000 + 1, 2), (1080, 2), b"\x81\0\x07\0")
    extra = F.when(k % 6 == 0, F.lit(b"")).when(k % 6 == 1, coarse).when(k % 6 == 2, exact).when(k % 6 == 3, F.lit(b"\x99\1\2")).when(k % 6 == 4, F.lit(b"\x82\0\0")).otherwise(F.lit(b"\x84\0\0\0\x83" + bytes(7)))
    rows = table(spark, sf_dir, "orders").select(k, extra.alias("extra"))
    size = F.octet_length("extra")
    length = size + k % 5 + 32
    kind = F.when(k % 4 == 0, 0xFD).when(k % 4 == 1, 0xFC).when(k % 4 == 2, 0xF0).otherwise(0xF1)
    clock = F.when(k % 9 == 0, 0).otherwise((24 << 26) | (5 << 22) | (10 << 17) | (10 << 12))
    head = pack(b"DHAV", (kind, 1), (0, 1), (k % 8, 2), (k % 60, 4), (length, 4), (clock, 4), (k % 1000, 2), (F.when(k % 17 == 0, 200).otherwise(size), 1), (k % 256, 1))
    tail = pack(F.when(k % 11 == 0, F.lit(b"dhax")).otherwise(F.lit(b"dhav")), (length - F.when(k % 13 == 0, 7).otherwise(8), 4))
    found = M.carve_described(on_files(rows.select(k.alias("image_id"), F.concat(head, F.col("extra"), filled(k % 5), tail).alias("data"))), WINDOW, 1000)
    return found.select("image_id", "payload_offset", "payload_length", "sub_time", "checksum", F.array_join("tags", ",").alias("tags"), "width", "height", "codec", "frame_rate", "problems", "state", "rejected")


_UNITS = U.Units((("old", 16), ("new", 48)), 512, 96, 32, 20)


def unit_images(spark, sf_dir):
    """An image with one unit a part: five slots, some blank, empty headers, abnormal counts, indexes that the image cuts off."""
    k = F.col("p_partkey")
    base = F.when(k % 2 == 0, 16).otherwise(48)
    count = F.when(k % 23 == 0, 0).when(k % 19 == 0, 30).otherwise(k % 8)

    def slot(i):
        date = 2000 + k % 130 + (k + i) % 14 * (1 << 12) + (5 * i << 16) + (i << 21) + k % 60 * (1 << 26) + F.lit(i).cast("long") * (1 << 32)
        bits = (7 * k + i) % 1024 + (k + 3 * i) % 12 * 1024
        return F.when((k + i) % 7 == 0, F.lit(bytes(16))).otherwise(pack((date, 5), (bits, 3), bytes(8)))

    rows = table(spark, sf_dir, "part").select(k, filled(base).alias("head"), F.concat(pack((F.when(k % 23 == 0, 0).otherwise(k), 4), (count, 4), bytes(8)), *map(slot, range(1, 6))).alias("index"))
    data = F.when(k % 29 == 0, F.concat("head", F.expr("substring(index, 1, 50)"))).otherwise(F.concat("head", "index", filled(k % 10 * 32)))
    images = on_files(rows.select(k.alias("image_id"), data.alias("data")))
    return U.read_units(images, U.unit_places(images.sizes().withColumn("generation", F.when(F.col("image_id") % 2 == 0, "old").otherwise("new")), _UNITS), WINDOW, _UNITS)


_UNIT = """u AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 16 ELSE 48 END AS base, CASE WHEN p_partkey % 23 = 0 THEN 0 WHEN p_partkey % 19 = 0 THEN 30 ELSE p_partkey % 8 END AS c, CASE WHEN p_partkey % 29 = 0 THEN 2 ELSE 5 END AS room FROM part),
h AS (SELECT *, greatest(c - 1, 0) AS n, CASE WHEN k % 29 = 0 THEN base + 50 ELSE base + 96 + 32 * (k % 10) END AS size_bytes, CASE WHEN k % 23 = 0 THEN 'empty' WHEN c = 30 THEN 'abnormal' WHEN room < least(greatest(c - 1, 0), 5) THEN 'truncated' ELSE 'valid' END AS hs FROM u)"""


@query("x08_unit_headers", f"WITH {_UNIT} SELECT k AS image_id, 1 AS unit, CASE WHEN k % 23 > 0 THEN k ELSE 0 END AS write_bytes, c AS declared, n AS n_entries, room AS n_readable, hs AS header_state FROM h")
def x08b(spark, sf_dir):
    return U.unit_headers(unit_images(spark, sf_dir), _UNITS).select("image_id", "unit", "write_bytes", "declared", "n_entries", "n_readable", "header_state")


@query("x08_unit_index", f"""WITH {_UNIT}, e AS (SELECT *, unnest(range(1, 6)) AS i FROM h WHERE hs <> 'empty'), f AS (SELECT *, (k + i) % 7 = 0 AS blank, CASE WHEN (k + i) % 7 > 0 THEN (k + 3 * i) % 12 ELSE 0 END AS p, (k + i) % 14 BETWEEN 1 AND 12 AND (k + i) % 7 > 0 AS good FROM e WHERE i <= room),
g AS (SELECT *, CASE WHEN p < 3 THEN 'index' WHEN base + 32 * p + 32 > size_bytes THEN 'outside' ELSE 'data' END AS cls, CASE WHEN blank THEN 'Empty' WHEN NOT good THEN 'Invalid' WHEN 2000 + k % 130 > 2100 THEN 'Implausible' ELSE 'Valid' END AS ts FROM f),
s AS (SELECT *, CASE WHEN hs = 'abnormal' THEN CASE WHEN NOT blank THEN 'declared' END WHEN i <= n THEN 'declared' WHEN hs = 'valid' AND ts = 'Valid' AND cls = 'data' THEN 'residual' END AS standing FROM g)
SELECT k AS image_id, i AS entry, base + 16 * i AS entry_offset, ts AS time_state, CASE WHEN good THEN epoch(make_timestamp(2000 + k % 130, (k + i) % 14, 5 * i, i, k % 60, i))::BIGINT END AS instant, CASE WHEN blank THEN 0 ELSE (7 * k + i) % 1024 END AS field_a, p AS pointer, cls AS pointer_class, base + 32 * p AS data_offset, standing, good AND cls = 'data' AS usable FROM s WHERE standing IS NOT NULL""")  # fmt: skip
def x08c(spark, sf_dir):
    found = U.unit_index(unit_images(spark, sf_dir), _UNITS)
    return found.select("image_id", "entry", "entry_offset", "time_state", F.unix_seconds(F.col("time").cast("timestamp")).alias("instant"), "field_a", "pointer", "pointer_class", "data_offset", "standing", "usable")


_HEADER = replace(H.BOOT_HEADER, places=(8, 600), rules={**H.BOOT_HEADER.rules, "video_start": H.Rule("fallback", 400, inside=True, anchor=True)})


@query("x19_read_headers", """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN 5 WHEN p_partkey % 17 = 0 THEN 138 ELSE 1112 END AS size_bytes FROM part), q AS (SELECT *, CASE WHEN k % 8 > 1 AND size_bytes > 5 THEN 0 WHEN k % 8 = 0 AND size_bytes = 1112 THEN 1 END AS place FROM p),
r AS (SELECT *, CASE WHEN place IS NOT NULL THEN CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN -4 WHEN k % 5 = 2 THEN 5000 ELSE 77 END END AS v, CASE WHEN size_bytes = 1112 AND place IS NOT NULL THEN [0, 2097152, 5][k % 3 + 1] END AS b, CASE WHEN size_bytes = 1112 AND place IS NOT NULL THEN k % 7 + place END AS n, CASE WHEN size_bytes = 1112 AND place IS NOT NULL THEN [0, 1000000000, 200, 200][k % 4 + 1] END AS t, CASE WHEN size_bytes = 1112 AND place IS NOT NULL THEN k % 6 END AS tn, CASE WHEN size_bytes = 1112 AND place IS NOT NULL THEN CASE WHEN k % 11 = 0 THEN -1 ELSE k % 10 END END AS bt, CASE WHEN size_bytes = 1112 AND place IS NOT NULL THEN k % 3 END AS bn FROM q),
o AS (SELECT *, CASE WHEN v IS NULL THEN 'absent' WHEN v = 0 THEN CASE WHEN size_bytes > 400 THEN 'fallback' ELSE 'malformed' END WHEN v > 0 AND v < size_bytes THEN 'declared' ELSE 'malformed' END AS vo, CASE WHEN b IS NULL THEN 'absent' WHEN b = 0 THEN 'fallback' WHEN b > 1048576 THEN 'declared' ELSE 'malformed' END AS bo, CASE WHEN n IS NULL THEN 'absent' WHEN n = 0 THEN 'malformed' ELSE 'declared' END AS no,
  CASE WHEN t IS NULL OR t = 0 THEN 'absent' WHEN t < size_bytes THEN 'declared' ELSE 'malformed' END AS "to", CASE WHEN tn IS NULL OR tn = 0 THEN 'absent' ELSE 'declared' END AS tno, CASE WHEN bt IS NULL OR bt = 0 THEN 'absent' WHEN bt > 0 THEN 'declared' ELSE 'malformed' END AS bto FROM r),
m AS (SELECT *, CASE WHEN place IS NULL THEN CASE WHEN size_bytes > 5 THEN 'mismatch' ELSE 'not found' END WHEN vo IN ('declared', 'fallback') OR "to" = 'declared' OR bto = 'declared' THEN 'recognised' ELSE 'malformed' END AS recognition,
  CASE WHEN place IS NOT NULL THEN nullif(concat_ws(', ', CASE WHEN vo <> 'declared' THEN 'video_start ' || vo END, CASE WHEN bo <> 'declared' THEN 'block_size ' || bo END, CASE WHEN no <> 'declared' THEN 'blocks ' || no END, CASE WHEN "to" <> 'declared' THEN 'tree_offset ' || "to" END, CASE WHEN tno <> 'declared' THEN 'tree_size ' || tno END, CASE WHEN bto = 'malformed' THEN 'backup_tree_offset malformed' END), '') END AS problems FROM o)
SELECT k AS image_id, [8, 600][place + 1]::BIGINT AS header_offset, recognition, CASE WHEN recognition = 'malformed' THEN 'REVIEW' WHEN recognition <> 'recognised' THEN 'UNKNOWN' WHEN problems IS NULL THEN 'PASS' ELSE 'REVIEW' END AS state, problems, CASE vo WHEN 'declared' THEN v WHEN 'fallback' THEN 400 END::BIGINT AS video_start, vo AS video_start_origin, v::BIGINT AS video_start_raw,
  CASE bo WHEN 'declared' THEN b WHEN 'fallback' THEN 1073741824 END::BIGINT AS block_size, CASE WHEN no = 'declared' THEN n END::BIGINT AS blocks, CASE WHEN "to" = 'declared' THEN t END::BIGINT AS tree_offset, bto AS backup_tree_offset_origin, CASE WHEN bn > 0 THEN bn END::BIGINT AS backup_tree_size FROM m""")  # fmt: skip
def x19b(spark, sf_dir):
    """Headers at two places of each image, with a wrong identifier at the first or at both, values of zero, below and beyond, and images that end early."""
    k = F.col("p_partkey")
    video = F.when(k % 5 == 0, 0).when(k % 5 == 1, -4).when(k % 5 == 2, 5000).otherwise(77)
    block = F.when(k % 3 == 0, 0).when(k % 3 == 1, 1 << 21).otherwise(5)
    tree = F.when(k % 4 == 0, 0).when(k % 4 == 1, 1000000000).otherwise(200)
    backup = F.when(k % 11 == 0, -1).otherwise(k % 10)

    def header(good, more):
        sign = F.when(good, F.lit(_HEADER.identifier)).otherwise(F.lit(bytes(18)))
        return pack(bytes(16), sign, bytes(86), (video, 8), bytes(8), (block, 8), (k % 7 + more, 4), bytes(4), (tree, 8), (k % 6, 8), (backup, 8), (k % 3, 8), bytes(328))

    whole = F.concat(F.lit(bytes(8)), header(k % 8 > 1, 0), F.lit(bytes(80)), header(k % 8 != 1, 1))
    rows = table(spark, sf_dir, "part").select(k.alias("image_id"), whole.alias("data"))
    data = F.when(F.col("image_id") % 13 == 0, F.expr("substring(data, 1, 5)")).when(F.col("image_id") % 17 == 0, F.expr("substring(data, 1, 138)")).otherwise(F.col("data"))
    found = H.decode_headers(on_files(rows.select("image_id", data.alias("data"))), WINDOW, _HEADER)
    return found.select("image_id", "header_offset", "recognition", "state", "problems", "video_start", "video_start_origin", "video_start_raw", "block_size", "blocks", "tree_offset", "backup_tree_offset_origin", "backup_tree_size")


def containers(spark, sf_dir):
    """A container for each row of part: a pack, an information part, video, junk, an unknown stream, audio that may be too long, and a system part."""
    k = F.col("p_partkey")
    be = lambda value, size: F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))
    little = F.lit(b"\x80\0\0\xaa")
    body = k % 40
    data = F.concat(
        F.lit(b"\0\0\1\xba" + b"\xaa" * 12), be(k, 4), F.lit(b"OFNI"), pack((k % 30, 4)), filled(k % 30),
        F.lit(b"\0\0\1\xe0"), be(body + 3, 2), F.lit(b"\x80"), be(0xA000 + k % 5, 2), filled(body), filled(F.when(k % 3 == 0, 3).otherwise(0)),
        F.when(k % 4 == 0, F.lit(b"\0\0\1\xf9\xaa\xaa\xaa\xaa")).otherwise(F.lit(b"")), F.lit(b"\0\0\1\xc0"), be(F.when(k % 7 == 0, 60000).otherwise(4), 2), little, F.lit(b"\0\0\1\xbb\0\4"), little)
    images = on_files(table(spark, sf_dir, "part").select(k.alias("image_id"), data.alias("data")))
    return images, images.sizes().select("image_id", F.lit(1).alias("region_id"), F.lit(0).alias("offset"), F.col("size_bytes").alias("length"))


_WALK = """p AS (SELECT p_partkey AS k, p_partkey % 30 AS o, p_partkey % 40 AS b, 37 + p_partkey % 30 + p_partkey % 40 + CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END AS f FROM part), q AS (SELECT *, f + CASE WHEN k % 4 = 0 THEN 8 ELSE 0 END AS a FROM p),
w AS (SELECT k, 0 AS "offset", 'pack' AS kind, 20 AS length, k AS serial, NULL AS payload_offset, NULL AS payload_length, NULL AS rejected FROM q UNION ALL SELECT k, 20, 'info', 8 + o, NULL, CASE WHEN o > 0 THEN 28 END, CASE WHEN o > 0 THEN o END, NULL FROM q
UNION ALL SELECT k, 28 + o, 'video-0', CASE WHEN k % 5 < b THEN 9 + b END, NULL, CASE WHEN k % 5 < b THEN 28 + o + 9 + k % 5 END, CASE WHEN k % 5 < b THEN b - k % 5 END, CASE WHEN k % 5 >= b THEN 'payload outside' END FROM q
UNION ALL SELECT k, f, NULL, NULL, NULL, NULL, NULL, 'unknown stream' FROM q WHERE k % 4 = 0 UNION ALL SELECT k, a, 'audio', CASE WHEN k % 7 > 0 THEN 10 END, NULL, CASE WHEN k % 7 > 0 THEN a + 9 END, CASE WHEN k % 7 > 0 THEN 1 END, CASE WHEN k % 7 = 0 THEN 'beyond region' END FROM q UNION ALL SELECT k, a + 10, 'system', 10, NULL, a + 19, 1, NULL FROM q),
x AS (SELECT *, "offset" - coalesce(lag("offset" + coalesce(length, 0)) OVER (PARTITION BY k ORDER BY "offset"), 0) AS skipped FROM w)"""


@query("x11_walk_containers", f"""WITH {_WALK} SELECT k AS image_id, "offset", kind, length::BIGINT AS length, serial, payload_offset::BIGINT AS payload_offset, payload_length::BIGINT AS payload_length, rejected, skipped FROM x""")
def x11b(spark, sf_dir):
    return X.walk_containers(*containers(spark, sf_dir), WINDOW).drop("region_id")


@query("x11_contiguous", f"""WITH {_WALK}, y AS (SELECT *, count(*) FILTER (rejected IS NOT NULL OR skipped > 0) OVER (PARTITION BY k ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS broken FROM x) SELECT k AS image_id, "offset", kind, length::BIGINT AS length FROM y WHERE broken = 0""")
def x11c(spark, sf_dir):
    return X.walk_containers(*containers(spark, sf_dir), WINDOW, resync=False).select("image_id", "offset", "kind", "length")
