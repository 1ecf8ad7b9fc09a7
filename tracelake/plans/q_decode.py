"""Queries of byte decoders: bytes are packed from the given tables, written to files where they are images, and decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as B
from ..operators import decode as C
from ..operators import ranges as R
from ..operators import records as E
from ..sources.images import FileImages
from .registry import query
from .views import table

WINDOW = 64


def pack(*parts):
    """Numbers as (value, bytes) pairs and bytes as they are, one behind the other."""
    lit = lambda x: x if not isinstance(x, bytes) else F.lit(x)
    return F.concat(*[B.le_bytes(p[0] if not isinstance(p[0], int) else F.lit(p[0]), p[1]) if isinstance(p, tuple) else lit(p) for p in parts])


def filled(n, byte="78"):
    return F.unhex(F.repeat(F.lit(byte), n.cast("int")))


def packed(n, part):
    """``part(i)`` for i from 0 to below ``n``, one behind the other: one expression for all, so that the code stays small enough to be compiled."""
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.hex(part(i))), ""))


def made(data):
    """Bytes that are packed once, like bytes that are read: what isn't deterministic is not packed again for each filter over it, nor ahead of an exchange."""
    return F.when(F.spark_partition_id() >= 0, data)


def dealt(spark, sf_dir, name):
    """Rows of a table dealt out by their key over all tasks, as a row makes many times the bytes that it has."""
    rows = table(spark, sf_dir, name)
    return R.dealt(rows, rows.columns[0])


def on_files(rows, window=WINDOW):
    """Images (image_id, data, maybe start for pieces) in files, to be read in windows."""
    start = F.col("start") if "start" in rows.columns else F.lit(0)
    return FileImages.written(rows.select("image_id", start.alias("start"), "data"), window)


@query("x03_read_pointers", """WITH h AS (SELECT o_orderkey AS image_id, o_orderkey % 90 + 12 AS pointer, o_orderkey % 4 > 0 AS ok FROM orders), b AS (SELECT *, unnest([1, 2]) AS hit_id FROM h)
SELECT image_id, hit_id, CASE WHEN hit_id = 2 AND image_id % 5 = 0 THEN 500 ELSE pointer END AS pointer, CASE WHEN hit_id = 2 AND image_id % 5 = 0 THEN 'out of image' WHEN ok THEN 'match' ELSE 'mismatch' END AS status, CASE WHEN hit_id = 1 AND ok THEN 0.5 ELSE 0 END::DOUBLE AS weight FROM b""")
def x03b(spark, sf_dir):
    """Two pointers at the head of each image, to the same place or, the second one, out of the image."""
    k = F.col("o_orderkey")
    far = F.when(k % 5 == 0, 500).otherwise(k % 90 + 12)
    data = pack((k % 90 + 12, 6), (far, 6), filled(k % 90), F.when(k % 4 > 0, F.lit(b"MAGIC")).otherwise(F.lit(b"magic")), bytes(200))
    chunks = on_files(dealt(spark, sf_dir, "orders").select(k.alias("image_id"), F.substring(data, 1, 200).alias("data")))
    hits = dealt(spark, sf_dir, "orders").select(k.alias("image_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("hit_id")).select("image_id", "hit_id", ((F.col("hit_id") - 1) * 6).cast("long").alias("offset"), F.lit(0.5).alias("weight"))
    return C.read_pointers(hits, chunks, b"MAGIC", WINDOW)


@query("x05_block_entries", """WITH e AS (SELECT p_partkey AS image_id, p_size AS s, unnest(range(3)) AS entry FROM part), f AS (SELECT *, (image_id + entry) % 5 = 0 AS empty, entry * 4096 AS lo, CASE WHEN entry < 2 THEN 4096 ELSE least(s * 512, 4096) END AS own FROM e), g AS (SELECT *, least(lo + own, 10000) - lo AS cut FROM f),
h AS (SELECT *, nullif(concat_ws(', ', CASE WHEN (image_id + entry) % 7 = 0 THEN 'previous' END, CASE WHEN entry = 2 AND s * 512 > 4096 THEN 'too many sectors' END, CASE WHEN cut < own THEN 'cut by the image''s end' END), '') AS p FROM g)
SELECT image_id, entry, CASE WHEN empty THEN 'Empty' WHEN p IS NOT NULL THEN 'Malformed' ELSE 'Occupied' END AS state, CASE WHEN NOT empty THEN p END AS problems, CASE WHEN image_id % 3 = 0 THEN image_id % 32 ELSE image_id % 16 + 1 END AS channel, CASE WHEN entry < 2 THEN entry + 1 ELSE 0 END AS next, CASE WHEN NOT empty THEN lo END AS "offset", CASE WHEN NOT empty THEN cut END AS length FROM h""")
def x05b(spark, sf_dir):
    """Block tables of three entries; the last one's next block is 0 or -1."""
    k, s = F.col("p_partkey"), F.col("p_size")

    def entry(i):
        after = F.when(k % 2 == 0, -1).otherwise(0) if i == 2 else F.lit(i + 1)
        kind, before = F.when((k + i) % 5 == 0, 0xFE).otherwise(1), F.when((k + i) % 7 == 0, -5).otherwise(0)
        return pack((kind, 1), (k % 16, 1), bytes(2), (1000, 4), (1060, 4), (after, 4), (s, 2), bytes(2), (before, 4), (0, 4), bytes(1), (F.when(k % 3 == 0, 1).otherwise(0), 1), bytes(1), (k % 64, 1))

    rows = table(spark, sf_dir, "part").select(k.alias("image_id"), F.lit(10000).cast("long").alias("size_bytes"), F.concat(*map(entry, range(3))).alias("data"))
    return C.block_entries(rows, 4096).select("image_id", "entry", "state", "problems", "channel", "next", "offset", "length")


@query("x06_leaf_entries", """WITH e AS (SELECT p_partkey AS page_id, p_size AS declared, unnest(range(0, least(p_size, 10))) AS entry FROM part), f AS (SELECT *, CASE WHEN (page_id + entry) % 5 = 0 THEN 'blank' WHEN (page_id + entry) % 7 = 0 THEN 'malformed' ELSE 'populated' END AS state, (page_id + entry) % 11 = 0 AS other, (page_id + entry) % 13 = 0 AS turned FROM e)
SELECT page_id, entry, state, CASE WHEN state = 'populated' THEN page_id * 4096 + entry END AS data_offset, CASE WHEN state = 'populated' THEN entry + 1 END AS channel, CASE WHEN state = 'populated' THEN 1700000000 END AS start, CASE WHEN state = 'populated' THEN nullif(concat_ws(', ', CASE WHEN turned THEN 'end before start' END, CASE WHEN other THEN 'other page' END), '') END AS notes, declared > 10 AS truncated FROM f""")
def x06b(spark, sf_dir):
    """Pages of a header and ten entries, cut off behind them, packed from part."""
    k, n = F.col("p_partkey"), F.col("p_size")

    def entry(i):
        x = k + i
        sentinel = F.when(x % 5 == 0, -1).when(x % 7 == 0, 77).otherwise(0)
        return pack((F.when(x % 11 == 0, k + 1).otherwise(k), 8), (sentinel, 8), bytes(1), (i, 1), bytes(6), (1_700_000_000, 4), (F.when(x % 13 == 0, 1_600_000_000).otherwise(1_700_000_060), 4), (k * 4096 + i, 8), bytes(8))

    data = pack(bytes(16), (n, 4), bytes(76), packed(10, entry))
    pages = dealt(spark, sf_dir, "part").select(k.alias("page_id"), k.alias("page_offset"), made(data).alias("data"))
    return C.leaf_entries(pages).select("page_id", "entry", "state", "data_offset", "channel", "start", "notes", "truncated")


@query("x07_footer_slots", """WITH e AS (SELECT p_partkey AS block_id, unnest(range(p_size % 6)) AS slot FROM part WHERE p_size % 6 < 5 AND p_partkey % 9 > 0), f AS (SELECT *, block_id + slot AS x FROM e), g AS (SELECT *, CASE WHEN x % 10 > 0 OR x % 20 = 0 THEN 1700000000 + x END AS start FROM f)
SELECT block_id, slot, CASE WHEN x % 7 = 0 THEN 'unknown channel' WHEN x % 11 = 0 THEN 'no end time' WHEN x % 13 = 0 AND start IS NOT NULL THEN 'span' WHEN x % 17 = 0 THEN 'empty range' WHEN x % 19 = 0 THEN 'beyond block' END AS rejected, start, x % 20 = 0 AS from_fallback FROM g""")
def x07b(spark, sf_dir):
    """Footers of a header and four slots; some declare five or carry the marker, so they have none."""
    k, n = F.col("p_partkey"), F.col("p_size")

    def slot(i):
        x = k + i
        at = x + 1_700_000_000
        end = F.when(x % 11 == 0, 0).when(x % 13 == 0, at - 1).otherwise(at + 60)
        last = F.when(x % 17 == 0, 4096).when(x % 19 == 0, 2_000_000).otherwise(8192)
        return pack(bytes(13), (F.when(x % 7 == 0, 200).otherwise(x % 16), 1), bytes(26), (F.when(x % 20 == 0, at).otherwise(0), 4), bytes(4), (end, 4), bytes(4), (F.when(x % 10 == 0, 0).otherwise(at), 4), bytes(12), (4096, 4), (last, 4), bytes(432))

    data = pack(bytes(13), (F.when(k % 9 == 0, 255).otherwise(0), 1), bytes(6), (n % 6, 2), bytes(490), packed(4, slot))
    slots = C.footer_slots(dealt(spark, sf_dir, "part").select(k.alias("block_id"), made(data).alias("data")))
    return E.clip_slots(slots, 1 << 20).select("block_id", F.col("entry").alias("slot"), "rejected", "start", "from_fallback")


@query("x09_boot_record", """WITH e AS (SELECT o_orderkey AS image_id, unnest(range(4)) AS slot FROM orders WHERE o_orderkey % 23 > 0), f AS (SELECT *, CASE WHEN (image_id + slot) % 5 = 0 THEN 0 ELSE 7 END AS type, (image_id + slot) % 9 * 100 AS lba, CASE WHEN (image_id + slot) % 7 = 0 THEN 0 ELSE 5000 END AS n FROM e),
g AS (SELECT *, CASE WHEN type = 0 THEN CASE WHEN lba <> 0 OR n <> 0 THEN 'unused with geometry' END WHEN n = 0 THEN 'zero length' WHEN (lba + n) * 512 > 2800000 THEN 'out of bounds' END AS finding, type <> 0 AND n > 0 AS there FROM f)
SELECT image_id, slot::INTEGER AS slot, finding, CASE WHEN there THEN lba * 512 END AS "offset", CASE WHEN there THEN least((lba + n) * 512, 2800000) - lba * 512 END AS length, there AND finding IS NULL AS candidate FROM g""")
def x09b(spark, sf_dir):
    """Boot records; those of every 23rd image lack the mark at their end."""
    k = F.col("o_orderkey")

    def slot(i):
        x = k + i
        return pack(bytes(4), (F.when(x % 5 == 0, 0).otherwise(7), 1), bytes(3), (x % 9 * 100, 4), (F.when(x % 7 == 0, 0).otherwise(5000), 4))

    mark = F.when(k % 23 > 0, F.lit(b"\x55\xaa")).otherwise(F.lit(bytes(2)))
    rows = table(spark, sf_dir, "orders").select(k.alias("image_id"), F.lit(2800000).cast("long").alias("size_bytes"), pack(bytes(446), *map(slot, range(4)), mark).alias("data"))
    return E.partition_entries(C.boot_entries(rows)).drop("severity")


@query("x10_tagged_frames", """WITH f AS (SELECT o_orderkey AS image_id, o_orderkey % 5 AS "offset", 32 + o_orderkey % 70 AS length, o_orderkey % 8 AS channel, CASE o_orderkey % 3 WHEN 0 THEN 'video-key-frame' WHEN 1 THEN 'audio-frame' ELSE 'unrecognised-type-0x01' END AS kind FROM orders)
SELECT *, CASE WHEN image_id % 17 = 0 THEN 'past end' WHEN image_id % 11 = 0 THEN 'no trailer' WHEN image_id % 13 = 0 THEN 'back length' END AS rejected FROM f""")
def x10b(spark, sf_dir):
    """A frame behind some bytes of each image, with a wrong trailer, a wrong back-length or a cut end in some."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, 0xFD).when(k % 3 == 1, 0xF0).otherwise(1)
    length = k % 70 + 32
    frame = pack(b"DHAV", (kind, 1), (0, 1), (k % 8, 2), (k, 4), (length, 4), bytes(8), filled(k % 70), F.when(k % 11 == 0, F.lit(b"dhax")).otherwise(F.lit(b"dhav")), (F.when(k % 13 == 0, length - 7).otherwise(length - 8), 4))
    data = F.concat(filled(k % 5), F.when(k % 17 == 0, F.expr("substring(f, 1, octet_length(f) - 3)")).otherwise(F.col("f")))
    images = dealt(spark, sf_dir, "orders").select(k.alias("image_id"), k, frame.alias("f")).select("image_id", data.alias("data"))
    return E.carve_frames(C.tagged_frames(on_files(images), WINDOW), 1000).select("image_id", "offset", "length", F.col("raw_channel").alias("channel"), "kind", "rejected")


@query("x13_start_codes", """SELECT p_partkey AS image_id, 0 AS run, 10 * (p_partkey % 9) AS last, p_partkey % 9 + 1 AS n_units, CASE WHEN p_partkey % 2 = 0 THEN 'H264' ELSE 'H265' END AS codec FROM part WHERE p_partkey % 9 > 0""")
def x13b(spark, sf_dir):
    """Streams of one to nine units: a parameter set, then key frames; a single unit is no run."""
    k = F.col("p_partkey")
    first, rest = F.when(k % 2 == 0, F.lit("67")).otherwise(F.lit("40")), F.when(k % 2 == 0, F.lit("65")).otherwise(F.lit("26"))
    fill = F.lit("AAAAAAAAAAAA")
    data = F.unhex(F.concat(F.lit("000001"), first, fill, F.repeat(F.concat(F.lit("000001"), rest, fill), (k % 9).cast("int"))))
    return C.carve_streams(on_files(dealt(spark, sf_dir, "part").select(k.alias("image_id"), data.alias("data"))), WINDOW)


@query("x16_decoded_records", """SELECT o_orderkey AS image_id, o_orderkey % 100 AS "offset", (o_orderkey % 16)::INTEGER AS channel, o_orderkey * 4294967296 + 7 AS time, CASE WHEN o_orderkey % 3 > 0 THEN 'H.265' END AS codec, o_custkey AS frames, 'cam ' || o_orderkey AS description FROM orders WHERE o_orderkey % 10 > 0""")
def x16b(spark, sf_dir):
    """A record behind some bytes of each image, cut off in every tenth."""
    k = F.col("o_orderkey")
    codec = F.when(k % 3 > 0, F.lit(b"H.265" + bytes(11))).otherwise(F.lit(bytes(16)))
    name = F.substring(F.concat(F.concat(F.lit("cam "), k.cast("string")).cast("binary"), F.lit(bytes(16))), 1, 16)
    record = pack(b"TPREC\1\0", (k % 16, 1), (F.lit(7), 4), (k, 4), codec, bytes(8), (F.col("o_custkey"), 4), bytes(4), name)
    data = F.concat(filled(k % 100), F.when(k % 10 == 0, F.substring(F.col("r"), 1, 60)).otherwise(F.col("r")))
    images = dealt(spark, sf_dir, "orders").select(k.alias("image_id"), k, record.alias("r")).select("image_id", data.alias("data"))
    return C.stream_records(on_files(images), WINDOW).withColumn("time", F.col("time").cast("long"))


@query("x17_frame_references", """WITH e AS (SELECT p_partkey AS clip_id, p_size % 4 AS n, unnest(range(9)) AS k FROM part WHERE p_partkey % 9 > 0), f AS (SELECT clip_id, CASE WHEN k < 6 THEN 0 ELSE 1 END AS "array", CASE WHEN k < 6 THEN k ELSE k - 6 END AS entry, clip_id + k AS x FROM e WHERE k < 6 OR k - 6 < n AND clip_id % 6 > 0), g AS (SELECT *, CASE WHEN x % 23 = 0 THEN 4294967295 ELSE x % 1000 * 50 END AS o FROM f)
SELECT clip_id, "array", CASE WHEN "array" = 0 THEN 1 ELSE 3 END AS kind, entry, CASE WHEN x % 23 = 0 THEN 'sentinel' WHEN x % 29 = 0 THEN 'no length' WHEN o + 100 > 40000 THEN 'past clip' WHEN o + 100 > 39000 AND o < 39144 THEN 'overlaps index' END AS rejected FROM g""")
def x17b(spark, sf_dir):
    """Indexes of two arrays of references; of every sixth clip the second lies outside of the index; every ninth lacks the tag."""
    k = F.col("p_partkey")

    def entry(i):
        x = k + i
        return pack((F.when(x % 23 == 0, F.lit(0xFFFFFFFF)).otherwise(x % 1000 * 50), 4), (F.when(x % 29 == 0, 0).otherwise(100), 4), bytes(4))

    arrays = pack((1, 4), (39036, 4), (72, 4), (3, 4), (F.when(k % 6 == 0, 100).otherwise(39108), 4), (F.col("p_size") % 4 * 12, 4))
    data = pack(F.when(k % 9 == 0, F.lit(b"DHIX")).otherwise(F.lit(b"DHII")), (144, 4), (2, 4), arrays, *map(entry, range(9)))
    rows = table(spark, sf_dir, "part").select(k.alias("clip_id"), F.lit(40000).alias("clip_length"), F.lit(39000).alias("index_offset"), data.alias("data"))
    return E.frame_index(C.frame_references(rows)).select("clip_id", "array", "kind", "entry", "rejected")


@query("x20_flat_directory", """WITH e AS (SELECT p_partkey AS image_id, unnest(range(5)) AS entry FROM part WHERE p_partkey % 9 > 0), f AS (SELECT *, (image_id + entry) * 64 AS o, CASE WHEN (image_id + entry) % 31 = 0 THEN 0 ELSE 64 END AS n, (image_id + entry) % 37 = 0 AS far FROM e), r AS (SELECT *, CASE WHEN n <= 0 THEN 'zero length' WHEN far THEN 'overflow' WHEN o + n > 90000 THEN 'past end' END AS rejected FROM f)
SELECT image_id, entry, image_id % 16 + 1 AS channel, rejected, CASE WHEN rejected IS NULL THEN o END AS "offset", CASE WHEN rejected IS NULL AND entry = 3 THEN 'frame ' || image_id END AS payload FROM r""")
def x20b(spark, sf_dir):
    """Directories of five entries, one of which has a frame, some so far out that their end overflows; every ninth lacks the tag."""
    k = F.col("p_partkey")

    def entry(i):
        far = F.when((k + i) % 37 == 0, -8).otherwise((k + i) * 64)
        return pack((k % 16, 1), (0xFD, 1), bytes(2), (far, 8), (F.when((k + i) % 31 == 0, 0).otherwise(64), 8), bytes(12))

    data = pack(F.when(k % 9 == 0, F.lit(b"DIDY")).otherwise(F.lit(b"DIDX")), (5, 4), bytes(8), *map(entry, range(5)))
    images = table(spark, sf_dir, "part").select(k.alias("image_id"), F.lit(90000).cast("long").alias("size_bytes"), data.alias("data"))
    frames = images.select("image_id", ((F.col("image_id") + 3) * 64).alias("offset"), F.concat(F.lit("frame "), F.col("image_id").cast("string")).alias("payload"))
    return E.directory_entries(C.directory(images), frames).select("image_id", "entry", "channel", "rejected", "offset", "payload")
