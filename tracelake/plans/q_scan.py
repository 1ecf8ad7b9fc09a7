"""Queries of runs over image bytes. Each order makes an image: two vendors' signs, then five slots with a frame or start codes in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digests
from ..operators import scan as S
from ..sources.images import FileImages, TableImages
from .q_decode import WINDOW, dealt, filled, made, on_files, pack
from .registry import query
from .views import table

#: Bytes of a slot and of what stands ahead of the slots.
SLOT, HEAD, SLOTS = 64, 32, 5
_RULES = [("alpha", "opens", b"ALPHAREC", 0, 0.6, True), ("alpha", "index", b"alphaidx", 8, 0.4, False), ("beta", "opens", b"BETA-REC", 16, 0.6, True), ("beta", "index", b"beta-idx", 24, 0.4, False)]


def images(spark, sf_dir):
    k = F.col("o_orderkey")
    alpha, beta = k % 4 % 2 == 0, (k % 4 == 1) | (k % 4 == 2)
    signs = [F.when(on, F.lit(sign)).otherwise(F.lit(b"--------")) for on, sign in ((alpha, b"ALPHAREC"), (alpha, b"alphaidx"), (beta, b"BETA-REC"), (beta, b"beta-idx"))]

    def slot(i):
        x = k + i
        clock = F.lit((24 << 26) | (5 << 22) | (10 << 17) | (10 << 12) | (i << 6)) + k % 50 + 2
        frame = pack(b"DHAV", (F.when(x % 11 == 0, 9).otherwise(0xFD), 1), bytes(1), (F.lit(i), 1), bytes(1), (k % 200 + 0x20202020, 4), (SLOT, 4), (clock, 4), bytes(4), filled(F.lit(32)), F.when(x % 7 == 0, F.lit(b"xxxx")).otherwise(F.lit(b"dhav")), (SLOT - 8, 4))
        codes = pack(b"\0\0\1\x67\0\0\1\x68\0\0\1\x65\0\0\1\x61", filled(F.lit(48)))
        return F.when(x % 5 == 0, codes).otherwise(frame)

    rows = dealt(spark, sf_dir, "orders").select(k.alias("image_id"), made(F.concat(*signs, *map(slot, range(SLOTS)))).alias("data"))
    # every 13th image lacks the bytes of one window
    piece = lambda at, to: F.struct(F.lit(at).alias("start"), F.expr(f"substring(data, {at + 1}, {to - at})").alias("data"))
    size = HEAD + SLOTS * SLOT
    pieces = F.when(F.col("image_id") % 13 == 0, F.array(piece(0, 256), piece(320, size))).otherwise(F.array(piece(0, size)))
    return on_files(rows.select("image_id", F.inline(pieces)))


def index(spark, sf_dir):
    """Records of the first two slots, a freed one of the third, and of some images one of the last two; every 17th image has none."""
    k = F.col("o_orderkey")
    late = F.when(k % 9 == 0, 10000).otherwise(60)
    part = lambda at, n, used, t: F.struct(F.lit(at).cast("long").alias("offset"), F.lit(n).cast("long").alias("length"), F.lit(used).alias("accessible"), t.cast("long").alias("instant"))
    none = F.lit(None)
    parts = F.array(part(32, 64, True, k * 100), part(96, 64, True, k * 100 + late), part(160, 64, False, none), part(224, 128, True, none))
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 17 > 0").select(k.alias("image_id"), F.posexplode(parts).alias("i", "p"))
    return rows.where("i < 3 or image_id % 5 > 2").select("image_id", "p.*", F.lit(1).alias("channel"))


def scopes(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(k.alias("image_id"), F.lit(0).cast("long").alias("offset"), F.when(k % 3 == 1, 352).otherwise(224).cast("long").alias("length"))


#: s: the slots of all images, with what a search of image k finds there; has: the image has records, scoped: and an index's region.
_SLOTS = """o AS (SELECT o_orderkey AS k, o_orderkey % 17 > 0 AS has, o_orderkey % 3 AS scope FROM orders), e AS (SELECT *, unnest(range(5)) AS i FROM o),
s AS (SELECT *, CASE WHEN has AND (i < 2 OR i > 2 AND k % 5 > 2) THEN 'claimed' WHEN has AND i = 2 THEN 'available' ELSE 'unclaimed' END AS target, (k + i) % 5 = 0 AS codes, (k + i) % 7 > 0 AS valid, (k + i) % 11 > 0 AS known FROM e)"""
#: Without records all but the one target of the whole image is gone, so a window that can't be read skips all of it.
_FOUND = """f AS (SELECT *, CASE WHEN NOT valid THEN 'Corrupted' WHEN target = 'available' THEN 'Deleted' WHEN target = 'claimed' THEN 'Active' WHEN scope = 1 OR scope = 2 AND i < 3 THEN 'Orphaned' ELSE 'Unindexed' END AS data_state FROM s WHERE NOT codes AND known AND NOT (k % 13 = 0 AND (i > 2 OR NOT has)))"""
_COUNTS = "count(*) AS n_candidates, count(*) FILTER (valid) AS n_valid, " + ", ".join(f"count(*) FILTER (data_state = '{s}') AS n_{s.lower()}" for s in S.STATES)
_CANDIDATE = """k AS image_id, 32 + i * 64 AS "offset", 64 AS length, 'video-key-frame' AS kind, i + 1 AS channel, epoch(make_timestamp(2024, 5, 10, 10, i, (k % 50 + 2)::DOUBLE))::BIGINT AS start, target, data_state"""


def _searched(spark, sf_dir):
    files = images(spark, sf_dir)
    return S.scan_recovery(files, files.sizes(), index(spark, sf_dir), scopes(spark, sf_dir), WINDOW)


_PICKED = ("image_id", "offset", "length", "kind", "channel", "start", "target", "data_state")


@query("d08_scan_candidates", f"WITH {_SLOTS}, {_FOUND} SELECT {_CANDIDATE} FROM f")
def d08_candidates(spark, sf_dir):
    return _searched(spark, sf_dir)[0].select(*_PICKED)


_REPORT = f"""c AS (SELECT k, {_COUNTS} FROM f GROUP BY k), t AS (SELECT k, CASE WHEN NOT has THEN 1 ELSE 4 END AS n_targets, 352 AS bytes, CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS n_skipped, CASE WHEN k % 13 > 0 THEN 0 WHEN has THEN 128 ELSE 352 END AS bytes_skipped FROM o)"""
_FILLED = ", ".join(f"coalesce({n}, 0) AS {n}" for n in ["n_candidates", "n_valid", *[f"n_{s.lower()}" for s in S.STATES]])


@query("d08_scan_recovery", f"WITH {_SLOTS}, {_FOUND}, {_REPORT} SELECT k AS image_id, n_targets, bytes, n_skipped, bytes_skipped, false AS truncated, {_FILLED}, 'PASS' AS state FROM t LEFT JOIN c USING (k)")
def d08_scan(spark, sf_dir):
    return _searched(spark, sf_dir)[1]


#: Images of no vendor: recordings are the slots with start codes, and the search has no index.
_RUN = f"""g AS (SELECT *, CASE k % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS vendor, CASE k % 4 WHEN 2 THEN 'Ambiguous' WHEN 3 THEN 'Insufficient' ELSE 'Confirmed' END AS classification, CASE k % 4 WHEN 2 THEN 'analyst' WHEN 3 THEN 'stop' ELSE 'proceed' END AS decision FROM o),
q AS (SELECT k, count(*) FILTER (codes AND NOT (k % 13 = 0 AND i = 4)) AS n_codes FROM s GROUP BY k),
p AS (SELECT g.*, CASE decision WHEN 'proceed' THEN CASE WHEN NOT has THEN 0 WHEN k % 5 > 2 THEN 4 ELSE 3 END WHEN 'stop' THEN n_codes END AS n_recordings FROM g JOIN q USING (k)),
a AS (SELECT *, CASE WHEN n_recordings > 0 THEN CASE WHEN decision = 'proceed' AND k % 9 = 0 THEN 1 ELSE 0 END END AS n_gaps, n_recordings > 0 AND decision = 'stop' AS bare FROM p),
h AS (SELECT *, CASE WHEN n_recordings > 0 THEN CASE WHEN bare THEN CASE WHEN (5 - k % 5) % 5 >= 2 THEN 1 ELSE 0 END + CASE WHEN (5 - k % 5) % 5 <= 3 THEN 1 ELSE 0 END ELSE CASE WHEN k % 5 > 2 THEN 0 ELSE 1 END END END AS n_holes FROM a),
x AS (SELECT k, count(*) FILTER (there) AS n_candidates, count(*) FILTER (there AND NOT valid) AS n_corrupted FROM (SELECT s.*, NOT codes AND known AND NOT (k % 13 = 0 AND (decision = 'stop' OR i > 2)) AS there FROM s JOIN (SELECT k, decision FROM h WHERE n_gaps > 0 OR n_holes > 0) USING (k)) GROUP BY k)"""


@query("d13_run_images", f"""WITH {_SLOTS}, {_RUN} SELECT k AS image_id, vendor, classification, decision, n_recordings, n_gaps, n_holes, n_candidates, CASE WHEN n_candidates IS NOT NULL THEN CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END END AS n_skipped,
CASE WHEN decision = 'analyst' THEN 'needs an analyst: ambiguous' WHEN n_recordings = 0 THEN 'needs an analyst: not parsed' WHEN n_candidates IS NULL THEN 'complete' WHEN n_candidates = 0 THEN 'gaps, not recovered' WHEN n_corrupted > 0 THEN 'gaps, partially recovered' ELSE 'gaps, completely recovered' END AS outcome FROM h LEFT JOIN x USING (k)""")
def d13_images(spark, sf_dir):
    rules = [(v, r, p, "exact", at, at + 1, 1, "validated", w, x) for v, r, p, at, w, x in _RULES]
    rules = spark.createDataFrame(rules, "vendor string, rule string, pattern binary, kind string, at long, stop long, step long, state string, weight double, exclusive boolean")
    most = spark.createDataFrame([("alpha", 1.0), ("beta", 1.0)], "vendor string, max_score double")
    return S.run_images(images(spark, sf_dir), rules, most, index(spark, sf_dir), scopes(spark, sf_dir), WINDOW, 8, min_bytes=100)[0]


@query("d15_image_digests", """WITH d AS (SELECT doc_id, doc_id % 50 AS image_id, coalesce(text, '') AS text FROM documents), g AS (SELECT image_id, sum(octet_length(encode(text)))::BIGINT AS size_bytes, md5(string_agg(text, '' ORDER BY doc_id)) AS md5_again, sha256(string_agg(text, '' ORDER BY doc_id)) AS sha256_again FROM d GROUP BY image_id)
SELECT image_id, size_bytes, md5_again, sha256_again, CASE WHEN image_id % 7 = 0 THEN 'MISMATCH' WHEN image_id % 11 = 0 THEN 'UNKNOWN' ELSE 'MATCH' END AS verdict FROM g WHERE size_bytes > 0""")
def d15_images(spark, sf_dir):
    """Documents one behind the other as images in files: digests of their windows as acquired, some damaged or lost since, against a second pass that seeks."""
    own = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("image_id"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    files = FileImages.laid(own.where("length(data) > 0"), ["doc_id"], 1 << 20)
    first = digests.image_digests(TableImages(files.chunks(64), files.window))
    acquired = first.select("image_id", F.when(F.col("image_id") % 7 == 0, F.md5(F.lit(""))).when(F.col("image_id") % 11 != 0, F.upper("md5")).alias("md5"), "sha256")
    return digests.verify_images(acquired, files).select("image_id", "size_bytes", "md5_again", "sha256_again", "verdict")
