"""Queries of record extraction over part, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as B
from ..operators import detect as D
from ..operators import index as N
from ..operators import records as E
from ..operators import recovery as V
from ..sources.tables import read_case_tables
from .q_decode import on_files
from .q_detect import WINDOW, chunks
from .q_index import _TWO, two
from .q_recovery import _FRAGMENTS, fragments
from .q_timeline import _DOMAINS, _GAPS, _ROLLUP, _SESSIONS, _STEPS, a04
from .registry import query
from .views import segments, table


@query("p07_packed_date", """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 40 = 0 THEN 0 ELSE (p_partkey * 2654435761 * 97) % 1099511627776 END AS v, p_partkey % 50 = 7 AS cut FROM part), f AS (SELECT *, v & 4095 AS y, (v >> 12) & 15 AS mo, (v >> 16) & 31 AS d, (v >> 21) & 31 AS h, (v >> 26) & 63 AS mi, (v >> 32) & 63 AS s FROM v),
g AS (SELECT *, y >= 1 AND mo BETWEEN 1 AND 12 AND d >= 1 AND h < 24 AND mi < 60 AND s < 60 AND CASE WHEN mo BETWEEN 1 AND 12 AND y >= 1 THEN d <= day(last_day(make_date(y::INT, mo::INT, 1))) ELSE false END AS ok FROM f)
SELECT p_partkey, CASE WHEN ok AND NOT cut AND v <> 0 THEN y * 10000 + mo * 100 + d END AS ymd, CASE WHEN cut THEN 'Truncated' WHEN v = 0 THEN 'Empty' WHEN NOT ok THEN 'Invalid' WHEN y NOT BETWEEN 2000 AND 2100 THEN 'Implausible' ELSE 'Valid' END AS state FROM g""")
def p07(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.when(k % 40 == 0, 0).otherwise(k * 2654435761 * 97 % 1099511627776)
    data = F.when(k % 50 == 7, B.le_bytes(value, 4)).otherwise(B.le_bytes(value, 5))
    rows = table(spark, sf_dir, "part").select("p_partkey", E.packed_date(data, 0, 2000, 2100).alias("p"))
    return rows.select("p_partkey", (F.year("p.time") * 10000 + F.month("p.time") * 100 + F.dayofmonth("p.time")).cast("long").alias("ymd"), "p.state")


@query("x03_follow_pointers", """WITH h AS (SELECT o_orderkey % 10 AS image_id, o_orderkey AS hit_id, CASE WHEN o_orderkey % 17 = 0 THEN 9999999 ELSE o_custkey * 10 END AS pointer, 0.5 AS weight FROM orders), t AS (SELECT DISTINCT o_orderkey % 10 AS image_id, o_custkey * 10 AS pointer, o_custkey % 4 > 0 AS ok FROM orders),
s AS (SELECT h.*, CASE WHEN h.pointer >= 1000000 THEN 'out of image' WHEN coalesce(ok, false) THEN 'match' ELSE 'mismatch' END AS status, row_number() OVER (PARTITION BY h.image_id, h.pointer ORDER BY hit_id) AS n FROM h LEFT JOIN t USING (image_id, pointer)) SELECT image_id, hit_id, pointer, status, CASE WHEN status = 'match' AND n = 1 THEN 0.5 ELSE 0 END::DOUBLE AS weight FROM s""")
def x03(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    hits = rows.select((k % 10).alias("image_id"), k.alias("hit_id"), F.when(k % 17 == 0, 9999999).otherwise(c * 10).alias("pointer"), F.lit(1000000).alias("size_bytes"), F.lit(0.5).alias("weight"))
    return E.follow_pointers(hits, rows.select((k % 10).alias("image_id"), (c * 10).alias("offset"), (c % 4 > 0).alias("magic_ok")).distinct())


@query("x07_clip_slots", """SELECT o_orderkey AS slot_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown channel' WHEN o_orderkey % 11 = 0 THEN 'no end time' WHEN o_orderkey % 13 = 0 THEN 'span' WHEN o_orderkey % 17 = 0 THEN 'empty range' WHEN o_orderkey * 10 + 100 > 100000 THEN 'beyond block' END AS rejected FROM orders""")
def x07(spark, sf_dir):
    k = F.col("o_orderkey")
    slots = table(spark, sf_dir, "orders").select(k.alias("slot_id"), F.when(k % 7 > 0, k % 16).alias("channel"), k.alias("start"), F.when(k % 11 > 0, F.when(k % 13 == 0, k - 1).otherwise(k + 60)).alias("end"), (k * 10).alias("first"), F.when(k % 17 == 0, k * 10).otherwise(k * 10 + 100).alias("last"))
    return E.clip_slots(slots, 100000).select("slot_id", "rejected")


@query("x08_unit_entries", "SELECT o_orderkey // 100 AS unit, o_orderkey % 100 AS slot, CASE WHEN o_orderkey % 100 < 70 THEN 'declared' ELSE 'residual' END AS standing FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 10 > 0")
def x08(spark, sf_dir):
    k = F.col("o_orderkey")
    slots = table(spark, sf_dir, "orders").select(F.floor(k / 100).alias("unit"), (k % 100).alias("slot"), F.lit(70).alias("declared"), F.when(k % 9 > 0, k % 10).alias("value"))
    return E.unit_entries(slots).select("unit", "slot", "standing")


@query("x09_partition_entries", """WITH e AS (SELECT c_custkey AS image_id, c_nationkey % 4 AS slot, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 7 END AS type, CASE WHEN c_custkey % 19 = 0 THEN 9000000000000000 * (c_custkey % 1000) ELSE 100 * c_custkey END AS lba, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 5000 END AS n, 60000000 AS size_bytes FROM customer), f AS (SELECT *, lba::HUGEINT * 512 > 9223372036854775807 OR lba::HUGEINT * 512 + n * 512 > 9223372036854775807 AS wide FROM e),
g AS (SELECT *, CASE WHEN type = 0 THEN CASE WHEN lba <> 0 OR n <> 0 THEN 'unused with geometry' END WHEN n = 0 THEN 'zero length' WHEN wide THEN 'overflow' WHEN lba::HUGEINT * 512 + n * 512 > size_bytes THEN 'out of bounds' END AS finding, type <> 0 AND n > 0 AND NOT wide AS there FROM f)
SELECT image_id, slot, finding, CASE finding WHEN 'unused with geometry' THEN 'info' WHEN 'overflow' THEN 'error' WHEN 'zero length' THEN 'warning' WHEN 'out of bounds' THEN 'warning' END AS severity, CASE WHEN there THEN least(lba::HUGEINT * 512, size_bytes)::BIGINT END AS "offset", CASE WHEN there THEN (least(lba::HUGEINT * 512 + n * 512, size_bytes) - least(lba::HUGEINT * 512, size_bytes))::BIGINT END AS length, there AND finding IS NULL AS candidate FROM g""")
def x09(spark, sf_dir):
    """The starts far out go by the key modulo 1000, so that they stay in LONG at any size."""
    rows, far = table(spark, sf_dir, "customer"), F.col("c_custkey") % 1000
    k = F.col("c_custkey")
    entries = rows.select(k.alias("image_id"), (F.col("c_nationkey") % 4).alias("slot"), F.when(k % 5 == 0, 0).otherwise(7).alias("type"), F.when(k % 19 == 0, F.lit(9000000000000000) * far).otherwise(F.lit(100) * k).alias("start_lba"), F.when(k % 7 == 0, 0).otherwise(5000).cast("long").alias("sectors"), F.lit(60000000).cast("long").alias("size_bytes"))
    return E.partition_entries(entries)


@query("x13_carve_runs", """WITH RECURSIVE c AS (SELECT l_suppkey AS image_id, l_orderkey * 100 + l_linenumber * 10 AS pos, min(l_partkey % 3) AS h264, min(l_partkey % 4) AS h265, bool_or(l_partkey % 11 = 0) AS boundary FROM lineitem GROUP BY ALL), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pos) AS i, coalesce(pos - lag(pos) OVER (PARTITION BY image_id ORDER BY pos) > 900, true) AS cut FROM c),
r AS (SELECT image_id, i, pos AS run, 1 AS units FROM n WHERE i = 1 UNION ALL SELECT r.image_id, n.i, CASE WHEN n.cut OR (n.boundary AND r.units >= 3) THEN n.pos ELSE r.run END, CASE WHEN n.cut OR (n.boundary AND r.units >= 3) THEN 1 ELSE r.units + 1 END FROM r JOIN n ON n.image_id = r.image_id AND n.i = r.i + 1)
SELECT image_id, run, max(pos) AS last, count(*) AS n_units, CASE WHEN sum(h264) = 0 AND sum(h265) = 0 THEN 'unknown' WHEN sum(h265) > sum(h264) THEN 'H265' ELSE 'H264' END AS codec FROM r JOIN n USING (image_id, i) GROUP BY image_id, run HAVING count(*) >= 3""")
def x13(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10).alias("pos")).agg(F.min(F.col("l_partkey") % 3).alias("h264"), F.min(F.col("l_partkey") % 4).alias("h265"), F.bool_or(F.col("l_partkey") % 11 == 0).alias("boundary"))
    return E.carve_runs(rows, 900, 3)


@query("x16_stream_records", """WITH p AS (SELECT doc_id AS image_id, string_split(text, 'the ') AS parts FROM documents), u AS (SELECT image_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM p), h AS (SELECT image_id, i, n, (sum(octet_length(encode(part))) OVER (PARTITION BY image_id ORDER BY i ROWS UNBOUNDED PRECEDING) + 4 * (i - 1))::BIGINT AS "offset" FROM u)
SELECT h.image_id, h."offset", ('0x' || substr(hex(encode(text)), (2 * (h."offset" + 4) + 1)::BIGINT, 2))::INTEGER AS next_byte FROM h JOIN documents ON doc_id = h.image_id WHERE i < n AND h."offset" + 4 < octet_length(encode(text))""")
def x16(spark, sf_dir):
    """A record for each needle with a byte behind it: the byte that follows, as its first field."""
    rows = chunks(spark, sf_dir)
    met = D.find_pattern(rows, b"the ").join(rows.select("image_id", "owned_len", "data"), "image_id").where(F.col("offset") + 4 < F.col("owned_len"))
    return met.select("image_id", "offset", B.byte_at(F.col("data"), F.col("offset") + 4).alias("next_byte"))


@query("x17_frame_index", """SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 23 = 0 THEN 'sentinel' WHEN o_orderkey % 29 = 0 THEN 'no length' WHEN o_orderkey * 3 + 100 > 40000 THEN 'past clip' WHEN o_orderkey * 3 + 100 > 39000 THEN 'overlaps index' END AS rejected FROM orders""")
def x17(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("entry_id"), F.when(k % 23 == 0, F.lit(0xFFFFFFFF)).otherwise(k * 3).alias("offset"), F.when(k % 29 == 0, 0).otherwise(100).alias("length"), F.lit(40000).alias("clip_length"), F.lit(39000).alias("index_offset"))
    return E.frame_index(rows).select("entry_id", "rejected")


@query("x19_header_origin", """WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS p, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN -1 ELSE p_size + 1 END AS b FROM part) SELECT p_partkey, CASE WHEN p >= 0 THEN p WHEN b >= 0 THEN b END AS size, CASE WHEN p >= 0 THEN 'declared' WHEN b >= 0 THEN 'fallback' WHEN p IS NOT NULL OR b IS NOT NULL THEN 'malformed' ELSE 'absent' END AS size_origin FROM h""")
def x19(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, None).when(k % 5 == 0, -1).otherwise(s).alias("primary_size"), F.when(k % 3 == 0, None).when(k % 7 == 0, -1).otherwise(s + 1).alias("backup_size"))
    return E.with_origin(rows, ["size"]).select("p_partkey", "size", "size_origin")


@query("x21_partition_geometry", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'absent' WHEN p_size = 10 THEN 'empty' WHEN (p_partkey + p_size - 10) * 512 > 500000 OR p_size < 10 THEN CASE WHEN p_size < 10 THEN 'empty' ELSE 'beyond image' END END AS rejected FROM part""")
def x21(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 > 0, F.col("p_partkey")).alias("first_sector"), (F.col("p_size") - 10).cast("long").alias("n_sectors"), F.lit(500000).alias("size_bytes"))
    return E.partition_geometry(rows).select("p_partkey", "rejected")


@query("a20_unit_consistency", """WITH u AS (SELECT o_custkey % 40 AS image_id, o_orderkey AS unit, o_orderkey % 50 AS declared, o_orderkey % 40 AS usable, o_orderkey % 290 = 3 AS current, epoch(o_orderdate)::BIGINT AS written FROM orders), b AS (SELECT image_id, sum(declared)::BIGINT AS declared, sum(usable)::BIGINT AS usable, count(*) FILTER (current) AS n_current, max(unit) FILTER (current) AS c, arg_max(unit, [written, unit]) AS l FROM u GROUP BY image_id) SELECT image_id, declared, usable, n_current, CASE WHEN n_current = 0 THEN 'UNKNOWN' WHEN n_current > 1 THEN 'REVIEW' WHEN c = l THEN 'PASS' ELSE 'REVIEW' END AS state FROM b""")
def a20(spark, sf_dir):
    k = F.col("o_orderkey")
    units = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("image_id"), k.alias("unit"), (k % 50).alias("declared"), (k % 40).alias("usable"), (k % 290 == 3).alias("current"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("written"))
    return E.unit_consistency(units)


@query("d06_build_index", """WITH m AS (SELECT o_custkey % 40 AS image_id, o_orderkey AS clip_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey // 2 END AS entry_id FROM orders) SELECT image_id, count(entry_id) AS n_accessible, count(*) FILTER (entry_id IS NULL) AS n_unreferenced, count(DISTINCT entry_id) AS n_entries FROM m GROUP BY image_id""")
def d06(spark, sf_dir):
    k = F.col("o_orderkey")
    clips = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("image_id"), k.alias("clip_id"))
    matched = clips.where("clip_id % 3 > 0").withColumn("entry_id", F.floor(F.col("clip_id") / 2))
    return E.build_index(clips, matched)


def documents_on_files(spark, sf_dir, window):
    return on_files(chunks(spark, sf_dir), window)


@query("d22_extract_payload", """WITH r AS (SELECT doc_id AS recording_id, text, octet_length(encode(text)) AS n, doc_id % 9 = 0 AS far FROM documents) SELECT recording_id, 60 + CASE WHEN far THEN 200000 ELSE 0 END AS n_bytes, CASE WHEN n >= 110 AND NOT far THEN sha256(unhex(substr(hex(encode(text)), 101, 120))) END AS sha256, CASE WHEN n < 110 OR far THEN 'range outside image' END AS error FROM r""")
def d22(spark, sf_dir):
    ids = chunks(spark, sf_dir).select(F.col("image_id").alias("recording_id"), "image_id")
    far = F.when(F.col("recording_id") % 9 == 0, 200000).otherwise(0)
    pieces = ids.select("recording_id", "image_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit(50).alias("offset"), F.lit(30).alias("length")), F.struct(F.lit(2).alias("seq"), F.lit(80).alias("offset"), (F.lit(30) + far).alias("length")))).alias("p")).select("recording_id", "image_id", "p.*")
    return E.extract_payload(pieces, documents_on_files(spark, sf_dir, WINDOW), 1000000, WINDOW)


@query("d17_report", f"""WITH {_DOMAINS}, {_STEPS}, {_SESSIONS}, {_GAPS}, {_ROLLUP}, {_TWO}, s AS (SELECT image_id, count(*) AS n_sessions, sum(missing_seconds)::BIGINT AS missing FROM ru GROUP BY image_id) SELECT i.image_id, n_sessions, missing, verdict FROM (SELECT DISTINCT image_id FROM v_segments) i LEFT JOIN s USING (image_id) LEFT JOIN vd USING (image_id)""")
def d17(spark, sf_dir):
    images = segments(spark, sf_dir).select("image_id").distinct()
    sessions = a04(spark, sf_dir).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("missing_seconds").alias("missing"))
    report = E.assemble_report(images, sessions=sessions, index=N.compare_indexes(*two(spark, sf_dir)))
    return report.select("image_id", "sessions.n_sessions", "sessions.missing", "index.verdict")


@query("x10_carve_frames", """WITH RECURSIVE h AS (SELECT DISTINCT l_suppkey AS image_id, l_orderkey * 20 + l_linenumber AS "offset" FROM lineitem), d AS (SELECT *, "offset" % 61 AS length, "offset" % 13 > 0 AS trailer_ok, "offset" % 61 + CASE WHEN "offset" % 17 = 0 THEN 1 ELSE 0 END AS back_length FROM h), j AS (SELECT *, CASE WHEN length <= 0 THEN 'no length' WHEN "offset" + length > 290000 THEN 'past end' WHEN NOT trailer_ok THEN 'no trailer' WHEN back_length <> length THEN 'back length' END AS rejected FROM d),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY "offset") AS i FROM j WHERE rejected IS NULL), w AS (SELECT image_id, i, "offset" + length AS reach, true AS kept FROM g WHERE i = 1 UNION ALL SELECT w.image_id, g.i, CASE WHEN g."offset" >= w.reach THEN g."offset" + g.length ELSE w.reach END, g."offset" >= w.reach FROM w JOIN g ON g.image_id = w.image_id AND g.i = w.i + 1),
k AS (SELECT g.image_id, g."offset", g.length, kept, count(*) FILTER (kept) OVER (PARTITION BY g.image_id ORDER BY g.i ROWS UNBOUNDED PRECEDING) AS place FROM g JOIN w USING (image_id, i))
SELECT image_id, "offset", length, CASE WHEN NOT kept THEN 'inside a frame' WHEN place > 200 THEN 'over the cap' END AS rejected FROM k UNION ALL SELECT image_id, "offset", length, rejected FROM j WHERE rejected IS NOT NULL""")
def x10(spark, sf_dir):
    at = F.col("offset")
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 20 + F.col("l_linenumber")).alias("offset")).distinct()
    rows = hits.select("image_id", "offset", (at % 61).alias("length"), F.lit(290000).alias("owned_len"), (at % 13 > 0).alias("trailer_ok"), (at % 61 + F.when(at % 17 == 0, 1).otherwise(0)).alias("back_length"))
    return E.carve_frames(rows, 200).select("image_id", "offset", "length", "rejected")


@query("x11_walk_parts", """WITH p AS (SELECT p_partkey AS k, p_partkey % 40 AS a, p_partkey % 300 AS b, p_partkey % 7 AS c, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END AS junk FROM part)
SELECT k AS region_id, unnest([0, 6 + a, 12 + a + b + junk]) AS "offset", unnest([186, 224, 192]) AS kind, unnest([6 + a, 6 + b, 6 + c]) AS length, true AS complete FROM p""")
def x11(spark, sf_dir):
    """Containers of three parts for each row of part, every fifth with junk before the last one."""
    k = F.col("p_partkey")

    def part(kind, size):
        body = F.unhex(F.repeat(F.lit("AA"), size.cast("int")))
        return F.concat(F.lit(b"\x00\x00\x01"), B.le_bytes(kind, 1), B.le_bytes(F.shiftright(size, 8), 1), B.le_bytes(size, 1), body)

    junk = F.when(k % 5 == 0, F.lit(b"\x07\x07\x07")).otherwise(F.lit(b""))
    data = F.concat(part(F.lit(186), k % 40), part(F.lit(224), k % 300), junk, part(F.lit(192), k % 7))
    return E.walk_parts(table(spark, sf_dir, "part").select(k.alias("region_id"), data.alias("data")), True)


@query("x12_evaluate_candidates", """WITH c AS (SELECT o_orderkey AS candidate_id, o_orderkey % 2 = 0 AS a, o_orderkey % 3 > 0 AS b, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 2 = 0 END AS c, o_totalprice > 100000 AS d FROM orders) SELECT candidate_id, concat_ws(',', CASE WHEN a THEN 'start' END, CASE WHEN b THEN 'parameters' END, CASE WHEN c THEN 'sentinel' END, CASE WHEN d THEN 'size' END) AS held, a AND b AND coalesce(c, false) AS recoverable FROM c""")
def x12(spark, sf_dir):
    k = F.col("o_orderkey")
    conditions = {"start": k % 2 == 0, "parameters": k % 3 > 0, "sentinel": F.when(k % 5 > 0, F.col("o_custkey") % 2 == 0), "size": F.col("o_totalprice") > 100000}
    return E.evaluate_candidates(table(spark, sf_dir, "orders"), conditions, ["start", "parameters", "sentinel"]).select(k.alias("candidate_id"), "held", "recoverable")


@query("x20_directory", """WITH e AS (SELECT o_custkey % 20 AS image_id, o_orderkey AS entry, o_orderkey * 64 AS "offset", CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE 64 END AS length FROM orders), r AS (SELECT *, CASE WHEN length <= 0 THEN 'zero length' WHEN "offset" + length > 900000 THEN 'past end' END AS rejected FROM e) SELECT image_id, entry, rejected, CASE WHEN rejected IS NULL AND entry % 3 = 0 THEN 'frame ' || entry END AS payload FROM r""")
def x20(spark, sf_dir):
    k = F.col("o_orderkey")
    entries = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("image_id"), k.alias("entry"), (k * 64).alias("offset"), F.when(k % 31 == 0, 0).otherwise(64).cast("long").alias("length"), F.lit(900000).cast("long").alias("size_bytes"))
    frames = entries.where("entry % 3 = 0").select("image_id", "offset", F.concat(F.lit("frame "), F.col("entry").cast("string")).alias("payload"))
    return E.directory_entries(entries, frames).select("image_id", "entry", "rejected", "payload")


@query("d11_reconstruct", f"""WITH {_FRAGMENTS}, c AS (SELECT image_id, channel, fragment_id AS block, CASE WHEN fragment_id % 3 > 0 THEN ts END AS s, CASE WHEN fragment_id % 3 > 0 THEN ts + 4 END AS e, "offset", length FROM v_fragments WHERE channel IS NOT NULL), n AS (SELECT *, lag(e) OVER w AS pe, lag("offset" + length) OVER w AS pd FROM c WINDOW w AS (PARTITION BY image_id, channel ORDER BY block)),
g AS (SELECT *, sum(CASE WHEN coalesce(CASE WHEN s IS NOT NULL AND pe IS NOT NULL THEN abs(s - pe) <= 5 ELSE "offset" = pd END, false) THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, channel ORDER BY block ROWS UNBOUNDED PRECEDING)::BIGINT AS clip_group FROM n)
SELECT image_id, channel, clip_group, count(*) AS n_clips, min(s) AS start, max(e) AS "end", sum(length)::BIGINT AS bytes, string_agg("offset" || '+' || length, ',' ORDER BY block) AS ranges, CASE WHEN count(s) = count(*) THEN 'time' WHEN count(s) = 0 THEN 'place on disk' ELSE 'mixed' END AS ordering FROM g GROUP BY image_id, channel, clip_group""")
def d11(spark, sf_dir):
    timed = F.col("fragment_id") % 3 > 0
    clips = fragments(spark, sf_dir).where("channel is not null").select("image_id", "channel", F.col("fragment_id").alias("block"), F.when(timed, F.col("ts")).alias("start"), F.when(timed, F.col("ts") + 4).alias("end"), "offset", "length")
    return E.reconstruct(V.clip_groups(clips))


@query("s02_read_regions", """WITH r AS (SELECT doc_id AS image_id, unnest([1, 2, 3]) AS region_id, unnest([0, 100, 5000]) AS "offset", unnest([16, 64, 200]) AS length, hex(encode(text)) AS h FROM documents) SELECT image_id, region_id, "offset", length, nullif(substr(h, 2 * "offset" + 1, 2 * length), '') AS hex FROM r""")
def s02(spark, sf_dir):
    parts = F.array(*[F.struct(F.lit(i).alias("region_id"), F.lit(o).alias("offset"), F.lit(n).alias("length")) for i, o, n in ((1, 0, 16), (2, 100, 64), (3, 5000, 200))])
    wanted = chunks(spark, sf_dir).select("image_id", F.inline(parts))
    return documents_on_files(spark, sf_dir, 128).read(wanted).select("image_id", "region_id", "offset", "length", F.hex("data").alias("hex"))


@query("s01_image_chunks", """WITH h AS (SELECT doc_id AS image_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT *, unnest(range(0, (length(h) // 2 + 999) // 1000)) * 1000 AS base_offset FROM h)
SELECT image_id, base_offset, least(1000, length(h) // 2 - base_offset) AS owned_len, md5(substr(h, 2 * base_offset + 1, 2 * 1008)) AS digest FROM w""")
def s01(spark, sf_dir):
    """Texts as images in files, in windows of 1,000 bytes that run on by 8."""
    windows = documents_on_files(spark, sf_dir, 1000).chunks(8)
    return windows.select("image_id", "base_offset", "owned_len", F.md5(F.hex("data").cast("binary")).alias("digest"))


@query("s06_case_tables", "SELECT o_orderpriority, c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def s06(spark, sf_dir):
    tables = read_case_tables(spark, sf_dir, ["orders", "customer"])
    return tables["orders"].join(tables["customer"], F.col("c_custkey") == F.col("o_custkey")).groupBy("o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
