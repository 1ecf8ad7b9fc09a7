"""Queries of byte fields, patterns and vendor scores over documents, part and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as B
from ..operators import decode as C
from ..operators import detect as D
from .registry import query
from .views import table


def chunks(spark, sf_dir):
    data = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.lit(0).cast("long").alias("base_offset"), F.octet_length(data).cast("long").alias("owned_len"), data.alias("data"))


#: Bytes of a window of ``windows``, shorter than most documents, and by how many its data runs on.
WINDOW, OVERLAP = 100, 8


def windows(spark, sf_dir):
    """The documents as images cut in small windows."""
    data, n = F.col("text").cast("binary"), F.octet_length(F.col("text").cast("binary")).cast("long")
    cut = lambda k: F.struct((k * WINDOW).alias("base_offset"), F.when(n.isNotNull(), F.least(F.lit(WINDOW).cast("long"), n - k * WINDOW)).alias("owned_len"), F.substring(data, (k * WINDOW + 1).cast("int"), F.lit(WINDOW + OVERLAP)).alias("data"))
    last = F.floor(F.greatest(n - 1, F.lit(0).cast("long")) / WINDOW)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), cut)).alias("w")).select("image_id", "w.*")


_BYTES = "byt AS (SELECT doc_id AS image_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n, encode(text) AS data FROM documents)"
_HITS = """parts AS (SELECT doc_id AS image_id, unnest(string_split(text, 'tion')) AS part, generate_subscripts(string_split(text, 'tion'), 1) AS i, len(string_split(text, 'tion')) AS n FROM documents),
hits AS (SELECT image_id, "offset" FROM (SELECT image_id, i, n, (sum(octet_length(encode(part))) OVER (PARTITION BY image_id ORDER BY i ROWS UNBOUNDED PRECEDING) + 4 * (i - 1))::BIGINT AS "offset" FROM parts) WHERE i < n)"""


@query("x01_find_pattern", f'WITH {_HITS} SELECT image_id, "offset" FROM hits')
def x01(spark, sf_dir):
    return D.find_pattern(chunks(spark, sf_dir), b"tion")


@query("x01_first_hit", f'WITH {_HITS} SELECT image_id, min("offset") AS "offset", count(*) AS n_hits FROM hits GROUP BY image_id')
def x01b(spark, sf_dir):
    return D.first_hit(D.find_pattern(chunks(spark, sf_dir), b"tion"))


#: vendor, rule, pattern, kind, at, stop, step, state, weight, exclusive
_RULES = [
    ("alpha", "opens-the", b"The", "exact", 0, 3, 1, "validated", 0.5, True),
    ("alpha", "and-aligned", b"and ", "aligned", 0, 512, 4, "provisional", 0.3, False),
    ("alpha", "tion-early", b"tion", "header", 0, 200, 1, "unvalidated", 0.2, False),
    ("beta", "de-early", b" de ", "header", 0, 300, 1, "validated", 0.6, True),
    ("beta", "la-aligned", b"la", "aligned", 2, 800, 2, "model_specific", 0.4, False),
    ("gamma", "und-early", b" und ", "header", 0, 300, 1, "validated", 0.7, True),
    ("gamma", "sch-late", b"sch", "header", 1000, 1400, 1, "firmware_specific", 0.3, False),
]
_MOST = [("alpha", 0.9), ("beta", 0.8), ("gamma", 0.9)]
_SHAPE = "vendor string, rule string, pattern binary, kind string, at long, stop long, step long, state string, weight double, exclusive boolean"
_RULES_SQL = "rules(vendor, rule, pattern, kind, pos, stop, step, state, weight, exclusive) AS (VALUES " + ", ".join(f"('{v}', '{r}', '{p.hex().upper()}', '{k}', {a}, {b}, {s}, '{st}', {w}::DOUBLE, {str(x).lower()})" for v, r, p, k, a, b, s, st, w, x in _RULES) + ")"
_EVIDENCE = f"""{_BYTES}, {_RULES_SQL}, evi AS (SELECT image_id, vendor, rule, CASE WHEN len(list_filter(CASE kind WHEN 'exact' THEN [pos] ELSE range(pos, stop, step) END, lambda p: substr(h, 2 * p + 1, length(pattern)) = pattern)) > 0 THEN 'match' WHEN n < pos + length(pattern) // 2 THEN 'absent' ELSE 'mismatch' END AS match_status, state, weight, exclusive FROM byt CROSS JOIN rules)"""
_SCORES = """sc AS (SELECT image_id, vendor, sum(weight * CASE state WHEN 'validated' THEN 1.0 WHEN 'provisional' THEN 0.8 WHEN 'model_specific' THEN 0.7 WHEN 'firmware_specific' THEN 0.6 ELSE 0.4 END * CASE match_status WHEN 'match' THEN 1 ELSE 0 END) AS raw_score, avg(CASE match_status WHEN 'match' THEN 1.0 ELSE 0.0 END) AS quality, bool_or(exclusive AND match_status = 'match') AS has_exclusive, count(*) FILTER (match_status = 'match') <= 1 AS insufficient FROM evi GROUP BY image_id, vendor),
vs AS (SELECT image_id, vendor, raw_score, greatest(least(raw_score / CASE vendor WHEN 'alpha' THEN 0.9::DOUBLE WHEN 'beta' THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END, 1.0), 0.0) AS confidence, quality, has_exclusive, insufficient FROM sc),
rk AS (SELECT *, row_number() OVER w AS rank, lead(vendor) OVER w AS second, lead(confidence) OVER w AS nx FROM vs WINDOW w AS (PARTITION BY image_id ORDER BY round(confidence, 9) DESC, vendor)), mg AS (SELECT *, CASE WHEN nx IS NULL THEN confidence ELSE greatest(confidence - nx, 0.0) END AS margin FROM rk),
cf AS (SELECT *, CASE WHEN insufficient THEN 'Insufficient' WHEN rank > 1 THEN 'Unknown' WHEN confidence < 0.65 THEN 'Unknown' WHEN second IS NOT NULL AND margin < 0.2 THEN 'Ambiguous' WHEN margin >= 0.2 AND quality >= 0.5 AND has_exclusive THEN 'Confirmed' ELSE 'CompatibleCandidate' END AS classification FROM mg)"""


def evidence(spark, sf_dir):
    return D.evaluate_rules(windows(spark, sf_dir), spark.createDataFrame(_RULES, _SHAPE), WINDOW, OVERLAP)


def scores(spark, sf_dir):
    return D.vendor_scores(evidence(spark, sf_dir), spark.createDataFrame(_MOST, "vendor string, max_score double"))


@query("x02_evaluate_rules", f"WITH {_EVIDENCE} SELECT * FROM evi")
def x02(spark, sf_dir):
    return evidence(spark, sf_dir)


@query("x04_detection_status", f"WITH {_EVIDENCE}, b AS (SELECT image_id, vendor, count(*) FILTER (match_status = 'match') AS n_matches, bool_or(exclusive AND match_status = 'match') AS has_exclusive FROM evi GROUP BY image_id, vendor) SELECT *, CASE WHEN n_matches < 2 THEN 'Insufficient' WHEN has_exclusive THEN 'Confirmed' ELSE 'Compatible' END AS status FROM b")
def x04(spark, sf_dir):
    return D.detection_status(evidence(spark, sf_dir))


@query("a01_vendor_scores", f"WITH {_EVIDENCE}, {_SCORES} SELECT image_id, vendor, round(raw_score, 6) AS raw_score, round(confidence, 6) AS confidence, round(quality, 6) AS quality, has_exclusive, insufficient FROM vs")
def a01(spark, sf_dir):
    return scores(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("raw_score", "confidence", "quality")})


@query("a02_classify_top", f"WITH {_EVIDENCE}, {_SCORES} SELECT image_id, vendor, second, round(confidence, 6) AS confidence, round(margin, 6) AS margin, round(quality, 6) AS quality, classification FROM cf WHERE rank = 1")
def a02(spark, sf_dir):
    return D.classify_top(scores(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))).withColumns({c: F.round(c, 6) for c in ("confidence", "margin", "quality")})


@query("a03_classify_all", f"WITH {_EVIDENCE}, {_SCORES} SELECT image_id, rank, vendor, round(confidence, 6) AS confidence, classification FROM cf")
def a03(spark, sf_dir):
    return D.classify_all(scores(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))).withColumns({"confidence": F.round("confidence", 6), "rank": F.col("rank").cast("long")})


@query("a24_detection_depth", f"""WITH {_EVIDENCE}, x AS (SELECT e.*, r.pos AS "offset", r.stop - r.pos AS length FROM evi e JOIN rules r USING (vendor, rule)) SELECT image_id, sum(length)::BIGINT AS bytes_examined, max("offset" + length) AS highest_offset, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (match_status = 'match'), '') AS indicators FROM x GROUP BY image_id""")
def a24(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, _SHAPE).select("vendor", "rule", F.col("at").alias("offset"), (F.col("stop") - F.col("at")).alias("length"))
    return D.detection_depth(evidence(spark, sf_dir).join(F.broadcast(rules), ["vendor", "rule"]))


@query("x14_codec_vote", """WITH u AS (SELECT l_suppkey AS region_id, (l_partkey * 7 + l_linenumber * 3) % 256 AS unit FROM lineitem), v AS (SELECT region_id, sum(CASE WHEN unit < 128 AND unit & 31 IN (7, 8) THEN 2 WHEN unit < 128 AND unit & 31 IN (1, 5) THEN 1 ELSE 0 END)::BIGINT AS h264, sum(CASE WHEN unit < 128 AND (unit >> 1) & 63 IN (32, 33, 34) THEN 2 WHEN unit < 128 AND (unit >> 1) & 63 IN (1, 19, 20) THEN 1 ELSE 0 END)::BIGINT AS h265, count(*) FILTER (unit < 128 AND unit & 31 = 5) AS keyframes FROM u GROUP BY region_id),
c AS (SELECT *, CASE WHEN h264 >= 4 AND h264 - h265 > 2 THEN 'H264' WHEN h265 >= 4 AND h265 - h264 > 2 THEN 'H265' END AS codec FROM v) SELECT *, CASE WHEN codec IS NULL THEN 'REVIEW' ELSE 'PASS' END AS state FROM c""".replace("unit & 31 IN", "(unit & 31) IN").replace("unit & 31 = 5", "(unit & 31) = 5").replace("(unit >> 1) & 63 IN", "((unit >> 1) & 63) IN"))
def x14(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region_id"), ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 3) % 256).alias("unit"))
    return D.codec_vote(units)


@query("x15_keyframe_count", "SELECT l_suppkey AS region_id, count(*) AS keyframes FROM lineitem WHERE (l_partkey * 7 + l_linenumber * 3) % 256 < 128 AND (((l_partkey * 7 + l_linenumber * 3) % 256) & 31) = 5 GROUP BY l_suppkey")
def x15(spark, sf_dir):
    return x14(spark, sf_dir).select("region_id", "keyframes").where("keyframes > 0")


@query("x18_probe_nonzero", f"WITH {_BYTES} SELECT image_id, regexp_matches(substr(h, 1, 128), '[1-9A-F]') AS nonzero FROM byt")
def x18(spark, sf_dir):
    return chunks(spark, sf_dir).select("image_id", C.probe_nonzero(F.substring("data", 1, 64)).alias("nonzero"))


@query("x22_scan_report", f"WITH {_BYTES}, c AS (SELECT image_id % 10 AS image_id, image_id * 50000 AS base_offset, n AS owned_len FROM byt) SELECT image_id, min(base_offset) AS first, max(base_offset + owned_len) AS \"end\", sum(owned_len)::BIGINT AS bytes, CASE WHEN sum(owned_len) >= 250000 THEN 'limit' ELSE 'end of image' END AS termination FROM c GROUP BY image_id")
def x22(spark, sf_dir):
    rows = chunks(spark, sf_dir).select((F.col("image_id") % 10).alias("image_id"), (F.col("image_id") * 50000).alias("base_offset"), "owned_len")
    return D.scan_report(rows, 250000)


@query("p11_content_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha256(substr(text, 11, 50)) AS region_sha256 FROM documents")
def p11(spark, sf_dir):
    data = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", C.content_hash(data)["value"].alias("sha256"), C.content_hash(data, "MD5")["value"].alias("md5"), C.content_hash(F.substring("text", 11, 50).cast("binary"))["value"].alias("region_sha256"))


_LE8 = " || ".join("lpad(to_hex(({0} >> %d) & 255), 2, '0')" % (8 * k) for k in range(8))


@query("p12_fragment_id", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'frag-' || substr(sha256(unhex(hex(encode('tracelake' || l_suppkey)) || {_LE8.format('l_orderkey * 64')} || {_LE8.format('(l_linenumber * 1000)::BIGINT')})), 1, 24) AS fragment_id FROM lineitem")
def p12(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", B.fragment_id("tracelake", F.col("l_suppkey"), F.col("l_orderkey") * 64, F.col("l_linenumber") * 1000).alias("fragment_id"))


def _packed(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    data = F.concat(B.le_bytes(k, 4), B.le_bytes(s, 2), B.le_bytes(k * 40503 - 5000000, 7), B.le_bytes(k * 1000003, 6))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", data.alias("data"))


@query("p10_le_fields", "SELECT p_partkey, p_partkey AS u32, p_size::BIGINT AS u16, p_partkey * 40503 - 5000000 AS i32, p_partkey * 1000003 AS u48, (p_partkey & 255)::INTEGER AS first_byte, NULL::BIGINT AS beyond FROM part")
def p10(spark, sf_dir):
    d = F.col("data")
    return _packed(spark, sf_dir).select("p_partkey", B.le_uint(d, 0, 4).alias("u32"), B.le_uint(d, 4, 2).alias("u16"), B.le_int(d, 6, 7).alias("i32"), B.le_uint(d, 13, 6).alias("u48"), B.byte_at(d, 0).alias("first_byte"), B.le_uint(d, 17, 4).alias("beyond"))


@query("p09_channels", "SELECT p_partkey, (p_partkey & 255) + 1 AS zero_based, CASE WHEN p_size % 2 = 0 THEN p_partkey & 255 ELSE p_partkey & 15 END AS flagged, CASE WHEN p_size BETWEEN 0 AND 31 THEN p_size + 1 END AS bounded FROM part")
def p09(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", B.channel_zero_based(k).alias("zero_based"), B.channel_flagged(k, s % 2 == 0).alias("flagged"), B.channel_bounded(s, 31, 1).alias("bounded"))


@query("x05_explode_entries", """WITH t AS (SELECT p_partkey AS table_id, p_size AS n_declared FROM part), e AS (SELECT table_id, n_declared, unnest(range(0, n_declared)) AS slot FROM t), v AS (SELECT *, (table_id * 31 + slot * 17) % 4096 AS sectors FROM e WHERE slot < 20)
SELECT table_id, slot, sectors, CASE WHEN sectors % 8 = 0 THEN 'Empty' WHEN sectors > 4000 THEN 'Malformed' ELSE 'Occupied' END AS state, least(sectors * 512, 1048576) AS length, n_declared > 20 AS truncated FROM v""")
def x05(spark, sf_dir):
    """A table of two-byte entries (sectors) for each part, cut off after 20 of them, decoded entry by entry."""
    k, n = F.col("p_partkey"), F.col("p_size")
    entries = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(20)) - 1), lambda i: B.le_bytes((k * 31 + i * 17) % 4096, 2))
    data = F.when(n > 0, F.unhex(F.array_join(F.transform(entries, F.hex), ""))).otherwise(F.lit(b""))
    rows = table(spark, sf_dir, "part").select(k.alias("table_id"), n.alias("n_declared"), data.alias("data"))
    slots = C.explode_table(rows, {"sectors": (0, 2)}, 2, F.col("n_declared"))
    sectors = F.col("sectors")
    state = F.when(sectors % 8 == 0, "Empty").when(sectors > 4000, "Malformed").otherwise("Occupied")
    return slots.select("table_id", F.col("entry").alias("slot"), "sectors", state.alias("state"), F.least(sectors * 512, F.lit(1048576)).alias("length"), "truncated")


@query("p13_validation_struct", "SELECT doc_id, quality IS NOT NULL AS valid, CASE WHEN quality = 1 THEN 'PASS' WHEN quality = 0 THEN 'REVIEW' END AS state, CASE WHEN quality IS NOT NULL THEN 'quality ' || quality END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def p13(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "REVIEW").otherwise("UNKNOWN")
    reason = F.coalesce(F.concat(F.lit("quality "), F.col("quality").cast("string")), F.lit(" "))
    v = B.validation(state, reason, "label", F.col("doc_id").cast("string"))
    return rows.select("doc_id", v.alias("v")).select("doc_id", F.col("v").isNotNull().alias("valid"), "v.state", "v.reason")


@query("p16_record_confidence", "SELECT event_id, least(CASE WHEN value > 20 THEN 0.4 ELSE 0 END + CASE WHEN event_type = 'view' THEN 0.3 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 0.4 ELSE 0 END, 0.95)::DOUBLE AS score, concat_ws('; ', CASE WHEN value > 20 THEN 'large' END, CASE WHEN event_type = 'view' THEN 'view' END, CASE WHEN user_id % 2 = 0 THEN 'even' END) AS basis FROM events")
def p16(spark, sf_dir):
    c = B.record_confidence(("large", 0.4, F.col("value") > 20), ("view", 0.3, F.col("event_type") == "view"), ("even", 0.4, F.col("user_id") % 2 == 0))
    return table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", F.round("c.score", 6).alias("score"), "c.basis")


@query("p17_source_safety", "SELECT event_id, CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'reject' ELSE 'accept with warning' END AS decision FROM events")
def p17(spark, sf_dir):
    mode = F.when(F.col("event_type") == "view", "ReadOnly").when(F.col("event_type") == "click", "ReadWrite").otherwise("Unknown")
    return table(spark, sf_dir, "events").select("event_id", B.source_safety(mode).alias("decision"))


@query("p24_integrity_flags", "SELECT event_id, concat_ws(',', CASE WHEN value > 50 THEN 'large' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN user_id % 10 = 0 THEN 'tenth' END) AS flags FROM events")
def p24(spark, sf_dir):
    flags = B.integrity_flags(("large", F.col("value") > 50), ("error", F.col("event_type") == "error"), ("tenth", F.col("user_id") % 10 == 0), ("large", F.col("value") > 60))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(flags, ",").alias("flags"))


@query("p25_vocabulary", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'VALIDATED' WHEN 1 THEN 'PROVISIONAL' WHEN 2 THEN 'VALIDATED' WHEN 3 THEN 'UNVALIDATED' ELSE 'UNKNOWN' END AS state FROM events")
def p25(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ("Validated", " indicative", "CONFIRMED", "unvalidated ", "odd"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", B.normal_state(word).alias("state"))


@query("d15_verify_hashes", "SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN 'MISMATCH' WHEN doc_id % 41 = 0 THEN 'UNKNOWN' ELSE 'MATCH' END AS verdict FROM documents")
def d15(spark, sf_dir):
    """Stored hashes in any case against recomputed ones; no stored hash is unknown."""
    rows = table(spark, sf_dir, "documents").withColumn("own", C.content_hash(F.col("text").cast("binary"))["value"])
    stored = F.when(F.col("doc_id") % 37 == 0, F.sha2(F.lit(b""), 256)).when(F.col("doc_id") % 41 != 0, F.upper("own"))
    return C.verify_hashes(rows.select("doc_id", stored.alias("expected")), rows.select("doc_id", F.col("own").alias("actual")), "doc_id").select("doc_id", "verdict")
