"""Queries of timelines over segments from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as X
from ..operators import islands as I
from ..operators import ranges as R
from ..operators import timeline as T
from .registry import query
from .views import RANGES, SEGMENTS, complement, merged, ranges, segments, table

_DOMAINS = f"""{SEGMENTS}, d AS (SELECT *, CASE WHEN tz IS NOT NULL THEN 'absolute' ELSE 'device-local' END AS domain FROM v_segments)"""
_STEPS = """st AS (SELECT *, instant - lag(instant) OVER (PARTITION BY image_id, channel, domain ORDER BY instant, "offset") AS step FROM d),
rk AS (SELECT image_id, channel, domain, step, row_number() OVER (PARTITION BY image_id, channel, domain ORDER BY step) AS n, count(*) OVER (PARTITION BY image_id, channel, domain) AS c FROM st WHERE step > 0),
cad AS (SELECT DISTINCT d.image_id, d.channel, d.domain, greatest(coalesce(rk.step, 1), 1) AS cadence FROM d LEFT JOIN rk ON rk.image_id = d.image_id AND rk.channel = d.channel AND rk.domain = d.domain AND rk.n = rk.c // 2 + 1)"""
_SESSIONS = """se AS (SELECT image_id, channel, domain, instant, "offset", length, sum(CASE WHEN step IS NULL OR step >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, channel, domain ORDER BY instant, "offset" ROWS UNBOUNDED PRECEDING) AS session FROM st)"""
_GAPS = """nx AS (SELECT se.*, lead(instant) OVER w AS next_instant, lead("offset") OVER w AS next_offset FROM se WINDOW w AS (PARTITION BY image_id, channel, domain, session ORDER BY instant, "offset")),
gp AS (SELECT nx.*, cadence, next_instant - instant - cadence AS missing FROM nx JOIN cad USING (image_id, channel, domain))"""
_ROLLUP = """ru AS (SELECT image_id, channel, domain, session::BIGINT AS session, min(instant) AS start, max(instant) + max(cadence) AS "end", count(*) AS n_segments, count(*) FILTER (missing >= 30) AS n_gaps, coalesce(sum(missing) FILTER (missing >= 30), 0)::BIGINT AS missing_seconds FROM gp GROUP BY ALL)"""


def domains(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("zone_offset", F.when(F.col("tz").isNotNull(), 19800))
    return T.assign_domain(rows, "zone_offset").drop("zone_offset", "label", "conflict")


@query("p01_parse_time", f"""WITH {SEGMENTS}, t AS (SELECT event_id, instant, CASE event_id % 5 WHEN 0 THEN strftime(make_timestamp(instant * 1000000), '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(make_timestamp(instant * 1000000), '%Y-%m-%dT%H:%M:%S') || '+05:30' WHEN 2 THEN strftime(make_timestamp(instant * 1000000), '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(make_timestamp(instant * 1000000), '%Y-%m-%d %H:%M:%S') ELSE 'at ' || instant END AS text FROM v_segments)
SELECT event_id, text, CASE event_id % 5 WHEN 1 THEN instant - 19800 WHEN 4 THEN NULL ELSE instant END AS parsed, CASE WHEN event_id % 5 < 2 THEN true WHEN event_id % 5 < 4 THEN false END AS explicit_tz FROM t""")
def p01(spark, sf_dir):
    at = F.timestamp_seconds("instant")
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 5 == 1, F.concat(iso, F.lit("+05:30"))).when(F.col("event_id") % 5 == 2, iso).when(F.col("event_id") % 5 == 3, F.replace(iso, F.lit("T"), F.lit(" "))).otherwise(F.concat(F.lit("at "), F.col("instant").cast("string")))
    rows = segments(spark, sf_dir).select("event_id", text.alias("text")).withColumn("p", X.parse_time(F.col("text")))
    return rows.select("event_id", "text", F.unix_seconds("p.instant").alias("parsed"), "p.explicit_tz")


@query("p02_comparable_instant", f"WITH {SEGMENTS} SELECT event_id, CASE WHEN tz IS NOT NULL THEN instant END AS comparable FROM v_segments")
def p02(spark, sf_dir):
    text = F.date_format(F.timestamp_seconds("instant"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return segments(spark, sf_dir).select("event_id", F.unix_seconds(X.comparable(text, F.col("tz"))).alias("comparable"))


_ZONES = ["UTC+05:30", "ist", "Europe/Berlin", "asia/kolkata", "-0330", "Z", "bogus", "UTC+15", "America/New York", "GMT-2", "EST", "5:61"]
_ZONE_SECONDS = [19800, 19800, 3600, 19800, -12600, 0, None, None, -18000, -7200, -18000, None]


@query("p03_zone_resolution", f"""WITH {SEGMENTS} SELECT event_id, CASE event_id % 12 {' '.join(f"WHEN {k} THEN '{z}'" for k, z in enumerate(_ZONES))} END AS zone, CASE event_id % 12 {' '.join(f"WHEN {k} THEN {'NULL' if s is None else s}" for k, s in enumerate(_ZONE_SECONDS))} END::BIGINT AS offset_seconds FROM v_segments""")
def p03(spark, sf_dir):
    zone = F.element_at(F.array(*map(F.lit, _ZONES)), (F.col("event_id") % 12 + 1).cast("int"))
    rows = segments(spark, sf_dir).select("event_id", zone.alias("zone"), F.timestamp_seconds("instant").alias("local"))
    return X.resolve_zone(rows, "zone", "local").select("event_id", "zone", F.col("offset_seconds").cast("long").alias("offset_seconds"))


@query("p04_temporal_domain", f"""WITH {SEGMENTS} SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN tz IS NOT NULL OR channel < 3 THEN 'absolute' ELSE 'device-local' END AS domain, CASE WHEN tz IS NOT NULL THEN 'recorded zone' WHEN channel < 3 THEN 'examiner zone' ELSE 'unknown zone' END AS label, tz IS NOT NULL AND channel < 3 AS conflict, CASE WHEN event_id % 7 = 0 THEN NULL WHEN tz IS NULL AND channel < 3 THEN instant - 7200 ELSE instant END AS instant FROM v_segments""")
def p04(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumns({"zone_offset": F.when(F.col("tz").isNotNull(), 19800), "examiner": F.when(F.col("channel") < 3, 7200), "instant": F.when(F.col("event_id") % 7 != 0, F.col("instant"))})
    return T.assign_domain(rows, "zone_offset", "examiner").select("event_id", "domain", "label", "conflict", "instant")


_PACKED = "(event_id * 2654435761) % 4294967296"


@query("p05_packed_clock", f"""WITH b AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE {_PACKED} END AS v FROM events), f AS (SELECT event_id, v, v & 63 AS s, (v >> 6) & 63 AS mi, (v >> 12) & 31 AS h, (v >> 17) & 31 AS d, (v >> 22) & 15 AS mo, ((v >> 26) & 63) + 2000 AS y FROM b),
g AS (SELECT *, v <> 0 AND s < 60 AND mi < 60 AND h < 24 AND mo BETWEEN 1 AND 12 AND d >= 1 AND CASE WHEN mo BETWEEN 1 AND 12 THEN d <= day(last_day(make_date(y::INT, mo::INT, 1))) ELSE false END AS ok FROM f)
SELECT event_id, CASE WHEN ok THEN epoch(make_timestamp(y::BIGINT, mo::BIGINT, d::BIGINT, h::BIGINT, mi::BIGINT, s::DOUBLE))::BIGINT END AS decoded, CASE WHEN v = 0 THEN 'absent' WHEN NOT ok THEN 'invalid calendar' END AS reason FROM g""")
def p05(spark, sf_dir):
    value = F.when(F.col("event_id") % 50 == 0, 0).otherwise(F.expr(_PACKED)).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", X.packed_clock(value).alias("p"))
    return rows.select("event_id", F.unix_seconds("p.time").alias("decoded"), "p.reason")


@query("p06_unix_clock", """WITH b AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 2147483647 WHEN 1 THEN 0 WHEN 2 THEN -event_id ELSE event_id * 300000 END AS v FROM events),
r AS (SELECT *, CASE WHEN v = 2147483647 THEN 'incomplete' WHEN v = 0 THEN 'zero' WHEN v < 0 THEN 'negative' WHEN v < 946684800 OR v > 1893456000 THEN 'implausible' END AS reason FROM b)
SELECT event_id, CASE WHEN reason IS NULL OR reason = 'implausible' THEN v END AS decoded, CASE WHEN reason IS NULL THEN 'High' WHEN reason = 'implausible' THEN 'Low' ELSE 'None' END AS confidence, reason FROM r""")
def p06(spark, sf_dir):
    kind = F.col("event_id") % 6
    value = F.when(kind == 0, 2**31 - 1).when(kind == 1, 0).when(kind == 2, -F.col("event_id")).otherwise(F.col("event_id") * 300000)
    rows = table(spark, sf_dir, "events").select("event_id", X.unix_clock(value, 946684800, 1893456000).alias("p"))
    return rows.select("event_id", F.unix_seconds("p.time").alias("decoded"), "p.confidence", "p.reason")


@query("p08_start_and_span", f"""WITH {SEGMENTS}, b AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN instant END AS a, CASE WHEN event_id % 9 > 0 THEN instant - 5 END AS b, instant + (event_id % 20 - 4) * 60000 AS e FROM v_segments)
SELECT event_id, coalesce(a, b) AS start, a IS NULL AND b IS NOT NULL AS from_secondary, coalesce(e >= coalesce(a, b) AND e - coalesce(a, b) <= 604800, false) AS span_ok FROM b""")
def p08(spark, sf_dir):
    rows = segments(spark, sf_dir)
    a, b = F.when(F.col("event_id") % 3 > 0, F.col("instant")), F.when(F.col("event_id") % 9 > 0, F.col("instant") - 5)
    return rows.select("event_id", X.start_and_span(a, b, F.col("instant") + (F.col("event_id") % 20 - 4) * 60000).alias("p")).select("event_id", "p.*")


@query("p19_filter_timeline", f"""WITH {SEGMENTS} SELECT event_id, image_id, channel, kind, instant FROM v_segments WHERE channel IN (1, 3) AND kind IN ('view', 'click', 'error') AND strftime(make_timestamp(instant * 1000000), '%Y-%m-%d') IN ('2024-01-05', '2024-01-06', '2024-01-20') AND instant % 86400 BETWEEN 8 * 3600 AND 18 * 3600 + 59""")
def p19(spark, sf_dir):
    return T.filter_timeline(segments(spark, sf_dir), [1, 3], ["view", "click", "error"], ["2024-01-05", "2024-01-06", "2024-01-20"], (480, 1080)).select("event_id", "image_id", "channel", "kind", "instant")


@query("w01_timeline_gaps", f"""WITH {SEGMENTS}, n AS (SELECT *, lead(instant) OVER w AS next_instant, lead("offset") OVER w AS next_offset FROM v_segments WHERE tz IS NOT NULL WINDOW w AS (PARTITION BY image_id, channel ORDER BY instant, "offset"))
SELECT image_id, channel, instant AS gap_start, next_instant AS gap_end, next_instant - instant AS gap_seconds, "offset", next_offset FROM n WHERE next_instant - instant > 120""")
def w01(spark, sf_dir):
    return T.timeline_gaps(segments(spark, sf_dir).where("tz is not null"))


@query("w02_cadence", f"WITH {_DOMAINS}, {_STEPS} SELECT * FROM cad")
def w02(spark, sf_dir):
    return T.cadence(domains(spark, sf_dir))


@query("w03_sessionize", f'WITH {_DOMAINS}, {_STEPS}, {_SESSIONS} SELECT image_id, channel, domain, instant, "offset", session::BIGINT AS session FROM se')
def w03(spark, sf_dir):
    return T.sessionize(domains(spark, sf_dir)).select("image_id", "channel", "domain", "instant", "offset", "session")


@query("w04_session_gaps", f"""WITH {_DOMAINS}, {_STEPS}, {_SESSIONS}, {_GAPS} SELECT image_id, channel, domain, session::BIGINT AS session, instant + cadence AS gap_start, next_instant AS gap_end, missing AS missing_seconds, "offset" AS previous_offset, length AS previous_length, next_offset FROM gp WHERE missing >= 30""")
def w04(spark, sf_dir):
    rows = domains(spark, sf_dir)
    return T.session_gaps(T.sessionize(rows), T.cadence(rows))


_SESSION_ROWS = """SELECT image_id, channel, domain, session, 'ch' || channel || CASE WHEN domain = 'absolute' THEN '-' ELSE '-local-' END || start AS session_id, start, "end", n_segments, n_gaps, "end" - start AS span_seconds, missing_seconds, greatest("end" - start - missing_seconds, 0) AS covered_seconds, CASE WHEN "end" = start THEN 1 ELSE greatest("end" - start - missing_seconds, 0)::DOUBLE / ("end" - start) END AS ratio FROM ru"""


@query("a04_session_rollup", f"WITH {_DOMAINS}, {_STEPS}, {_SESSIONS}, {_GAPS}, {_ROLLUP} {_SESSION_ROWS}")
def a04(spark, sf_dir):
    return T.session_rollup(domains(spark, sf_dir))


@query("a05_timeline_summary", f"""WITH {_DOMAINS}, {_STEPS}, {_SESSIONS}, {_GAPS}, {_ROLLUP}, x AS (SELECT image_id, count(DISTINCT channel) AS n_channels, count(*) AS n_sessions, sum(n_segments)::BIGINT AS n_segments, sum(missing_seconds)::BIGINT AS missing_seconds FROM ru GROUP BY image_id)
SELECT x.*, n_without_time, n_unknown_zone FROM x JOIN (SELECT image_id, count(*) FILTER (instant IS NULL) AS n_without_time, count(*) FILTER (tz IS NULL) AS n_unknown_zone FROM v_segments GROUP BY image_id) USING (image_id)""")
def a05(spark, sf_dir):
    return T.timeline_summary(a04(spark, sf_dir), segments(spark, sf_dir))


@query("a06_gap_analysis", f"""WITH {SEGMENTS}, n AS (SELECT *, lead(instant) OVER (PARTITION BY image_id, channel ORDER BY instant, "offset") - instant AS gap FROM v_segments WHERE tz IS NOT NULL), t AS (SELECT image_id, count(*) AS n_gaps, sum(gap)::BIGINT AS gap_seconds FROM n WHERE gap > 120 GROUP BY image_id),
s AS (SELECT image_id, count(*) AS n_events, count(*) FILTER (tz IS NULL) AS n_excluded FROM v_segments GROUP BY image_id), uu AS (SELECT image_id, 0::BIGINT AS lo, max("offset" + length) + 100000 AS hi FROM v_segments GROUP BY image_id), {merged("m", "v_segments")}, {complement("h", "m", "uu")}, g AS (SELECT image_id, count(*) FILTER (length >= 4000) AS n_holes, sum(length)::BIGINT AS unaccounted_bytes FROM h GROUP BY image_id)
SELECT image_id, n_events, n_excluded, coalesce(n_gaps, 0) AS n_gaps, coalesce(gap_seconds, 0) AS gap_seconds, coalesce(n_holes, 0) AS n_holes, coalesce(unaccounted_bytes, 0) AS unaccounted_bytes, CASE WHEN n_events = n_excluded THEN 'UNKNOWN' WHEN n_excluded > 0 THEN 'REVIEW' ELSE 'PASS' END AS state, CASE WHEN n_events = n_excluded THEN 'no event has a comparable time' WHEN n_excluded > 0 THEN n_excluded || ' events have no comparable time' ELSE 'all events have a comparable time' END AS reason FROM s LEFT JOIN t USING (image_id) LEFT JOIN g USING (image_id)""")
def a06(spark, sf_dir):
    rows = segments(spark, sf_dir)
    images = rows.groupBy("image_id").agg((F.max(F.col("offset") + F.col("length")) + 100000).alias("size_bytes"))
    return T.analyze_gaps(w01(spark, sf_dir), R.coverage(rows, images, 4000), rows)


@query("w14_correlate_events", f"""WITH RECURSIVE {SEGMENTS}, t AS MATERIALIZED (SELECT DISTINCT image_id, instant FROM v_segments), a AS (SELECT image_id, min(instant) AS anchor FROM t GROUP BY image_id UNION ALL SELECT a.image_id, (SELECT min(instant) FROM t WHERE t.image_id = a.image_id AND t.instant > a.anchor + 60) FROM a WHERE a.anchor IS NOT NULL),
g AS (SELECT s.image_id, s.channel, s.instant, s.tz, x.anchor FROM v_segments s ASOF JOIN (SELECT * FROM a WHERE anchor IS NOT NULL) x ON s.image_id = x.image_id AND s.instant >= x.anchor),
r AS (SELECT image_id, anchor, max(instant) AS last, count(*) AS n_events, string_agg(DISTINCT channel::VARCHAR, ',' ORDER BY channel::VARCHAR) AS channels, bool_or(tz IS NULL) AS unsure FROM g GROUP BY image_id, anchor HAVING count(DISTINCT channel) > 1)
SELECT image_id, 'CORR-' || lpad((row_number() OVER (PARTITION BY image_id ORDER BY anchor))::VARCHAR, 4, '0') AS correlation_id, anchor, last, n_events, channels, CASE WHEN unsure THEN 'REVIEW' ELSE 'PASS' END AS state FROM r""")
def w14(spark, sf_dir):
    return T.correlate(segments(spark, sf_dir), 60)


@query("w13_greedy_non_overlap", f"""WITH RECURSIVE {RANGES}, d AS MATERIALIZED (SELECT image_id, "offset", min(length) AS length FROM v_ranges GROUP BY ALL), k AS (SELECT image_id, min("offset") AS lo, arg_min("offset" + length, "offset") AS hi FROM d GROUP BY image_id UNION ALL SELECT k.image_id, n.lo, n.hi FROM k, LATERAL (SELECT min(d."offset") AS lo, arg_min(d."offset" + d.length, d."offset") AS hi FROM d WHERE d.image_id = k.image_id AND d."offset" >= k.hi) n WHERE n.lo IS NOT NULL)
SELECT image_id, lo AS "offset", hi - lo AS length FROM k""")
def w13(spark, sf_dir):
    rows = ranges(spark, sf_dir).groupBy("image_id", "offset").agg(F.min("length").alias("length"))
    return I.greedy_non_overlap(rows, ["image_id"])


_ANCHORS = f"{SEGMENTS}, an AS (SELECT user_id AS device, instant AS recorder, instant + k AS reference FROM v_segments)"


def anchors(spark, sf_dir):
    return segments(spark, sf_dir).select(F.col("user_id").alias("device"), F.col("instant").alias("recorder"), (F.col("instant") + F.col("k")).alias("reference"))


_FIT = """mid AS (SELECT device, avg(recorder) AS m, count(*) AS n_anchors, count(DISTINCT recorder) AS times, avg(reference - recorder) AS o FROM an GROUP BY device),
fit AS (SELECT an.device, regr_slope(reference - recorder, recorder - m) AS s FROM an JOIN mid USING (device) GROUP BY an.device), bo AS (SELECT mid.*, CASE WHEN times > 1 THEN s ELSE 0 END AS drift FROM mid JOIN fit USING (device))"""


@query("a07_fit_clock", f"""WITH {_ANCHORS}, {_FIT} SELECT bo.device, n_anchors, CASE WHEN n_anchors = 1 THEN 'single offset' WHEN times = 1 THEN 'coincident average' ELSE 'least squares' END AS method, round((o - drift * m)::DOUBLE, 2) AS "offset", round(drift, 9) AS drift, round(max(abs(reference - recorder - o - drift * (recorder - m))), 6) AS max_residual FROM bo JOIN an USING (device) GROUP BY ALL""")
def a07(spark, sf_dir):
    return T.fit_clock(anchors(spark, sf_dir)).withColumns({"offset": F.round("offset", 2), "drift": F.round("drift", 9), "max_residual": F.round("max_residual", 6)})


@query("a08_apply_clock", f"""WITH {_ANCHORS}, {_FIT} SELECT device, recorder, reference, round(recorder + o + drift * (recorder - m))::BIGINT AS corrected FROM an JOIN bo USING (device) WHERE abs(recorder + o + drift * (recorder - m) - floor(recorder + o + drift * (recorder - m)) - 0.5) > 0.001""")
def a08(spark, sf_dir):
    fit = T.fit_clock(anchors(spark, sf_dir))
    raw = F.col("recorder") + F.col("__o") + F.col("__d") * F.col("recorder")
    rows = T.apply_clock(anchors(spark, sf_dir), fit, "recorder").join(fit.select("device", F.col("offset").alias("__o"), F.col("drift").alias("__d")), "device")
    return rows.where(F.abs(raw - F.floor(raw) - 0.5) > 0.001).select("device", "recorder", "reference", "corrected")


def _events(spark, sf_dir):
    rows = segments(spark, sf_dir)
    return rows.withColumns({"native": F.when(F.col("event_id") % 11 != 0, F.date_format(F.timestamp_seconds("instant"), "yyyy-MM-dd HH:mm")), "description": F.col("kind"), "offset": F.when(F.col("event_id") % 13 != 0, F.col("offset") % 100000), "instant": F.when(F.col("event_id") % 17 != 0, F.col("instant"))}).select("image_id", "channel", "native", "instant", "offset", "description", "tz", "event_id")


_EVENTS = f"""{SEGMENTS}, ev AS (SELECT image_id, channel, CASE WHEN event_id % 11 <> 0 THEN strftime(make_timestamp(instant * 1000000), '%Y-%m-%d %H:%M') END AS native, CASE WHEN event_id % 17 <> 0 THEN instant END AS instant, CASE WHEN event_id % 13 <> 0 THEN "offset" % 100000 END AS "offset", kind AS description, tz, event_id FROM v_segments)"""
_KEYS = {
    "physical": '"offset" NULLS LAST, channel, native NULLS FIRST, instant NULLS FIRST, description, event_id',
    "native": 'native NULLS FIRST, channel, instant NULLS FIRST, "offset" NULLS LAST, description, event_id',
    "normalized": 'instant NULLS LAST, "offset" NULLS LAST, channel, native NULLS FIRST, description, event_id',
}


def _ordered(name, kind):
    @query(name, f"WITH {_EVENTS} SELECT image_id, event_id, row_number() OVER (PARTITION BY image_id ORDER BY {_KEYS[kind]}) AS place FROM ev")
    def run(spark, sf_dir):
        return T.order_timeline(_events(spark, sf_dir), kind).select("image_id", "event_id", F.col("place").cast("long").alias("place"))


_ordered("o01_order_physical", "physical")
_ordered("o02_order_native", "native")
_ordered("o03_order_normalized", "normalized")


@query("o03_order_state", f"WITH {_EVENTS} SELECT image_id, count(instant) AS n_timed, count(*) FILTER (tz IS NULL) AS n_unknown_zone, CASE WHEN count(instant) = 0 THEN 'UNKNOWN' WHEN count(*) FILTER (tz IS NULL) > 0 THEN 'REVIEW' ELSE 'PASS' END AS state FROM ev GROUP BY image_id")
def o03(spark, sf_dir):
    return T.order_state(_events(spark, sf_dir))


@query("o04_sort_rows", f"WITH {SEGMENTS} SELECT image_id, event_id, row_number() OVER (PARTITION BY image_id ORDER BY length DESC NULLS LAST, event_id) AS place FROM v_segments")
def o04(spark, sf_dir):
    return T.sort_rows(segments(spark, sf_dir), "length", True, ["event_id"]).select("image_id", "event_id", F.col("place").cast("long").alias("place"))


@query("o05_latest", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def o05(spark, sf_dir):
    return T.latest(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "text")


@query("o06_cap_rows", f"WITH {SEGMENTS} SELECT image_id, event_id, rank, n_all FROM (SELECT image_id, event_id, row_number() OVER (PARTITION BY image_id ORDER BY instant, event_id) AS rank, count(*) OVER (PARTITION BY image_id) AS n_all FROM v_segments) WHERE rank <= 150")
def o06(spark, sf_dir):
    return T.cap_rows(segments(spark, sf_dir), ["image_id"], ["instant", "event_id"], 150).select("image_id", "event_id", F.col("rank").cast("long").alias("rank"), "n_all")


@query("o07_order_sessions", f"WITH {_DOMAINS}, {_STEPS}, {_SESSIONS}, {_GAPS}, {_ROLLUP} SELECT image_id, channel, domain, session, row_number() OVER (PARTITION BY image_id ORDER BY domain, start, channel) AS place FROM ru")
def o07(spark, sf_dir):
    return T.order_sessions(a04(spark, sf_dir)).select("image_id", "channel", "domain", "session", "place")


@query("a23_facets", f"WITH {SEGMENTS} SELECT DISTINCT image_id, 'channel' AS facet, channel::VARCHAR AS value FROM v_segments UNION ALL SELECT DISTINCT image_id, 'date', strftime(make_timestamp(instant * 1000000), '%Y-%m-%d') FROM v_segments")
def a23(spark, sf_dir):
    return T.facets(segments(spark, sf_dir))


@query("u01_final_events", f"""WITH {SEGMENTS} SELECT image_id, channel, instant, kind, NULL AS fragment_id, 'preliminary' AS origin FROM v_segments WHERE tz IS NOT NULL UNION ALL SELECT image_id, channel, instant, NULL, event_id, 'recovered' FROM v_segments WHERE tz IS NULL""")
def u01(spark, sf_dir):
    rows = segments(spark, sf_dir)
    recovered = rows.where("tz is null").select("image_id", "channel", "instant", F.col("event_id").alias("fragment_id"))
    return T.final_events(rows.where("tz is not null").select("image_id", "channel", "instant", "kind"), recovered)


@query("u03_recovery_targets", f"""WITH {SEGMENTS}, n AS (SELECT *, lead(instant) OVER w - instant AS gap, lead("offset") OVER w AS next_offset FROM v_segments WHERE tz IS NOT NULL WINDOW w AS (PARTITION BY image_id, channel ORDER BY instant, "offset")), uu AS (SELECT image_id, 0::BIGINT AS lo, max("offset" + length) AS hi FROM v_segments GROUP BY image_id), {merged("m", "v_segments")}, {complement("h", "m", "uu")},
x AS (SELECT image_id, 'temporal' AS source, least("offset", next_offset) AS scan_start, abs(next_offset - "offset") AS scan_bytes FROM n WHERE gap > 120 UNION ALL SELECT image_id, 'physical', "offset", length FROM h) SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY scan_start, source, scan_bytes) AS place FROM x""")
def u03(spark, sf_dir):
    rows = segments(spark, sf_dir)
    universe = rows.groupBy("image_id").agg(F.lit(0).cast("long").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("length"))
    return T.recovery_targets(w01(spark, sf_dir), R.complement_ranges(rows, universe)).withColumn("place", F.col("place").cast("long"))


@query("d23_examiner_zone", "SELECT conv_id AS image_id, arg_max(CASE WHEN role = 'user' THEN 'UTC+' || lpad((turn % 14)::VARCHAR, 2, '0') || ':00' ELSE '' END, turn) AS tz, max(turn) AS established_at FROM conversations GROUP BY conv_id")
def d23(spark, sf_dir):
    """The latest assertion wins; an empty one clears."""
    zone = F.when(F.col("role") == "user", F.concat(F.lit("UTC+"), F.lpad((F.col("turn") % 14).cast("string"), 2, "0"), F.lit(":00"))).otherwise("")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), zone.alias("tz"), F.col("turn").alias("established_at"))
    return T.latest(rows, ["image_id"], ["established_at"]).select("image_id", "tz", "established_at")
