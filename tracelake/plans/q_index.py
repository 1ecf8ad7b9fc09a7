"""Queries of recorder indexes over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as N
from .registry import query
from .views import RANGES, ranges, table

_TWO = """pr AS (SELECT o_orderkey % 20 AS image_id, o_orderkey * 512 AS "offset" FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 20 IN (3, 4)), ba AS (SELECT o_orderkey % 20 AS image_id, o_orderkey * 512 AS "offset" FROM orders WHERE (o_orderkey % 97 <> 0 OR o_orderkey % 20 IN (3, 4)) AND o_orderkey % 20 <> 7),
bo AS (SELECT coalesce(pr.image_id, ba.image_id) AS image_id, pr."offset" AS p, ba."offset" AS b FROM pr FULL JOIN ba ON pr.image_id = ba.image_id AND pr."offset" = ba."offset"), co AS (SELECT image_id, count(*) FILTER (p IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS n_primary_only, count(*) FILTER (p IS NULL) AS n_backup_only FROM bo GROUP BY image_id),
vd AS (SELECT *, CASE WHEN n_both = 0 AND (n_primary_only = 0 OR n_backup_only = 0) THEN 'single' WHEN n_primary_only = 0 AND n_backup_only = 0 THEN 'agree' ELSE 'disagree' END AS verdict FROM co)"""


def two(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 20).alias("image_id"), (F.col("o_orderkey") * 512).alias("offset"), "o_orderkey", "o_orderstatus")
    whole = F.col("image_id").isin(3, 4)
    return rows.where((F.col("o_orderstatus") != "P") | whole).select("image_id", "offset"), rows.where(((F.col("o_orderkey") % 97 != 0) | whole) & (F.col("image_id") != 7)).select("image_id", "offset")


@query("j08_compare_indexes", f"WITH {_TWO} SELECT * FROM vd")
def j08(spark, sf_dir):
    return N.compare_indexes(*two(spark, sf_dir))


@query("j09_select_authority", f"WITH {_TWO} SELECT image_id, CASE WHEN n_backup_only > n_primary_only THEN 'backup' ELSE 'primary' END AS authority, CASE WHEN verdict = 'agree' THEN 'Authoritative' ELSE 'Partial' END AS standing, concat_ws('; ', CASE WHEN verdict <> 'agree' THEN 'indexes ' || verdict END, CASE WHEN n_backup_only > n_primary_only THEN 'backup is more complete' END) AS downgrades FROM vd")
def j09(spark, sf_dir):
    return N.select_authority(j08(spark, sf_dir))


@query("u02_one_sided", f"""WITH {_TWO} SELECT image_id, p AS "offset", 'a' AS side FROM bo WHERE b IS NULL UNION ALL SELECT image_id, b, 'b' FROM bo WHERE p IS NULL""")
def u02(spark, sf_dir):
    return N.one_sided(*two(spark, sf_dir), ["image_id", "offset"])


@query("u04_described_regions", f'WITH {RANGES} SELECT DISTINCT image_id, "offset", length FROM v_ranges')
def u04(spark, sf_dir):
    return N.described_regions(ranges(spark, sf_dir))


@query("j10_select_table", """WITH t AS (SELECT o_custkey % 50 AS image_id, o_orderkey % 4 AS partition, CASE WHEN o_orderkey % 11 = 0 OR o_custkey % 50 > 45 THEN 'primary' ELSE 'secondary' END AS role, o_orderkey * 512 AS "offset" FROM orders WHERE o_custkey % 50 < 48 OR o_orderkey % 11 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY image_id, partition ORDER BY CASE role WHEN 'primary' THEN 0 ELSE 1 END, "offset") AS r, bool_or(role <> 'primary') OVER (PARTITION BY image_id) AS anysec FROM t) SELECT image_id, partition, role, "offset", NOT anysec AS accessible FROM n WHERE r = 1""")
def j10(spark, sf_dir):
    image, key = F.col("o_custkey") % 50, F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").where((image < 48) | (key % 11 == 0))
    return N.select_table(rows.select(image.alias("image_id"), (key % 4).alias("partition"), F.when((key % 11 == 0) | (image > 45), "primary").otherwise("secondary").alias("role"), (key * 512).alias("offset")))


_BLOCKS = """en AS (SELECT l_suppkey AS image_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS entry_id, l_orderkey * 640 + l_linenumber * 64 AS data_offset FROM lineitem WHERE l_returnflag = 'R'), bl AS (SELECT DISTINCT l_suppkey AS image_id, (l_orderkey * 640) // 65536 AS block FROM lineitem WHERE l_linestatus = 'O'),
me AS (SELECT en.*, data_offset // 65536 AS block, bl.block IS NULL AS dangling FROM en LEFT JOIN bl ON bl.image_id = en.image_id AND bl.block = en.data_offset // 65536)"""


def _mapped(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    entries = rows.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("entry_id"), (F.col("l_orderkey") * 640 + F.col("l_linenumber") * 64).alias("data_offset"))
    blocks = rows.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("image_id"), F.floor(F.col("l_orderkey") * 640 / 65536).alias("block")).distinct()
    return N.map_entries(entries, blocks, 65536), blocks


@query("j06_map_entries", f"WITH {_BLOCKS} SELECT image_id, entry_id, data_offset, block, dangling FROM me")
def j06(spark, sf_dir):
    return _mapped(spark, sf_dir)[0].select("image_id", "entry_id", "data_offset", "block", "dangling")


@query("j07_classify_blocks", f"WITH {_BLOCKS}, c AS (SELECT image_id, block, count(*) AS n FROM me WHERE NOT dangling GROUP BY ALL) SELECT bl.image_id, bl.block, coalesce(n, 0) AS n_entries, CASE WHEN bl.block % 17 = 0 THEN 'malformed' WHEN bl.block > 130 THEN 'out of scope' WHEN n > 0 THEN 'referenced' ELSE 'unreferenced' END AS class FROM bl LEFT JOIN c USING (image_id, block)")
def j07(spark, sf_dir):
    mapped, blocks = _mapped(spark, sf_dir)
    rows = blocks.withColumns({"malformed": F.col("block") % 17 == 0, "in_scope": F.col("block") <= 130})
    return N.classify_blocks(rows, mapped).select("image_id", "block", "n_entries", "class")


@query("j04_match_entries", """WITH cp AS (SELECT o_custkey % 40 AS image_id, o_orderkey AS clip_id, o_orderkey // 50 AS block, o_orderkey * 1000 AS "offset", 500 AS length, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 8 END AS channel, o_orderkey * 10 AS s, o_orderkey * 10 + 25 AS e FROM orders), ey AS (SELECT o_custkey % 40 AS image_id, o_orderkey * 7 AS entry_id, o_orderkey // 50 AS block, o_orderkey * 1000 + CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 700 END AS data_offset, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 8 END AS ec, o_orderkey * 10 + 5 AS es, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 10 + 15 END AS ee FROM orders),
j AS (SELECT cp.image_id, clip_id, entry_id, CASE WHEN data_offset >= "offset" AND data_offset < "offset" + length THEN 0 WHEN entry_id IS NOT NULL AND (channel IS NULL OR ec IS NULL OR channel = ec) AND coalesce(s <= ee, true) AND coalesce(es <= e, true) THEN 1 END AS rank FROM cp LEFT JOIN ey ON ey.image_id = cp.image_id AND ey.block = cp.block),
b AS (SELECT image_id, clip_id, min(CASE WHEN rank IS NOT NULL THEN rank * 1000000000000 + entry_id END) AS m FROM j GROUP BY image_id, clip_id) SELECT image_id, clip_id, m % 1000000000000 AS entry_id, CASE m // 1000000000000 WHEN 0 THEN 'offset' WHEN 1 THEN 'channel and time' END AS basis FROM b""")
def j04(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    image, block = (F.col("o_custkey") % 40).alias("image_id"), F.floor(k / 50).alias("block")
    clips = rows.select(image, k.alias("clip_id"), block, (k * 1000).alias("offset"), F.lit(500).alias("length"), F.when(k % 5 > 0, k % 8).alias("channel"), (k * 10).alias("start"), (k * 10 + 25).alias("end"))
    entries = rows.select(image, (k * 7).alias("entry_id"), block, (k * 1000 + F.when(k % 3 == 0, 100).otherwise(700)).alias("data_offset"), F.when(k % 7 > 0, k % 8).alias("entry_channel"), (k * 10 + 5).alias("entry_start"), F.when(k % 4 > 0, k * 10 + 15).alias("entry_end"))
    return N.match_entries(clips, entries)


_SPANS = """ix AS (SELECT image_id, unit, "index", CASE WHEN k % 13 > 0 THEN k * 37 % 70000 END AS "offset" FROM (SELECT o_custkey % 10 AS image_id, o_orderkey // 200 AS unit, o_orderkey AS "index", o_orderkey AS k FROM orders)), nx AS (SELECT *, lead("offset") OVER w AS n, lead("index") OVER w AS more FROM ix WINDOW w AS (PARTITION BY image_id, unit ORDER BY "index")),
bs AS (SELECT *, CASE WHEN "offset" IS NULL THEN 'unusable' WHEN "offset" >= 65536 THEN 'exceeds unit' WHEN more IS NULL THEN 'terminal' WHEN n IS NULL THEN 'next unusable' WHEN n = "offset" THEN 'duplicate' WHEN n < "offset" THEN 'wraparound' ELSE 'adjacent' END AS basis FROM nx),
sp AS (SELECT image_id, unit, "index", "offset", basis, CASE WHEN basis = 'adjacent' THEN least(n, 65536) - "offset" WHEN basis IN ('terminal', 'next unusable', 'wraparound') THEN 65536 - "offset" ELSE 0 END AS length, basis IN ('duplicate', 'unusable', 'exceeds unit') AS lower_bound FROM bs)"""


def _spans(spark, sf_dir):
    k = F.col("o_orderkey")
    entries = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("image_id"), F.floor(k / 200).alias("unit"), k.alias("index"), F.when(k % 13 > 0, k * 37 % 70000).alias("offset"))
    return N.compute_spans(entries, 65536)


@query("w09_compute_spans", f"WITH {_SPANS} SELECT * FROM sp")
def w09(spark, sf_dir):
    return _spans(spark, sf_dir)


@query("a18_unit_summary", f"WITH {_SPANS}, g AS (SELECT image_id, unit, basis, count(*) AS n, sum(length) AS bytes FROM sp GROUP BY ALL) SELECT image_id, unit, sum(n)::BIGINT AS n_entries, sum(CASE WHEN basis <> 'unusable' THEN n ELSE 0 END)::BIGINT AS n_usable, sum(bytes)::BIGINT AS bytes, string_agg(basis || '=' || n, ',' ORDER BY basis || '=' || n) AS bases FROM g GROUP BY image_id, unit")
def a18(spark, sf_dir):
    return N.unit_summary(_spans(spark, sf_dir))


@query("a17_time_index_summary", """WITH x AS (SELECT o_custkey % 30 AS image_id, o_orderkey AS "index", CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_orderkey ELSE epoch(o_orderdate)::BIGINT END AS ts FROM orders), v AS (SELECT *, ts BETWEEN 946684800 AND 4102444800 AS ok FROM x)
SELECT image_id, count(ts) AS n_populated, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_implausible, min("index") FILTER (ts IS NOT NULL) AS first_index, max("index") FILTER (ts IS NOT NULL) AS last_index, min(ts) FILTER (ok) AS earliest, max(ts) FILTER (ok) AS latest FROM v GROUP BY image_id""")
def a17(spark, sf_dir):
    k = F.col("o_orderkey")
    ts = F.when(k % 6 == 0, None).when(k % 7 == 0, k).otherwise(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return N.time_index_summary(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("image_id"), k.alias("index"), ts.alias("ts")))


@query("a19_flow_totals", """WITH x AS (SELECT o_custkey % 30 AS image_id, o_orderkey AS unit, o_orderkey % 1000 AS bytes, o_orderkey % 301 > 0 AS readable FROM orders), n AS (SELECT *, max(CASE WHEN readable THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY unit ROWS UNBOUNDED PRECEDING) AS bad FROM x) SELECT image_id, coalesce(sum(bytes) FILTER (readable), 0)::BIGINT AS scan_bytes, coalesce(sum(bytes) FILTER (bad = 0), 0)::BIGINT AS prefix_bytes FROM n GROUP BY image_id""")
def a19(spark, sf_dir):
    k = F.col("o_orderkey")
    return N.flow_totals(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("image_id"), k.alias("unit"), (k % 1000).alias("bytes"), (k % 301 > 0).alias("readable")))
