"""Queries of linked structures over block tables and index pages from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query
from .views import table

_BLOCKS = """v_blocks AS (SELECT (b - 1) // 1000 AS image_id, b AS block, b - (b - 1) % 10 AS "first", CASE WHEN b % 97 <> 0 AND b % 89 <> 0 AND b % 83 <> 0 AND b % 79 <> 0 AND b % 73 = 0 THEN b + 5 WHEN (b - 1) % 10 = 0 THEN 0 ELSE b - 1 END AS prev,
  CASE WHEN b % 97 = 0 THEN b WHEN b % 89 = 0 THEN b - (b - 1) % 10 WHEN b % 83 = 0 THEN 1000000000 WHEN (b - 1) % 10 = 9 THEN 0 ELSE b + 1 END AS next, b % 97 <> 0 AND b % 89 <> 0 AND b % 83 <> 0 AND b % 79 = 0 AS empty, b * 4096 AS "offset", 4096 AS length, o_custkey % 4 AS channel, epoch(o_orderdate)::BIGINT AS start, epoch(o_orderdate)::BIGINT + 60 AS "end" FROM (SELECT o_orderkey + 1 AS b, * FROM orders))"""


def blocks(spark, sf_dir):
    b = F.col("b")
    rows = table(spark, sf_dir, "orders").withColumn("b", F.col("o_orderkey") + 1)
    rule = F.when(b % 97 == 0, "self").when(b % 89 == 0, "loop").when(b % 83 == 0, "far").when(b % 79 == 0, "empty").when(b % 73 == 0, "back").otherwise("")
    first, start = b - (b - 1) % 10, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    nexts = F.when(rule == "self", b).when(rule == "loop", first).when(rule == "far", F.lit(10**9)).when((b - 1) % 10 == 9, 0).otherwise(b + 1)
    prev = F.when(rule == "back", b + 5).when((b - 1) % 10 == 0, 0).otherwise(b - 1)
    return rows.select(F.floor((b - 1) / 1000).alias("image_id"), b.alias("block"), first.alias("first"), prev.alias("prev"), nexts.alias("next"), (rule == "empty").alias("empty"), (b * 4096).alias("offset"), F.lit(4096).alias("length"), (F.col("o_custkey") % 4).alias("channel"), start.alias("start"), (start + 60).alias("end"))


_WALK = f"""{_BLOCKS}, l AS MATERIALIZED (SELECT a.*, CASE WHEN a.next = 0 THEN 'last' WHEN a.next = a.block THEN 'self' WHEN n.block IS NULL THEN 'out of range' WHEN n.empty THEN 'empty' ELSE 'follow' END AS link, n.prev AS next_prev FROM v_blocks a LEFT JOIN v_blocks n ON n.image_id = a.image_id AND n.block = a.next),
walk AS (SELECT image_id, block AS head, block, 0::BIGINT AS place, [block] AS path FROM l WHERE "first" = block AND NOT empty UNION ALL SELECT w.image_id, w.head, l.next, w.place + 1, list_append(w.path, l.next) FROM walk w JOIN l ON l.image_id = w.image_id AND l.block = w.block WHERE l.link = 'follow' AND NOT list_contains(w.path, l.next)),
m AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM walk x WHERE x.image_id = w.image_id AND x.block = w.head AND x.head < w.head)),
j AS (SELECT m.image_id, m.head, m.place, l.* EXCLUDE (image_id), max(m.place) OVER (PARTITION BY m.image_id, m.head) AS last_place FROM m JOIN l USING (image_id, block))"""
_CHAINS = """ch AS (SELECT image_id, head, count(*) AS n_blocks, arg_max(block, place) AS last_block, count(*) FILTER (place < last_place AND next_prev <> block) AS back_mismatches, arg_max(link, place) AS link FROM j GROUP BY image_id, head),
oc AS (SELECT image_id, head, n_blocks, last_block, back_mismatches, CASE link WHEN 'self' THEN 'self-reference' WHEN 'out of range' THEN 'out of range' WHEN 'empty' THEN 'broken at empty slot' WHEN 'follow' THEN 'loop' ELSE CASE WHEN back_mismatches > 0 THEN 'back-link mismatch' ELSE 'complete' END END AS outcome FROM ch)"""


@query("d01_traverse_chains", f"WITH RECURSIVE {_WALK}, {_CHAINS} SELECT * FROM oc")
def d01(spark, sf_dir):
    return G.traverse_chains(blocks(spark, sf_dir))


@query("d02_unreached_groups", f"""WITH RECURSIVE {_WALK}, u AS (SELECT v.*, v."first" AS grp FROM v_blocks v WHERE NOT empty AND NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = v.image_id AND m.block = v.block)),
e AS (SELECT a.image_id, a.grp, a.block, a.next FROM u a JOIN u b ON b.image_id = a.image_id AND b.grp = a.grp AND b.block = a.next WHERE a.next <> a.block), s AS (SELECT image_id, grp, min(block) AS block, count(*) AS n FROM u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.image_id = u.image_id AND e.next = u.block) GROUP BY image_id, grp),
k AS (SELECT image_id, grp, block, 0 AS place, [block] AS path FROM s WHERE n = 1 UNION ALL SELECT k.image_id, k.grp, e.next, place + 1, list_append(path, e.next) FROM k JOIN e ON e.image_id = k.image_id AND e.block = k.block WHERE NOT list_contains(path, e.next)),
c AS (SELECT u.image_id, u.grp, count(*) AS n_blocks, (SELECT count(*) FROM k WHERE k.image_id = u.image_id AND k.grp = u.grp) AS walked FROM u GROUP BY u.image_id, u.grp)
SELECT u.image_id, u.grp AS "group", u.block, n_blocks, CASE WHEN walked = n_blocks THEN 'links' ELSE 'block number' END AS ordering, row_number() OVER (PARTITION BY u.image_id, u.grp ORDER BY CASE WHEN walked = n_blocks THEN k.place ELSE u.block END) AS rank FROM u JOIN c USING (image_id, grp) LEFT JOIN k ON k.image_id = u.image_id AND k.grp = u.grp AND k.block = u.block""")
def d02(spark, sf_dir):
    return G.unreached(blocks(spark, sf_dir))


@query("d03_chain_summary", f"""WITH RECURSIVE {_WALK}, x AS (SELECT *, lag("offset" + length) OVER (PARTITION BY image_id, head ORDER BY place) AS before, first_value(channel) OVER (PARTITION BY image_id, head ORDER BY place) AS c0 FROM j)
SELECT image_id, head, sum(length)::BIGINT AS bytes, max(c0) AS channel, count(*) FILTER (channel <> c0) AS disagreeing, min(start) AS start, max("end") AS "end", NOT bool_or(coalesce("offset" <> before, false)) AS contiguous FROM x GROUP BY image_id, head""")
def d03(spark, sf_dir):
    return G.chain_summary(blocks(spark, sf_dir))


_PAGES = """pg AS (SELECT image_id, page, CASE WHEN page % 29 = 5 THEN page + 1 WHEN page * 2 + 1 < 1000 AND page % 31 <> 7 THEN page * 2 + 1 END AS next, CASE WHEN page % 41 = 9 THEN 5000000 WHEN page % 37 = 11 THEN (page - 1) // 2 WHEN page * 2 + 2 < 1000 THEN page * 2 + 2 END AS other FROM (SELECT o_orderkey // 1000 AS image_id, o_orderkey % 1000 AS page FROM orders))"""


@query("d04_traverse_pages", f"""WITH RECURSIVE {_PAGES}, e AS MATERIALIZED (SELECT DISTINCT image_id, page, target FROM (SELECT image_id, page, next AS target FROM pg UNION ALL SELECT image_id, page, other FROM pg) WHERE target IS NOT NULL), g AS MATERIALIZED (SELECT e.* FROM e SEMI JOIN pg ON pg.image_id = e.image_id AND pg.page = e.target),
b AS (SELECT image_id, page, 0 AS depth FROM pg WHERE page = 0 UNION SELECT b.image_id, g.target, depth + 1 FROM b JOIN g ON g.image_id = b.image_id AND g.page = b.page WHERE depth < 40), v AS (SELECT image_id, page, min(depth) AS depth FROM b GROUP BY image_id, page),
tree AS (SELECT g.image_id, g.target, min(g.page) AS page FROM g JOIN v p ON p.image_id = g.image_id AND p.page = g.page JOIN v c ON c.image_id = g.image_id AND c.page = g.target WHERE c.depth = p.depth + 1 GROUP BY g.image_id, g.target),
ag AS (SELECT g.image_id, g.page, g.target, v.depth FROM v JOIN g USING (image_id, page) WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.image_id = g.image_id AND t.page = g.page AND t.target = g.target)),
r AS (SELECT image_id, page AS source, target AS page FROM ag UNION SELECT r.image_id, r.source, g.target FROM r JOIN g ON g.image_id = r.image_id AND g.page = r.page), back AS (SELECT DISTINCT image_id, page FROM r WHERE source = page)
SELECT image_id, 'visited' AS kind, page, NULL AS target, depth FROM v UNION ALL SELECT v.image_id, 'out of range', v.page, e.target, v.depth FROM v JOIN e ON e.image_id = v.image_id AND e.page = v.page WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.image_id = e.image_id AND pg.page = e.target)
UNION ALL SELECT image_id, CASE WHEN EXISTS (SELECT 1 FROM back WHERE back.image_id = ag.image_id AND back.page = ag.page) THEN 'cycle' ELSE 'duplicate' END, page, target, depth FROM ag""")
def d04(spark, sf_dir):
    p = F.col("page")
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("image_id"), (F.col("o_orderkey") % 1000).alias("page"))
    pages = rows.select("image_id", "page", F.when(p % 29 == 5, p + 1).when((p * 2 + 1 < 1000) & (p % 31 != 7), p * 2 + 1).alias("next"), F.when(p % 41 == 9, 5000000).when(p % 37 == 11, F.floor((p - 1) / 2)).when(p * 2 + 2 < 1000, p * 2 + 2).alias("other"))
    return G.traverse_pages(pages, pages.where("page = 0"))


@query("d05_chain_accessibility", f"""WITH RECURSIVE {_WALK}, {_CHAINS}, t AS (SELECT *, CASE WHEN head % 50 = 1 THEN 'secondary' ELSE 'primary' END AS table_role FROM oc), x AS (SELECT *, CASE WHEN outcome IN ('complete', 'back-link mismatch') AND table_role = 'primary' THEN NULL WHEN table_role <> 'primary' THEN 'described by a secondary table only' ELSE 'chain is not complete: ' || outcome END AS reason FROM t) SELECT image_id, head, reason IS NULL AS accessible, reason FROM x""")
def d05(spark, sf_dir):
    chains = d01(spark, sf_dir).withColumn("table_role", F.when(F.col("head") % 50 == 1, "secondary").otherwise("primary"))
    return G.accessibility(chains).select("image_id", "head", "accessible", "reason")
