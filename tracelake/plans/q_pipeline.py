"""Queries of whole runs: gates, recovery within a budget, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pipeline as P
from ..operators import ranges as R
from .q_detect import _EVIDENCE, _SCORES, a02
from .q_index import _SPANS, _spans
from .q_recovery import MOST, _CLAIMS, _FRAGMENTS, _IMAGES, _records, places
from .registry import query, uncut
from .views import RANGES, complement, merged, table


@query("d13_pipeline_gates", f"""WITH {_EVIDENCE}, {_SCORES}, g AS (SELECT image_id, classification, CASE WHEN classification IN ('Confirmed', 'CompatibleCandidate') THEN 'proceed' WHEN classification = 'Ambiguous' THEN 'analyst' ELSE 'stop' END AS decision FROM cf WHERE rank = 1),
r AS (SELECT o_custkey AS image_id, count(*) AS n FROM orders WHERE o_custkey % 4 > 0 GROUP BY 1), p AS (SELECT o_custkey AS image_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), c AS (SELECT o_custkey AS image_id, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
x AS (SELECT g.*, CASE WHEN decision = 'proceed' THEN coalesce(r.n, 0) END AS n_recordings, coalesce(p.n, 0) AS pn, coalesce(c.n, 0) AS cn FROM g LEFT JOIN r USING (image_id) LEFT JOIN p USING (image_id) LEFT JOIN c USING (image_id)), y AS (SELECT *, CASE WHEN n_recordings > 0 THEN pn END AS n_gaps FROM x)
SELECT image_id, classification, decision, n_recordings, n_gaps, CASE WHEN n_gaps > 0 THEN cn END AS n_candidates, CASE WHEN decision = 'analyst' THEN 'needs an analyst' WHEN decision = 'stop' THEN 'not identified' WHEN n_recordings = 0 THEN 'no recordings' WHEN n_gaps = 0 THEN 'complete' WHEN cn = 0 THEN 'gaps, nothing recovered' ELSE 'gaps, candidates recovered' END AS outcome FROM y""")
def d13(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("image_id", F.col("o_custkey"))
    return P.run_gates(a02(spark, sf_dir).select("image_id", "classification"), rows.where("o_custkey % 4 > 0"), rows.where("o_orderstatus = 'P'"), rows.where("o_orderkey % 5 = 0"))


_STATES = "CASE WHEN fragment_id % 4 = 0 THEN 'Corrupted' WHEN fragment_id % 5 IN (0, 1) AND fragment_id % 3 = 0 THEN 'Deleted' WHEN fragment_id % 5 = 0 THEN 'Active' WHEN fragment_id % 5 IN (1, 2) THEN 'Orphaned' ELSE 'Unindexed' END"


@query("d08_run_recovery", f"""WITH {RANGES}, {_FRAGMENTS}, {_IMAGES}, {_CLAIMS}, t AS (SELECT image_id, 'claimed' AS kind, "offset", least(length, 262144) AS length FROM mc UNION ALL SELECT image_id, 'available', "offset", least(length, 262144) FROM mv UNION ALL SELECT image_id, 'unclaimed', "offset" + p * 1048576, least(1048576, length - p * 1048576) FROM (SELECT *, unnest(range(0, (length + 1048575) // 1048576)) AS p FROM un)),
n AS (SELECT *, sum(length) OVER w AS upto, row_number() OVER w AS place FROM t WINDOW w AS (PARTITION BY image_id ORDER BY "offset", kind, length ROWS UNBOUNDED PRECEDING)), o AS (SELECT *, upto > 400000 OR place > 450 AS over FROM n), k AS (SELECT *, bool_or(over) OVER (PARTITION BY image_id) AS truncated, bool_or(over) OVER (PARTITION BY image_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS stop FROM o), b AS (SELECT * FROM k WHERE NOT stop),
f AS (SELECT image_id, fragment_id, min(g."offset" // 20) AS pos, {_STATES} AS state FROM v_fragments g WHERE fragment_id % 7 > 0 GROUP BY image_id, fragment_id), h AS (SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM b WHERE b.image_id = f.image_id AND f.pos >= b."offset" AND f.pos < b."offset" + b.length)),
c AS (SELECT image_id, count(*) AS n_candidates, count(*) FILTER (state = 'Active') AS n_active, count(*) FILTER (state = 'Deleted') AS n_deleted, count(*) FILTER (state = 'Orphaned') AS n_orphaned, count(*) FILTER (state = 'Unindexed') AS n_unindexed, count(*) FILTER (state = 'Corrupted') AS n_corrupted FROM h GROUP BY image_id)
SELECT image_id, n_targets, bytes, truncated, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_active, 0) AS n_active, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_orphaned, 0) AS n_orphaned, coalesce(n_unindexed, 0) AS n_unindexed, coalesce(n_corrupted, 0) AS n_corrupted FROM (SELECT image_id, count(*) AS n_targets, sum(length)::BIGINT AS bytes, bool_or(truncated) AS truncated FROM b GROUP BY image_id) LEFT JOIN c USING (image_id)""")
def d08(spark, sf_dir):
    return _recovery(spark, sf_dir, 400000, 450)


@query("d08_run_recovery_whole", uncut("d08_run_recovery", ("upto > 400000 OR place > 450", f"upto > {1 << 62} OR place > {MOST}")))
def d08_whole(spark, sf_dir):
    return _recovery(spark, sf_dir, 1 << 62, MOST)


def _recovery(spark, sf_dir, max_bytes, max_regions):
    i = F.col("fragment_id")
    claim = F.element_at(F.array(*map(F.lit, ("indexed", "available", "unclaimed in scope", "outside scope", "no index"))), (i % 5 + 1).cast("int"))
    # a row a line item: those of a fragment are alike, and count once where they meet the targets
    findings = places(spark, sf_dir).select("image_id", i.alias("region_id"), F.floor(F.col("offset") / 20).alias("offset"), claim.alias("claim"), F.when(i % 3 == 0, "free").otherwise("allocated").alias("allocation"), (i % 7 > 0).alias("present"), F.lit(True).alias("signature"), (i % 4 > 0).alias("valid"))
    records, images = _records(spark, sf_dir)
    return P.run_recovery(records, images, findings, max_bytes, max_regions)


@query("d10_basis_inventory", f"""WITH {_SPANS}, {RANGES}, w AS (SELECT image_id % 10 AS image_id, "offset", length FROM v_ranges WHERE l_returnflag = 'A'), {merged("m", "w")}, uu AS (SELECT image_id, 0::BIGINT AS lo, max("offset" + length) AS hi FROM w GROUP BY image_id), {complement("h", "m", "uu")},
x AS (SELECT image_id, 'indexed' AS basis, unit * 65536 + "offset" AS "offset", length FROM sp WHERE length > 0 UNION ALL SELECT image_id, 'structural', "offset", length FROM h UNION ALL SELECT image_id, 'heuristic', unit * 65536 + "index" % 65536, 512 FROM sp WHERE basis = 'unusable'), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY "offset", basis, length) AS rank, count(*) OVER (PARTITION BY image_id) AS n_all FROM x) SELECT * FROM n WHERE rank <= 500""")
def d10(spark, sf_dir):
    return _inventory(spark, sf_dir, 500)


@query("d10_basis_inventory_whole", uncut("d10_basis_inventory", ("rank <= 500", f"rank <= {MOST}")))
def d10_whole(spark, sf_dir):
    return _inventory(spark, sf_dir, MOST)


def _inventory(spark, sf_dir, most):
    spans = _spans(spark, sf_dir)
    indexed = spans.select("image_id", (F.col("unit") * 65536 + F.col("offset")).alias("offset"), "length")
    residual = spans.where("basis = 'unusable'").select("image_id", (F.col("unit") * 65536 + F.col("index") % 65536).alias("offset"), F.lit(512).alias("length"))
    known = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select((F.col("l_suppkey") % 10).alias("image_id"), (F.col("l_orderkey") * 64 + F.col("l_linenumber") * 8).alias("offset"), (F.floor("l_quantity") * 32).alias("length"))
    universe = known.groupBy("image_id").agg(F.lit(0).cast("long").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("length"))
    return P.basis_inventory(indexed, R.complement_ranges(known, universe), residual, most).withColumn("rank", F.col("rank").cast("long"))
