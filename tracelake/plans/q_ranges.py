"""Queries of the interval algebra over ranges from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges as R
from .registry import query
from .views import RANGES, complement, merged, ranges

#: The ranges' universe in each image: from 1000 to the last end and 5000 bytes on.
_U = 'u AS (SELECT image_id, 1000::BIGINT AS lo, max("offset" + length) + 5000 AS hi FROM v_ranges GROUP BY image_id)'


def _universe(df):
    return df.groupBy("image_id").agg(F.lit(1000).cast("long").alias("offset"), (F.max(F.col("offset") + F.col("length")) + 4000).alias("length"))


def _two(spark, sf_dir):
    rows = ranges(spark, sf_dir)
    return rows.where("l_linestatus = 'O'"), rows.where("l_returnflag = 'R'")


_A = """a AS (SELECT * FROM v_ranges WHERE l_linestatus = 'O'), b AS (SELECT * FROM v_ranges WHERE l_returnflag = 'R')"""


@query("i01_merge_ranges", f'WITH {RANGES}, {merged("m", "v_ranges")} SELECT image_id, "offset", length FROM m')
def i01(spark, sf_dir):
    return R.merge_ranges(ranges(spark, sf_dir))


@query("i02_union_ranges", f'WITH {RANGES}, {_A}, ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), {merged("m", "ab")} SELECT image_id, "offset", length FROM m')
def i02(spark, sf_dir):
    return R.union_ranges(*_two(spark, sf_dir))


_INTERSECT = f"""{merged("ma", "a")}, {merged("mb", "b")}, x AS (SELECT ma.image_id, greatest(ma."offset", mb."offset") AS "offset", least(ma."offset" + ma.length, mb."offset" + mb.length) - greatest(ma."offset", mb."offset") AS length
  FROM ma JOIN mb ON ma.image_id = mb.image_id AND ma."offset" < mb."offset" + mb.length AND mb."offset" < ma."offset" + ma.length), {merged("mx", "x")}"""


@query("i03_intersect_ranges", f'WITH {RANGES}, {_A}, {_INTERSECT} SELECT image_id, "offset", length FROM mx')
def i03(spark, sf_dir):
    return R.intersect_ranges(*_two(spark, sf_dir))


_ALL = 'w AS (SELECT image_id, min("offset") AS lo, max("offset" + length) AS hi FROM a GROUP BY image_id)'


@query("i04_subtract_ranges", f"""WITH {RANGES}, {_A}, {_ALL}, {merged("ma", "a")}, {merged("mcut", "b")}, {complement("rest", "mcut", "w")},
x AS (SELECT ma.image_id, greatest(ma."offset", r."offset") AS "offset", least(ma."offset" + ma.length, r."offset" + r.length) - greatest(ma."offset", r."offset") AS length FROM ma JOIN rest r ON ma.image_id = r.image_id AND ma."offset" < r."offset" + r.length AND r."offset" < ma."offset" + ma.length), {merged("mx", "x")}
SELECT image_id, "offset", length FROM mx""")
def i04(spark, sf_dir):
    return R.subtract_ranges(*_two(spark, sf_dir))


@query("i05_complement_ranges", f'WITH {RANGES}, {_U}, {merged("m", "v_ranges")}, {complement("c", "m", "u")} SELECT image_id, "offset", length FROM c')
def i05(spark, sf_dir):
    rows = ranges(spark, sf_dir)
    return R.complement_ranges(rows, _universe(rows))


@query("i06_range_stats", f'WITH {RANGES}, {merged("m", "v_ranges")} SELECT image_id, count(*) AS n_ranges, sum(length)::BIGINT AS total_bytes, min("offset") AS min_offset, max("offset" + length) AS max_end FROM m GROUP BY image_id')
def i06(spark, sf_dir):
    return R.range_stats(ranges(spark, sf_dir))


@query("i06_covers", f"""WITH {RANGES}, {_A}, {merged("m", "a")} SELECT b.image_id, b."offset", b.length, b.l_orderkey, b.l_linenumber, EXISTS (SELECT 1 FROM m WHERE m.image_id = b.image_id AND m."offset" <= b."offset" AND m."offset" + m.length >= b."offset" + b.length) AS covered FROM b""")
def i06b(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return R.covers(a, b.select("image_id", "offset", "length", "l_orderkey", "l_linenumber"))


_CLIP = 'c AS (SELECT image_id, (max("offset") / 4)::BIGINT AS lo, (max("offset") / 2)::BIGINT AS hi FROM v_ranges GROUP BY image_id)'


def _middle(df):
    return df.groupBy("image_id").agg(F.round(F.max("offset") / 4).cast("long").alias("offset"), (F.round(F.max("offset") / 2).cast("long") - F.round(F.max("offset") / 4).cast("long")).alias("length"))


@query("i07_clip_ranges", f"""WITH {RANGES}, {_CLIP} SELECT image_id, least("offset" + length, hi) > greatest("offset", lo) AS inside, CASE WHEN least("offset" + length, hi) > greatest("offset", lo) THEN greatest("offset", lo) ELSE "offset" END AS "offset",
CASE WHEN least("offset" + length, hi) > greatest("offset", lo) THEN least("offset" + length, hi) - greatest("offset", lo) ELSE length END AS length FROM v_ranges JOIN c USING (image_id) WHERE length > 0""")
def i07(spark, sf_dir):
    rows = ranges(spark, sf_dir).select("image_id", "offset", "length")
    inside, excluded = R.clip_ranges(rows, _middle(rows))
    return inside.withColumn("inside", F.lit(True)).unionByName(excluded.withColumn("inside", F.lit(False)))


_CLAIM = f"""clipped AS (SELECT image_id, l_returnflag = 'N' AS accessible, greatest("offset", lo) AS "offset", least("offset" + length, hi) - greatest("offset", lo) AS length FROM v_ranges JOIN u USING (image_id) WHERE least("offset" + length, hi) > greatest("offset", lo) AND l_returnflag <> 'R'),
acc AS (SELECT * FROM clipped WHERE accessible), ava AS (SELECT * FROM clipped WHERE NOT accessible), {merged("mc", "acc")}, {merged("mv", "ava")}, {merged("mb", "clipped")}, {complement("un", "mb", "u")}"""


@query("i08_claim_map", f"""WITH {RANGES}, {_U}, {_CLAIM} SELECT image_id, 'claimed' AS kind, "offset", length FROM mc UNION ALL SELECT image_id, 'available', "offset", length FROM mv UNION ALL SELECT image_id, 'unclaimed', "offset", length FROM un""")
def i08(spark, sf_dir):
    rows = ranges(spark, sf_dir)
    records = rows.where("l_returnflag <> 'R'").select("image_id", (F.col("l_returnflag") == "N").alias("accessible"), "offset", "length")
    return R.claim_map(records, _universe(rows))


@query("i09_split_by_scope", f"""WITH {RANGES}, {_U}, {_CLIP}, {_CLAIM}, s AS (SELECT * FROM c),
x AS (SELECT un.image_id, un."offset" AS lo, un."offset" + un.length AS hi, s.lo AS s_lo, s.hi AS s_hi FROM un JOIN s USING (image_id)),
p AS (SELECT image_id, true AS in_scope, greatest(lo, s_lo) AS lo, least(hi, s_hi) AS hi FROM x UNION ALL SELECT image_id, false, lo, least(hi, s_lo) FROM x UNION ALL SELECT image_id, false, greatest(lo, s_hi), hi FROM x)
SELECT image_id, in_scope, lo AS "offset", hi - lo AS length FROM p WHERE hi > lo""")
def i09(spark, sf_dir):
    rows = ranges(spark, sf_dir)
    return R.split_by_scope(i08(spark, sf_dir).where("kind = 'unclaimed'").drop("kind"), _middle(rows))


@query("i10_coverage", f"""WITH {RANGES}, img AS (SELECT image_id, max("offset" + length) + 70000 AS size_bytes FROM v_ranges GROUP BY image_id), uu AS (SELECT image_id, 0::BIGINT AS lo, size_bytes AS hi FROM img), {merged("m", "v_ranges")}, {complement("h", "m", "uu")},
g AS (SELECT image_id, sum(length)::BIGINT AS unaccounted_bytes, count(*) FILTER (length >= 2000) AS n_holes, max(CASE WHEN length >= 2000 THEN [length, "offset"] END) AS largest FROM h GROUP BY image_id)
SELECT image_id, size_bytes, size_bytes - coalesce(unaccounted_bytes, 0) AS accounted_bytes, coalesce(unaccounted_bytes, 0) AS unaccounted_bytes, CASE WHEN size_bytes > 0 THEN (size_bytes - coalesce(unaccounted_bytes, 0))::DOUBLE / size_bytes ELSE 0 END AS ratio, coalesce(n_holes, 0) AS n_holes, largest[2] AS largest_offset, largest[1] AS largest_length FROM img LEFT JOIN g USING (image_id)""")
def i10(spark, sf_dir):
    rows = ranges(spark, sf_dir)
    images = rows.groupBy("image_id").agg((F.max(F.col("offset") + F.col("length")) + 70000).alias("size_bytes"))
    return R.coverage(rows, images, 2000)


@query("i11_chunk_ranges", f"""WITH {RANGES} SELECT image_id, l_orderkey, l_linenumber, piece, "offset" + piece * 256 AS "offset", least(256, length - piece * 256) AS length FROM (SELECT *, unnest(range(0, (length + 255) // 256)) AS piece FROM v_ranges)""")
def i11(spark, sf_dir):
    return R.chunk_ranges(ranges(spark, sf_dir).select("image_id", "l_orderkey", "l_linenumber", "offset", "length"), 256)


@query("i12_split_at_wrap", f"""WITH {RANGES}, w AS (SELECT image_id, min("offset") + 40 AS wrap_offset FROM v_ranges GROUP BY image_id), x AS (SELECT * FROM v_ranges JOIN w USING (image_id) WHERE wrap_offset > "offset" AND wrap_offset < "offset" + length)
SELECT image_id, l_orderkey, l_linenumber, 'pre' AS part, "offset", wrap_offset - "offset" AS length FROM x UNION ALL SELECT image_id, l_orderkey, l_linenumber, 'post', wrap_offset, "offset" + length - wrap_offset FROM x""")
def i12(spark, sf_dir):
    rows = ranges(spark, sf_dir).select("image_id", "l_orderkey", "l_linenumber", "offset", "length")
    return R.split_at_wrap(rows, rows.groupBy("image_id").agg((F.min("offset") + 40).alias("wrap_offset")))


@query("j01_resolve_claims", f"""WITH {RANGES}, p AS (SELECT image_id, event_id AS point_id, event_id * 997 % 500000 AS point FROM (SELECT event_id, event_id % 10 + 1 AS image_id FROM events)),
c AS (SELECT image_id, l_orderkey * 10 + l_linenumber AS claim_id, l_returnflag = 'N' AS accessible, l_partkey AS index_order, "offset", length FROM v_ranges WHERE l_returnflag <> 'R'),
r AS (SELECT p.image_id, point_id, point, claim_id, accessible, row_number() OVER (PARTITION BY p.image_id, point_id ORDER BY accessible DESC NULLS LAST, index_order, claim_id) AS n FROM p LEFT JOIN c ON p.image_id = c.image_id AND point >= "offset" AND point < "offset" + length)
SELECT image_id, point_id, point, claim_id, accessible FROM r WHERE n = 1""")
def j01(spark, sf_dir):
    from .views import table

    points = table(spark, sf_dir, "events").select((F.col("event_id") % 10 + 1).alias("image_id"), F.col("event_id").alias("point_id"), (F.col("event_id") * 997 % 500000).alias("point"))
    claims = ranges(spark, sf_dir).where("l_returnflag <> 'R'").select("image_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_returnflag") == "N").alias("accessible"), F.col("l_partkey").alias("index_order"), "offset", "length")
    return R.resolve_claims(points, claims)


@query("j02_overlap_join", f"""WITH {RANGES}, {_A}, s AS (SELECT * FROM a), t AS (SELECT * FROM b)
SELECT s.image_id, s."offset" AS a_offset, s.length AS a_length, s.l_orderkey AS a_l_orderkey, t."offset" AS b_offset, t.length AS b_length, t.l_orderkey AS b_l_orderkey FROM s JOIN t ON s.image_id = t.image_id AND s."offset" < t."offset" + t.length AND t."offset" < s."offset" + s.length""")
def j02(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    cols = ["image_id", "offset", "length", "l_orderkey"]
    return R.overlap_join(a.select(*cols), b.select(*cols))


@query("j03_overlapping_pairs", f"""WITH {RANGES}, s AS (SELECT image_id, "offset", length, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS part_id FROM v_ranges)
SELECT DISTINCT s.image_id, s.part_id AS a_part_id, t.part_id AS b_part_id, greatest(s."offset", t."offset") AS "offset", least(s."offset" + s.length, t."offset" + t.length) - greatest(s."offset", t."offset") AS length FROM s JOIN s t ON s.image_id = t.image_id AND s.part_id < t.part_id AND s."offset" < t."offset" + t.length AND t."offset" < s."offset" + s.length""")
def j03(spark, sf_dir):
    rows = ranges(spark, sf_dir).select("image_id", "offset", "length", (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("part_id"))
    return R.overlapping_pairs(rows, "part_id").distinct()


@query("j05_asof_before", f"""WITH {RANGES}, {_A}, l AS (SELECT DISTINCT image_id, "offset" FROM a), r AS (SELECT DISTINCT image_id, "offset" AS marker FROM b)
SELECT l.image_id, l."offset", CASE WHEN l."offset" - r.marker <= 4096 THEN r.marker END AS marker FROM l ASOF LEFT JOIN r ON l.image_id = r.image_id AND l."offset" >= r.marker""")
def j05(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return R.asof_before(a.select("image_id", "offset").distinct(), b, 4096)


@query("j11_uncovered_entries", f"""WITH {RANGES}, {_A} SELECT image_id, l_orderkey, l_linenumber, "offset" AS point FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = a.image_id AND a."offset" >= b."offset" AND a."offset" < b."offset" + b.length)""")
def j11(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    claims = b.select("image_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.lit(True).alias("accessible"), F.lit(0).alias("index_order"), "offset", "length")
    points = a.select("image_id", "l_orderkey", "l_linenumber", F.col("offset").alias("point"))
    return R.resolve_claims(points, claims).where("claim_id is null").drop("claim_id", "accessible")


@query("j14_map_logical", f"""WITH {RANGES}, s AS (SELECT image_id, "offset" AS disk, length, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq FROM v_ranges WHERE l_returnflag = 'A'),
d AS (SELECT image_id, seq, min(disk) AS disk, min(length) AS length FROM s GROUP BY image_id, seq), t AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY image_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d),
q AS (SELECT DISTINCT l_suppkey AS image_id, l_partkey AS range_id, l_partkey * 13 AS lo, 2000 AS n FROM lineitem)
SELECT q.image_id, range_id, seq, disk + greatest(lo, pos) - pos AS "offset", least(lo + n, pos + length) - greatest(lo, pos) AS length FROM q JOIN t ON q.image_id = t.image_id AND lo < pos + length AND pos < lo + n""")
def j14(spark, sf_dir):
    rows = ranges(spark, sf_dir)
    segs = rows.where("l_returnflag = 'A'").groupBy("image_id", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq")).agg(F.min("offset").alias("offset"), F.min("length").alias("length"))
    wanted = rows.select("image_id", F.col("l_partkey").alias("range_id"), (F.col("l_partkey") * 13).alias("offset"), F.lit(2000).cast("long").alias("length")).distinct()
    return R.map_logical(wanted, segs)
