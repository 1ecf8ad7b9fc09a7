"""Queries of recovery over fragments from lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recovery as V
from ..operators.ranges import dealt
from .registry import query, uncut
from .views import RANGES, complement, merged, ranges, table

#: Rows that agree in all columns are one fragment, so that ids are unique.
_FRAGMENTS = """v_fragments AS (SELECT l_suppkey AS image_id, (l_orderkey * 100000 + l_partkey) * 10 + l_linenumber AS fragment_id, CASE WHEN l_returnflag = 'N' THEN l_orderkey END AS parent, CASE WHEN l_returnflag <> 'A' THEN l_orderkey % 16 END AS channel, l_suppkey % 3 AS partition, CASE WHEN l_linenumber % 5 > 0 THEN l_orderkey // 100 END AS region_id, l_orderkey AS group_id,
  CASE WHEN l_orderkey % 9 > 0 THEN l_linenumber + l_partkey % 4 END AS sequence, CASE WHEN l_orderkey % 8 > 0 THEN epoch(min(l_shipdate))::BIGINT // 86400 * 86400 END AS ts, min(l_orderkey * 640 + l_linenumber * 64) AS "offset", min(floor(l_quantity)::BIGINT) * 16 AS length, min(CASE WHEN l_linestatus = 'F' THEN 'Active' ELSE 'Orphaned' END) AS state FROM lineitem GROUP BY l_suppkey, l_orderkey, l_partkey, l_linenumber, l_returnflag)"""


def fragments(spark, sf_dir):
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    at = F.min(F.unix_seconds(F.col("l_shipdate").cast("timestamp")))
    grouped = rows.groupBy("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").agg(at.alias("at"), F.min(F.floor("l_quantity")).alias("q"), F.bool_or(F.col("l_linestatus") == "F").alias("active"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return grouped.select(
        F.col("l_suppkey").alias("image_id"),
        ((o * 100000 + F.col("l_partkey")) * 10 + n).alias("fragment_id"),
        F.when(F.col("l_returnflag") == "N", o).alias("parent"),
        F.when(F.col("l_returnflag") != "A", o % 16).alias("channel"),
        (F.col("l_suppkey") % 3).alias("partition"),
        F.when(n % 5 > 0, F.floor(o / 100)).alias("region_id"),
        o.alias("group_id"),
        F.when(o % 9 > 0, n + F.col("l_partkey") % 4).alias("sequence"),
        F.when(o % 8 > 0, F.floor(F.col("at") / 86400) * 86400).alias("ts"),
        (o * 640 + n * 64).alias("offset"),
        (F.col("q") * 16).alias("length"),
        F.when(F.col("active"), "Active").otherwise("Orphaned").alias("state"),
    )


def places(spark, sf_dir):
    """Where fragments lie (image_id, fragment_id, offset), as often as they have line items."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), ((o * 100000 + F.col("l_partkey")) * 10 + n).alias("fragment_id"), (o * 640 + n * 64).alias("offset"))


_REGIONS = """rg AS (SELECT fragment_id, image_id, "offset", length, CASE fragment_id % 5 WHEN 0 THEN 'indexed' WHEN 1 THEN 'available' WHEN 2 THEN 'unclaimed in scope' WHEN 3 THEN 'outside scope' ELSE 'no index' END AS claim, CASE WHEN fragment_id % 3 = 0 THEN 'free' ELSE 'allocated' END AS allocation, fragment_id % 11 > 0 AS present, fragment_id % 13 > 0 AS signature, fragment_id % 4 > 0 AS valid FROM v_fragments),
cl AS (SELECT fragment_id, image_id, "offset", length, claim, CASE WHEN NOT valid THEN 'Corrupted' WHEN claim IN ('indexed', 'available') AND allocation = 'free' THEN 'Deleted' WHEN claim = 'indexed' THEN 'Active' WHEN claim IN ('available', 'unclaimed in scope') THEN 'Orphaned' ELSE 'Unindexed' END AS data_state, CASE WHEN valid THEN 'Recoverable' ELSE 'PartiallyRecoverable' END AS status, CASE WHEN claim = 'indexed' THEN 'L1' WHEN claim IN ('available', 'unclaimed in scope') THEN 'L2' ELSE 'L3' END AS level FROM rg WHERE present AND signature)"""


def regions(spark, sf_dir):
    i = F.col("fragment_id")
    claim = F.element_at(F.array(*map(F.lit, ("indexed", "available", "unclaimed in scope", "outside scope", "no index"))), (i % 5 + 1).cast("int"))
    return fragments(spark, sf_dir).select("fragment_id", "image_id", "offset", "length", claim.alias("claim"), F.when(i % 3 == 0, "free").otherwise("allocated").alias("allocation"), (i % 11 > 0).alias("present"), (i % 13 > 0).alias("signature"), (i % 4 > 0).alias("valid"))


_CLASSES = ["fragment_id", "image_id", "offset", "length", "claim", "data_state", "status", "level"]


@query("p15_classify_regions", f"WITH {_FRAGMENTS}, {_REGIONS} SELECT * FROM cl")
def p15(spark, sf_dir):
    return V.classify_regions(regions(spark, sf_dir)).select(*_CLASSES)


@query("p14_coarse_assessment", f"WITH {_FRAGMENTS}, {_REGIONS} SELECT fragment_id, CASE WHEN fragment_id % 17 = 0 THEN 'Overwritten' WHEN NOT present THEN 'Unrecoverable' WHEN NOT valid THEN 'Corrupted' WHEN claim = 'indexed' THEN 'Active' ELSE 'Orphaned' END AS assessment FROM rg")
def p14(spark, sf_dir):
    return regions(spark, sf_dir).select("fragment_id", V.coarse_assessment(F.col("claim") == "indexed", F.col("present"), F.col("valid"), F.col("fragment_id") % 17 == 0).alias("assessment"))


@query("w05_sequence_gaps", f"""WITH {_FRAGMENTS}, n AS (SELECT group_id, sequence, lag(sequence) OVER (PARTITION BY group_id ORDER BY sequence, "offset") AS previous FROM v_fragments WHERE sequence IS NOT NULL) SELECT group_id, previous, sequence, sequence - previous - 1 AS missing FROM n WHERE sequence > previous + 1""")
def w05(spark, sf_dir):
    return V.sequence_gaps(fragments(spark, sf_dir).where("sequence is not null"))


@query("w06_discontinuities", f"""WITH {_FRAGMENTS}, n AS (SELECT *, lag("offset") OVER w AS previous_offset, lag("offset" + length) OVER w AS e FROM v_fragments WHERE sequence IS NOT NULL WINDOW w AS (PARTITION BY group_id ORDER BY sequence, "offset", length)) SELECT group_id, sequence, previous_offset, "offset", CASE WHEN "offset" < previous_offset THEN 'wrap' ELSE 'fragmented' END AS kind, CASE WHEN "offset" >= previous_offset THEN greatest("offset" - e, 0) END AS distance FROM n WHERE "offset" <> e""")
def w06(spark, sf_dir):
    return V.discontinuities(fragments(spark, sf_dir).where("sequence is not null"))


@query("w07_order_frames", f"""WITH {_FRAGMENTS}, f AS (SELECT group_id, fragment_id, "offset" * 3 AS "offset", length AS size, ts, fragment_id % 6 > 0 AS valid FROM v_fragments), n AS (SELECT *, row_number() OVER w AS p, lag("offset" + size) OVER w AS e FROM f WINDOW w AS (PARTITION BY group_id, valid ORDER BY ts NULLS LAST, "offset", size, fragment_id)) SELECT group_id, fragment_id, CASE WHEN valid THEN p END AS place, CASE WHEN valid AND "offset" > e + 1024 THEN "offset" - e END AS gap_bytes FROM n""")
def w07(spark, sf_dir):
    rows = fragments(spark, sf_dir).select("group_id", "fragment_id", (F.col("offset") * 3).alias("offset"), F.col("length").alias("size"), "ts", (F.col("fragment_id") % 6 > 0).alias("valid"))
    return V.order_frames(rows).select("group_id", "fragment_id", F.col("place").cast("long").alias("place"), "gap_bytes")


@query("w08_regressions", f"""WITH {_FRAGMENTS}, n AS (SELECT image_id, ts, max(CASE WHEN ts IS NOT NULL THEN fragment_id END) OVER (PARTITION BY image_id ORDER BY fragment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf FROM v_fragments) SELECT n.image_id, count(*) FILTER (n.ts < p.ts) AS regressions, count(n.ts) AS n_timed FROM n LEFT JOIN v_fragments p ON p.image_id = n.image_id AND p.fragment_id = n.lf GROUP BY n.image_id""")
def w08(spark, sf_dir):
    return V.regressions(fragments(spark, sf_dir), ["image_id"], ["fragment_id"], "ts")


@query("w10_clip_groups", f"""WITH {_FRAGMENTS}, c AS (SELECT image_id, channel, fragment_id AS block, CASE WHEN fragment_id % 3 > 0 THEN ts END AS s, CASE WHEN fragment_id % 3 > 0 THEN ts + 4 END AS e, "offset", length FROM v_fragments WHERE channel IS NOT NULL), n AS (SELECT *, lag(e) OVER w AS pe, lag("offset" + length) OVER w AS pd FROM c WINDOW w AS (PARTITION BY image_id, channel ORDER BY block))
SELECT image_id, channel, block, sum(CASE WHEN coalesce(CASE WHEN s IS NOT NULL AND pe IS NOT NULL THEN abs(s - pe) <= 5 ELSE "offset" = pd END, false) THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, channel ORDER BY block ROWS UNBOUNDED PRECEDING)::BIGINT AS clip_group FROM n""")
def w10(spark, sf_dir):
    timed = F.col("fragment_id") % 3 > 0
    clips = fragments(spark, sf_dir).where("channel is not null").select("image_id", "channel", F.col("fragment_id").alias("block"), F.when(timed, F.col("ts")).alias("start"), F.when(timed, F.col("ts") + 4).alias("end"), "offset", "length")
    return V.clip_groups(clips).select("image_id", "channel", "block", "clip_group")


@query("w11_rank_hypotheses", f"""WITH {_FRAGMENTS}, h AS (SELECT image_id, fragment_id AS hypothesis_id, length % 8 AS score, "offset" AS min_offset, group_id % 5 AS n_regions FROM v_fragments), n AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nx, count(*) OVER (PARTITION BY image_id) AS c FROM h WINDOW w AS (PARTITION BY image_id ORDER BY score DESC, min_offset, n_regions, hypothesis_id)),
t AS (SELECT *, max(CASE WHEN rank = 1 AND nx = score THEN 1 ELSE 0 END) OVER (PARTITION BY image_id) AS tie FROM n) SELECT image_id, hypothesis_id, score, min_offset, n_regions, rank, CASE WHEN tie = 1 OR c > 10 THEN 'REVIEW' ELSE 'PASS' END AS state FROM t WHERE rank <= 10""")
def w11(spark, sf_dir):
    rows = fragments(spark, sf_dir).select("image_id", F.col("fragment_id").alias("hypothesis_id"), (F.col("length") % 8).alias("score"), F.col("offset").alias("min_offset"), (F.col("group_id") % 5).alias("n_regions"))
    return V.rank_hypotheses(rows, 10).withColumn("rank", F.col("rank").cast("long"))


@query("w12_budget_prefix", f"""WITH {_FRAGMENTS}, n AS (SELECT image_id, fragment_id, length, sum(length) OVER w::BIGINT AS bytes_upto, row_number() OVER w AS place FROM v_fragments WINDOW w AS (PARTITION BY image_id ORDER BY "offset", fragment_id ROWS UNBOUNDED PRECEDING)), o AS (SELECT *, bytes_upto > 40000 OR place > 90 AS over FROM n), s AS (SELECT *, bool_or(over) OVER (PARTITION BY image_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS stop, bool_or(over) OVER (PARTITION BY image_id) AS truncated FROM o) SELECT image_id, fragment_id, length, bytes_upto, place, truncated FROM s WHERE NOT stop""")
def w12(spark, sf_dir):
    rows = fragments(spark, sf_dir).select("image_id", "fragment_id", "length", "offset")
    return V.budget_prefix(rows, ["image_id"], ["offset", "fragment_id"], 40000, 90).drop("offset").withColumn("place", F.col("place").cast("long"))


_ORDER = """fx AS (SELECT group_id, count(*) AS n, count(sequence) AS ns, count(DISTINCT sequence) AS ds, count(ts) AS nt, count(DISTINCT ts) AS dt FROM v_fragments GROUP BY group_id), bs AS (SELECT group_id, CASE WHEN ns = n THEN CASE WHEN ds = n THEN 'sequence' ELSE 'unknown: duplicate sequence numbers' END WHEN nt = n THEN CASE WHEN dt = n THEN 'time' ELSE 'unknown: identical times' END ELSE 'unknown: no ordering evidence' END AS basis FROM fx)"""


@query("w15_establish_order", f"""WITH {_FRAGMENTS}, {_ORDER} SELECT group_id, fragment_id, basis, row_number() OVER (PARTITION BY group_id ORDER BY CASE basis WHEN 'sequence' THEN sequence WHEN 'time' THEN ts ELSE "offset" END, "offset", length, fragment_id) AS place FROM v_fragments JOIN bs USING (group_id)""")
def w15(spark, sf_dir):
    return V.establish_order(fragments(spark, sf_dir)).select("group_id", "fragment_id", "basis", F.col("place").cast("long").alias("place"))


@query("w16_adjacent_overlaps", f"""WITH {_FRAGMENTS}, n AS (SELECT group_id, "offset", lag("offset" + length) OVER (PARTITION BY group_id ORDER BY "offset", length, fragment_id) AS e FROM v_fragments) SELECT group_id, count(*) FILTER ("offset" < e) AS overlaps FROM n GROUP BY group_id""")
def w16(spark, sf_dir):
    return V.adjacent_overlaps(fragments(spark, sf_dir))


@query("a09_group_fragments", f"""WITH {_FRAGMENTS}, k AS (SELECT * EXCLUDE (group_id), CASE WHEN parent IS NOT NULL THEN 'recording/' || parent WHEN channel IS NOT NULL AND region_id IS NOT NULL THEN 'stream/' || partition || '/' || channel || '/' || region_id ELSE 'alone/' || fragment_id END AS group_id FROM v_fragments), n AS (SELECT *, row_number() OVER (PARTITION BY image_id, group_id ORDER BY "offset", length, fragment_id) AS member, count(*) OVER (PARTITION BY image_id, group_id) AS n_members FROM k),
g AS (SELECT image_id, group_id, row_number() OVER (PARTITION BY image_id ORDER BY min("offset"), group_id) AS group_rank FROM k GROUP BY image_id, group_id) SELECT image_id, group_id, fragment_id, member, n_members, group_rank, n_members > 2 AS truncated FROM n JOIN g USING (image_id, group_id) WHERE member <= 2 AND group_rank <= 300""")
def a09(spark, sf_dir):
    return V.group_fragments(fragments(spark, sf_dir).drop("group_id"), 2, 300).select("image_id", "group_id", "fragment_id", F.col("member").cast("long").alias("member"), "n_members", F.col("group_rank").cast("long").alias("group_rank"), "truncated")


#: The reference's largest bound, a u32: nothing of a table is cut.
MOST = 4294967295


@query("a09_group_fragments_whole", uncut("a09_group_fragments", ("n_members > 2 AS truncated", f"n_members > {MOST} AS truncated, (SELECT count(*) FROM g h WHERE h.image_id = n.image_id) AS n_groups, (SELECT count(*) FROM g h WHERE h.image_id = n.image_id) > {MOST} AS groups_truncated"), ("member <= 2", f"member <= {MOST}"), ("group_rank <= 300", f"group_rank <= {MOST}")))
def a09_whole(spark, sf_dir):
    return V.group_fragments(fragments(spark, sf_dir).drop("group_id"), MOST, MOST).select("image_id", "group_id", "fragment_id", F.col("member").cast("long").alias("member"), "n_members", F.col("group_rank").cast("long").alias("group_rank"), "truncated", "n_groups", "groups_truncated")


@query("a10_unanimous", f"WITH {_FRAGMENTS} SELECT group_id, CASE WHEN count(DISTINCT channel) = 1 AND count(channel) = count(*) THEN min(channel) END AS channel, CASE WHEN count(DISTINCT state) = 1 AND count(state) = count(*) THEN min(state) END AS state, CASE WHEN count(DISTINCT partition) = 1 AND count(partition) = count(*) THEN min(partition) END AS partition FROM v_fragments GROUP BY group_id")
def a10(spark, sf_dir):
    return fragments(spark, sf_dir).groupBy("group_id").agg(*[V.unanimous(c).alias(c) for c in ("channel", "state", "partition")])


@query("a11_group_records", f"""WITH {_FRAGMENTS} SELECT image_id, group_id, count(*) AS n_fragments, CASE WHEN count(DISTINCT channel) = 1 AND count(channel) = count(*) THEN min(channel) END AS channel, CASE WHEN count(DISTINCT state) = 1 AND count(state) = count(*) THEN min(state) END AS state, min(ts) AS start, max(ts) AS "end", sum(length)::BIGINT AS bytes, string_agg("offset" || '+' || length, ',' ORDER BY "offset", length, fragment_id) AS regions FROM v_fragments GROUP BY image_id, group_id""")
def a11(spark, sf_dir):
    return V.group_records(fragments(spark, sf_dir))


@query("a12_reassemble", f"""WITH {_FRAGMENTS}, n AS (SELECT *, row_number() OVER w AS r, lag(sequence) OVER w AS ps, lag("offset" + length) OVER w AS e FROM v_fragments WHERE sequence IS NOT NULL WINDOW w AS (PARTITION BY group_id ORDER BY sequence, "offset", length)), x AS (SELECT group_id, count(*) AS n_all, count(*) FILTER (r <= 4 AND sequence > ps + 1) AS n_gaps, coalesce(sum(sequence - ps - 1) FILTER (r <= 4 AND sequence > ps + 1), 0)::BIGINT AS n_missing, NOT bool_or(coalesce(r <= 4 AND "offset" <> e, false)) AS contiguous FROM n GROUP BY group_id)
SELECT group_id, least(n_all, 4) AS n_fragments, n_gaps, n_missing, contiguous, n_all > 4 AS truncated, CASE WHEN n_all > 4 OR n_gaps > 0 THEN 'REVIEW' ELSE 'PASS' END AS state FROM x""")
def a12(spark, sf_dir):
    return V.reassemble(fragments(spark, sf_dir).where("sequence is not null"), 4)


@query("a12_reassemble_whole", uncut("a12_reassemble", ("r <= 4 ", f"r <= {MOST} "), ("least(n_all, 4)", "n_all"), ("n_all > 4", f"n_all > {MOST}")))
def a12_whole(spark, sf_dir):
    return V.reassemble(fragments(spark, sf_dir).where("sequence is not null"), MOST)


_IMAGES = 'img AS (SELECT image_id, max("offset" + length) + 3000000 AS size_bytes FROM v_ranges GROUP BY image_id), u AS (SELECT image_id, 0::BIGINT AS lo, size_bytes AS hi FROM img)'
_CLAIMS = f"""rc AS (SELECT image_id, l_returnflag = 'N' AS accessible, "offset", length FROM v_ranges WHERE l_returnflag <> 'R'), acc AS (SELECT * FROM rc WHERE accessible), ava AS (SELECT * FROM rc WHERE NOT accessible), {merged("mc", "acc")}, {merged("mv", "ava")}, {merged("mb", "rc")}, {complement("un", "mb", "u")}"""


def _records(spark, sf_dir):
    rows = ranges(spark, sf_dir)
    images = rows.groupBy("image_id").agg((F.max(F.col("offset") + F.col("length")) + 3000000).alias("size_bytes"))
    return rows.where("l_returnflag <> 'R'").select("image_id", (F.col("l_returnflag") == "N").alias("accessible"), "offset", "length"), images


@query("a13_recovery_metrics", f"""WITH {RANGES}, {_FRAGMENTS}, {_REGIONS}, {_IMAGES}, {_CLAIMS}, c AS (SELECT image_id, count(*) AS n_candidates, count(*) FILTER (data_state = 'Active') AS n_active, count(*) FILTER (data_state = 'Deleted') AS n_deleted, count(*) FILTER (data_state = 'Orphaned') AS n_orphaned, count(*) FILTER (data_state = 'Unindexed') AS n_unindexed, count(*) FILTER (data_state = 'Corrupted') AS n_corrupted FROM cl GROUP BY image_id),
b AS (SELECT image_id, coalesce((SELECT sum(length) FROM mc WHERE mc.image_id = img.image_id), 0)::BIGINT AS bytes_claimed, coalesce((SELECT sum(length) FROM mv WHERE mv.image_id = img.image_id), 0)::BIGINT AS bytes_available, coalesce((SELECT sum(length) FROM un WHERE un.image_id = img.image_id), 0)::BIGINT AS bytes_unclaimed FROM img)
SELECT b.*, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_active, 0) AS n_active, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_orphaned, 0) AS n_orphaned, coalesce(n_unindexed, 0) AS n_unindexed, coalesce(n_corrupted, 0) AS n_corrupted FROM b LEFT JOIN c USING (image_id)""")
def a13(spark, sf_dir):
    from ..operators.ranges import claim_map

    records, images = _records(spark, sf_dir)
    universe = images.select("image_id", F.lit(0).cast("long").alias("offset"), F.col("size_bytes").alias("length"))
    return V.recovery_metrics(p15(spark, sf_dir), claim_map(records, universe))


_FACTS = """fa AS (SELECT image_id, count(parent) AS n_records, count(*) FILTER (state = 'Active' AND parent IS NOT NULL) AS n_accessible, sum(CASE WHEN parent IS NULL THEN length ELSE 0 END) AS bytes_unclaimed, count(*) FILTER (length > 100) AS n_fragments, count(ts) AS n_timed, count(CASE WHEN image_id % 7 > 0 THEN sequence END) AS n_sequenced FROM v_fragments GROUP BY image_id)"""


def _facts(spark, sf_dir):
    return fragments(spark, sf_dir).groupBy("image_id").agg(F.count("parent").alias("n_records"), F.count_if((F.col("state") == "Active") & F.col("parent").isNotNull()).alias("n_accessible"), F.sum(F.when(F.col("parent").isNull(), F.col("length")).otherwise(0)).alias("bytes_unclaimed"), F.count_if(F.col("length") > 100).alias("n_fragments"), F.count("ts").alias("n_timed"), F.count(F.when(F.col("image_id") % 7 > 0, F.col("sequence"))).alias("n_sequenced"))


_CAPS = [("index", "n_records", "an index describes recordings", "no index record was found"), ("accessible recordings", "n_accessible", "the index has accessible recordings", "no record is accessible"), ("unclaimed space", "bytes_unclaimed", "bytes are claimed by no record", "records claim all bytes"), ("fragments", "n_fragments", "fragments were found", "no fragment was found"), ("time evidence", "n_timed", "fragments carry times", "no fragment carries a time"), ("sequence evidence", "n_sequenced", "fragments carry sequence numbers", "no fragment carries a sequence number")]


@query("a14_capabilities", f"WITH {_FRAGMENTS}, {_FACTS} " + " UNION ALL ".join(f"SELECT image_id, '{n}' AS capability, {c} > 0 AS available, CASE WHEN {c} > 0 THEN '{y}' ELSE '{x}' END AS reason FROM fa" for n, c, y, x in _CAPS))
def a14(spark, sf_dir):
    return V.capabilities(_facts(spark, sf_dir))


_COUNTED = [(3, ("allocation",)), (4, ("unreferenced",)), (5, ("start", "f_start")), (6, ("channel", "f_channel")), (7, ("payload",)), (8, ("codec",)), (9, ("carved",))]


def _count_sql(place, names):
    told = " || ' and ' || ".join(f"{n} || '{' fragments' if n[:2] == 'f_' or n == 'carved' else ' recordings'}'" for n in names)
    return f"SELECT image_id, {place} AS place, '{V.FINDINGS[place]}' AS capability, {' + '.join(names)} > 0 AS available, {told} AS reason FROM w"


@query("a14_ten_findings", f"""WITH i AS (SELECT c_custkey AS image_id, c_nationkey % 3 > 0 AS geometry, CASE c_nationkey % 4 WHEN 0 THEN 'found' WHEN 1 THEN 'not found' END AS index_state, CASE WHEN c_nationkey % 5 = 0 THEN c_mktsegment END AS scope FROM customer),
r AS (SELECT o_custkey AS image_id, count(*) FILTER (o_orderstatus <> 'O') AS allocation, count(*) FILTER (o_orderkey % 3 = 0) AS unreferenced, count(*) FILTER (o_orderkey % 7 > 0) AS start, count(*) FILTER (o_orderkey % 2 = 0) AS channel, count(*) FILTER (o_orderkey % 5 = 0) AS payload, count(*) FILTER (o_orderkey % 11 = 0) AS codec FROM orders WHERE o_orderkey % 4 > 0 GROUP BY ALL),
f AS (SELECT o_custkey AS image_id, count(*) FILTER (o_orderkey % 8 = 0) AS f_start, count(*) FILTER (o_orderkey % 12 = 0) AS f_channel, count(*) FILTER (o_orderkey % 16 = 0) AS carved FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL),
w AS (SELECT i.*, {", ".join(f"coalesce({n}, 0) AS {n}" for _, ns in _COUNTED for n in ns)} FROM i LEFT JOIN r USING (image_id) LEFT JOIN f USING (image_id))
SELECT image_id, 0 AS place, 'storage-geometry' AS capability, geometry AS available, CASE WHEN geometry THEN 'read from the recorder' ELSE 'none read' END AS reason FROM w UNION ALL SELECT image_id, 1, 'recording-index', coalesce(index_state, '') = 'found', coalesce(index_state, 'not looked for') FROM w
UNION ALL SELECT image_id, 2, 'authoritative-index-scope', scope IS NOT NULL, coalesce('absence counts within ' || scope, 'absence counts nowhere') FROM w UNION ALL """ + " UNION ALL ".join(_count_sql(*x) for x in _COUNTED))
def a14b(spark, sf_dir):
    """Customers as images; their orders as described recordings, every fourth as a fragment found by scanning."""
    n, k = F.col("c_nationkey"), F.col("o_orderkey")
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), (n % 3 > 0).alias("geometry"), F.when(n % 4 == 0, "found").when(n % 4 == 1, "not found").alias("index_state"), F.when(n % 5 == 0, F.col("c_mktsegment")).alias("scope"))
    rows = table(spark, sf_dir, "orders").withColumn("image_id", F.col("o_custkey"))
    recordings = rows.where(k % 4 > 0).select("image_id", (k % 3 > 0).alias("referenced"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("allocation"), F.when(k % 7 > 0, k).alias("start"), F.when(k % 2 == 0, k % 16).alias("channel"), F.when(k % 5 == 0, 1).otherwise(0).alias("n_payload"), F.when(k % 11 == 0, "H264").alias("codec"))
    fragments_ = rows.where(k % 4 == 0).select("image_id", F.when(k % 8 == 0, k).alias("start"), F.when(k % 12 == 0, k % 16).alias("channel"), (k % 16 == 0).alias("carved"))
    return V.assess_capabilities(images, recordings, fragments_)


_WAYS = {"index walk": "n_records > 0", "sweep of unclaimed space": "bytes_unclaimed > 0", "order by sequence": "n_fragments > 0 AND n_sequenced > 0", "order by time": "n_fragments > 0 AND n_timed > 0", "carving": "bytes_unclaimed > 0 OR n_records = 0", "reconstruction": "n_accessible > 0"}


@query("a15_strategies", f"WITH {_FRAGMENTS}, {_FACTS} " + " UNION ALL ".join(f"SELECT image_id, '{k}' AS strategy, {v} AS licensed FROM fa" for k, v in _WAYS.items()))
def a15(spark, sf_dir):
    return V.strategies(V.capabilities(_facts(spark, sf_dir)))


_LICENSED = [("indexed recovery", "recording-index", "y0 AND n_accessible > 0", [("n_accessible", "accessible claims")]), ("available metadata recovery", "unreferenced-metadata", "y1 AND n_available > 0", [("n_available", "claims out of reach")]), ("structural orphan recovery", "authoritative-index-scope", "y2 AND n_orphan > 0", [("n_orphan", "unclaimed regions in scope")]), ("raw recovery", None, "n_ungoverned > 0", [("n_ungoverned", "regions that no index governs")]),
    ("fragment correlation", "channel-attribution", "n_parented > 0 OR n_channel > 0", [("n_parented", "fragments of a recording"), ("n_channel", "with a channel")]), ("temporal correlation", "recorder-timestamps", "n_sequence > 1 OR n_timed > 1", [("n_sequence", "fragments with a number"), ("n_timed", "with a time")])]
_PLANNED = {"n_accessible": "o_orderkey % 4 = 1", "n_available": "o_orderkey % 9 = 1", "n_orphan": "o_orderkey % 7 = 1", "n_ungoverned": "o_orderkey % 11 = 1", "n_parented": "o_orderkey % 13 = 0", "n_channel": "o_orderkey % 12 = 0", "n_sequence": "o_orderkey % 6 = 0", "n_timed": "o_orderkey % 8 = 0"}


@query("a15_licensed_strategies", f"""WITH c AS (SELECT o_custkey AS image_id, {", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _PLANNED.items())}, count(*) FILTER (o_orderkey % 4 > 0 AND o_orderkey % 3 = 0) > 0 AS unreferenced FROM orders GROUP BY 1),
w AS (SELECT c.*, coalesce(c_nationkey % 4 = 0, false) AS y0, unreferenced AND c_custkey IS NOT NULL AS y1, coalesce(c_nationkey % 5 = 0 AND c_mktsegment IS NOT NULL, false) AS y2 FROM c LEFT JOIN customer ON c_custkey = image_id) """ + " UNION ALL ".join(f"SELECT image_id, '{s}' AS strategy, {v} AS licensed, {repr(b) if b else 'NULL'} AS basis, " + " || ', ' || ".join(f"{n} || ' {t}'" for n, t in told) + " AS reason FROM w" for s, b, v, told in _LICENSED))
def a15b(spark, sf_dir):
    """The findings of ``a14_ten_findings`` with counts out of the same images' orders."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("image_id")).agg(*[F.count_if(F.expr(v)).alias(k) for k, v in _PLANNED.items()])
    return V.license_strategies(a14b(spark, sf_dir), counts)


@query("a16_reduce_validation", """WITH x AS (SELECT source AS subject, CASE WHEN quality = 0 AND toxic = 1 THEN 'FAIL' WHEN quality = 0 THEN 'REVIEW' WHEN quality IS NULL THEN 'UNKNOWN' ELSE 'PASS' END AS state, lang || ' ' || coalesce(quality::VARCHAR, '?') AS reason FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT subject, state, CASE state WHEN 'FAIL' THEN 4 WHEN 'REVIEW' THEN 3 WHEN 'UNKNOWN' THEN 2 ELSE 1 END AS rank, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM x GROUP BY subject, state) SELECT subject, arg_max(state, rank) AS state, arg_max(reasons, rank) AS reasons FROM r GROUP BY subject""")
def a16(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "FAIL").when(F.col("quality") == 0, "REVIEW").when(F.col("quality").isNull(), "UNKNOWN").otherwise("PASS")
    reason = F.concat("lang", F.lit(" "), F.coalesce(F.col("quality").cast("string"), F.lit("?")))
    return V.reduce_validation(rows.select(F.col("source").alias("subject"), state.alias("state"), reason.alias("reason")), ["subject"])


@query("a25_seconds_per_level", f"WITH {_FRAGMENTS}, {_REGIONS} SELECT image_id, level, count(*) * 10 AS seconds FROM cl GROUP BY image_id, level")
def a25(spark, sf_dir):
    return V.seconds_per_level(p15(spark, sf_dir), 10)


@query("d07_plan_recovery", f"""WITH {RANGES}, {_IMAGES}, {_CLAIMS}, t AS (SELECT image_id, 'claimed' AS kind, "offset", least(length, 262144) AS length FROM mc UNION ALL SELECT image_id, 'available', "offset", least(length, 262144) FROM mv UNION ALL SELECT image_id, 'unclaimed', "offset" + p * 1048576, least(1048576, length - p * 1048576) FROM (SELECT *, unnest(range(0, (length + 1048575) // 1048576)) AS p FROM un))
SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY "offset", kind, length) AS place FROM t""")
def d07(spark, sf_dir):
    return V.plan_recovery(*_records(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query("d09_gap_slots", f"""WITH {RANGES}, g AS (SELECT image_id, "offset" AS gap_id, "offset", length * 10 AS length, length % 97 AS seconds FROM (SELECT DISTINCT image_id, "offset", min(length) OVER (PARTITION BY image_id, "offset") AS length FROM v_ranges)), n AS (SELECT *, greatest(round(seconds / 10.0)::BIGINT, 1) AS n_slots FROM g), s AS (SELECT *, unnest(range(0, n_slots)) AS slot, length // n_slots AS each FROM n)
SELECT image_id, gap_id, slot, "offset" + slot * each AS "offset", CASE WHEN slot = n_slots - 1 THEN length - each * (n_slots - 1) ELSE each END AS length FROM s""")
def d09(spark, sf_dir):
    rows = ranges(spark, sf_dir).groupBy("image_id", "offset").agg(F.min("length").alias("n"))
    return V.gap_slots(rows.select("image_id", F.col("offset").alias("gap_id"), "offset", (F.col("n") * 10).alias("length"), (F.col("n") % 97).alias("seconds")), 10)


@query("d12_candidates_to_events", f"""WITH {_FRAGMENTS}, c AS (SELECT fragment_id, channel, CASE WHEN fragment_id % 19 = 0 THEN -1 ELSE ts END AS ts FROM v_fragments), r AS (SELECT *, CASE WHEN channel IS NULL THEN 'no channel' WHEN ts IS NULL THEN 'no time' WHEN ts < 0 THEN 'time before 1970' END AS reason FROM c) SELECT fragment_id, channel, ts, reason IS NOT NULL AS withheld, reason FROM r""")
def d12(spark, sf_dir):
    rows = fragments(spark, sf_dir).select("fragment_id", "channel", F.when(F.col("fragment_id") % 19 == 0, -1).otherwise(F.col("ts")).alias("ts"))
    return V.candidates_to_events(rows).select("fragment_id", "channel", "ts", "withheld", "reason")


@query("j15_pair_candidates", f"""WITH {_FRAGMENTS.replace("v_fragments AS (", "v_fragments AS MATERIALIZED (", 1)}, {_REGIONS.replace("rg AS (", "rg AS MATERIALIZED (", 1)} SELECT f.fragment_id, f.channel, f.ts, cl.data_state, cl.level FROM v_fragments f LEFT JOIN cl USING (fragment_id)""")
def j15(spark, sf_dir):
    return V.pair_candidates(fragments(spark, sf_dir).select("fragment_id", "channel", "ts"), p15(spark, sf_dir).select("fragment_id", "data_state", "level"))
