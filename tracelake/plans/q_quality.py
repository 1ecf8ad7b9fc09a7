"""Queries of frames, contracts and custody."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media as M
from ..operators import quality as Q
from .registry import query
from .views import table


def frames(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").cast("long").alias("artifact_id"), F.col("vec_id").alias("frame_index"), (F.col("vec_id") * 0.04).alias("pts"), F.col("embedding").alias("pixels"))


@query("p20_sample_every", 'SELECT label::BIGINT AS artifact_id, vec_id AS frame_index FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 7 = 0) WHERE n <= 20')
def p20(spark, sf_dir):
    return M.sample_frames(frames(spark, sf_dir), every=7, most=20).select("artifact_id", "frame_index")


@query("p20_sample_seconds", "SELECT label::BIGINT AS artifact_id, min(vec_id) AS frame_index FROM embeddings GROUP BY label, floor(vec_id * 0.04::DOUBLE / 10)")
def p20b(spark, sf_dir):
    return M.sample_frames(frames(spark, sf_dir), seconds=10).select("artifact_id", "frame_index")


@query("p20_sample_range", "SELECT label::BIGINT AS artifact_id, vec_id AS frame_index FROM embeddings WHERE vec_id * 0.04::DOUBLE BETWEEN 10 AND 60.5")
def p20c(spark, sf_dir):
    return M.sample_frames(frames(spark, sf_dir), between=(10, 60.5)).select("artifact_id", "frame_index")


@query("p21_frame_timing", """WITH a AS (SELECT DISTINCT label::BIGINT AS artifact_id, CASE WHEN label % 3 = 0 THEN 25.0 END::DOUBLE AS rate, CASE WHEN label % 3 = 1 THEN 2.0 END::DOUBLE AS step, label * 10.0::DOUBLE AS base FROM embeddings)
SELECT artifact_id, vec_id AS frame_index, round(CASE WHEN rate > 0 THEN base + vec_id * (1.0 / rate) WHEN step > 0 THEN base + vec_id * step WHEN vec_id = 0 THEN base END, 6) AS pts, round(1000 + CASE WHEN rate > 0 THEN base + vec_id * (1.0 / rate) WHEN step > 0 THEN base + vec_id * step WHEN vec_id = 0 THEN base END, 6) AS wall, CASE WHEN rate > 0 THEN 'frame rate' WHEN step > 0 THEN 'interval' ELSE 'unknown' END AS source FROM embeddings JOIN a ON a.artifact_id = label""")
def p21(spark, sf_dir):
    rows = frames(spark, sf_dir).select("artifact_id", "frame_index")
    k = F.col("artifact_id")
    artifacts = rows.select("artifact_id").distinct().select("artifact_id", F.when(k % 3 == 0, 25.0).alias("rate"), F.when(k % 3 == 1, 2.0).alias("interval"), (k * 10.0).alias("base"), F.lit(1000.0).alias("recording_start"))
    return M.frame_timing(rows, artifacts).withColumns({"pts": F.round("pts", 6), "wall": F.round("wall", 6)})


@query("p22_frame_quality", """WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS deviation, max(v) > min(v) AS has_tonal_variation FROM p GROUP BY vec_id),
x AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest([10, 11, 12, 13, 14, 15, 18, 19, 20, 21, 22, 23, 26, 27, 28, 29, 30, 31, 34, 35, 36, 37, 38, 39, 42, 43, 44, 45, 46, 47, 50, 51, 52, 53, 54, 55]) AS k FROM embeddings), l AS (SELECT vec_id, var_pop(4 * e[k] - e[k - 8] - e[k + 8] - e[k - 1] - e[k + 1]) AS sharpness FROM x GROUP BY vec_id)
SELECT vec_id AS frame_index, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(sharpness, 6) AS sharpness, has_tonal_variation FROM s JOIN l USING (vec_id)""")
def p22(spark, sf_dir):
    return M.frame_quality(frames(spark, sf_dir), 8).withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "sharpness")})


def _each_pixel(frames):
    return frames.select("frame_index", F.posexplode("pixels").alias("place", "value")).withColumn("value", F.round("value", 6))


@query("p23_crop_and_shrink", """WITH e AS (SELECT vec_id AS frame_index, embedding::DOUBLE[] AS e, unnest(range(6)) AS place FROM embeddings), k AS (SELECT *, (place // 2) * 16 + 3 + place % 2 * 2 AS k FROM e)
SELECT frame_index, place::INTEGER AS place, round((e[k] + e[k + 1] + e[k + 8] + e[k + 9]) / 4, 6) AS value FROM k""")
def p23(spark, sf_dir):
    return _each_pixel(M.crop_and_shrink(frames(spark, sf_dir), 8, 8, (2, 0, 4, 6), 2))


@query("p23_transform_frames", """WITH e AS (SELECT vec_id AS frame_index, embedding::DOUBLE[] AS e, unnest(range(6)) AS place FROM embeddings), g AS (SELECT frame_index, place, list_transform(range(16), lambda p: 0.299 * e[3 * p + 1] + 0.587 * e[3 * p + 2] + 0.114 * e[3 * p + 3]) AS g FROM e),
c AS (SELECT frame_index, place, list_transform(range(1, 5), lambda x: (g[x + place // 3 * 8] + g[x + place // 3 * 8 + 4]) / 2) AS c FROM g)
SELECT frame_index, place::INTEGER AS place, round(CASE place % 3 WHEN 0 THEN 0.75 * c[1] + 0.25 * c[2] WHEN 1 THEN (c[2] + c[3]) / 2 ELSE 0.25 * c[3] + 0.75 * c[4] END, 6) AS value FROM c""")
def p23b(spark, sf_dir):
    """The first 48 values of each vector as 4 x 4 pixels of three channels, in grey, resized to 3 x 2."""
    rows = frames(spark, sf_dir).withColumn("pixels", F.slice("pixels", 1, 48))
    return _each_pixel(M.transform_frames(rows, 4, 4, [("grey",), ("resize", 3, 2)], 3))


_FINDINGS = "f AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'FAIL' WHEN quality = 1 THEN 'PASS' WHEN quality = 0 THEN 'REVIEW' ELSE 'UNKNOWN' END AS state FROM documents LEFT JOIN labels USING (doc_id))"


def _findings(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "REVIEW").otherwise("UNKNOWN").alias("state"))


@query("p18_eligible", f"WITH {_FINDINGS} SELECT * FROM f WHERE state IN ('PASS', 'REVIEW')")
def p18(spark, sf_dir):
    return M.eligible(_findings(spark, sf_dir))


@query("j12_stray_observations", f"WITH {_FINDINGS} SELECT doc_id AS frame_id, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE state IN ('PASS', 'REVIEW'))")
def j12(spark, sf_dir):
    seen = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("frame_id"), "toxic")
    return M.stray_observations(seen, p18(spark, sf_dir).withColumnRenamed("doc_id", "frame_id"))


@query("d14_diff_results", """WITH b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 31 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 47 <> 0)
SELECT part.p_partkey, 'p_size' AS path, '{"v":' || part.p_size || '}' AS "left", '{"v":' || b.p_size || '}' AS "right" FROM part JOIN b USING (p_partkey) WHERE part.p_size <> b.p_size UNION ALL SELECT p_partkey, '(row)', 'there', NULL FROM part WHERE p_partkey % 47 = 0""")
def d14(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    b = a.where("p_partkey % 47 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 31 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return Q.diff_results(a, b, ["p_partkey"])


@query("d14_diff_nested", """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
t AS (SELECT *, CASE WHEN l_orderkey % 13 = 0 AND l_linenumber % 2 = 1 THEN 'changed' ELSE l_returnflag END AS flag FROM l)
SELECT l_orderkey, 'lines[' || i || '].state.flag' AS path, '{"v":"' || l_returnflag || '"}' AS "left", '{"v":"' || flag || '"}' AS "right" FROM t WHERE l_returnflag <> flag AND NOT (l_orderkey % 17 = 0 AND i = n - 1 AND n > 1) AND l_orderkey % 19 <> 0
UNION ALL SELECT l_orderkey, unnest(['lines[' || i || '].number', 'lines[' || i || '].state.flag']), unnest(['{"v":' || l_linenumber || '}', '{"v":"' || l_returnflag || '"}']), NULL FROM t WHERE l_orderkey % 17 = 0 AND i = n - 1 AND n > 1 AND l_orderkey % 19 <> 0
UNION ALL SELECT DISTINCT l_orderkey, '(row)', 'there', NULL FROM t WHERE l_orderkey % 19 = 0""")
def d14_nested(spark, sf_dir):
    """Orders with their lines as nested values: a changed flag, a last line that is gone where there are several, orders that are gone."""
    line = F.struct(F.col("l_linenumber").alias("number"), F.struct(F.col("l_returnflag").alias("flag")).alias("state"))
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    changed = F.transform("lines", lambda e: e.withField("state.flag", F.when((F.col("l_orderkey") % 13 == 0) & (e["number"] % 2 == 1), "changed").otherwise(e["state"]["flag"])))
    short = F.when((F.col("l_orderkey") % 17 == 0) & (F.size("lines") > 1), F.slice(changed, 1, F.size("lines") - 1)).otherwise(changed)
    return Q.diff_results(a, a.where("l_orderkey % 19 <> 0").withColumn("lines", short), ["l_orderkey"])


@query("d18_contract_checks", """WITH r AS (SELECT o_custkey % 10 AS image_id, o_orderkey // 2 AS record_id, o_orderkey * 100 AS "offset", CASE WHEN o_orderkey % 53 = 0 THEN 0 ELSE 100 END AS length, CASE WHEN o_orderkey % 71 = 0 THEN 0 ELSE epoch(o_orderdate)::BIGINT END AS start, o_orderkey * 100 - CASE WHEN o_orderkey % 83 = 0 THEN 1 ELSE 0 END AS po, 50 AS pl, o_orderstatus <> 'P' AS accessible FROM orders), i AS (SELECT image_id, max("offset") AS size_bytes FROM r GROUP BY image_id),
x AS (SELECT 'region in bounds' AS "check", count(*) FILTER (NOT ("offset" >= 0 AND "offset" + length <= size_bytes)) AS failures FROM r JOIN i USING (image_id) UNION ALL SELECT 'region not empty', count(*) FILTER (length <= 0) FROM r UNION ALL SELECT 'no placeholder time', count(*) FILTER (start IN (0, 2147483647)) FROM r UNION ALL SELECT 'payload inside record', count(*) FILTER (po < "offset" OR po + pl > "offset" + length) FROM r UNION ALL SELECT 'one standing', (SELECT count(*) FROM (SELECT record_id FROM r GROUP BY record_id HAVING count(DISTINCT accessible) > 1))) SELECT *, CASE WHEN failures > 0 THEN 'FAIL' ELSE 'PASS' END AS state FROM x""")
def d18(spark, sf_dir):
    k = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("image_id"), F.floor(k / 2).alias("record_id"), (k * 100).alias("offset"), F.when(k % 53 == 0, 0).otherwise(100).alias("length"), F.when(k % 71 == 0, 0).otherwise(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("start"), (k * 100 - F.when(k % 83 == 0, 1).otherwise(0)).alias("payload_offset"), F.lit(50).alias("payload_length"), (F.col("o_orderstatus") != "P").alias("accessible"))
    return Q.contract_checks(records, records.groupBy("image_id").agg(F.max("offset").alias("size_bytes")))


@query("d19_register", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 9 = 0 THEN 'source' END, CASE WHEN doc_id % 6 = 0 THEN 'lang' END) AS missing, doc_id % 9 <> 0 AND doc_id % 6 <> 0 AS accepted FROM documents")
def d19(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 9 == 0, "  ").otherwise(F.col("source")).alias("source"), F.when(k % 6 != 0, F.col("lang")).alias("lang"))
    return Q.register(rows, ["doc_id", "source", "lang"]).select("doc_id", "missing", "accepted")


@query("a21_acquisition_manifest", """WITH a AS (SELECT c_custkey AS acquisition_id, 1000000 AS size_bytes, CASE WHEN c_custkey % 9 = 0 THEN 999999 ELSE 1000000 END AS bytes_read, c_custkey * 10 AS started, c_custkey * 10 + c_nationkey AS ended FROM customer), b AS (SELECT o_custkey AS acquisition_id, count(*) AS bad_ranges, sum(o_orderkey % 7 + 1)::BIGINT AS bad_sectors FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey)
SELECT acquisition_id, coalesce(bad_ranges, 0) AS bad_ranges, coalesce(bad_sectors, 0) AS bad_sectors, coalesce(bad_sectors, 0) * 512 AS zero_filled, ended - started AS seconds, CASE WHEN coalesce(bad_sectors, 0) = 0 AND bytes_read = size_bytes THEN 'Complete' ELSE 'Partial' END AS status FROM a LEFT JOIN b USING (acquisition_id)""")
def a21(spark, sf_dir):
    k = F.col("c_custkey")
    runs = table(spark, sf_dir, "customer").select(k.alias("acquisition_id"), F.lit(1000000).alias("size_bytes"), F.when(k % 9 == 0, 999999).otherwise(1000000).alias("bytes_read"), (k * 10).alias("started"), (k * 10 + F.col("c_nationkey")).alias("ended"))
    bad = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("acquisition_id"), (F.col("o_orderkey") % 7 + 1).alias("sectors"))
    return Q.acquisition_manifest(runs, bad)


@query("d20_custody_log", "SELECT conv_id AS case_id, turn, role AS action, text FROM conversations WHERE role = 'user' AND conv_id = (SELECT min(conv_id) FROM conversations)")
def d20(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), "turn", F.col("role").alias("action"), "text")
    first = rows.agg(F.min("case_id")).first()[0]
    return Q.custody_log(rows, first, "user")


@query("d16_finalize_exports", "SELECT conv_id AS case_id, 'export' AS action, conv_id * 1000 + turn AS export_id, sha256(text) AS sha256 FROM conversations")
def d16(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("export_id"), F.col("text").alias("body"))
    return Q.finalize_exports(rows)[1]


@query("j13_artifact_lineage", """SELECT o_orderkey AS artifact_id, o_orderpriority AS method, CASE WHEN o_orderkey % 3 > 0 THEN 'PASS' END AS state, r.regions FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey || '+' || l_linenumber, ',' ORDER BY l_partkey, l_linenumber) AS regions FROM lineitem GROUP BY l_orderkey) r ON l_orderkey = o_orderkey""")
def j13(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_orderpriority").alias("method"))
    states = rows.where("artifact_id % 3 > 0").select("artifact_id", F.lit("PASS").alias("state"))
    regions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.col("l_partkey").alias("offset"), F.col("l_linenumber").alias("length"))
    return Q.artifact_lineage(rows.select("artifact_id"), rows, states, regions)


@query("d21_validate_artifacts", """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 11 > 0 AS t0, CASE WHEN o_orderkey % 13 > 0 THEN true ELSE false END AS t1, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 17 > 0 END AS t2, o_orderkey % 19 > 0 AS t3, o_orderkey % 23 > 0 AS t4 FROM orders), c AS (SELECT k, unnest([t0, t1, t2, t3, t4]) AS t, unnest(['exists', 'not empty', 'hash', 'geometry', 'codec']) AS "check", unnest([0, 1, 2, 3, 4]) AS place FROM a)
SELECT k AS artifact_id, place, "check", CASE WHEN coalesce(bool_or(t = false) OVER (PARTITION BY k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'SKIPPED' WHEN t IS NULL THEN 'UNAVAILABLE' WHEN t THEN 'PASS' ELSE 'FAIL' END AS state FROM c""")
def d21(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("artifact_id"), (k % 11 > 0).alias("exists"), F.when(k % 13 > 0, 10).otherwise(0).alias("n_bytes"), F.lit("a").alias("sha256"), F.when(k % 4 > 0, F.when(k % 17 > 0, "a").otherwise("b")).alias("stored_sha256"), F.when(k % 19 > 0, 64).otherwise(0).alias("width"), F.lit(64).alias("height"), F.when(k % 23 > 0, "H264").otherwise("odd").alias("codec"))
    return Q.validate_artifacts(rows)
