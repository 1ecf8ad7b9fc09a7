"""Queries of sources over small files that they write into the shared folder from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as S
from ..sources.scratch import shared_path
from .registry import query
from .views import table

_PROFILES = """pr AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE 'p' || p_partkey END AS id, CASE WHEN p_partkey % 17 = 0 THEN 0.0 ELSE 0.5 END AS weight, p_partkey % 19 <> 0 AS hex FROM part)"""


def _profiles(spark, sf_dir):
    """A profile with two signatures for each part, written as JSON lines; some have a blank id, no weight or a pattern that is no hex."""
    k = F.col("p_partkey")
    lit = lambda x: F.lit(x).cast("long")
    place = lambda kind, **at: F.struct(F.lit(kind).alias("type"), *[(lit(at[n]) if isinstance(at.get(n), int) else at[n] if n in at else F.lit(None).cast("long")).alias(n) for n in ("offset", "start", "end", "alignment", "max_offset")])
    first = F.struct(F.lit("head").alias("name"), F.when(k % 19 == 0, "XYZ").otherwise("54686520").alias("pattern_hex"), F.when(k % 17 == 0, 0.0).otherwise(0.5).alias("weight"), F.lit(True).alias("exclusive"), F.lit("Validated").alias("evidence_status"), F.array(place("exact", offset=k % 4)).alias("offset_constraints"))
    second = F.struct(F.lit("body").alias("name"), F.lit("616E64").alias("pattern_hex"), F.lit(0.25).cast("double").alias("weight"), F.lit(False).alias("exclusive"), F.lit(None).cast("string").alias("evidence_status"), F.array(place("range", start=4, end=k % 50 + 10), place("aligned", start=0, alignment=4, max_offset=64)).alias("offset_constraints"))
    rows = table(spark, sf_dir, "part").select(F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("id"), F.lit("1").alias("version"), F.concat(F.lit("v"), (k % 5).cast("string")).alias("vendor"), F.array(first, second).alias("signatures"))
    path = shared_path(spark, "profiles")
    rows.write.json(path)
    return S.load_rules(spark, path)


@query("s03_rejected_profiles", f"""WITH {_PROFILES} SELECT id, CASE WHEN id = ' ' THEN 'blank id or version' WHEN weight <= 0 THEN 'weight not above zero' ELSE 'pattern is no hex' END AS reason FROM pr WHERE id = ' ' OR weight <= 0 OR NOT hex""")
def s03_rejected(spark, sf_dir):
    return _profiles(spark, sf_dir)[1].select("id", "reason")


@query("s03_signature_rules", f"""WITH {_PROFILES}, g AS (SELECT k FROM pr WHERE id <> ' ' AND weight > 0 AND hex)
SELECT 'v' || k % 5 AS vendor, 'head' AS rule, '54686520' AS pattern, 'exact' AS kind, k % 4 AS "at", NULL::BIGINT AS stop, 1 AS step, 'validated' AS state, 0.5::DOUBLE AS weight, true AS exclusive FROM g
UNION ALL SELECT 'v' || k % 5, 'body', '616E64', 'header', 4, k % 50 + 10, 1, 'unvalidated', 0.25, false FROM g UNION ALL SELECT 'v' || k % 5, 'body', '616E64', 'aligned', 0, 64, 4, 'unvalidated', 0.25, false FROM g""")
def s03_rules(spark, sf_dir):
    return S.signature_rules(_profiles(spark, sf_dir)[0]).withColumn("pattern", F.hex("pattern"))


@query("s07_csv_report", """SELECT coalesce(CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 16)::VARCHAR END, 'Unknown') AS channel, o_orderkey AS instant, 'clip "' || o_orderpriority || '"' AS kind, 'order ' || o_custkey || ', done' AS description FROM orders""")
def s07(spark, sf_dir):
    """A timeline report written as CSV and read back."""
    k, path = F.col("o_orderkey"), shared_path(spark, "report")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 7 > 0, k % 16).alias("channel"), k.alias("instant"), F.concat(F.lit('clip "'), "o_orderpriority", F.lit('"')).alias("kind"), F.concat(F.lit("order "), F.col("o_custkey").cast("string"), F.lit(", done")).alias("description"))
    S.write_csv_report(rows, "timeline", path)
    return spark.read.schema("channel string, instant long, kind string, description string").option("header", True).option("escape", '"').csv(path)


@query("s10_custody", "SELECT o_custkey % 5 AS case_id, count(*) AS n_events, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1")
def s10(spark, sf_dir):
    """Custody events appended in two batches and read back."""
    path = shared_path(spark, "custody")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("case_id"), F.col("o_orderkey").alias("event"))
    S.append_custody(rows.where("event % 2 = 0"), path)
    S.append_custody(rows.where("event % 2 = 1"), path)
    return spark.read.schema("event long, case_id long").parquet(path).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("event").alias("total"))


@query("s04_applicable_rules", """WITH r AS (SELECT 'p' || n_nationkey AS id, n_nationkey % 5 AS v, CASE WHEN n_nationkey % 3 > 0 THEN 'm' || n_nationkey % 4 END AS m, CASE WHEN n_nationkey % 2 = 0 THEN 'v' || n_nationkey % 3 END AS w FROM nation)
SELECT c_custkey AS image_id, min(id) AS profile_id FROM customer LEFT JOIN r ON v = c_nationkey % 5 AND (m IS NULL OR m = 'm' || c_custkey % 5) AND (w IS NULL OR w = 'v' || c_custkey % 4) GROUP BY c_custkey""")
def s04(spark, sf_dir):
    """Profiles out of nations, in capitals, some for one model or one variant alone."""
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    only = lambda on, value: F.when(on, F.array(value)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    rules = table(spark, sf_dir, "nation").select(named("p", n).alias("id"), F.lit("1").alias("version"), named("VENDOR", n % 5).alias("vendor"), only(n % 3 > 0, named("m", n % 4)).alias("models"), none.alias("firmware"), only(n % 2 == 0, named("v", n % 3)).alias("variants"))
    images = table(spark, sf_dir, "customer").select(c.alias("image_id"), named("Vendor", F.col("c_nationkey") % 5).alias("vendor"), named("m", c % 5).alias("model"), F.lit("f").alias("firmware_version"), named("v", c % 4).alias("variant"))
    return S.applicable_rules(images, rules).select("image_id", "profile_id")
