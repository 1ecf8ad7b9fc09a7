"""The driver's tables as the record types that the operators take, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("image_id"),
        (F.col("user_id") % 4 + 1).cast("int").alias("channel"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("instant"),
        (F.col("event_id") * 4096).alias("offset"),
        (1024 + 16 * k).alias("length"),
        F.when(F.col("event_type") != "error", "UTC+05:30").alias("tz"),
        F.col("event_type").alias("kind"),
        "event_id",
        k.alias("k"),
        "user_id",
    )


SEGMENTS = """v_segments AS (SELECT user_id % 3 AS image_id, (user_id % 4 + 1)::INTEGER AS channel, floor(epoch(ts))::BIGINT AS instant, event_id * 4096 AS "offset",
  1024 + 16 * regexp_extract(props, '[0-9]+')::BIGINT AS length, CASE WHEN event_type <> 'error' THEN 'UTC+05:30' END AS tz, event_type AS kind, event_id, regexp_extract(props, '[0-9]+')::BIGINT AS k, user_id FROM events)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"),
        (F.col("l_orderkey") * 64 + F.col("l_linenumber") * 8).alias("offset"),
        (F.floor("l_quantity") * 32).alias("length"),
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey",
    )


RANGES = """v_ranges AS (SELECT l_suppkey AS image_id, l_orderkey * 64 + l_linenumber * 8 AS "offset", floor(l_quantity)::BIGINT * 32 AS length, l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey FROM lineitem)"""

#: Merging as a macro-like fragment: name, source with image_id, offset, length.
def merged(name: str, source: str) -> str:
    return f"""{name}_f AS (SELECT image_id, "offset" AS lo, "offset" + length AS hi, max("offset" + length) OVER (PARTITION BY image_id ORDER BY "offset", length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source} WHERE length > 0),
{name}_g AS (SELECT image_id, lo, hi, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY lo, hi, before IS NULL OR lo > before DESC ROWS UNBOUNDED PRECEDING) AS g FROM {name}_f),
{name} AS (SELECT image_id, min(lo) AS "offset", max(hi) - min(lo) AS length FROM {name}_g GROUP BY image_id, g)"""


def complement(name: str, source: str, universe: str) -> str:
    """Holes of merged ranges in ``source`` within ``universe`` (image_id, lo, hi)."""
    return f"""{name}_e AS (SELECT image_id, u.lo AS u_lo, u.hi AS u_hi, greatest(s."offset", u.lo) AS lo, least(s."offset" + s.length, u.hi) AS hi FROM {source} s JOIN {universe} u USING (image_id) WHERE least(s."offset" + s.length, u.hi) > greatest(s."offset", u.lo)),
{name}_a AS (SELECT image_id, hi AS lo, lead(lo) OVER (PARTITION BY image_id ORDER BY lo) AS hi, u_hi FROM {name}_e UNION ALL SELECT u.image_id, u.lo, (SELECT min(e.lo) FROM {name}_e e WHERE e.image_id = u.image_id), u.hi FROM {universe} u),
{name} AS (SELECT image_id, lo AS "offset", coalesce(hi, u_hi) - lo AS length FROM {name}_a WHERE coalesce(hi, u_hi) > lo)"""
