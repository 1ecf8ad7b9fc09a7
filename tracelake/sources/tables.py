"""Reading rule profiles, corpus manifests and case tables; writing reports and custody rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SHAPE = "id string, version string, vendor string, models array<string>, firmware array<string>, variants array<string>, signatures array<struct<name:string,pattern_hex:string,weight:double,exclusive:boolean,evidence_status:string,offset_constraints:array<struct<type:string,offset:long,start:long,end:long,alignment:long,max_offset:long>>>>, layout map<string,string>"
CASE_SHAPE = "case_id string, source_path string, source_type string, expected_detection string, expected_classification string, expected_regions array<struct<offset:long,length:long>>, synthetic boolean"
#: The headers of the CSV reports.
CSV_COLUMNS = {"recovery": ["candidate_id", "offset", "length", "data_state", "status", "level", "reason"], "recordings": ["channel", "start", "end", "n_segments", "missing_seconds"], "timeline": ["channel", "instant", "kind", "description"]}


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profiles with a digest of their content, rejected ones with the reason) from JSON lines.

    Rejected: blank id or version, no signatures, a weight of zero or less, a pattern that is no hex.
    """
    rows = spark.read.schema(RULE_SHAPE).json(path).withColumn("digest", F.sha2(F.to_json(F.struct("*")), 256))
    bad = F.exists("signatures", lambda s: ~F.coalesce(s["pattern_hex"].rlike("^([0-9A-Fa-f]{2})+$"), F.lit(False)))
    light = F.exists("signatures", lambda s: ~F.coalesce(s["weight"] > 0, F.lit(False)))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = F.when(blank("id") | blank("version"), "blank id or version").when(F.coalesce(F.size("signatures"), F.lit(0)) <= 0, "no signatures").when(light, "weight not above zero").when(bad, "pattern is no hex")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def signature_rules(profiles: DataFrame) -> DataFrame:
    """Profiles as rules for ``evaluate_rules``: vendor, rule, pattern, kind, at, stop, step, state, weight, exclusive; one for each constraint.

    exact: at an offset; range: from start, before end; aligned: at multiples of the alignment from start on, before max_offset;
    header: from 0, before max_offset. A signature without constraints is looked for in the first 512 bytes.
    """
    each = profiles.select("vendor", F.explode("signatures").alias("s"))
    rows = each.select("vendor", "s", F.explode_outer("s.offset_constraints").alias("c"))
    kind = F.coalesce(F.col("c.type"), F.lit("header"))
    at = F.when(kind == "exact", F.col("c.offset")).otherwise(F.coalesce("c.start", F.lit(0)))
    stop = F.when(kind == "exact", F.lit(None)).otherwise(F.coalesce("c.end", "c.max_offset", F.lit(512)))
    return rows.select(
        "vendor", F.col("s.name").alias("rule"), F.unhex("s.pattern_hex").alias("pattern"), F.when(kind == "range", "header").otherwise(kind).alias("kind"), at.cast("long").alias("at"), stop.cast("long").alias("stop"),
        F.when(kind == "aligned", F.coalesce("c.alignment", F.lit(1))).otherwise(1).cast("long").alias("step"), F.lower(F.coalesce("s.evidence_status", F.lit("unvalidated"))).alias("state"), F.col("s.weight").alias("weight"), F.coalesce("s.exclusive", F.lit(False)).alias("exclusive"))


def applicable_rules(images: DataFrame, rules: DataFrame) -> DataFrame:
    """Images with the first profile of their vendor (any case) whose model, firmware and, if there, variant lists are empty or name theirs."""
    fits = lambda col, own: (F.coalesce(F.size(col), F.lit(0)) <= 0) | F.array_contains(F.col(col), F.col(own))
    lists = ["variants"] if "variants" in rules.columns and "variant" in images.columns else []
    profiles = rules.select(F.lower("vendor").alias("__vendor"), F.col("id").alias("profile_id"), "version", "models", "firmware", *lists)
    met = images.join(profiles, F.lower(images["vendor"]) == F.col("__vendor"), "left")
    good = F.coalesce(fits("models", "model") & fits("firmware", "firmware_version") & (fits("variants", "variant") if lists else F.lit(True)), F.lit(False))
    best = met.groupBy("image_id").agg(F.min(F.when(good, F.struct("profile_id", "version"))).alias("best"))
    return best.select("image_id", "best.profile_id", "best.version")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected ones): a case needs an id, a path and an expected detection."""
    rows = spark.read.schema(CASE_SHAPE).option("multiLine", True).json(path)
    blank = F.lit(False)
    for c in ("case_id", "source_path", "expected_detection"):
        blank = blank | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return rows.where(~blank), rows.where(blank)


def read_case_tables(spark: SparkSession, source: str, names: list[str], **options: str) -> dict[str, DataFrame]:
    """Case tables by name from a JDBC url (options: user and so on) or a folder of Parquet tables."""
    if source.startswith("jdbc:"):
        return {n: spark.read.jdbc(source, n, properties=options) for n in names}
    return {n: spark.read.parquet(f"{source.rstrip('/')}/{n}.parquet") for n in names}


def write_csv_report(df: DataFrame, kind: str, path: str) -> None:
    """A CSV report with its fixed header; a missing channel is Unknown, quotes are doubled."""
    rows = df.select(*CSV_COLUMNS[kind])
    if "channel" in rows.columns:
        rows = rows.withColumn("channel", F.coalesce(F.col("channel").cast("string"), F.lit("Unknown")))
    rows.write.option("header", True).option("escape", '"').csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_custody(events: DataFrame, path: str) -> None:
    """Append custody events, one folder a case; nothing there is ever changed."""
    events.write.mode("append").partitionBy("case_id").parquet(path)
