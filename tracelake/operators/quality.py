"""Contracts on result tables: differences of two runs, bounds, registration, acquisition and custody."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """An array of (path, value as text) for each value inside ``value`` that holds no others; null and empty containers are such values."""
    leaf = F.array(F.struct(path.alias("path"), F.to_json(F.struct(value.alias("v"))).alias("value")))
    if isinstance(kind, T.StructType) and kind.fields:
        inner = F.concat(*[_leaves(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields])
        return F.when(value.isNull(), leaf).otherwise(inner)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda v, i: _leaves(v, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
    elif isinstance(kind, T.MapType):
        inner = F.transform(F.map_entries(value), lambda e: _leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
    else:
        return leaf
    return F.when(F.coalesce(F.size(value), F.lit(0)) <= 0, leaf).otherwise(F.flatten(inner))


def diff_results(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differences of two tables by key and path: (keys, path, left, right); values as JSON text, a missing row as path '(row)'.

    Paths lead into structs, arrays and maps, as ``a.b[2].c``; a path that one side alone has is null on the other. Tables meet once,
    by key, and only rows that differ are taken apart. Keys are unique in either table; rows with a null key meet no other.
    """

    def flat(df, side):
        parts = [_leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in df.schema.fields if f.name not in keys]
        return df.select(*keys, (F.concat(*parts) if parts else F.array().cast("array<struct<path:string,value:string>>")).alias(side))

    met = flat(a, "__a").join(flat(b, "__b"), list(keys), "full_outer")
    there = [F.when(F.col(c).isNotNull(), "there").alias(n) for c, n in (("__a", "left"), ("__b", "right"))]
    lone = met.where("__a is null or __b is null").select(*keys, F.lit("(row)").alias("path"), *there)
    none = F.lit(None).cast("string")
    cells = F.concat(
        F.transform("__a", lambda e: F.struct(e["path"].alias("path"), e["value"].alias("left"), none.alias("right"))),
        F.transform("__b", lambda e: F.struct(e["path"].alias("path"), none.alias("left"), e["value"].alias("right"))),
    )
    apart = met.where("__a <> __b").select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").groupBy(*keys, "path").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    return apart.where(~F.col("left").eqNullSafe(F.col("right"))).unionByName(lone)


def contract_checks(records: DataFrame, images: DataFrame) -> DataFrame:
    """One row a check with how many records break it: in bounds, not empty, no placeholder time, payload inside, one standing."""
    rows = records.join(images.select("image_id", "size_bytes"), "image_id", "left")
    end = F.col("offset") + F.col("length")
    checks = {
        "region in bounds": ~F.coalesce((F.col("offset") >= 0) & (end <= F.col("size_bytes")), F.lit(False)),
        "region not empty": ~F.coalesce(F.col("length") > 0, F.lit(False)),
        "no placeholder time": F.coalesce(F.col("start").isin(0, 2**31 - 1), F.lit(False)),
        "payload inside record": F.coalesce((F.col("payload_offset") < F.col("offset")) | (F.col("payload_offset") + F.col("payload_length") > end), F.lit(False)),
    }
    one = rows.agg(*[F.count_if(v).alias(k) for k, v in checks.items()])
    counted = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("failures")) for k in checks])).alias("c")).select("c.*")
    split = records.groupBy("record_id").agg(F.count_distinct("accessible").alias("n")).where("n > 1")
    return counted.unionByName(split.agg(F.lit("one standing").alias("check"), F.count(F.lit(1)).alias("failures"))).withColumn("state", F.when(F.col("failures") > 0, "FAIL").otherwise("PASS"))


def register(inputs: DataFrame, required: Sequence[str]) -> DataFrame:
    """Inputs with whether they are accepted, and the required fields that are blank."""
    blank = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required]))
    return inputs.withColumns({"missing": F.array_join(blank, ","), "accepted": F.size(blank) == 0})


def acquisition_manifest(acquisitions: DataFrame, bad: DataFrame) -> DataFrame:
    """Per acquisition bad ranges and sectors, bytes filled with zeros, seconds, and Complete only without any of them and all bytes read."""
    by = bad.groupBy("acquisition_id").agg(F.count(F.lit(1)).alias("bad_ranges"), F.sum("sectors").alias("bad_sectors"))
    rows = acquisitions.join(by, "acquisition_id", "left").fillna(0, ["bad_ranges", "bad_sectors"])
    whole = (F.col("bad_sectors") == 0) & (F.col("bytes_read") == F.col("size_bytes"))
    return rows.select("acquisition_id", "bad_ranges", "bad_sectors", (F.col("bad_sectors") * 512).alias("zero_filled"), (F.col("ended") - F.col("started")).alias("seconds"), F.when(whole, "Complete").otherwise("Partial").alias("status"))


def custody_log(custody: DataFrame, case_id, action: str | None = None) -> DataFrame:
    """A case's custody events, of one action or all; order by the time column where it matters."""
    rows = custody.where(F.col("case_id") == case_id)
    return rows if action is None else rows.where(F.col("action") == action)


def artifact_lineage(artifacts: DataFrame, provenance: DataFrame, states: DataFrame, regions: DataFrame) -> DataFrame:
    """Artifacts with how they came about, their state, and their source regions in order."""
    sources = regions.groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "length"))), lambda r: F.concat(r["offset"].cast("string"), F.lit("+"), r["length"].cast("string"))), ",").alias("regions"))
    return artifacts.join(provenance, "artifact_id", "left").join(states, "artifact_id", "left").join(sources, "artifact_id", "left")


def finalize_exports(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(export rows with the digest of their body, a custody row for each)."""
    exports = requests.withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256)).withColumn("n_bytes", F.octet_length("body"))
    custody = exports.select("case_id", F.lit("export").alias("action"), "export_id", "sha256")
    return exports.drop("body"), custody


def validate_artifacts(artifacts: DataFrame) -> DataFrame:
    """The checks of each artifact in order, each PASS, FAIL, UNAVAILABLE or, behind a failure, SKIPPED."""
    tests = [("exists", F.col("exists")), ("not empty", F.col("n_bytes") > 0), ("hash", F.col("sha256") == F.col("stored_sha256")), ("geometry", (F.col("width") > 0) & (F.col("height") > 0)), ("codec", F.col("codec").isin("H264", "H265", "MJPEG"))]
    failed, out = F.lit(False), []
    for k, (name, test) in enumerate(tests):
        state = F.when(failed, "SKIPPED").when(test.isNull(), "UNAVAILABLE").when(test, "PASS").otherwise("FAIL")
        out.append(F.struct(F.lit(k).alias("place"), F.lit(name).alias("check"), state.alias("state")))
        failed = failed | F.coalesce(~test, F.lit(False))
    return artifacts.select("artifact_id", F.explode(F.array(*out)).alias("c")).select("artifact_id", "c.*")
