"""Recorder indexes: which copy to trust, which blocks and entries belong together, how far a block's recording reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compare_indexes(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """Per image entries in both copies and in one alone, and a verdict: agree, disagree, single or neither."""
    both = primary.select("image_id", "offset", F.lit(True).alias("p")).distinct().join(backup.select("image_id", "offset", F.lit(True).alias("b")).distinct(), ["image_id", "offset"], "full_outer")
    by = both.groupBy("image_id").agg(F.count_if(F.col("p") & F.col("b")).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_primary_only"), F.count_if(F.col("p").isNull()).alias("n_backup_only"))
    verdict = F.when((F.col("n_both") == 0) & ((F.col("n_primary_only") == 0) | (F.col("n_backup_only") == 0)), "single").when((F.col("n_primary_only") == 0) & (F.col("n_backup_only") == 0), "agree").otherwise("disagree")
    return by.withColumn("verdict", verdict)


def select_authority(compared: DataFrame) -> DataFrame:
    """The copy to follow: the backup only if it has strictly more entries; anything but agreement makes it partial."""
    p, b = F.col("n_both") + F.col("n_primary_only"), F.col("n_both") + F.col("n_backup_only")
    return compared.select("image_id", F.when(b > p, "backup").otherwise("primary").alias("authority"), F.when(F.col("verdict") == "agree", "Authoritative").otherwise("Partial").alias("standing"), F.concat_ws("; ", F.when(F.col("verdict") != "agree", F.concat(F.lit("indexes "), F.col("verdict"))), F.when(b > p, F.lit("backup is more complete"))).alias("downgrades"))


def one_sided(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side alone, with the side."""
    left = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("a"))
    return left.unionByName(b.select(*keys).distinct().join(a.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("b")))


def select_table(tables: DataFrame) -> DataFrame:
    """Per image and partition its table: the primary, else the first secondary; any secondary makes it available only."""
    w = Window.partitionBy("image_id", "partition").orderBy(F.when(F.col("role") == "primary", 0).otherwise(1), "offset")
    rows = tables.withColumns({"__n": F.row_number().over(w), "__any": F.bool_or(F.col("role") != "primary").over(Window.partitionBy("image_id"))})
    return rows.where("__n = 1").select("image_id", "partition", "role", "offset", (~F.col("__any")).alias("accessible"))


def map_entries(entries: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """Entries (image_id, entry_id, data_offset) with the block that they point into, and whether there is such a block."""
    rows = entries.withColumn("block", F.floor(F.col("data_offset") / block_size))
    known = blocks.select("image_id", "block", F.lit(True).alias("__known")).distinct()
    return rows.join(known, ["image_id", "block"], "left").withColumn("dangling", F.col("__known").isNull()).drop("__known")


def classify_blocks(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Blocks as malformed, out of scope, referenced by an entry or unreferenced, with the number of entries."""
    counts = entries.where("not dangling").groupBy("image_id", "block").agg(F.count(F.lit(1)).alias("n_entries"))
    rows = blocks.join(counts, ["image_id", "block"], "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))
    return rows.withColumn("class", F.when(F.col("malformed"), "malformed").when(~F.col("in_scope"), "out of scope").when(F.col("n_entries") > 0, "referenced").otherwise("unreferenced"))


def match_entries(clips: DataFrame, entries: DataFrame) -> DataFrame:
    """Clips with their entry in the same block: one whose offset lies inside the clip first, else one of a compatible channel and overlapping time; null is compatible."""
    rows = clips.join(entries, ["image_id", "block"], "left")
    inside = (F.col("data_offset") >= F.col("offset")) & (F.col("data_offset") < F.col("offset") + F.col("length"))
    same = (F.col("channel").isNull() | F.col("entry_channel").isNull() | (F.col("channel") == F.col("entry_channel"))) & F.coalesce(F.col("start") <= F.col("entry_end"), F.lit(True)) & F.coalesce(F.col("entry_start") <= F.col("end"), F.lit(True))
    rank = F.when(F.coalesce(inside, F.lit(False)), 0).when(F.col("entry_id").isNotNull() & same, 1)
    best = rows.withColumn("__rank", rank).groupBy("image_id", "clip_id").agg(F.min(F.when(F.col("__rank").isNotNull(), F.struct(F.col("__rank").alias("rank"), "entry_id"))).alias("m"))
    return best.select("image_id", "clip_id", "m.entry_id", F.when(F.col("m.rank") == 0, "offset").when(F.col("m.rank") == 1, "channel and time").alias("basis"))


def compute_spans(entries: DataFrame, unit_size: int) -> DataFrame:
    """How far each entry's data reaches, from the next entry of its unit: (basis, length, lower_bound).

    ``entries``: image_id, unit, index, offset (in the unit; null: not usable). The last entry reaches to the unit's end.
    """
    w = Window.partitionBy("image_id", "unit").orderBy("index")
    rows = entries.withColumns({"__next": F.lead("offset").over(w), "__more": F.lead("index").over(w)})
    basis = F.when(F.col("offset").isNull(), "unusable").when(F.col("offset") >= unit_size, "exceeds unit").when(F.col("__more").isNull(), "terminal").when(F.col("__next").isNull(), "next unusable").when(F.col("__next") == F.col("offset"), "duplicate").when(F.col("__next") < F.col("offset"), "wraparound").otherwise("adjacent")
    length = F.when(basis == "adjacent", F.least(F.col("__next"), F.lit(unit_size)) - F.col("offset")).when(basis.isin("terminal", "next unusable", "wraparound"), unit_size - F.col("offset")).otherwise(0)
    return rows.withColumns({"basis": basis, "length": length, "lower_bound": basis.isin("duplicate", "unusable", "exceeds unit")}).drop("__next", "__more")


def unit_summary(spans: DataFrame) -> DataFrame:
    """Per unit: entries, usable ones, bytes, and how often each basis comes, as text in order of the basis."""
    by = spans.groupBy("image_id", "unit", "basis").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    return by.groupBy("image_id", "unit").agg(F.sum("n").alias("n_entries"), F.sum(F.when(F.col("basis") != "unusable", F.col("n")).otherwise(0)).alias("n_usable"), F.sum("bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_list(F.concat("basis", F.lit("="), F.col("n").cast("string")))), ",").alias("bases"))


def time_index_summary(entries: DataFrame) -> DataFrame:
    """Per image: populated, valid and implausible entries, first and last index, earliest and latest valid time."""
    valid = F.col("ts").between(946684800, 4102444800)
    return entries.groupBy("image_id").agg(F.count("ts").alias("n_populated"), F.count_if(valid).alias("n_valid"), F.count_if(F.col("ts").isNotNull() & ~valid).alias("n_implausible"), F.min(F.when(F.col("ts").isNotNull(), F.col("index"))).alias("first_index"), F.max(F.when(F.col("ts").isNotNull(), F.col("index"))).alias("last_index"), F.min(F.when(valid, F.col("ts"))).alias("earliest"), F.max(F.when(valid, F.col("ts"))).alias("latest"))


def flow_totals(units: DataFrame) -> DataFrame:
    """Per image bytes of all readable units, and of those before the first unreadable one."""
    w = Window.partitionBy("image_id").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    rows = units.withColumn("__bad", F.max(F.when(F.col("readable"), 0).otherwise(1)).over(w))
    return rows.groupBy("image_id").agg(F.coalesce(F.sum(F.when(F.col("readable"), F.col("bytes"))), F.lit(0)).alias("scan_bytes"), F.coalesce(F.sum(F.when(F.col("__bad") == 0, F.col("bytes"))), F.lit(0)).alias("prefix_bytes"))


def described_regions(clips: DataFrame) -> DataFrame:
    """The distinct regions that clips (image_id, offset, length) describe."""
    return clips.select("image_id", "offset", "length").distinct()
