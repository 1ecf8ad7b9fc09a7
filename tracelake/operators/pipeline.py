"""The full run over many images in one job: each gate is a column with a reason, and a filter feeds the next operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import recovery as V
from . import ranges as R
from .timeline import cap_rows


def detection_gate(classified: DataFrame) -> DataFrame:
    """Images (image_id, classification) with decision: proceed, analyst for ambiguous ones, or stop, and the reason."""
    c = F.col("classification")
    decision = F.when(c.isin("Confirmed", "CompatibleCandidate"), "proceed").when(c == "Ambiguous", "analyst").otherwise("stop")
    return classified.withColumns({"decision": decision, "reason": F.concat(F.lit("detection is "), c)})


def run_gates(classified: DataFrame, recordings: DataFrame, gaps: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row an image with the outcome: where the run ended, and counts up to there (null behind it).

    ``recordings``, ``gaps`` and ``candidates`` are rows with an image_id; only those of images that got so far are counted.
    """
    gate1 = detection_gate(classified).select("image_id", "classification", "decision")
    on = gate1.where("decision = 'proceed'").select("image_id")

    def count(df, images, name):
        return images.join(df.groupBy("image_id").agg(F.count(F.lit(1)).alias(name)), "image_id", "left").fillna(0, [name])

    parsed = count(recordings, on, "n_recordings")
    timed = count(gaps, parsed.where("n_recordings > 0").select("image_id"), "n_gaps")
    found = count(candidates, timed.where("n_gaps > 0").select("image_id"), "n_candidates")
    rows = gate1.join(parsed, "image_id", "left").join(timed, "image_id", "left").join(found, "image_id", "left")
    outcome = F.when(F.col("decision") == "analyst", "needs an analyst").when(F.col("decision") == "stop", "not identified").when(F.col("n_recordings") == 0, "no recordings").when(F.col("n_gaps") == 0, "complete").when(F.col("n_candidates") == 0, "gaps, nothing recovered").otherwise("gaps, candidates recovered")
    return rows.withColumn("outcome", outcome)


def run_recovery(records: DataFrame, images: DataFrame, findings: DataFrame, max_bytes: int, max_regions: int) -> DataFrame:
    """Per image the targets of the plan within the budget, the findings (image_id, offset, ...) that lie in one of them, and those by state.

    ``findings`` are regions with the columns of ``classify_regions``; outside of the planned targets nothing is looked at. A region that is
    given twice counts once; it has one place, and so one bin, in which it meets its targets and is told from others without going elsewhere.
    """
    # asked for twice, by the findings and by the counts
    targets = stored(V.planned_targets(records, images, max_bytes, max_regions).select("image_id", "offset", "length", "truncated"), "targets")
    spread = R.with_bins(targets.select("image_id", F.col("offset").alias("t_offset"), F.col("length").alias("t_length")), F.col("t_offset"), F.col("t_offset") + F.col("t_length"))
    regions = V.classify_regions(findings).withColumn("__bin", F.floor(F.col("offset") / R.BIN))
    inside = regions.join(spread, ["image_id", "__bin"]).where("offset >= t_offset and offset < t_offset + t_length")
    hits = inside.groupBy("image_id", "__bin", "region_id").agg(F.first("data_state").alias("data_state"))
    by = hits.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_candidates"), *[F.count_if(F.col("data_state") == s).alias(f"n_{s.lower()}") for s in ("Active", "Deleted", "Orphaned", "Unindexed", "Corrupted")])
    done = targets.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("length").alias("bytes"), F.bool_or("truncated").alias("truncated"))
    return done.join(by, "image_id", "left").fillna(0)


def basis_inventory(spans: DataFrame, holes: DataFrame, residual: DataFrame, most: int) -> DataFrame:
    """What an image may still hold, by how it is known: indexed spans, unreferenced holes, residual entries; the first ``most`` of each image by offset."""
    parts = [d.select("image_id", F.lit(basis).alias("basis"), "offset", "length") for basis, d in (("indexed", spans), ("structural", holes), ("heuristic", residual))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("length > 0")
    return cap_rows(rows, ["image_id"], ["offset", "basis", "length"], most)
