"""Runs over image bytes: recovery that scans what its plan names, and the whole run from signatures to recovered candidates.

Images are ``FileImages``, of which only the windows are read that a step needs, or a table of chunks (image_id, base_offset, owned_len,
data) of ``window`` bytes each, where null data is a window that can't be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as B
from ..functions import times as T
from ..sources.images import FileImages, as_images
from ..sources.scratch import checkpointed
from . import decode, detect
from . import ranges as R
from . import recovery as V
from .pipeline import detection_gate
from .timeline import MAX_GAP, timeline_gaps

STATES = ("Active", "Deleted", "Orphaned", "Unindexed", "Corrupted")
#: Bytes of the bins in which hits meet targets.
BIN = 1 << 16


def place_hits(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits (image_id, offset, ...) that lie in a target, with its kind as ``target``; where claimed and available ranges overlap, the claimed one counts."""
    spread = R.with_bins(targets.select("image_id", "kind", F.col("offset").alias("__lo"), (F.col("offset") + F.col("length")).alias("__hi")), F.col("__lo"), F.col("__hi"), BIN)
    met = hits.withColumn("__bin", F.floor(F.col("offset") / BIN)).join(spread, ["image_id", "__bin"]).where("offset >= __lo and offset < __hi")
    rank = F.when(F.col("kind") == "claimed", 0).when(F.col("kind") == "available", 1).otherwise(2)
    others = [F.first(c).alias(c) for c in hits.columns if c not in ("image_id", "offset")]
    # a hit has one bin, so hits are grouped where the join has put them
    return met.groupBy("image_id", "__bin", "offset").agg(F.min_by("kind", rank).alias("target"), *others).drop("__bin")


def scan_recovery(chunks: DataFrame | FileImages, images: DataFrame, records: DataFrame, scope: DataFrame, window: int, max_bytes: int = V.ALL_BYTES, max_regions: int = V.ALL_REGIONS) -> tuple[DataFrame, DataFrame]:
    """(candidates, report): container frames in the bytes that the plan names, classified, and one row an image on the run.

    ``images``: image_id, size_bytes; ``records``: image_id, accessible, offset, length; ``scope``: the one region of an image that its index
    governs, images without one have no row. Targets with an unreadable window are skipped and counted; the run goes on. A frame with an
    unknown kind has no signature and goes; one without a valid length, trailer or back-length is Corrupted. A run that its bounds cut
    is a REVIEW. Of files only the windows that targets touch are searched, headers come along with the hits, and trailers are read by seeking; a table
    of chunks is searched whole, and its windows shuffle where headers and trailers are read.
    """
    planned = V.planned_targets(records, images, max_bytes, max_regions)
    source = as_images(chunks, window)
    targets = checkpointed(source.readable(planned.select("image_id", "kind", "offset", "length", "truncated")))
    found = detect.find_in_images(source, b"DHAV", touching=targets.where("readable"), follow=(0, decode.HEADER)).withColumnRenamed("bytes", "head")
    frames = decode.tagged_frames(chunks, window, hits=place_hits(found, targets.where("readable")))
    governed = scope.select("image_id", F.col("offset").alias("__lo"), (F.col("offset") + F.col("length")).alias("__hi"))
    inside = F.when(F.col("__lo").isNull(), "no index").when((F.col("offset") >= F.col("__lo")) & (F.col("offset") < F.col("__hi")), "unclaimed in scope").otherwise("outside scope")
    valid = (F.col("length") > 0) & (F.col("offset") + F.col("length") <= F.col("owned_len")) & F.col("trailer_ok") & (F.col("back_length") == F.col("length"))
    rows = frames.join(governed, "image_id", "left").withColumns({
        "claim": F.when(F.col("target") == "claimed", "indexed").when(F.col("target") == "available", "available").otherwise(inside),
        "allocation": F.when(F.col("target") == "available", "free").otherwise("allocated"),
        "present": F.lit(True),
        "signature": F.coalesce(~F.col("kind").startswith("unrecognised"), F.lit(False)),
        "valid": F.coalesce(valid, F.lit(False)),
        "channel": B.channel_zero_based(F.col("raw_channel")),
        "start": F.unix_seconds(T.packed_clock(F.col("packed_time"))["time"]),
    })
    kept = ["image_id", "offset", "length", "kind", "channel", "start", "target", "claim", "valid", "data_state", "status", "level"]
    candidates = checkpointed(V.classify_regions(rows).select(*kept))
    return candidates, recovery_report(targets, candidates, images)


def recovery_report(targets: DataFrame, candidates: DataFrame, images: DataFrame) -> DataFrame:
    """Per image of ``images``: targets and bytes searched and skipped, candidates by validity and state, PASS, or REVIEW where bounds cut the plan."""
    by = targets.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("length").alias("bytes"), F.count_if(~F.col("readable")).alias("n_skipped"), F.sum(F.when(F.col("readable"), 0).otherwise(F.col("length"))).alias("bytes_skipped"), F.bool_or("truncated").alias("truncated"))
    states = [F.count_if(F.col("data_state") == s).alias(f"n_{s.lower()}") for s in STATES]
    found = candidates.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("valid").alias("n_valid"), *states)
    rows = images.select("image_id").join(by, "image_id", "left").join(found, "image_id", "left").fillna(0).fillna(False, ["truncated"])
    return rows.withColumn("state", F.when(F.col("truncated"), "REVIEW").otherwise("PASS"))


def recovery_decision(report_found: Column, partly: Column) -> Column:
    return F.when(report_found == 0, "not recovered").when(partly, "partially recovered").otherwise("completely recovered")


def run_images(chunks: DataFrame | FileImages, rules: DataFrame, most: DataFrame, records: DataFrame, scope: DataFrame, window: int, overlap: int, max_gap: int = MAX_GAP, min_bytes: int = 1 << 20, max_bytes: int = V.ALL_BYTES) -> tuple[DataFrame, DataFrame]:
    """(run, candidates): the whole run over many images. A row an image: each gate's decision, counts up to there (null behind it) and the outcome.

    ``rules`` and ``most`` as ``evaluate_rules`` and ``vendor_scores`` take them; ``records``: what the vendors' indexes describe
    (image_id, offset, length, accessible, channel, instant). Images of a vendor are parsed by their records, images of none by carving start
    codes, ambiguous ones go to an analyst, as do those in which nothing is parsed. Gaps are silences of a channel above ``max_gap`` seconds and holes
    of ``min_bytes`` or more; only images with gaps are searched for candidates. Images of no vendor have no index in the search.
    """
    scores = detect.vendor_scores(detect.evaluate_rules(chunks, rules, window, overlap), most)
    gate = checkpointed(detection_gate(detect.classify_top(scores)).select("image_id", F.when(F.col("decision") == "proceed", F.col("vendor")).alias("vendor"), "classification", "decision"))
    known, unknown = (gate.where(F.col("decision") == d).select("image_id") for d in ("proceed", "stop"))
    described = records.join(known, "image_id", "left_semi").select("image_id", "offset", "length", "accessible", "channel", "instant")
    runs = decode.carve_streams(chunks, window, images=unknown)
    carved = runs.select("image_id", F.col("run").alias("offset"), (F.col("last") - F.col("run") + 4).alias("length"))
    recordings = checkpointed(described.unionByName(carved, allowMissingColumns=True))
    parsed = recordings.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_recordings"))
    sizes = checkpointed(as_images(chunks, window).sizes().join(parsed.select("image_id"), "image_id", "left_semi"))
    silent = timeline_gaps(recordings, max_gap).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_gaps"))
    holes = R.coverage(recordings, sizes, min_bytes).select("image_id", "n_holes")
    gaps = checkpointed(holes.join(silent, "image_id", "left").fillna(0, ["n_gaps"]))
    searched = sizes.join(gaps.where("n_gaps > 0 or n_holes > 0"), "image_id", "left_semi")
    candidates, report = scan_recovery(chunks, searched, described, scope.join(known, "image_id", "left_semi"), window, max_bytes)
    partly = F.col("truncated") | (F.col("n_corrupted") > 0)
    recovered = report.select("image_id", "n_candidates", "n_skipped", recovery_decision(F.col("n_candidates"), partly).alias("recovery"))
    rows = gate.join(parsed, "image_id", "left").join(gaps, "image_id", "left").join(recovered, "image_id", "left")
    n = F.when(F.col("decision") != "analyst", F.coalesce("n_recordings", F.lit(0)))
    outcome = F.when(F.col("decision") == "analyst", "needs an analyst: ambiguous").when(F.col("n_recordings").isNull(), "needs an analyst: not parsed").when(F.col("recovery").isNull(), "complete").otherwise(F.concat(F.lit("gaps, "), F.col("recovery")))
    return rows.select("image_id", "vendor", "classification", "decision", n.alias("n_recordings"), "n_gaps", "n_holes", "n_candidates", "n_skipped", outcome.alias("outcome")), candidates
