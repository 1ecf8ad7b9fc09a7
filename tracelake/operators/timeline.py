"""Timelines: sessions, gaps, cadence, correlation across channels, clock correction and orders.

Times are epoch seconds in ``instant``; a row whose zone is unknown keeps its own domain and is never put in line with UTC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .islands import anchored_groups, number_islands

CHANNEL = ("image_id", "channel", "domain")
#: Seconds: gap between events, silence that starts a session, missing footage worth a gap, correlation width.
MAX_GAP, SPLIT, MIN_GAP, CORRELATION = 120, 3600, 30, 5


def assign_domain(segments: DataFrame, zone_offset: str, examiner_offset: str | None = None) -> DataFrame:
    """``segments`` with domain, label and conflict: absolute where the zone is known, or shifted by an examiner's zone, else the device's own."""
    zone, examiner = F.col(zone_offset), F.col(examiner_offset) if examiner_offset else F.lit(None).cast("long")
    domain = F.when(F.col("instant").isNull(), None).when(zone.isNotNull() | examiner.isNotNull(), "absolute").otherwise("device-local")
    label = F.when(zone.isNotNull(), "recorded zone").when(examiner.isNotNull(), "examiner zone").otherwise("unknown zone")
    return segments.withColumns({"domain": domain, "label": label, "conflict": F.coalesce(zone.isNotNull() & examiner.isNotNull() & (zone != examiner), F.lit(False)), "instant": F.when(zone.isNull() & examiner.isNotNull(), F.col("instant") - examiner).otherwise(F.col("instant"))})


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("instant", "offset")


def timeline_gaps(events: DataFrame, max_gap: int = MAX_GAP, keys: Sequence[str] = ("image_id", "channel")) -> DataFrame:
    """Neighbouring comparable instants of a channel more than ``max_gap`` seconds apart."""
    w = _order(keys)
    nexts = events.where("instant is not null").withColumns({"next_instant": F.lead("instant").over(w), "next_offset": F.lead("offset").over(w)})
    gap = F.col("next_instant") - F.col("instant")
    return nexts.where(gap > max_gap).select(*keys, F.col("instant").alias("gap_start"), F.col("next_instant").alias("gap_end"), gap.alias("gap_seconds"), "offset", "next_offset")


def cadence(segments: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Per channel and domain the upper median of the positive steps between segments, at least 1."""
    steps = segments.withColumn("step", F.col("instant") - F.lag("instant").over(_order(keys))).where("step > 0")
    # counts by step first: the running count over distinct steps finds the median without a sort of all of them
    counted = steps.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("step")
    upto = counted.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy(*keys))})
    median = upto.where(F.col("upto") >= F.floor(F.col("all") / 2) + 1).groupBy(*keys).agg(F.min("step").alias("median"))
    return segments.select(*keys).distinct().join(median, list(keys), "left").select(*keys, F.greatest(F.coalesce("median", F.lit(1)), F.lit(1)).alias("cadence"))


def sessionize(segments: DataFrame, split: int = SPLIT, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """``segments`` with ``session``, which counts from 1 in each channel; a silence of ``split`` seconds or more starts a new one."""
    w = _order(keys)
    step = F.col("instant") - F.lag("instant").over(w)
    return number_islands(segments.where("instant is not null"), keys, ["instant", "offset"], F.coalesce(step >= split, F.lit(True)), "session")


def session_gaps(sessions: DataFrame, cadences: DataFrame, min_gap: int = MIN_GAP, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Footage missing inside sessions: what a step is longer than the cadence, from ``min_gap`` seconds on."""
    w = Window.partitionBy(*keys, "session").orderBy("instant", "offset")
    rows = sessions.withColumns({"next_instant": F.lead("instant").over(w), "next_offset": F.lead("offset").over(w)}).join(cadences, list(keys))
    missing = F.col("next_instant") - F.col("instant") - F.col("cadence")
    return rows.where(missing >= min_gap).select(*keys, "session", (F.col("instant") + F.col("cadence")).alias("gap_start"), F.col("next_instant").alias("gap_end"), missing.alias("missing_seconds"), F.col("offset").alias("previous_offset"), F.col("length").alias("previous_length"), "next_offset")


def session_rollup(segments: DataFrame, split: int = SPLIT, min_gap: int = MIN_GAP, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """One row a session: start, end = last + cadence, span, missing and covered seconds, ratio (1 for no span), counts and an id."""
    cadences = cadence(segments, keys)
    w = Window.partitionBy(*keys, "session").orderBy("instant", "offset")
    steps = sessionize(segments, split, keys).withColumn("step", F.lead("instant").over(w) - F.col("instant")).join(cadences, list(keys))
    missing = F.when(F.col("step") - F.col("cadence") >= min_gap, F.col("step") - F.col("cadence"))
    rolled = steps.groupBy(*keys, "session").agg(F.min("instant").alias("start"), (F.max("instant") + F.max("cadence")).alias("end"), F.count(F.lit(1)).alias("n_segments"), F.count(missing).alias("n_gaps"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_seconds"))
    span = F.col("end") - F.col("start")
    covered = F.greatest(span - F.col("missing_seconds"), F.lit(0))
    prefix = F.when(F.col("domain") == "absolute", "-").otherwise("-local-")
    return rolled.select(*keys, "session", F.concat(F.lit("ch"), F.col("channel").cast("string"), prefix, F.col("start").cast("string")).alias("session_id"), "start", "end", "n_segments", "n_gaps", span.alias("span_seconds"), "missing_seconds", covered.alias("covered_seconds"), F.when(span == 0, 1.0).otherwise(covered / span).alias("ratio"))


def timeline_summary(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """Per image: channels, sessions, segments, missing seconds, segments without a usable time and with an unknown zone."""
    by = sessions.groupBy("image_id").agg(F.count_distinct("channel").alias("n_channels"), F.count(F.lit(1)).alias("n_sessions"), F.sum("n_segments").alias("n_segments"), F.sum("missing_seconds").alias("missing_seconds"))
    other = segments.groupBy("image_id").agg(F.count_if(F.col("instant").isNull()).alias("n_without_time"), F.count_if(F.col("tz").isNull()).alias("n_unknown_zone"))
    return by.join(other, "image_id")


def analyze_gaps(gaps: DataFrame, covered: DataFrame, events: DataFrame) -> DataFrame:
    """Per image: temporal gaps and physical holes, events left out, and a state with its reason."""
    temporal = gaps.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("gap_seconds").alias("gap_seconds"))
    seen = events.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("instant").isNull() | F.col("tz").isNull()).alias("n_excluded"))
    rows = seen.join(temporal, "image_id", "left").join(covered.select("image_id", "n_holes", "unaccounted_bytes"), "image_id", "left").fillna(0, ["n_gaps", "gap_seconds", "n_holes", "unaccounted_bytes"])
    state = F.when(F.col("n_events") == F.col("n_excluded"), "UNKNOWN").when(F.col("n_excluded") > 0, "REVIEW").otherwise("PASS")
    reason = F.when(state == "UNKNOWN", "no event has a comparable time").when(state == "REVIEW", F.concat(F.col("n_excluded").cast("string"), F.lit(" events have no comparable time"))).otherwise("all events have a comparable time")
    return rows.withColumns({"state": state, "reason": reason})


def correlate(events: DataFrame, width: int = CORRELATION) -> DataFrame:
    """Windows anchored at an image's first event not yet in one; those with more than one channel, numbered in order of time.

    Rows without an instant are left out and end no window. A row with an unknown zone makes its window a REVIEW.
    """
    grouped = anchored_groups(events.where("instant is not null"), ["image_id"], "instant", width, ["offset"])
    rolled = grouped.groupBy("image_id", "anchor").agg(F.max("instant").alias("last"), F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("channel")).alias("__channels"), F.bool_or(F.col("tz").isNull()).alias("__unsure"))
    kept = rolled.where(F.size("__channels") > 1)
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("anchor"))
    return kept.select("image_id", F.format_string("CORR-%04d", number).alias("correlation_id"), "anchor", "last", "n_events", F.array_join(F.col("__channels").cast("array<string>"), ",").alias("channels"), F.when(F.col("__unsure"), "REVIEW").otherwise("PASS").alias("state"))


def fit_clock(anchors: DataFrame, key: str = "device") -> DataFrame:
    """Per device offset and drift of reference against recorder time: none, one offset, least squares with the largest residual, or an average.

    Times are centred on their mean before the fit.
    """
    middle = anchors.groupBy(key).agg(F.avg("recorder").alias("__mid"), F.count(F.lit(1)).alias("n_anchors"), F.count_distinct("recorder").alias("__times"), F.avg(F.col("reference") - F.col("recorder")).alias("__offset"))
    rows = anchors.join(middle, key).withColumns({"__x": F.col("recorder") - F.col("__mid"), "__y": F.col("reference") - F.col("recorder")})
    fit = rows.groupBy(key).agg(F.regr_slope("__y", "__x").alias("__slope"))
    both = middle.join(fit, key).withColumn("drift", F.when(F.col("__times") > 1, F.col("__slope")).otherwise(0.0))
    rest = rows.select(key, "__x", "__y").join(both, key).groupBy(key).agg(F.max(F.abs(F.col("__y") - F.col("__offset") - F.col("drift") * F.col("__x"))).alias("max_residual"))
    method = F.when(F.col("n_anchors") == 1, "single offset").when(F.col("__times") == 1, "coincident average").otherwise("least squares")
    return both.join(rest, key).select(key, "n_anchors", method.alias("method"), (F.col("__offset") - F.col("drift") * F.col("__mid")).alias("offset"), "drift", "max_residual")


def apply_clock(df: DataFrame, corrections: DataFrame, time: str, key: str = "device") -> DataFrame:
    """``df`` with corrected = round(t + offset + drift t); rows without a correction have null."""
    fixed = corrections.select(key, F.col("offset").alias("__offset"), F.col("drift").alias("__drift"))
    return df.join(fixed, key, "left").withColumn("corrected", F.round(F.col(time) + F.col("__offset") + F.col("__drift") * F.col(time)).cast("long")).drop("__offset", "__drift")


def order_key(kind: str) -> list[Column]:
    """Sort columns of a timeline: physical, native or normalized; the others break ties."""
    first = {"physical": [F.col("offset").asc_nulls_last(), "channel", "native", "instant"], "native": [F.col("native").asc_nulls_first(), "channel", "instant", F.col("offset").asc_nulls_last()], "normalized": [F.col("instant").asc_nulls_last(), F.col("offset").asc_nulls_last(), "channel", "native"]}[kind]
    return [*first, "description", "event_id"]


def order_timeline(events: DataFrame, kind: str) -> DataFrame:
    """Each image's events with their place in the order, from 1."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(*order_key(kind))))


def order_state(events: DataFrame) -> DataFrame:
    """Per image whether a normalized order can be trusted: UNKNOWN when empty of times, REVIEW when a zone is unknown, else PASS."""
    counts = events.groupBy("image_id").agg(F.count("instant").alias("n_timed"), F.count_if(F.col("tz").isNull()).alias("n_unknown_zone"))
    return counts.withColumn("state", F.when(F.col("n_timed") == 0, "UNKNOWN").when(F.col("n_unknown_zone") > 0, "REVIEW").otherwise("PASS"))


def filter_timeline(events: DataFrame, channels=None, kinds=None, dates=None, minutes: tuple[int, int] | None = None) -> DataFrame:
    """Rows that pass all facets given; the last minute of a time-of-day window counts whole, to its 59th second."""
    out = events
    if channels is not None:
        out = out.where(F.col("channel").isin(*channels))
    if kinds is not None:
        out = out.where(F.col("kind").isin(*kinds))
    if dates is not None:
        out = out.where(F.to_date(F.timestamp_seconds("instant")).cast("string").isin(*dates))
    if minutes is not None:
        out = out.where((F.col("instant") % 86400).between(minutes[0] * 60, minutes[1] * 60 + 59))
    return out


def facets(events: DataFrame) -> DataFrame:
    """The distinct channels and dates of each image."""
    dates = F.to_date(F.timestamp_seconds("instant")).cast("string")
    pairs = F.array(F.struct(F.lit("channel").alias("facet"), F.col("channel").cast("string").alias("value")), F.struct(F.lit("date").alias("facet"), dates.alias("value")))
    return events.select("image_id", F.explode(pairs).alias("p")).select("image_id", "p.*").where("value is not null").distinct()


def sort_rows(df: DataFrame, key: str, descending: bool, ties: Sequence[str]) -> DataFrame:
    """Each image's rows numbered by a user's sort key, all ties broken."""
    first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    return df.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(first, *ties)))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key: one aggregation, no sort."""
    others = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return newest.select(*keys, "__row.*")


def cap_rows(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each key with the number of all rows of the key."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "n_all": F.count(F.lit(1)).over(w)}).where(F.col("rank") <= k)


def recovery_targets(gaps: DataFrame, holes: DataFrame) -> DataFrame:
    """Temporal gaps (by their offsets) and physical holes as one list, numbered by where a scan starts."""
    temporal = gaps.select("image_id", F.lit("temporal").alias("source"), F.least("offset", "next_offset").alias("scan_start"), F.abs(F.col("next_offset") - F.col("offset")).alias("scan_bytes"))
    physical = holes.select("image_id", F.lit("physical").alias("source"), F.col("offset").alias("scan_start"), F.col("length").alias("scan_bytes"))
    w = Window.partitionBy("image_id").orderBy("scan_start", "source", "scan_bytes")
    return temporal.unionByName(physical).withColumn("place", F.row_number().over(w))


def order_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions (image_id, domain, start, channel) with their place in the image's list: by basis, start and channel."""
    w = Window.partitionBy("image_id").orderBy("domain", "start", "channel")
    return sessions.withColumn("place", F.row_number().over(w).cast("long"))


def final_events(preliminary: DataFrame, recovered: DataFrame) -> DataFrame:
    """Both kinds of events with their origin; columns that only one of them has are null in the other."""
    first = preliminary.withColumn("origin", F.lit("preliminary"))
    return first.unionByName(recovered.withColumn("origin", F.lit("recovered")), allowMissingColumns=True)
