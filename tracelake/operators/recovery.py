"""Recovery: fragments in order, regions classified, groups, plans and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranges as R
from .prefix import by_ranges, running_sums, sums_in_ranges

#: Bytes of a probe at most, and of a scan chunk.
PROBE, CHUNK = 256 * 1024, 1024 * 1024
#: Bounds that cut nothing.
ALL_BYTES, ALL_REGIONS = 1 << 62, (1 << 32) - 1


def classify_regions(df: DataFrame) -> DataFrame:
    """Regions (claim, allocation, present, signature, valid) with data_state, status and level; those without codec evidence go.

    claim: indexed, available, unclaimed in scope, outside scope or no index. Only a mark that frees the entry means deletion.
    """
    rows = df.where("present and signature")
    claim, free = F.col("claim"), F.col("allocation") == "free"
    inner = claim.isin("available", "unclaimed in scope")
    level = F.when(claim == "indexed", "L1").when(inner, "L2").otherwise("L3")
    state = F.when(~F.col("valid"), "Corrupted").when(claim.isin("indexed", "available") & free, "Deleted").when(claim == "indexed", "Active").when(inner, "Orphaned").otherwise("Unindexed")
    return rows.withColumns({"data_state": state, "status": F.when(F.col("valid"), "Recoverable").otherwise("PartiallyRecoverable"), "level": level})


def coarse_assessment(indexed: Column, present: Column, valid: Column, overwritten: Column) -> Column:
    """One word from four yes/no findings."""
    return F.when(overwritten, "Overwritten").when(~present, "Unrecoverable").when(~valid, "Corrupted").when(indexed, "Active").otherwise("Orphaned")


def sequence_gaps(fragments: DataFrame, key: str = "group_id") -> DataFrame:
    """Jumps in a group's sequence numbers, with how many are missing."""
    w = Window.partitionBy(key).orderBy("sequence", "offset")
    rows = fragments.withColumn("previous", F.lag("sequence").over(w))
    return rows.where(F.col("sequence") > F.col("previous") + 1).select(key, "previous", "sequence", (F.col("sequence") - F.col("previous") - 1).alias("missing"))


def discontinuities(fragments: DataFrame, key: str = "group_id") -> DataFrame:
    """Neighbours in sequence that don't lie one behind the other: fragmented by some bytes, or a wrap to before the last one."""
    w = Window.partitionBy(key).orderBy("sequence", "offset", "length")
    rows = fragments.withColumns({"previous_offset": F.lag("offset").over(w), "__end": F.lag(F.col("offset") + F.col("length")).over(w)})
    kind = F.when(F.col("offset") < F.col("previous_offset"), "wrap").otherwise("fragmented")
    return rows.where(F.col("offset") != F.col("__end")).select(key, "sequence", "previous_offset", "offset", kind.alias("kind"), F.when(kind == "fragmented", F.greatest(F.col("offset") - F.col("__end"), F.lit(0))).alias("distance"))


def order_frames(frames: DataFrame, key: str = "group_id") -> DataFrame:
    """Frames with their place among the valid ones by time (unknown last), and the gap before each: more than 1024 bytes from the last end."""
    w = Window.partitionBy(key, "valid").orderBy(F.col("ts").asc_nulls_last(), "offset", "size", "fragment_id")
    end = F.lag(F.col("offset") + F.col("size")).over(w)
    gap = F.when(F.col("valid") & (F.col("offset") > end + 1024), F.col("offset") - end)
    return frames.withColumns({"place": F.when(F.col("valid"), F.row_number().over(w)), "gap_bytes": gap})


def regressions(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str) -> DataFrame:
    """Per key how often a time is before the last known one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__last", F.last(ts, ignorenulls=True).over(w))
    return rows.groupBy(*keys).agg(F.count_if(F.col(ts) < F.col("__last")).alias("regressions"), F.count(ts).alias("n_timed"))


def rank_hypotheses(df: DataFrame, k: int, key: str = "image_id") -> DataFrame:
    """The best ``k`` of each key by score, then first offset, fewer regions and id; a tie of the first two or a cut is a REVIEW."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "min_offset", "n_regions", "hypothesis_id")
    rows = df.withColumns({"rank": F.row_number().over(w), "__next": F.lead("score").over(w), "n_all": F.count(F.lit(1)).over(Window.partitionBy(key))})
    tie = F.max(F.when((F.col("rank") == 1) & (F.col("__next") == F.col("score")), 1).otherwise(0)).over(Window.partitionBy(key))
    state = F.when((tie == 1) | (F.col("n_all") > k), "REVIEW").otherwise("PASS")
    return rows.withColumn("state", state).where(F.col("rank") <= k).drop("__next", "n_all")


def budget_prefix(targets: DataFrame, keys: Sequence[str], order: Sequence[str], max_bytes: int, max_regions: int) -> DataFrame:
    """Targets in order up to the first that would break a bound; ``truncated`` tells whether there was one.

    Where no length is negative what is behind the first one breaks a bound too, so that rows needn't meet it: they are summed and cut in one
    pass, and the sums of a key tell whether it was cut.
    """
    values = {"bytes_upto": F.col("length"), "place": F.lit(1)}
    dealt = by_ranges(targets, keys, order)
    broken = lambda size, place: F.coalesce((size > max_bytes) | (place > max_regions), F.lit(False))
    if dealt.where("length < 0").isEmpty():
        rows = sums_in_ranges(dealt, keys, order, values)
        kept = rows.where(~broken(F.col("bytes_upto"), F.col("place")))
        return kept.withColumn("truncated", broken(F.col("__all_bytes_upto"), F.col("__all_place"))).select(*targets.columns, *values, "truncated")
    rows = running_sums(targets, keys, order, values)
    over = broken(F.col("bytes_upto"), F.col("place"))
    stops = rows.groupBy(*keys).agg(F.min(F.when(over, F.col("place"))).alias("__stop")).where("__stop is not null").select(*[F.col(k).alias(f"__{k}") for k in keys], "__stop")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    kept = rows.join(stops, same, "left").where(F.col("__stop").isNull() | (F.col("place") < F.col("__stop")))
    return kept.withColumn("truncated", F.col("__stop").isNotNull()).drop("__stop", *[f"__{k}" for k in keys])


def establish_order(fragments: DataFrame, key: str = "group_id") -> DataFrame:
    """Members with the basis of their order and their place: distinct sequence numbers, else distinct times, else place on disk, which is no timeline."""
    group = Window.partitionBy(key)
    again = lambda c: F.coalesce(F.lag(c).over(group.orderBy(c)) == F.col(c), F.lit(False))
    rows = R.dealt(fragments, key).withColumn("__s", again("sequence")).withColumn("__t", again("ts"))
    n = F.count(F.lit(1)).over(group)
    known, distinct = (lambda c: F.count(c).over(group) == n), (lambda c: ~F.bool_or(c).over(group))
    basis = F.when(known("sequence"), F.when(distinct("__s"), "sequence").otherwise("unknown: duplicate sequence numbers")).when(known("ts"), F.when(distinct("__t"), "time").otherwise("unknown: identical times")).otherwise("unknown: no ordering evidence")
    rows = rows.withColumn("basis", basis).drop("__s", "__t")
    chosen = F.when(F.col("basis") == "sequence", F.col("sequence")).when(F.col("basis") == "time", F.col("ts")).otherwise(F.col("offset"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(chosen, "offset", "length", "fragment_id")))


def adjacent_overlaps(fragments: DataFrame, key: str = "group_id") -> DataFrame:
    """Per group how many members start before the end of the one before, in order of place on disk."""
    w = Window.partitionBy(key).orderBy("offset", "length", "fragment_id")
    rows = fragments.withColumn("__end", F.lag(F.col("offset") + F.col("length")).over(w))
    return rows.groupBy(key).agg(F.count_if(F.col("offset") < F.col("__end")).alias("overlaps"))


def group_fragments(fragments: DataFrame, max_members: int, max_groups: int) -> DataFrame:
    """Fragments with a group key: the parent recording, else partition, channel and originating region, else alone; members and groups are capped with a flag.

    ``truncated``: the group has more members than are given; ``n_groups`` of the image, and ``groups_truncated`` if those behind ``max_groups`` are left out.
    """
    together = F.concat_ws("/", F.lit("stream"), F.col("partition").cast("string"), F.col("channel").cast("string"), F.col("region_id").cast("string"))
    key = F.when(F.col("parent").isNotNull(), F.concat(F.lit("recording/"), F.col("parent").cast("string"))).when(F.col("channel").isNotNull() & F.col("region_id").isNotNull(), together).otherwise(F.concat(F.lit("alone/"), F.col("fragment_id").cast("string")))
    keyed = fragments.withColumn("group_id", key)
    w = Window.partitionBy("image_id", "group_id").orderBy("offset", "length", "fragment_id")
    rows = keyed.withColumns({"member": F.row_number().over(w), "n_members": F.count(F.lit(1)).over(Window.partitionBy("image_id", "group_id"))})
    groups = keyed.groupBy("image_id", "group_id").agg(F.min("offset").alias("first_offset"))
    ranked = groups.withColumns({"group_rank": F.row_number().over(Window.partitionBy("image_id").orderBy("first_offset", "group_id")), "n_groups": F.count(F.lit(1)).over(Window.partitionBy("image_id"))}).where(F.col("group_rank") <= max_groups)
    return rows.where(F.col("member") <= max_members).join(ranked, ["image_id", "group_id"]).withColumns({"truncated": F.col("n_members") > max_members, "groups_truncated": F.col("n_groups") > max_groups})


def unanimous(col: str) -> Column:
    """The one value that all rows of a group carry, else null."""
    return F.when((F.min(col) == F.max(col)) & (F.count(col) == F.count(F.lit(1))), F.min(col))


def group_records(fragments: DataFrame, key: str = "group_id") -> DataFrame:
    """One row a group: members, regions in order, unanimous channel and state, first start and last end."""
    return fragments.groupBy("image_id", key).agg(
        F.count(F.lit(1)).alias("n_fragments"),
        unanimous("channel").alias("channel"),
        unanimous("state").alias("state"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.sum("length").alias("bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "fragment_id"))), lambda r: F.concat(r["offset"].cast("string"), F.lit("+"), r["length"].cast("string"))), ",").alias("regions"),
    )


def reassemble(fragments: DataFrame, max_fragments: int, key: str = "group_id") -> DataFrame:
    """Per group its first ``max_fragments`` in sequence: logical gaps, missing numbers, contiguity, and a state. Capped after sorting."""
    w = Window.partitionBy(key).orderBy("sequence", "offset", "length")
    rows = fragments.withColumns({"__n": F.row_number().over(w), "__seq": F.lag("sequence").over(w), "__end": F.lag(F.col("offset") + F.col("length")).over(w)})
    missing = F.when(F.col("sequence") > F.col("__seq") + 1, F.col("sequence") - F.col("__seq") - 1)
    kept = F.col("__n") <= max_fragments
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(kept, missing)).alias("n_gaps"), F.coalesce(F.sum(F.when(kept, missing)), F.lit(0)).alias("n_missing"), (~F.bool_or(F.coalesce(kept & (F.col("offset") != F.col("__end")), F.lit(False)))).alias("contiguous"))
    truncated = F.col("n_all") > max_fragments
    state = F.when(truncated | (F.col("n_gaps") > 0), "REVIEW").otherwise("PASS")
    return out.select(key, F.least("n_all", F.lit(max_fragments)).alias("n_fragments"), "n_gaps", "n_missing", "contiguous", truncated.alias("truncated"), state.alias("state"))


def recovery_metrics(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Per image: candidates by state and bytes claimed, available and unclaimed."""
    states = ["Active", "Deleted", "Orphaned", "Unindexed", "Corrupted"]
    counts = candidates.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_candidates"), *[F.count_if(F.col("data_state") == s).alias(f"n_{s.lower()}") for s in states])
    sizes = claims.groupBy("image_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("length"))), F.lit(0)).alias(f"bytes_{k}") for k in ("claimed", "available", "unclaimed")])
    return sizes.join(counts, "image_id", "left").fillna(0)


def capabilities(facts: DataFrame) -> DataFrame:
    """Yes/no findings with reasons, one row each, from per-image counts (n_records, n_accessible, bytes_unclaimed, n_fragments, n_timed, n_sequenced)."""
    def finding(name, yes, why, why_not):
        return F.struct(F.lit(name).alias("capability"), yes.alias("available"), F.when(yes, why).otherwise(why_not).alias("reason"))

    rows = F.array(
        finding("index", F.col("n_records") > 0, "an index describes recordings", "no index record was found"),
        finding("accessible recordings", F.col("n_accessible") > 0, "the index has accessible recordings", "no record is accessible"),
        finding("unclaimed space", F.col("bytes_unclaimed") > 0, "bytes are claimed by no record", "records claim all bytes"),
        finding("fragments", F.col("n_fragments") > 0, "fragments were found", "no fragment was found"),
        finding("time evidence", F.col("n_timed") > 0, "fragments carry times", "no fragment carries a time"),
        finding("sequence evidence", F.col("n_sequenced") > 0, "fragments carry sequence numbers", "no fragment carries a sequence number"),
    )
    return facts.select("image_id", F.explode(rows).alias("f")).select("image_id", "f.*")


#: The names of the ten findings, in the order of output.
FINDINGS = ("storage-geometry", "recording-index", "authoritative-index-scope", "deletion-metadata", "unreferenced-metadata", "recorder-timestamps", "channel-attribution", "payload-boundaries", "codec-metadata", "container-carving")


def assess_capabilities(images: DataFrame, recordings: DataFrame, fragments: DataFrame) -> DataFrame:
    """(image_id, place, capability, available, reason): the ten findings of each image, with the counts that they rest on.

    images: image_id, geometry (boolean), index_state (found, not found, null: not looked for), scope (null: no region governed);
    recordings, described by an index: image_id, referenced (boolean), allocation (null: unknown), start, channel, n_payload, codec;
    fragments, found by scanning: image_id, start, channel, carved (boolean).
    """
    described = recordings.groupBy("image_id").agg(
        F.count("allocation").alias("allocation"), F.count_if(~F.col("referenced")).alias("unreferenced"), F.count("start").alias("start"),
        F.count("channel").alias("channel"), F.count_if(F.col("n_payload") > 0).alias("payload"), F.count("codec").alias("codec"))
    found = fragments.groupBy("image_id").agg(F.count("start").alias("f_start"), F.count("channel").alias("f_channel"), F.count_if("carved").alias("carved"))
    rows = images.join(described, "image_id", "left").join(found, "image_id", "left").fillna(0, ["allocation", "unreferenced", "start", "channel", "payload", "codec", "f_start", "f_channel", "carved"])

    def counted(*names):
        total = F.col(names[0])
        for n in names[1:]:
            total = total + F.col(n)
        return total > 0, F.concat_ws(" and ", *[F.concat(F.col(n).cast("string"), F.lit(" fragments" if n.startswith("f_") or n == "carved" else " recordings")) for n in names])

    index = F.coalesce(F.col("index_state"), F.lit("not looked for"))
    judged = [
        (F.coalesce("geometry", F.lit(False)), F.when(F.coalesce("geometry", F.lit(False)), "read from the recorder").otherwise("none read")),
        (index == "found", index),
        (F.col("scope").isNotNull(), F.coalesce(F.concat(F.lit("absence counts within "), F.col("scope")), F.lit("absence counts nowhere"))),
        counted("allocation"), counted("unreferenced"), counted("start", "f_start"), counted("channel", "f_channel"), counted("payload"), counted("codec"), counted("carved"),
    ]
    each = F.array(*[F.struct(F.lit(name).alias("capability"), yes.alias("available"), reason.alias("reason")) for name, (yes, reason) in zip(FINDINGS, judged, strict=True)])
    return rows.select("image_id", F.posexplode(each).alias("place", "finding")).select("image_id", "place", "finding.*")


def strategies(findings: DataFrame) -> DataFrame:
    """Which ways to recover the findings of ``capabilities`` license, one row each."""
    has = findings.groupBy("image_id").agg(*[F.bool_or((F.col("capability") == c) & F.col("available")).alias(c.replace(" ", "_")) for c in ("index", "accessible recordings", "unclaimed space", "fragments", "time evidence", "sequence evidence")])
    pairs = {"index walk": F.col("index"), "sweep of unclaimed space": F.col("unclaimed_space"), "order by sequence": F.col("fragments") & F.col("sequence_evidence"), "order by time": F.col("fragments") & F.col("time_evidence"), "carving": F.col("unclaimed_space") | ~F.col("index"), "reconstruction": F.col("accessible_recordings")}
    return has.select("image_id", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("licensed")) for k, v in pairs.items()])).alias("s")).select("image_id", "s.*")


def license_strategies(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """(image_id, strategy, licensed, basis, reason): which ways to recover the ten findings and the plan's counts license, six rows an image of ``counts``.

    counts: image_id, n_accessible and n_available (claims), n_orphan and n_ungoverned (unclaimed regions inside and outside of an index's
    scope), n_parented, n_channel, n_sequence and n_timed (fragments that carry one); null counts as 0. That fragments lie side by side licenses nothing.
    """
    needed = ("recording-index", "unreferenced-metadata", "authoritative-index-scope")
    has = findings.groupBy("image_id").agg(*[F.bool_or((F.col("capability") == c) & F.col("available")).alias(c) for c in needed])
    rows = counts.fillna(0).join(has, "image_id", "left").fillna(False, list(needed))
    n = F.col

    def row(strategy, basis, licensed, *told):
        counted = F.concat_ws(", ", *[F.concat(n(c).cast("string"), F.lit(f" {what}")) for c, what in told])
        return F.struct(F.lit(strategy).alias("strategy"), licensed.alias("licensed"), F.lit(basis).cast("string").alias("basis"), counted.alias("reason"))

    each = F.array(
        row("indexed recovery", needed[0], n(needed[0]) & (n("n_accessible") > 0), ("n_accessible", "accessible claims")),
        row("available metadata recovery", needed[1], n(needed[1]) & (n("n_available") > 0), ("n_available", "claims out of reach")),
        row("structural orphan recovery", needed[2], n(needed[2]) & (n("n_orphan") > 0), ("n_orphan", "unclaimed regions in scope")),
        row("raw recovery", None, n("n_ungoverned") > 0, ("n_ungoverned", "regions that no index governs")),
        row("fragment correlation", "channel-attribution", (n("n_parented") > 0) | (n("n_channel") > 0), ("n_parented", "fragments of a recording"), ("n_channel", "with a channel")),
        row("temporal correlation", "recorder-timestamps", (n("n_sequence") > 1) | (n("n_timed") > 1), ("n_sequence", "fragments with a number"), ("n_timed", "with a time")),
    )
    return rows.select("image_id", F.explode(each).alias("s")).select("image_id", "s.*")


def reduce_validation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The worst state of each key (FAIL, REVIEW, UNKNOWN, PASS) and the reasons for it, sorted and joined by '; '."""
    rank = F.when(F.col("state") == "FAIL", 4).when(F.col("state") == "REVIEW", 3).when(F.col("state") == "UNKNOWN", 2).otherwise(1)
    by = df.withColumn("__rank", rank).groupBy(*keys, "state", "__rank").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    return by.groupBy(*keys).agg(F.max_by(F.struct("state", "reasons"), "__rank").alias("r")).select(*keys, "r.state", "r.reasons")


def seconds_per_level(slots: DataFrame, nominal: int) -> DataFrame:
    return slots.groupBy("image_id", "level").agg((F.count(F.lit(1)) * nominal).alias("seconds"))


def plan_recovery(records: DataFrame, images: DataFrame, probe: int = PROBE, chunk: int = CHUNK) -> DataFrame:
    """Targets in order: a probe at the start of each claimed and available range, chunks over what no record claims.

    ``records``: image_id, accessible, offset, length; ``images``: image_id, size_bytes. ``place`` counts from 1 in each image.
    """
    universe = images.select("image_id", F.lit(0).cast("long").alias("offset"), F.col("size_bytes").alias("length"))
    claims = R.claim_map(records, universe)
    # in one go, as a union would work out the claims for either part
    sweep = F.col("kind") == "unclaimed"
    pieces = claims.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.when(sweep, F.floor((F.col("length") - 1) / chunk)).otherwise(0))))
    length = F.when(sweep, F.least(F.lit(chunk).cast("long"), F.col("length") - F.col("__piece") * chunk)).otherwise(F.least("length", F.lit(probe)))
    targets = pieces.select("image_id", "kind", (F.col("offset") + F.col("__piece") * chunk).alias("offset"), length.alias("length"))
    return targets.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("offset", "kind", "length")))


def planned_targets(records: DataFrame, images: DataFrame, max_bytes: int, max_regions: int) -> DataFrame:
    """Targets (image_id, kind, offset, length, truncated) of ``plan_recovery`` within a budget; bounds that cut nothing ask for no order."""
    plan = plan_recovery(records, images).select("image_id", "kind", "offset", "length")
    if max_bytes >= ALL_BYTES and max_regions >= ALL_REGIONS:
        return plan.withColumn("truncated", F.lit(False))
    return budget_prefix(plan, ["image_id"], ["offset", "kind", "length"], max_bytes, max_regions)


def gap_slots(gaps: DataFrame, nominal: int) -> DataFrame:
    """Gaps (image_id, gap_id, seconds, offset, length) as slots: round(seconds / nominal), 1 at least; equal bytes, the last takes the rest."""
    rows = gaps.withColumn("n_slots", F.greatest(F.round(F.col("seconds") / nominal).cast("long"), F.lit(1)))
    rows = rows.withColumns({"slot": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1)), "__each": F.floor(F.col("length") / F.col("n_slots"))})
    size = F.when(F.col("slot") == F.col("n_slots") - 1, F.col("length") - F.col("__each") * (F.col("n_slots") - 1)).otherwise(F.col("__each"))
    return rows.select("image_id", "gap_id", "slot", (F.col("offset") + F.col("slot") * F.col("__each")).alias("offset"), size.alias("length"))


def candidates_to_events(candidates: DataFrame) -> DataFrame:
    """Candidates with whether they become events: they need a channel and a time of 0 or more; the zone stays unknown."""
    reason = F.when(F.col("channel").isNull(), "no channel").when(F.col("ts").isNull(), "no time").when(F.col("ts") < 0, "time before 1970")
    return candidates.withColumns({"withheld": reason.isNotNull(), "reason": reason, "tz": F.lit(None).cast("string")})


def pair_candidates(fragments: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fragments with the candidate of the same id; fragments without one have null."""
    return fragments.join(candidates, "fragment_id", "left")


def clip_groups(clips: DataFrame, gap: int = 5) -> DataFrame:
    """Clips of a channel in block order, numbered by run: the next one joins if it starts within ``gap`` seconds of the last end, or, without times, right behind it on disk."""
    w = Window.partitionBy("image_id", "channel").orderBy("block")
    end, disk = F.lag("end").over(w), F.lag(F.col("offset") + F.col("length")).over(w)
    timed = F.col("start").isNotNull() & end.isNotNull()
    joins = F.when(timed, F.abs(F.col("start") - end) <= gap).otherwise(F.col("offset") == disk)
    rows = clips.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("clip_group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
