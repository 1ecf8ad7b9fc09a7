"""Interval algebra over byte ranges (offset, length) by key, and range joins by bins.

Ranges of zero or negative length, with a null or with an end beyond a 64-bit number are no ranges and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import running_sums

KEYS = ("image_id",)
#: Bytes of a bin, in which ranges are merged and joined before they meet over the whole key.
BIN = 1 << 20
#: Partitions of a pass over bins at least; up to 200 (``spark.shuffle.sort.bypassMergeThreshold``) rows go to their files without being held for a sort, and on small tables every one costs time.
PARTS = 64


def dealt(df: DataFrame, *by) -> DataFrame:
    """``df`` dealt out by ``by`` over all shuffle partitions of the session, which are not put together again for the cores at hand: what one task sorts shrinks as they grow in number."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by ``by`` over ``PARTS`` partitions, or the session's if they are more, however few the session has. Adaptive execution doesn't put them together again: it would make one for each core until each holds its advisory size, so that over that span what one task sorts grows by the cores, not by ``PARTS``."""
    return df.repartition(max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def _valid(df: DataFrame) -> DataFrame:
    return df.where((F.col("length") > 0) & (F.col("offset") >= 0) & F.try_add("offset", "length").isNotNull())


def _islands(df: DataFrame, by: Sequence) -> DataFrame:
    """Merge overlapping and adjacent (lo, hi) within ``by``, by windows over one order alone, so nothing is hashed row by row."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    rows = df.select(*by, "lo", "hi", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.max("hi").over(Window.partitionBy(*by)).alias("__most"))
    opened = rows.where("__before is null or lo > __before")
    return opened.select(*by, "lo", F.coalesce(F.lead("__before").over(w), "__most").alias("hi"))


def _reached(first: DataFrame, keys: Sequence[str], universe: DataFrame | None = None) -> DataFrame:
    """(__bin, lo, hi), disjoint in each bin, with what their bin has to know of the others: ``__known``, and ``__told``, the same in the bin's last range alone.

    Of each bin its last range goes through the pass over the key and comes back with how far earlier ranges reach, where the range
    starts that reaches so far, and whether the bin is the key's last. All rows take the same way, those that stand for their bin and the
    others, so that the input is read once, however many merges follow each other. With ``universe`` (keys, lo, hi: a row a key) the pass tells every
    bin that too, so it needs no join; the universe comes back as a row of its own with null lo, whose ``end`` is true if its key has no range.
    """
    last = F.lead("lo").over(Window.partitionBy(*keys, "__bin").orderBy("lo")).isNull()
    # bins count from 0, so -1 is the place of the pass over the key
    rows = first.select(*keys, "__bin", "lo", "hi", F.when(last, -1).otherwise(F.col("__bin")).alias("__place"))
    if universe is not None:
        own, none, nowhere = F.struct("lo", "hi"), F.lit(None).cast("long"), F.lit(-1).cast("long")
        ends = universe.select(*keys, nowhere.alias("__bin"), none.alias("lo"), none.alias("hi"), nowhere.alias("__place"), own.alias("__own"))
        rows = rows.withColumn("__own", F.lit(None).cast("struct<lo: bigint, hi: bigint>")).unionByName(ends)
    rows = spread(rows, *keys, "__place")
    order = Window.partitionBy(*keys, "__place").orderBy("__bin", "lo")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__reach": F.max("hi").over(earlier), "__end": F.lead("lo").over(order).isNull()})
    # ranges of a bin are disjoint by now: if the last one doesn't start behind all earlier bins, none of the bin does
    alone = F.when(F.col("__reach").isNull() | (F.col("lo") > F.col("__reach")), F.col("lo"))
    rows = rows.withColumn("__alone", alone).withColumn("__start", F.max("__alone").over(earlier))
    told = [F.col("__reach").alias("reach"), F.col("__start").alias("start"), F.col("__end").alias("end")]
    if universe is not None:
        told.append(F.max("__own").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("universe"))
    told = F.when(F.col("__place") == -1, F.struct(*told))
    back = spread(rows.select(*keys, "__bin", "lo", "hi", told.alias("__told")), *keys, "__bin")
    return back.withColumn("__known", F.max("__told").over(Window.partitionBy(*keys, "__bin")))


def _stitch(first: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge (__bin, lo, hi), disjoint in each bin, over the bins of a key.

    What a bin's last range opens is closed by the next bin in which a range starts anew, or by the key's last bin, so no further
    exchange brings starts and ends together.
    """
    same = Window.partitionBy(*keys, "__bin")
    back = _reached(first, keys)
    reach, start, end = (F.col("__known")[c] for c in ("reach", "start", "end"))
    anew = reach.isNull() | (F.col("lo") > reach)
    met = back.withColumn("__met", F.max(F.when(~anew, F.col("hi"))).over(same))
    mine = F.col("__told").isNotNull()
    opened = F.when(reach.isNotNull() & mine & (anew | end), F.struct(start.alias("lo"), F.greatest(reach, "__met").alias("hi")))
    own = F.when(anew & (~mine | end), F.struct("lo", "hi"))
    found = met.select(*keys, opened.alias("__opened"), own.alias("__own")).where("__opened is not null or __own is not null")
    found = found.select(*keys, F.inline(F.when(F.col("__opened").isNull(), F.array("__own")).otherwise(F.array("__opened", "__own")))).where("lo is not null")
    return found.select(*keys, F.col("lo").alias("offset"), (F.col("hi") - F.col("lo")).alias("length"))


def _binned(df: DataFrame, keys: Sequence[str], bin_bytes: int) -> DataFrame:
    """Ranges merged in the bins in which they start: (keys, __bin, lo, hi)."""
    rows = _valid(df).select(*keys, F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), F.floor(F.col("offset") / bin_bytes).alias("__bin"))
    return _islands(spread(rows, *keys, "__bin"), [*keys, "__bin"])


def merge_ranges(df: DataFrame, keys: Sequence[str] = KEYS, bin_bytes: int = BIN) -> DataFrame:
    """Sorted disjoint ranges; overlapping and adjacent ones merged.

    Merges in bins of each key first. Of each bin only where its last range starts and how far it reaches goes on to the pass over
    the key, which tells every bin that an earlier range enters how far that one reaches and where it starts. So a key with very
    many ranges is worked on by many tasks; the pass over the key sees a row for each bin.
    """
    return _stitch(_binned(df, keys, bin_bytes), keys)


def union_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    cols = [*keys, "offset", "length"]
    return merge_ranges(a.select(*cols).unionByName(b.select(*cols)), keys)


def with_bins(df: DataFrame, offset: Column, end: Column, bin_bytes: int = BIN) -> DataFrame:
    """A row for each bin that [offset, end) touches."""
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(offset / bin_bytes), F.floor((end - 1) / bin_bytes))))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, bin_bytes: int = BIN) -> DataFrame:
    """Pairs of ranges of one key that overlap: keys, a's other columns as a_*, b's as b_*.

    Both sides are dealt into bins; a pair is kept in the bin in which the later of the two starts, so it comes once.
    """
    left = _valid(a).select(*keys, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys])
    right = _valid(b).select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    ends = {s: F.col(f"{s}_offset") + F.col(f"{s}_length") for s in "ab"}
    left = with_bins(left, F.col("a_offset"), ends["a"], bin_bytes)
    right = with_bins(right, F.col("b_offset"), ends["b"], bin_bytes)
    met = left.join(right, [*keys, "__bin"])
    return met.where((F.col("a_offset") < ends["b"]) & (F.col("b_offset") < ends["a"]) & (F.col("__bin") == F.floor(F.greatest("a_offset", "b_offset") / bin_bytes))).drop("__bin")


def intersect_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What both cover. What two sets of merged ranges share is disjoint and not even adjacent, so it needs no merge of its own."""
    cols = [*keys, "offset", "length"]
    pairs = overlap_join(merge_ranges(a.select(*cols), keys), merge_ranges(b.select(*cols), keys), keys)
    lo = F.greatest("a_offset", "b_offset")
    hi = F.least(F.col("a_offset") + F.col("a_length"), F.col("b_offset") + F.col("b_length"))
    return pairs.select(*keys, lo.alias("offset"), (hi - lo).alias("length"))


def complement_ranges(df: DataFrame, universe: DataFrame, keys: Sequence[str] = KEYS, bin_bytes: int = BIN) -> DataFrame:
    """What of each key's universe (one range a key) no range covers; ranges beyond the universe don't count.

    Ranges aren't merged over bins first: a hole ends where a range starts behind all that its own bin and the earlier ones reach to.
    """
    u = universe.select(*keys, F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi")).where("hi > lo")
    # a null key meets no universe
    rows = _reached(_binned(df.dropna(subset=list(keys)), keys, bin_bytes), keys, u)
    known = F.col("__known")
    before = F.greatest(known["reach"], F.lag("hi").over(Window.partitionBy(*keys, "__bin").orderBy("lo")))
    rows = rows.withColumn("__before", before)
    mine = F.col("__told").isNotNull() & known["end"]
    none = F.lit(None).cast("long")
    ahead = F.when(F.col("__before").isNull() | (F.col("lo") > F.col("__before")), F.struct(F.col("__before").alias("from"), F.col("lo").alias("to")))
    behind = F.when(mine, F.struct(F.greatest(known["reach"], "hi").alias("from"), none.alias("to")))
    # without ranges all of the universe is left
    holes = F.when(F.col("lo").isNotNull(), F.array_compact(F.array(ahead, behind))).when(mine, F.array(F.struct(none.alias("from"), none.alias("to"))))
    found = rows.where(known["universe"].isNotNull()).select(*keys, known["universe"].alias("__in"), F.inline(holes))
    cut = found.select(*keys, F.greatest("from", "__in.lo").alias("from"), F.least("to", "__in.hi").alias("to")).where("to > from")
    return cut.select(*keys, F.col("from").alias("offset"), (F.col("to") - F.col("from")).alias("length"))


def _divided(a: DataFrame, b: DataFrame, keys: Sequence[str], bin_bytes: int = BIN) -> DataFrame:
    """a in pieces that b covers whole or not at all: (keys, inside, offset, length), merged for each of both.

    The starts and ends of both sides run through each bin in order, with how many ranges of a side are open, so that
    neither side has to be merged first. Ranges go to their bins as they are and are taken apart there.
    """
    sides = [_valid(d).select(*keys, "offset", (F.col("offset") + F.col("length")).alias("__hi"), F.lit(x).alias("__a")) for d, x in ((a, 1), (b, 0))]
    pieces = spread(with_bins(sides[0].unionByName(sides[1]), F.col("offset"), F.col("__hi"), bin_bytes), *keys, "__bin")
    lo, hi = F.greatest(F.col("offset"), F.col("__bin") * bin_bytes), F.least(F.col("__hi"), (F.col("__bin") + 1) * bin_bytes)
    change = lambda at, by: F.struct(at.alias("lo"), (F.col("__a") * by).alias("a"), ((1 - F.col("__a")) * by).alias("b"))
    events = pieces.select(*keys, "__bin", F.inline(F.array(change(lo, 1), change(hi, -1))))
    w = Window.partitionBy(*keys, "__bin").orderBy("lo", "a", "b")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = events.select(*keys, "__bin", "lo", F.lead("lo").over(w).alias("hi"), F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"))
    kept = pieces.where("a > 0 and hi > lo").select(*keys, (F.col("b") > 0).alias("inside"), "__bin", "lo", "hi")
    return _stitch(_islands(kept, [*keys, "inside", "__bin"]), [*keys, "inside"]).select(*keys, "inside", "offset", "length")


def subtract_ranges(a: DataFrame, cut: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """a without cut, trimmed, split or removed."""
    return _divided(a, cut, keys).where("not inside").drop("inside")


def range_stats(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of each key's merged ranges: n_ranges, total_bytes, min_offset, max_end."""
    return merge_ranges(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ranges"), F.sum("length").alias("total_bytes"), F.min("offset").alias("min_offset"), F.max(F.col("offset") + F.col("length")).alias("max_end"))


def covers(df: DataFrame, probes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The probes (offset, length and other columns) with ``covered``: one merged range holds the probe whole."""
    wanted = _valid(probes).select(*keys, "offset", "length").distinct()
    pairs = overlap_join(wanted, merge_ranges(df, keys), keys)
    inside = pairs.where((F.col("b_offset") <= F.col("a_offset")) & (F.col("b_offset") + F.col("b_length") >= F.col("a_offset") + F.col("a_length")))
    hit = inside.select(*keys, F.col("a_offset").alias("offset"), F.col("a_length").alias("length"), F.lit(True).alias("__hit")).distinct()
    return probes.join(hit, [*keys, "offset", "length"], "left").withColumn("covered", F.coalesce("__hit", F.lit(False))).drop("__hit")


def clip_ranges(df: DataFrame, universe: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(inside, excluded): rows cut to their key's universe, and rows wholly outside of it or without one."""
    u = universe.select(*keys, F.col("offset").alias("__lo"), (F.col("offset") + F.col("length")).alias("__hi"))
    lo = F.greatest("offset", "__lo")
    hi = F.least(F.col("offset") + F.col("length"), "__hi")
    rows = dealt(_valid(df), *keys).join(u, list(keys), "left").withColumn("__in", F.coalesce(hi > lo, F.lit(False)))
    inside = rows.where("__in").withColumns({"length": hi - lo, "offset": lo})
    return inside.select(*df.columns), rows.where("not __in").select(*df.columns)


def claim_map(records: DataFrame, universe: DataFrame, keys: Sequence[str] = KEYS, bin_bytes: int = BIN) -> DataFrame:
    """(keys, kind, offset, length): claimed by accessible records, available from the others, and unclaimed by either.

    The first two may overlap; they are kept as separate sets. All three come out of one way through the bins: the pass over the key tells each bin
    what ``_reached`` tells it for either kind, and how far both of them reach.
    """
    # a null key meets no universe
    known = _valid(records.where("accessible is not null").dropna(subset=list(keys)))
    rows = known.select(*keys, "accessible", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), F.floor(F.col("offset") / bin_bytes).alias("__bin"))
    rows = _islands(spread(rows, *keys, "__bin"), [*keys, "__bin", "accessible"])
    bins, kinds = Window.partitionBy(*keys, "__bin"), Window.partitionBy(*keys, "__bin", "accessible")
    last = F.lead("lo").over(kinds.orderBy("lo")).isNull()
    rows = rows.select(*keys, "accessible", "__bin", "lo", "hi", F.when(last, -1).otherwise(F.col("__bin")).alias("__place"), F.lit(None).cast("struct<lo: bigint, hi: bigint>").alias("__own"))
    none, nowhere = F.lit(None).cast("long"), F.lit(-1).cast("long")
    own = F.struct(F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"))
    ends = universe.select(*keys, F.lit(None).cast("boolean").alias("accessible"), nowhere.alias("__bin"), none.alias("lo"), none.alias("hi"), nowhere.alias("__place"), own.alias("__own"))
    rows = spread(rows.unionByName(ends), *keys, "__place")
    over = Window.partitionBy(*keys, "__place")
    order = Window.partitionBy(*keys, "__place", "accessible").orderBy("__bin", "lo")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__reach": F.max("hi").over(earlier), "__end": F.lead("lo").over(order).isNull()})
    alone = F.when(F.col("__reach").isNull() | (F.col("lo") > F.col("__reach")), F.col("lo"))
    rows = rows.withColumn("__alone", alone).withColumn("__start", F.max("__alone").over(earlier))
    both = F.max("hi").over(over.orderBy("__bin").rangeBetween(Window.unboundedPreceding, -1))
    told = F.struct(F.col("__reach").alias("reach"), F.col("__start").alias("start"), F.col("__end").alias("end"))
    shared = F.struct(both.alias("reach"), (F.col("__bin") == F.max("__bin").over(over)).alias("end"), F.max("__own").over(over).alias("universe"))
    here = F.col("__place") == -1
    back = spread(rows.select(*keys, "accessible", "__bin", "lo", "hi", F.when(here, told).alias("__told"), F.when(here, shared).alias("__shared")), *keys, "__bin")
    back = back.withColumns({"__known": F.max("__told").over(kinds), "__all": F.max("__shared").over(bins)})
    reach, start, end = (F.col("__known")[c] for c in ("reach", "start", "end"))
    anew = reach.isNull() | (F.col("lo") > reach)
    within = bins.orderBy("lo", "hi", "accessible")
    met = back.withColumns({
        "__met": F.max(F.when(~anew, F.col("hi"))).over(kinds),
        "__before": F.greatest(F.col("__all")["reach"], F.max("hi").over(within.rowsBetween(Window.unboundedPreceding, -1))),
        "__final": F.lead("lo").over(within).isNull() & F.col("__all")["end"],
    })
    mine, there = F.col("__told").isNotNull(), F.col("lo").isNotNull()
    kind = F.when(F.col("accessible"), "claimed").otherwise("available")
    part = lambda on, kind, lo, hi: F.when(on, F.struct(kind.alias("kind"), lo.alias("lo"), hi.alias("hi")))
    left = F.lit("unclaimed")
    parts = F.array_compact(F.array(
        part(there & reach.isNotNull() & mine & (anew | end), kind, start, F.greatest(reach, "__met")),
        part(there & anew & (~mine | end), kind, F.col("lo"), F.col("hi")),
        part(there & (F.col("__before").isNull() | (F.col("lo") > F.col("__before"))), left, F.col("__before"), F.col("lo")),
        # behind the last range, or without ranges all of the universe
        part(F.col("__final"), left, F.greatest("__before", "hi"), none),
    ))
    found = met.where(F.col("__all")["universe"].isNotNull()).select(*keys, F.col("__all")["universe"].alias("__in"), F.inline(parts))
    cut = found.select(*keys, "kind", F.greatest("lo", "__in.lo").alias("lo"), F.least("hi", "__in.hi").alias("hi")).where("hi > lo")
    return cut.select(*keys, "kind", F.col("lo").alias("offset"), (F.col("hi") - F.col("lo")).alias("length"))


def split_by_scope(unclaimed: DataFrame, scope: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unclaimed ranges cut at the region that an authoritative index governs: (keys, in_scope, offset, length)."""
    return _divided(unclaimed, scope, keys).withColumnRenamed("inside", "in_scope")


def coverage(regions: DataFrame, images: DataFrame, min_bytes: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key of ``images`` (keys, size_bytes): accounted and unaccounted bytes, ratio (0 for size 0), holes of at least ``min_bytes``.

    Of equally large holes the later one is the largest.
    """
    universe = images.select(*keys, F.lit(0).cast("long").alias("offset"), F.col("size_bytes").alias("length"))
    holes = complement_ranges(regions, universe, keys).groupBy(*keys).agg(
        F.sum("length").alias("unaccounted_bytes"),
        F.count_if(F.col("length") >= min_bytes).alias("n_holes"),
        F.max(F.when(F.col("length") >= min_bytes, F.struct("length", "offset"))).alias("__largest"),
    )
    out = images.join(holes, list(keys), "left")
    accounted = F.col("size_bytes") - F.coalesce("unaccounted_bytes", F.lit(0))
    return out.select(*keys, "size_bytes", accounted.alias("accounted_bytes"), F.coalesce("unaccounted_bytes", F.lit(0)).alias("unaccounted_bytes"), F.when(F.col("size_bytes") > 0, accounted / F.col("size_bytes")).otherwise(0.0).alias("ratio"), F.coalesce("n_holes", F.lit(0)).alias("n_holes"), F.col("__largest.offset").alias("largest_offset"), F.col("__largest.length").alias("largest_length"))


def chunk_ranges(df: DataFrame, size: int) -> DataFrame:
    """Each range in pieces of ``size`` bytes, the last one shorter; other columns are kept, ``piece`` counts from 0."""
    rows = _valid(df).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))))
    return rows.withColumns({"offset": F.col("offset") + F.col("piece") * size, "length": F.least(F.lit(size).cast("long"), F.col("length") - F.col("piece") * size)})


def split_at_wrap(regions: DataFrame, wraps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Regions that hold their key's wrap offset strictly inside, as two rows: part pre and part post."""
    rows = regions.join(wraps.select(*keys, "wrap_offset"), list(keys)).where((F.col("wrap_offset") > F.col("offset")) & (F.col("wrap_offset") < F.col("offset") + F.col("length")))
    end = F.col("offset") + F.col("length")
    parts = F.array(
        F.struct(F.lit("pre").alias("part"), F.col("offset").alias("offset"), (F.col("wrap_offset") - F.col("offset")).alias("length")),
        F.struct(F.lit("post").alias("part"), F.col("wrap_offset").alias("offset"), (end - F.col("wrap_offset")).alias("length")),
    )
    others = [c for c in regions.columns if c not in ("offset", "length")]
    return rows.select(*others, F.explode(parts).alias("p")).select(*others, "p.*")


def resolve_claims(points: DataFrame, claims: DataFrame, keys: Sequence[str] = KEYS, bin_bytes: int = BIN) -> DataFrame:
    """The points (keys, point and other columns) with the claim that holds each: accessible ones first, then by index order.

    ``claims``: keys, claim_id, accessible, index_order, offset, length. Points without a claim have null.
    """
    spread = with_bins(_valid(claims), F.col("offset"), F.col("offset") + F.col("length"), bin_bytes)
    at = points.select(*keys, "point").distinct().withColumn("__bin", F.floor(F.col("point") / bin_bytes))
    met = at.join(spread, [*keys, "__bin"]).where("point >= offset and point < offset + length")
    best = met.groupBy(*keys, "point").agg(F.min_by(F.struct("claim_id", "accessible"), F.struct((~F.col("accessible")).alias("late"), "index_order", "claim_id")).alias("claim"))
    return points.join(best, [*keys, "point"], "left").select(*points.columns, F.col("claim.claim_id").alias("claim_id"), F.col("claim.accessible").alias("accessible"))


def overlapping_pairs(df: DataFrame, id_col: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of rows i < j of one key that overlap, with the bytes they share."""
    pairs = overlap_join(df, df, keys).where(F.col(f"a_{id_col}") < F.col(f"b_{id_col}"))
    lo = F.greatest("a_offset", "b_offset")
    hi = F.least(F.col("a_offset") + F.col("a_length"), F.col("b_offset") + F.col("b_length"))
    return pairs.select(*keys, f"a_{id_col}", f"b_{id_col}", lo.alias("offset"), (hi - lo).alias("length"))


def asof_before(left: DataFrame, right: DataFrame, tolerance: int, keys: Sequence[str] = KEYS, bin_bytes: int = BIN) -> DataFrame:
    """``left`` (keys, offset, ...) with marker: the offset of the nearest right row at most ``tolerance`` before it, or at it.

    Searched in bins, each of which gets the last marker of the bins before it.
    """
    both = left.select(*keys, "offset").distinct().withColumn("__marker", F.lit(None).cast("long")).unionByName(right.select(*keys, "offset", F.col("offset").alias("__marker")).distinct())
    both = both.withColumns({"__bin": F.floor(F.col("offset") / bin_bytes), "__carried": F.lit(False)})
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "__bin").agg(F.max("__marker").alias("__marker")).withColumn("__marker", F.max("__marker").over(earlier))
    carried = carried.where(F.col("__bin") * bin_bytes - F.col("__marker") <= tolerance).withColumns({"offset": F.col("__marker"), "__carried": F.lit(True)})
    w = Window.partitionBy(*keys, "__bin").orderBy("offset", F.col("__marker").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.unionByName(carried).withColumn("marker", F.last("__marker", ignorenulls=True).over(w))
    hit = filled.where("__marker is null and not __carried").where(F.col("offset") - F.col("marker") <= tolerance).select(*keys, "offset", "marker")
    return left.join(hit, [*keys, "offset"], "left")


def map_logical(ranges: DataFrame, segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Logical ranges over a stream of physical segments in ``seq`` order as physical pieces, in logical order.

    ``ranges``: keys, range_id, offset, length in the stream; ``segments``: keys, seq, offset, length on disk.
    """
    laid = _valid(segments).select(*keys, F.col("offset").alias("disk"), "length", "seq")
    laid = running_sums(laid, keys, ["seq", "disk", "length"], {"__upto": F.col("length")}).withColumn("offset", F.col("__upto") - F.col("length")).drop("__upto")
    pairs = overlap_join(ranges, laid, keys)
    lo = F.greatest("a_offset", "b_offset")
    hi = F.least(F.col("a_offset") + F.col("a_length"), F.col("b_offset") + F.col("b_length"))
    return pairs.select(*keys, F.col("a_range_id").alias("range_id"), F.col("b_seq").alias("seq"), (F.col("b_disk") + lo - F.col("b_offset")).alias("offset"), (hi - lo).alias("length"))
