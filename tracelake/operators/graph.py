"""Linked structures: block chains by pointer doubling, index pages by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import checkpointed, stored

IMAGE = "image_id"


def link_state(blocks: DataFrame) -> DataFrame:
    """Blocks (image_id, block, first, prev, next, empty) with what their next link is: last, self, out of range, empty or follow."""
    target = blocks.select(IMAGE, F.col("block").alias("next"), F.col("empty").alias("__next_empty"), F.col("prev").alias("__next_prev"))
    rows = blocks.join(target, [IMAGE, "next"], "left")
    state = F.when(F.col("next") == 0, "last").when(F.col("next") == F.col("block"), "self").when(F.col("__next_empty").isNull(), "out of range").when(F.col("__next_empty"), "empty").otherwise("follow")
    return rows.select(*blocks.columns, state.alias("link"), ((state == "follow") & (F.col("__next_prev") != F.col("block"))).alias("back_mismatch"))


def reach(edges: DataFrame, heads: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(image_id, head, block, place): all that each head reaches along ``edges`` (image_id, block, next; one next a block).

    Pointer doubling: a round doubles both the length of the jumps and the distance covered, so a chain of n blocks takes log2 n rounds.
    A block is listed once, at its first place.
    """
    jumps, found, n = edges.select(IMAGE, "block", "next"), heads.select(IMAGE, F.col("block").alias("head"), "block", F.lit(0).cast("long").alias("place")), 0
    for k in range(max_rounds):
        further = found.join(jumps, [IMAGE, "block"]).select(IMAGE, "head", F.col("next").alias("block"), (F.col("place") + (1 << k)).alias("place"))
        found = checkpointed(found.unionByName(further).groupBy(IMAGE, "head", "block").agg(F.min("place").alias("place")))
        now = found.count()
        if now == n:
            return found
        n = now
        then = jumps.select(IMAGE, F.col("block").alias("next"), F.col("next").alias("after"))
        jumps = checkpointed(jumps.join(then, [IMAGE, "next"]).select(IMAGE, "block", F.col("after").alias("next")))
    raise RuntimeError(f"chains are longer than 2**{max_rounds} blocks")


def walk_links(rows: DataFrame) -> DataFrame:
    """Rows (image_id, block, to, steps, bad, done, low), one a block, with ``to`` moved on along the links until it is done.

    Pointer doubling from each block's side: an active row of round k has jumped 2**k links; steps and bad add up over the jumps, and low
    is the least of a block's own and all that lead to it. A round in which no row gets done and nothing else changes leaves
    only rows that lead into loops, all of them with ``to`` on a loop.
    """
    was, parts = None, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # where joins are broadcast, each round's union would double the partitions
        rows = stored(rows if was is None else rows.coalesce(parts), "walk")
        if was is None:
            parts = max(parts, rows.rdd.getNumPartitions())
        now = rows.agg(F.count_if(~F.col("done")), F.count("low"), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if now[0] == 0:
            return rows
        active = rows.where("not done")
        now = (*now, active.select(IMAGE, "to").distinct().count() if was is not None and was[0] == now[0] else None)
        if now == was and now[3] is not None:
            return rows
        was = now
        there = rows.select(IMAGE, F.col("block").alias("to"), F.col("to").alias("__to"), F.col("steps").alias("__steps"), F.col("bad").alias("__bad"), F.col("done").alias("__done"))
        moved = active.join(there, [IMAGE, "to"]).select(IMAGE, "block", F.col("__to").alias("to"), (F.col("steps") + F.col("__steps")).alias("steps"), (F.col("bad") + F.col("__bad")).alias("bad"), F.col("__done").alias("done"), "low")
        pushed = active.where("low is not null").groupBy(IMAGE, F.col("to").alias("block")).agg(F.min("low").alias("__low"))
        rows = rows.where("done").unionByName(moved).join(pushed, [IMAGE, "block"], "left").withColumn("low", F.least("low", "__low")).drop("__low")


def chain_ends(blocks: DataFrame) -> DataFrame:
    """One row a block in use: the end of its walk, links up to there, mismatches on the way, whether it is a loop, and the least head that leads to it.

    In a loop the end is the block that the walk would come back from. No pairs of heads and blocks are listed.
    """
    rows = checkpointed(link_state(blocks).where("not empty"))
    follow = F.col("link") == "follow"
    head = F.when((F.col("block") > 0) & (F.col("first") == F.col("block")), F.col("block"))
    bad = F.when(F.col("back_mismatch"), 1).otherwise(0).cast("long")
    start = rows.select(IMAGE, "block", F.when(follow, F.col("next")).otherwise(F.col("block")).alias("to"), follow.cast("long").alias("steps"), bad.alias("bad"), (~follow).alias("done"), head.alias("low"))
    walked = walk_links(start)
    straight = walked.where("done").select(IMAGE, "block", F.col("to").alias("end"), "steps", "bad", F.lit(False).alias("loop"), F.col("low").alias("least_head"))
    left = checkpointed(walked.where("not done"))
    if left.isEmpty():
        return straight
    on = left.select(IMAGE, F.col("to").alias("block")).distinct().withColumn("__on", F.lit(True))
    edges = checkpointed(start.join(left.select(IMAGE, "block", F.col("low").alias("__low")), [IMAGE, "block"]).drop("low").join(on, [IMAGE, "block"], "left"))
    ring = edges.where("__on").select(IMAGE, "block", "to", "bad")
    # the ring's least block names it
    names = ring.select(IMAGE, "block", "to", F.lit(1).cast("long").alias("steps"), F.lit(0).cast("long").alias("bad"), F.lit(False).alias("done"), F.col("block").alias("low"))
    named = ring.join(walk_links(names).select(IMAGE, "block", F.col("low").alias("ring")), [IMAGE, "block"])
    sizes = named.groupBy(IMAGE, "ring").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("all_bad"))
    entered = named.select(IMAGE, "ring", F.col("to").alias("entry"), F.col("block").alias("end"), F.col("bad").alias("closing")).join(sizes, [IMAGE, "ring"])
    stop = F.coalesce("__on", F.lit(False))
    tails = walk_links(edges.select(IMAGE, "block", F.when(stop, F.col("block")).otherwise(F.col("to")).alias("to"), F.when(stop, 0).otherwise(1).cast("long").alias("steps"), F.when(stop, 0).otherwise(F.col("bad")).cast("long").alias("bad"), stop.alias("done"), F.lit(None).cast("long").alias("low")))
    looped = tails.select(IMAGE, "block", F.col("to").alias("entry"), "steps", "bad").join(entered, [IMAGE, "entry"]).join(left.select(IMAGE, "block", "low"), [IMAGE, "block"])
    return straight.unionByName(looped.select(IMAGE, "block", "end", (F.col("steps") + F.col("n") - 1).alias("steps"), (F.col("bad") + F.col("all_bad") - F.col("closing")).alias("bad"), F.lit(True).alias("loop"), F.col("low").alias("least_head")))


def chain_members(blocks: DataFrame) -> DataFrame:
    """(image_id, head, block, place) of the chains; a head that an earlier head's chain holds has none of its own."""
    rows = link_state(blocks)
    heads = chain_ends(blocks).where("least_head = block").select(IMAGE, "block")
    return reach(rows.where("link = 'follow' and not empty").select(IMAGE, "block", "next"), heads)


def traverse_chains(blocks: DataFrame) -> DataFrame:
    """One row a chain: blocks, last block, back-link mismatches and outcome; as many rows as blocks at most are worked on, however many heads share a tail."""
    ends = chain_ends(blocks).where("least_head = block")
    rows = ends.join(link_state(blocks).select(IMAGE, F.col("block").alias("end"), "link"), [IMAGE, "end"])
    link, followed = F.col("link"), F.col("bad")
    outcome = F.when(F.col("loop"), "loop").when(link == "self", "self-reference").when(link == "out of range", "out of range").when(link == "empty", "broken at empty slot").when(followed > 0, "back-link mismatch").otherwise("complete")
    return rows.select(IMAGE, F.col("block").alias("head"), (F.col("steps") + 1).alias("n_blocks"), F.col("end").alias("last_block"), followed.alias("back_mismatches"), outcome.alias("outcome"))


def unreached(blocks: DataFrame) -> DataFrame:
    """Blocks in use that no chain holds, by the first block that they declare (-1 and the block itself if none), with their order.

    Ordered by links when a walk from the group's one start covers it, else by block number.
    """
    used = blocks.where("not empty").join(chain_ends(blocks).where("least_head is not null").select(IMAGE, "block"), [IMAGE, "block"], "left_anti")
    rows = used.withColumn("group", F.when(F.col("first") > 0, F.col("first")).otherwise(-F.col("block")))
    members = rows.select(IMAGE, "group", F.col("block").alias("next"))
    edges = checkpointed(rows.where("next <> block").join(members, [IMAGE, "group", "next"]).select(IMAGE, "group", "block", "next"))
    starts = rows.join(edges.select(IMAGE, F.col("next").alias("block")).distinct(), [IMAGE, "block"], "left_anti")
    one = starts.groupBy(IMAGE, "group").agg(F.count(F.lit(1)).alias("n_starts"), F.min("block").alias("block")).where("n_starts = 1")
    walked = reach(edges.select(IMAGE, "block", "next"), one.select(IMAGE, "block")).join(one.select(IMAGE, "group", F.col("block").alias("head")), [IMAGE, "head"])
    sizes = rows.groupBy(IMAGE, "group").agg(F.count(F.lit(1)).alias("n_blocks"))
    by_links = walked.groupBy(IMAGE, "group").agg(F.count(F.lit(1)).alias("n_walked")).join(sizes, [IMAGE, "group"]).where("n_walked = n_blocks").select(IMAGE, "group", F.lit("links").alias("ordering"))
    placed = rows.join(sizes, [IMAGE, "group"]).join(by_links, [IMAGE, "group"], "left").join(walked.select(IMAGE, "group", "block", "place"), [IMAGE, "group", "block"], "left")
    key = F.when(F.col("ordering") == "links", F.col("place")).otherwise(F.col("block"))
    return placed.select(IMAGE, "group", "block", "n_blocks", F.coalesce("ordering", F.lit("block number")).alias("ordering"), F.row_number().over(Window.partitionBy(IMAGE, "group").orderBy(key)).cast("long").alias("rank"))


def chain_summary(blocks: DataFrame) -> DataFrame:
    """Per chain: bytes, the head's channel, blocks of another channel, first start, last end and whether its blocks lie one behind the other.

    ``blocks`` has offset, length, channel, start and end besides the links.
    """
    rows = chain_members(blocks).join(blocks.select(IMAGE, "block", "offset", "length", "channel", "start", "end"), [IMAGE, "block"])
    w = Window.partitionBy(IMAGE, "head").orderBy("place")
    before = F.lag(F.col("offset") + F.col("length")).over(w)
    rows = rows.withColumns({"__apart": F.coalesce(F.col("offset") != before, F.lit(False)), "__channel": F.first("channel").over(w)})
    return rows.groupBy(IMAGE, "head").agg(F.sum("length").alias("bytes"), F.max("__channel").alias("channel"), F.count_if(F.col("channel") != F.col("__channel")).alias("disagreeing"), F.min("start").alias("start"), F.max("end").alias("end"), (~F.bool_or("__apart")).alias("contiguous"))


def traverse_pages(pages: DataFrame, roots: DataFrame, guard: int = 64, regions: DataFrame | None = None, page_bytes: int = 1) -> DataFrame:
    """Pages (image_id, page, next, other; null or 0 for none if ``regions`` are given; maybe leaf_or_internal: boolean) that the roots reach, with depth, and the edges that go wrong.

    (image_id, kind, page, target, depth): kind visited, bad type (a visited page whose pointers aren't followed), out of range, misaligned,
    unreadable, duplicate or cycle. ``regions`` (image_id, first, size) say where an image's pages lie, every ``page_bytes`` from the first on; without
    them each page that isn't there is out of range. An edge to a page already visited closes a cycle if both lie in one strongly
    connected component, else it is a duplicate. More than ``guard`` levels are an error; rings may be of any length.
    """
    from .components import strong_components

    sound = F.coalesce(F.col("leaf_or_internal"), F.lit(False)) if "leaf_or_internal" in pages.columns else F.lit(True)
    edges = pages.where(sound).select(IMAGE, "page", F.explode(F.array("next", "other")).alias("target")).where("target is not null").distinct()
    if regions is not None:
        lo, far = F.col("first"), F.col("target") - F.col("first")
        outside = (far < 0) | (far + page_bytes > F.col("size")) | lo.isNull()
        state = F.when(outside, "out of range").when(far % page_bytes != 0, "misaligned").otherwise("unreadable")
        edges = edges.where("target <> 0").join(regions.select(IMAGE, "first", "size"), IMAGE, "left").select(IMAGE, "page", "target", state.alias("kind"))
    else:
        edges = edges.withColumn("kind", F.lit("out of range"))
    edges = checkpointed(edges)
    known = pages.select(IMAGE, F.col("page").alias("target")).distinct()
    # a page that is there but lies at no page's place isn't followed either
    there = edges if regions is None else edges.where("kind = 'unreadable'")
    good = checkpointed(there.select(IMAGE, "page", "target").join(known, [IMAGE, "target"], "left_semi"))
    bad = edges.join(good, [IMAGE, "page", "target"], "left_anti")
    visited = checkpointed(roots.select(IMAGE, "page").join(known.withColumnRenamed("target", "page"), [IMAGE, "page"], "left_semi").distinct().select(IMAGE, "page", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    front = visited
    for depth in range(1, guard + 1):
        to = front.select(IMAGE, "page").join(good, [IMAGE, "page"]).groupBy(IMAGE, F.col("target").alias("next_page")).agg(F.min("page").alias("parent"))
        front = checkpointed(to.select(IMAGE, F.col("next_page").alias("page"), F.lit(depth).alias("depth"), "parent").join(visited.select(IMAGE, "page"), [IMAGE, "page"], "left_anti"))
        if front.isEmpty():
            break
        visited = checkpointed(visited.unionByName(front))
    else:
        raise RuntimeError(f"pages are more than {guard} levels deep")
    tree = visited.where("parent is not null").select(IMAGE, F.col("parent").alias("page"), F.col("page").alias("target"))
    reached = checkpointed(visited.select(IMAGE, "page", "depth").join(good, [IMAGE, "page"]))
    again = reached.join(tree, [IMAGE, "page", "target"], "left_anti")
    names = checkpointed(strong_components(reached))
    own = names.select(IMAGE, F.col("page").alias("target"), F.col("node").alias("__node"))
    round_ = (F.col("page") == F.col("target")) | F.coalesce(F.col("node") == F.col("__node"), F.lit(False))
    wrong = again.join(names, [IMAGE, "page"], "left").join(own, [IMAGE, "target"], "left").select(IMAGE, F.when(round_, "cycle").otherwise("duplicate").alias("kind"), "page", "target", "depth")
    astray = visited.join(bad, [IMAGE, "page"]).select(IMAGE, "kind", "page", "target", "depth")
    found = visited.select(IMAGE, F.lit("visited").alias("kind"), "page", F.lit(None).cast("long").alias("target"), "depth").unionByName(astray).unionByName(wrong)
    if "leaf_or_internal" in pages.columns:
        odd = visited.join(pages.where(~sound).select(IMAGE, "page"), [IMAGE, "page"], "left_semi")
        found = found.unionByName(odd.select(IMAGE, F.lit("bad type").alias("kind"), "page", F.lit(None).cast("long").alias("target"), "depth"))
    return found


def traversal_report(found: DataFrame, headers: DataFrame) -> DataFrame:
    """Per image of ``headers`` (image_id, declared: pages that the header declares, or null) what ``traverse_pages`` found, and whether that is the whole tree.

    COMPLETE: no pointer went wrong, no cycle, no bad type, and as many pages as declared; duplicates are normal. PARTIAL otherwise, NONE without pages.
    """
    kinds = ("visited", "duplicate", "cycle", "out of range", "misaligned", "unreadable", "bad type")
    names = ["n_" + k.replace(" ", "_") for k in kinds]
    by = found.groupBy(IMAGE).agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in zip(kinds, names, strict=True)])
    rows = headers.select(IMAGE, "declared").join(by, IMAGE, "left").fillna(0, names)
    wrong = F.col("n_cycle") + F.col("n_out_of_range") + F.col("n_misaligned") + F.col("n_unreadable") + F.col("n_bad_type")
    same = F.coalesce(F.col("declared") == F.col("n_visited"), F.lit(True))
    return rows.withColumn("state", F.when(F.col("n_visited") == 0, "NONE").when((wrong == 0) & same, "COMPLETE").otherwise("PARTIAL"))


def accessibility(chains: DataFrame, primary_table: str = "table_role") -> DataFrame:
    """Chains (outcome and the role of the table that described them) with whether their recording is accessible, and why not."""
    reason = F.when(F.col("outcome").isin("complete", "back-link mismatch") & (F.col(primary_table) == "primary"), None).when(F.col(primary_table) != "primary", "described by a secondary table only").otherwise(F.concat(F.lit("chain is not complete: "), F.col("outcome")))
    return chains.withColumns({"accessible": reason.isNull(), "reason": reason})
