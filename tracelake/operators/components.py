"""Strongly connected components of large directed graphs, a row for each edge and node, never for a pair that is only reachable.

Steps are repeated until no edge is left. Trimming: nodes that nothing leads to or that lead nowhere are on no way round. Chains: where
each node has one way on, pointers are doubled; ways that end are trimmed at once, however long, and ways that don't lead to rings.
Merging: nodes that point to each other are one, whole runs of them at once. Shortcuts: where chains lead from branch to branch, the
branches alone are searched, and the chains between two of one component belong to it. What has neither is coloured: each node gets
the largest number of those that lead to it, and the nodes that lead back to the one of that number are its component.

Rounds: as many as the depth of what is trimmed, the logarithm of chains, rings and runs, and for colouring the longest way
through a component in which each node branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .graph import IMAGE, walk_links


def _kept(df: DataFrame) -> DataFrame:
    """``df`` stored, in as many partitions as a shuffle has at most: unions of broadcast joins would add up to ever more."""
    return stored(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "components")


def _both_ends(edges: DataFrame) -> DataFrame:
    """Edges whose source has a way in and whose target has a way on."""
    on = edges.select(IMAGE, F.col("page").alias("target")).distinct()
    into = edges.select(IMAGE, F.col("target").alias("page")).distinct()
    return edges.join(on, [IMAGE, "target"], "left_semi").join(into, [IMAGE, "page"], "left_semi")


def _without(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges that touch none of ``pages``."""
    return edges.join(pages, [IMAGE, "page"], "left_anti").join(pages.withColumnRenamed("page", "target"), [IMAGE, "target"], "left_anti")


def _trimmed(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Edges without those of nodes at the ends, as long as that takes away an eighth of them in a round."""
    while n:
        left = _kept(_both_ends(edges))
        before, n, edges = n, left.count(), left
        if n > before * 7 / 8:
            break
    return edges, n


def _ways(edges: DataFrame) -> DataFrame:
    """A row a node (as ``walk_links`` takes them): nodes with one way on point to it, others are done; ``end`` has none."""
    out = edges.groupBy(IMAGE, "page").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("to"))
    nodes = edges.select(IMAGE, "page").unionByName(edges.select(IMAGE, F.col("target").alias("page"))).distinct()
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    return _kept(nodes.join(out, [IMAGE, "page"], "left").select(IMAGE, F.col("page").alias("block"), F.when(one, F.col("to")).otherwise(F.col("page")).alias("to"), one.cast("long").alias("steps"), F.lit(0).cast("long").alias("bad"), (~one).alias("done"), F.lit(None).cast("long").alias("low"), F.col("n").isNull().alias("end")))


def _rings(ways: DataFrame, walked: DataFrame) -> DataFrame:
    """(page, node) of rings of nodes with one way on."""
    on = _kept(walked.where("not done").select(IMAGE, F.col("to").alias("block")).distinct())
    if on.isEmpty():
        return on.select(IMAGE, F.col("block").alias("page"), F.col("block").alias("node"))
    ring = ways.join(on, [IMAGE, "block"], "left_semi").drop("end").withColumn("low", F.col("block"))
    return walk_links(ring).select(IMAGE, F.col("block").alias("page"), F.col("low").alias("node"))


def _through_branches(edges: DataFrame, ways: DataFrame, walked: DataFrame) -> DataFrame:
    """(page, node) of all components of edges in which every chain leads to a branch, by those of the branches."""
    to = walked.select(IMAGE, F.col("block").alias("target"), F.col("to").alias("branch"))
    leaps = _kept(edges.join(ways.where("done").select(IMAGE, F.col("block").alias("page")), [IMAGE, "page"], "left_semi").join(to, [IMAGE, "target"]))
    inner = _kept(strong_components(leaps.select(IMAGE, "page", F.col("branch").alias("target"))))
    own = leaps.join(inner, [IMAGE, "page"], "left").join(inner.select(IMAGE, F.col("page").alias("branch"), F.col("node").alias("__node")), [IMAGE, "branch"], "left")
    node = F.when(F.col("node") == F.col("__node"), F.col("node")).when(F.col("page") == F.col("branch"), F.coalesce("node", "page"))
    # the chain that begins at a leap's target lies in the component of the branches at both its ends
    marks = own.withColumn("node", node).where("node is not null")
    begun = marks.groupBy(IMAGE, F.col("target").alias("block")).agg(F.min("node").alias("__low"))
    rows = ways.drop("end").join(begun, [IMAGE, "block"], "left").withColumn("low", F.when(~F.col("done"), F.col("__low"))).drop("__low")
    chains = walk_links(rows).join(ways.where("not done").select(IMAGE, "block"), [IMAGE, "block"], "left_semi").where("low is not null").select(IMAGE, F.col("block").alias("page"), F.col("low").alias("node"))
    branches = marks.select(IMAGE, "page", "node").unionByName(inner).distinct()
    return chains.unionByName(branches)


def _mutual(edges: DataFrame) -> DataFrame:
    """(page, node) of nodes that point to each other: each goes to its least partner, and along these to the last one."""
    back = edges.select(IMAGE, F.col("target").alias("page"), F.col("page").alias("target"))
    pairs = _kept(edges.join(back, [IMAGE, "page", "target"], "left_semi"))
    if pairs.isEmpty():
        return pairs.select(IMAGE, "page", F.col("target").alias("node"))
    up = pairs.groupBy(IMAGE, "page").agg(F.min("target").alias("to")).withColumn("to", F.least("to", "page"))
    rows = up.select(IMAGE, F.col("page").alias("block"), "to", F.lit(1).cast("long").alias("steps"), F.lit(0).cast("long").alias("bad"), (F.col("to") == F.col("page")).alias("done"), F.lit(None).cast("long").alias("low"))
    return walk_links(rows).select(IMAGE, F.col("block").alias("page"), F.col("to").alias("node"))


def _coloured(edges: DataFrame) -> DataFrame:
    """(page, node) of some components, at least of the one with the largest number: nodes that the largest of those leading to them leads back to."""
    nodes = edges.select(IMAGE, "page").unionByName(edges.select(IMAGE, F.col("target").alias("page"))).distinct()
    colours, was = _kept(nodes.withColumn("node", F.col("page"))), None
    while True:
        sent = edges.join(colours, [IMAGE, "page"]).groupBy(IMAGE, F.col("target").alias("page")).agg(F.max("node").alias("__node"))
        colours = _kept(colours.join(sent, [IMAGE, "page"], "left").select(IMAGE, "page", F.greatest("node", "__node").alias("node")))
        now = colours.agg(F.sum(F.col("node").cast("decimal(38,0)"))).first()[0]
        if now == was:
            break
        was = now
    inside = edges.join(colours, [IMAGE, "page"]).join(colours.select(IMAGE, F.col("page").alias("target"), F.col("node").alias("__node")), [IMAGE, "target"]).where("node = __node").drop("__node")
    inside = _kept(inside)
    found = front = _kept(colours.where("page = node"))
    while not front.isEmpty():
        back = inside.join(front.select(IMAGE, F.col("page").alias("target"), "node"), [IMAGE, "target", "node"]).select(IMAGE, "page", "node").distinct()
        front = _kept(back.join(found, [IMAGE, "page", "node"], "left_anti"))
        found = _kept(found.unionByName(front))
    return found


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between the nodes that (page, node) makes one, without those inside of one."""
    to = names.select(IMAGE, F.col("page").alias("target"), F.col("node").alias("__to"))
    rows = edges.join(names, [IMAGE, "page"], "left").join(to, [IMAGE, "target"], "left")
    rows = rows.select(IMAGE, F.coalesce("node", "page").alias("page"), F.coalesce("__to", "target").alias("target"))
    return rows.where("page <> target").distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """(image_id, page, node) of pages that lie on a way round through other pages, by edges (image_id, page, target); ``node`` names the component."""
    live = _kept(edges.select(IMAGE, "page", "target").where("page <> target").distinct())
    names = _kept(live.limit(0).select(IMAGE, "page", F.col("page").alias("node")))
    n, few = live.count(), False  # few: merging has become slow, so other steps come first

    def merged(names: DataFrame, more: DataFrame) -> DataFrame:
        """Pages under their nodes' new names, and the new ones."""
        step = more.select(IMAGE, F.col("page").alias("node"), F.col("node").alias("__node"))
        old = names.join(step, [IMAGE, "node"], "left").select(IMAGE, "page", F.coalesce("__node", "node").alias("node"))
        return _kept(old.unionByName(more.join(names.select(IMAGE, "page"), [IMAGE, "page"], "left_anti")))

    while True:
        live, n = _trimmed(live, n)
        if not n:
            return names
        more = live.limit(0) if few else _kept(_mutual(live))
        if not more.isEmpty():
            names, live = merged(names, more), _kept(_renamed(live, more))
            few, n = live.count() > n * 7 / 8, live.count()
            continue
        ways = _ways(live)
        walked = _kept(walk_links(ways.drop("end")))
        ends = ways.where("end").select(IMAGE, F.col("block").alias("to"))
        dead = _kept(walked.where("done").join(ends, [IMAGE, "to"], "left_semi").select(IMAGE, F.col("block").alias("page")))
        more = _kept(_rings(ways, walked))
        live = _kept(_without(live, dead))
        left = live.count()
        if more.isEmpty() and left == n:
            if not ways.where("not done").isEmpty():
                return merged(names, _kept(_through_branches(live, ways, walked)))
            more, few = _coloured(live), False
            # a component of one node has had its turn, so its edges go
            alone = more.groupBy(IMAGE, "node").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(IMAGE, F.col("node").alias("page"))
            live = _kept(_without(live, alone))
            more = _kept(more.join(alone.withColumnRenamed("page", "node"), [IMAGE, "node"], "left_anti").select(IMAGE, "page", "node"))
        if not more.isEmpty():
            names = merged(names, more)
            live = _kept(_renamed(live, more))
        n = live.count()
