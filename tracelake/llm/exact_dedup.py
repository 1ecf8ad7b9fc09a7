"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions alone.

Pass one hashes each row into a counting filter with two hash functions and keeps, as bitmaps, the slots that
two or more rows hit. Pass two probes each row against those bitmaps, which are broadcast (at most
2**common.MAX_BITS bits, so 32 MB). A row with a slot of its own has no equal; it goes straight to the result. Only the
others shuffle, and their groups are settled exactly on SHA-256, so a false positive costs a shuffled row and nothing else.

Defined results: a null text counts as empty, and empty texts equal each other. Ties in length go to the smallest
id; a null id loses to any other. Rows that repeat an id and text count in group_size and share their decision.
An empty table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, bitmaps, filter_bits, slots, stored, with_probe, without_white_space

def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha: 32 bytes of SHA-256 of the text without white space, n_cp: code points of the text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(without_white_space(F.col(text_col)), 256)).alias("sha"), F.char_length(text).alias("n_cp"))


def repeated_slots(rows: DataFrame, bits: int) -> DataFrame:
    """Pass one: (page, bitmap) of the slots that two or more rows hit."""
    slot = rows.select(F.explode(F.array(*slots(F.xxhash64("sha"), bits))).alias("slot"))
    return bitmaps(slot.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slot"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Of rows equal but for white space, the longest by code points of the original text stays, then the smallest id.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    bits = filter_bits(rows.count())
    probed = with_probe(rows, stored(repeated_slots(rows, bits), "slots"), bits, F.xxhash64("sha"))
    alone = probed.where(~F.col("__maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    again = probed.where("__maybe").select("id", "sha", "n_cp")
    # ~id falls as the id rises and can't overflow; a null sorts below all.
    groups = again.groupBy(F.col("sha").alias("__sha")).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("n_cp", F.bitwise_not("id").alias("back"))).alias("best"))
    groups = stored(groups, "groups")  # the join below has plain sides then, so that a hot group is split
    settled = again.join(groups, F.col("sha") == F.col("__sha")).select("id", F.bitwise_not("best.back").alias("keep_id"), "group_size", "sha")
    return alone.unionByName(settled).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group, also of rows that repeat an id and text.

    Of rows that repeat an id and text, which may differ in white space or in other columns, one with the most code points stays.
    A second filter, over the ids of rows that go or repeat, lets all other rows pass without a shuffle.
    """
    decided = exact_dedup(docs, id_col, text_col)
    pairs = decided.groupBy(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__sha")).agg(F.bool_and("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows"))
    special = stored(pairs.where("not __kept or __rows > 1"), "special")
    straight, maybe = apart(docs, F.col(id_col), special.select("__id"))
    rows = maybe.withColumn("__own", F.unhex(F.sha2(without_white_space(F.col(text_col)), 256)))
    joined = rows.join(special, (F.col("__own") == F.col("__sha")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    plain = straight.unionByName(joined.where("__sha is null").select(*docs.columns))
    if special.where("__kept").isEmpty():  # no row repeats an id and text that stays
        return plain
    again = joined.where("__kept").groupBy("__id", "__sha").agg(F.max_by(F.struct(*[F.col(c) for c in docs.columns]), F.char_length(text_col)).alias("__row"))
    return plain.unionByName(again.select("__row.*"))
