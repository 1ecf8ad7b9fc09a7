"""Line deduplication by distinct-site spread: lines that stand on many sites are boilerplate and are removed everywhere.

Each line's sites go into a HyperLogLog sketch; partial sketches of one line merge by aggregation. An estimate clearly
above or below the threshold settles the line; lines near it get an exact count of distinct sites.

Defined results: a null text counts as empty; a null site counts as none. Lines are compared without the spaces around them;
empty lines always stay. A line that repeats on one site counts one site, repeated rows too. A document whose lines all go
has an empty text. A table without rows gives none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Sites from which a line is boilerplate; size of the sketches as a power of two; half width of the band that is counted exactly.
MIN_SITES, SKETCH, BAND = 10, 12, 0.1


@F.pandas_udf(T.StringType())
def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, gone in batches:
        out = []
        for text, places in zip(texts, gone, strict=True):
            drop = set(places) if places is not None else ()
            out.append("\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop) if len(drop) else text)
        yield pd.Series(out, dtype=object)


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(key, place, line: 16 bytes of MD5, site) of the lines that aren't empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the key is made before the lines are, so once a row
    rows = docs.select(_key(id_col, text).alias("key"), F.col(site_col).cast("string").alias("site"), text.alias("text"))
    rows = rows.select("key", "site", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    return rows.where(F.trim("raw") != "").select("key", "place", F.unhex(F.md5(F.trim("raw"))).alias("line"), "site")


def _key(id_col: str, text):
    """What a row is joined by: 16 bytes of MD5 of id and text, so that ids may repeat or be null."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), text)))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line) of the lines on at least ``min_sites`` distinct sites."""
    sketches = lines.where("site is not null").groupBy("line").agg(F.hll_sketch_agg("site", SKETCH).alias("sketch"))
    spread = stored(sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND) - 1), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + BAND) + 1).select("line")
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND) + 1).select("line")
    counted = lines.where("site is not null").join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(counted.select("line"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """A row for each row of ``docs``: id_col, text without boilerplate lines, n_lines, n_removed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = stored(lines_of(docs, id_col, text_col, site_col), "lines")
    common = stored(boilerplate(lines, min_sites), "boilerplate")
    gone = lines.join(common, "line").groupBy("key").agg(F.collect_set("place").alias("gone"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), _key(id_col, text).alias("key"))
    out = rows.join(gone, "key", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without("text", "gone")).alias("text"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
