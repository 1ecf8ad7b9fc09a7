"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space characters that the text contracts name, space and \x09-\x0D.
WHITE_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset, a new one on a local master and an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        there = spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="tracelake-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    Cuts the lineage; the written rows survive the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id, divisor: int):
    """crc32 of the id's decimal digits, modulo ``divisor``; a null id counts as the empty string."""
    digits = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(digits.cast("binary")) % divisor


def without_white_space(text):
    """``text`` (null: empty) without any character of [\\x20\\x09-\\x0D]."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


#: Bits of a bitmap that bitmap_construct_agg makes.
PAGE = 32768
#: A filter has 16 slots a row, from one page to 2**MAX_BITS slots, so 32 MB; beyond that it gets denser and lets more rows through.
MIN_BITS, MAX_BITS = 15, 28


def filter_bits(n_rows: int) -> int:
    """Slots of a filter for ``n_rows`` rows, as a power of two."""
    return min(MAX_BITS, max(MIN_BITS, (16 * n_rows).bit_length()))


def slots(h, bits: int) -> list:
    """The two slots of a 64-bit hash."""
    mask = (1 << bits) - 1
    return [h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 64 - MAX_BITS).bitwiseAND(F.lit(mask))]


def bitmaps(slot: DataFrame) -> DataFrame:
    """(page, bitmap) of the values in the one column of ``slot``."""
    name = slot.columns[0]
    return slot.groupBy(F.floor(F.col(name) / PAGE).cast("long").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(name) % PAGE + 1)).alias("bitmap"))


def with_probe(rows: DataFrame, filter_pages: DataFrame, bits: int, h) -> DataFrame:
    """``rows`` with ``__maybe``: whether both slots of the hash ``h`` are set in the filter, which is broadcast (32 MB at most)."""
    out, names, hits = rows, rows.columns, []
    for k, slot in enumerate(slots(h, bits)):
        pages = F.broadcast(filter_pages.select(F.col("page").alias(f"__page{k}"), F.col("bitmap").alias(f"__bitmap{k}")))
        out = out.withColumn(f"__slot{k}", slot)
        out = out.join(pages, F.floor(F.col(f"__slot{k}") / PAGE).cast("long") == F.col(f"__page{k}"), "left")
        byte = f"cast(conv(hex(substring(__bitmap{k}, cast((__slot{k} % {PAGE}) div 8 as int) + 1, 1)), 16, 10) as int)"
        hits.append(F.coalesce(F.expr(f"shiftright({byte}, cast(__slot{k} % 8 as int)) & 1"), F.lit(0)) == 1)
    return out.select(*names, (hits[0] & hits[1]).alias("__maybe"))


def apart(rows: DataFrame, key, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``key`` isn't in the one column of ``keys``, by a Bloom filter, and the others, which alone have to shuffle.

    A null key counts as a key like any other. ``keys`` is read twice, so it should be a stored table.
    """
    bits = filter_bits(keys.count())
    own = keys.select(F.explode(F.array(*slots(F.xxhash64(F.col(keys.columns[0])), bits))).alias("slot"))
    probed = with_probe(rows, stored(bitmaps(own), "filter"), bits, F.xxhash64(key))
    return probed.where(~F.col("__maybe")).drop("__maybe"), probed.where("__maybe").drop("__maybe")


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't in the one column of ``ids``; a null id matches a null id. Only rows that may match shuffle."""
    there = stored(ids.select(F.col(ids.columns[0]).alias("__gone")).distinct(), "ids")
    straight, maybe = apart(docs, F.col(id_col), there)
    return straight.unionByName(maybe.join(there, maybe[id_col].eqNullSafe(there["__gone"]), "left_anti"))
