"""MD5 and SHA-256 of images and of regions of any length, over windows in order, and their second pass.

A digest needs its bytes one behind the other, so a region is one task's work; only the digests' state and one window are in memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.sources.images import BATCH, FileImages, TableImages, _Files

DIGESTS = "image_id long, region_id string, read_bytes long, md5 string, sha256 string"


class _Running:
    """Both digests of one region while its bytes come in."""

    def __init__(self, key: tuple):
        self.key, self.read, self.whole, self.states = key, 0, True, (hashlib.md5(usedforsecurity=False), hashlib.sha256())

    def take(self, data: bytes | None, wanted: int):
        """The next ``wanted`` bytes; from bytes that can't be read on nothing counts any more."""
        self.whole = self.whole and data is not None and len(data) == wanted
        if self.whole:
            self.read += wanted
            for state in self.states:
                state.update(data)

    def row(self, length: int) -> tuple:
        done = self.whole and self.read == length
        return (*self.key, self.read, *(s.hexdigest() if done else None for s in self.states))


def _made(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _of_files(images: FileImages, regions: DataFrame) -> DataFrame:
    lo, hi = F.col("offset"), F.col("offset") + F.col("length")
    near = F.filter("__extents", lambda e: (e["start"] < hi) & (e["start"] + e["size"] > lo))
    placed = images._met(regions, "left").select("image_id", "region_id", "offset", "length", F.coalesce(near, F.array()).alias("__extents"))

    def read(batches):
        files = _Files()
        for row in (r for batch in batches for r in batch.to_pylist()):
            found = _Running((row["image_id"], row["region_id"]))
            for at in range(row["offset"], row["offset"] + row["length"], BATCH):
                wanted = min(BATCH, row["offset"] + row["length"] - at)
                found.take(files.region([tuple(e[n] for n in ("start", "size", "path", "at")) for e in row["__extents"] if e["start"] < at + wanted and e["start"] + e["size"] > at], at, wanted)[0], wanted)
                if not found.whole:
                    break
            yield _made([found.row(row["length"])])
        files.close()

    return placed.repartition("image_id", "region_id").mapInArrow(read, DIGESTS)


def _of_table(images: TableImages, regions: DataFrame) -> DataFrame:
    window = images.window
    touched = regions.where("length > 0").withColumn("__n", F.explode(F.sequence(F.floor(F.col("offset") / window), F.floor((F.col("offset") + F.col("length") - 1) / window))))
    # a window given twice counts once
    there = images.rows.withColumn("__n", F.floor(F.col("base_offset") / window)).dropDuplicates(["image_id", "__n"]).select("image_id", "__n", "base_offset", "owned_len", "data")
    lo = F.greatest(F.col("offset") - F.col("base_offset"), F.lit(0))
    hi = F.least(F.col("offset") + F.col("length") - F.col("base_offset"), F.lit(window))
    own = F.least(hi, F.col("owned_len")) - lo
    piece = F.substring("data", (lo + 1).cast("int"), F.greatest(own, F.lit(0)).cast("int"))
    met = touched.join(there, ["image_id", "__n"], "left").select("image_id", "region_id", "length", "__n", (hi - lo).alias("wanted"), piece.alias("data"))
    empty = regions.where("length = 0").select("image_id", "region_id", "length", F.lit(0).cast("long").alias("__n"), F.lit(0).cast("long").alias("wanted"), F.lit(b"").alias("data"))
    rows = met.unionByName(empty).repartition("image_id", "region_id").sortWithinPartitions("image_id", "region_id", "__n")

    def fold(batches):
        found, length = None, 0
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                key = (row["image_id"], row["region_id"])
                if found is None or found.key != key:
                    if found is not None:
                        done.append(found.row(length))
                    found, length = _Running(key), row["length"]
                found.take(row["data"], row["wanted"])
            if done:
                yield _made(done)
        if found is not None:
            yield _made([found.row(length)])

    return rows.mapInArrow(fold, DIGESTS)


def _of_windows(images: TableImages) -> DataFrame:
    """Of whole images; sizes are found along the way, so windows are read once."""
    window = images.window
    own = F.least(F.col("owned_len"), F.lit(window)).cast("int")
    rows = images.rows.select("image_id", F.floor(F.col("base_offset") / window).alias("__n"), (F.col("base_offset") + F.col("owned_len")).alias("__end"), own.alias("__own"), F.substring("data", F.lit(1), own).alias("data"))
    rows = rows.repartition("image_id").sortWithinPartitions("image_id", "__n")
    names = ("size_bytes", "read_bytes", "md5", "sha256")

    def fold(batches):
        found, size, at, short = None, None, -1, 0

        def done():
            if size is None or found.key[0] is None:
                return (*found.key, size, None, None, None)
            image, *rest = (found if size > 0 else _Running(found.key)).row(size)
            return (image, size, *rest)

        for batch in batches:
            kind, rows = batch.column(0).type, []
            for k, (image, n, end, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if found is None or found.key != (image,):
                    if found is not None:
                        rows.append(done())
                    found, size, at, short = _Running((image,)), None, -1, 0
                size = end if size is None else size if end is None else max(size, end)
                # a window given twice counts once
                if n is None or n == at:
                    continue
                if n != at + 1 or short:
                    # a window is missing, or the last one ended short of this one
                    found.whole, found.read, short = False, found.read - short, 0
                at = n
                data = batch.column(4)[k]
                found.take(data.as_buffer() if data.is_valid else None, own)
                if found.whole and own < window:
                    short = own
            if rows:
                yield listed(kind, rows)
        if found is not None:
            yield listed(kind, [done()])

    def listed(kind, rows):
        kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image_id", *names])

    kinds = zip(names, (T.LongType(), T.LongType(), T.StringType(), T.StringType()), strict=True)
    return rows.mapInArrow(fold, T.StructType([rows.schema["image_id"], *(T.StructField(n, t) for n, t in kinds)]))


def region_digests(images: TableImages | FileImages, regions: DataFrame) -> DataFrame:
    """(image_id, region_id as text, read_bytes, md5, sha256) of ``regions`` (image_id, region_id, offset, length), in lower-case hex.

    Digests are null where a byte can't be read, a window is missing or the image ends before the region; read_bytes tells how far it
    was read. An empty region has the digests of no bytes. Regions with a null or negative place or length are left out.
    A region given twice has to be one row. Of files bytes are read by seeking and don't shuffle; of a table windows do, as they have to meet in order.
    """
    wanted = regions.select(F.col("image_id").cast("long").alias("image_id"), F.col("region_id").cast("string").alias("region_id"), "offset", "length").where("offset >= 0 and length >= 0 and image_id is not null and region_id is not null")
    return (_of_files if isinstance(images, FileImages) else _of_table)(images, wanted)


def image_digests(images: TableImages | FileImages) -> DataFrame:
    """(image_id, size_bytes, read_bytes, md5, sha256) of whole images. Windows of a table shuffle once, to their image."""
    if isinstance(images, TableImages):
        return _of_windows(images)
    whole = images.sizes().select("image_id", F.lit("").alias("region_id"), F.lit(0).cast("long").alias("offset"), F.col("size_bytes").alias("length"))
    return images.sizes().join(region_digests(images, whole).drop("region_id"), "image_id", "left")


def verify_images(acquired: DataFrame, images: TableImages | FileImages) -> DataFrame:
    """The second pass: ``acquired`` (image_id, md5, sha256: of the first) with md5_again, sha256_again and ``verdict``.

    MATCH if both digests are the same, whatever their case; MISMATCH if one that both passes have differs; else UNKNOWN: a digest is
    missing in the first pass, or the image couldn't be read whole.
    """
    again = image_digests(images).select("image_id", "size_bytes", F.col("md5").alias("md5_again"), F.col("sha256").alias("sha256_again"))
    same = [F.lower(c) == F.col(f"{c}_again") for c in ("md5", "sha256")]
    verdict = F.when(F.coalesce(~same[0], F.lit(False)) | F.coalesce(~same[1], F.lit(False)), "MISMATCH").when(same[0] & same[1], "MATCH").otherwise("UNKNOWN")
    return acquired.join(again, "image_id", "left").withColumn("verdict", verdict)
