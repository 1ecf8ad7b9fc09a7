"""Walks through containers in image bytes: parts are found by their codes in any windows, judged one by one, and stitched by where each one ends.

Each place that could begin a part is judged on its own, by all tasks; the walk itself is an ordered pass over these places, cut into islands where
a walk has to arrive whatever it met before, and carries one number. So neither windows nor a region's size matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fields as B
from ..sources.images import FileImages, as_images
from ..sources.scratch import checkpointed
from .detect import find_in_images
from .islands import fold_islands
from .ranges import with_bins

#: The codes of parts, a pack's bytes and its serial's place, bounds and places of an information part, and a stream part's fields.
START_CODE, INFO = b"\0\0\1", b"OFNI"
KINDS = {0xBA: "pack", 0xBB: "system", 0xBC: "map", 0xBD: "private", 0xC0: "audio", 0xE0: "video-0", 0xE1: "video-1"}
PACK_BYTES, SERIAL_AT = 20, 16
INFO_ADDS, INFO_MOST = 8, 65536
PART_ADDS, PAYLOAD_AT, PAYLOAD_MASK, PAYLOAD_ADDS = 6, 7, 0xFFF, 9
#: Bytes of the bins in which places meet regions and running values are carried.
BIN = 1 << 20


def _big_endian(data: Column, at: int, size: int) -> Column:
    total = B.byte_at(data, at).cast("long")
    for k in range(1, size):
        total = total * 256 + B.byte_at(data, at + k)
    return total


def reached_before(rows: DataFrame, keys: Sequence[str], place: str, value: Column, name: str, bin_bytes: int = BIN) -> DataFrame:
    """``rows`` with the largest value of the rows of smaller place, null for the first; one row a bin is carried over a key, all else stays in its bin."""
    rows = rows.withColumns({"__bin": F.floor(F.col(place) / bin_bytes), "__value": value})
    order = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "__bin").agg(F.max("__value").alias("__most")).withColumn("__carried", F.max("__most").over(order)).drop("__most")
    inside = Window.partitionBy(*keys, "__bin").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, [*keys, "__bin"]).withColumn(name, F.greatest("__carried", F.max("__value").over(inside)))
    return joined.select(*[c for c in rows.columns if c not in ("__bin", "__value", name)], name)


def judge_parts(places: DataFrame) -> DataFrame:
    """Places (offset, bytes, coded, region_end) as parts: kind, length, serial, payload_offset, payload_length, or the first reason against as ``rejected``.

    Bytes behind the region don't count. truncated: fields are cut off; unknown stream: no such kind; length: an information part above its bound or
    below 0; beyond region: it ends behind the region; payload outside: it would begin behind the part. A part too short for a payload's place has none.
    """
    left = F.col("region_end") - F.col("offset")
    rows = places.withColumn("__head", F.substring("bytes", F.lit(1), F.least(left, F.lit(PACK_BYTES)).cast("int")))
    head, coded = F.col("__head"), F.col("coded")
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    kind = F.when(coded, F.try_element_at(names, B.byte_at(head, 3))).otherwise("info")
    rows = rows.withColumns({"kind": kind, "__declared": F.when(coded, _big_endian(head, 4, 2)).otherwise(B.le_int(head, 4, 4)), "serial": F.when(kind == "pack", _big_endian(head, SERIAL_AT, 4))})
    info, pack = F.col("kind") == "info", F.col("kind") == "pack"
    stream = ~info & ~pack
    rows = rows.withColumns({
        "length": F.when(info, F.col("__declared") + INFO_ADDS).when(pack, F.lit(PACK_BYTES).cast("long")).when(stream, F.col("__declared") + PART_ADDS),
        "__payload": F.when(info, INFO_ADDS).when(stream, _big_endian(head, PAYLOAD_AT, 2).bitwiseAND(F.lit(PAYLOAD_MASK)) + PAYLOAD_ADDS),
    })
    reason = (
        F.when(F.coalesce(F.octet_length(head), F.lit(0)) < 4, "truncated").when(F.col("kind").isNull(), "unknown stream").when(~pack & F.col("__declared").isNull(), "truncated")
        .when(info & ~F.col("__declared").between(0, INFO_MOST), "length").when(F.col("length") > left, "beyond region").when(pack & F.col("serial").isNull(), "truncated").when(stream & (F.col("__payload") >= F.col("length")), "payload outside")
    )
    rows = rows.withColumn("rejected", reason)
    size = F.when(F.col("rejected").isNull() & (F.col("length") > F.col("__payload")), F.col("length") - F.col("__payload"))
    rows = rows.withColumns({"payload_length": size, "payload_offset": F.when(size.isNotNull(), F.col("offset") + F.col("__payload"))})
    return rows.withColumns({c: F.when(F.col("rejected").isNull(), F.col(c)) for c in ("length", "serial")}).drop("__head", "__declared", "__payload", "bytes")


def walk_containers(chunks: DataFrame | FileImages, regions: DataFrame, window: int, resync: bool = True) -> DataFrame:
    """The parts that a walk through each region (image_id, region_id, offset, length; ids once an image) meets: image_id, region_id, offset, kind, length, serial, payload_offset, payload_length, rejected, skipped.

    The walk begins at the region's offset and goes on where a part ends. Where no good part is, with ``resync`` it goes to the next start code (an information
    part is only met directly) and ``skipped`` counts the bytes between; what is rejected is listed. Without ``resync`` it ends there and lists the good parts ahead. A
    region that ends behind the image is cut to it; one that is empty, without codes or of null ids or places has no rows. Images are searched twice, once for each code.
    """
    images = as_images(chunks, window)
    wanted = regions.select("image_id", "region_id", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length")).where("offset >= 0 and length > 0 and region_id is not null")
    sized = wanted.join(images.sizes(), "image_id").select("image_id", "region_id", F.col("offset").alias("region_offset"), F.least(F.col("offset") + F.col("length"), F.col("size_bytes")).alias("region_end")).where("region_end > region_offset")
    touching = wanted.select("image_id", "offset", "length")
    searched = [find_in_images(images, code, touching=touching, follow=(0, PACK_BYTES)).withColumn("coded", F.lit(code == START_CODE)) for code in (START_CODE, INFO)]
    hits = searched[0].unionByName(searched[1]).withColumn("__bin", F.floor(F.col("offset") / BIN))
    met = hits.join(with_bins(sized, F.col("region_offset"), F.col("region_end"), BIN), ["image_id", "__bin"]).where("offset >= region_offset and offset < region_end").drop("__bin")
    keys = ["image_id", "region_id"]
    places = checkpointed(judge_parts(met))
    places = reached_before(places, keys, "offset", F.col("offset") + F.coalesce("length", F.lit(1)), "__reach")
    # a walk arrives at a start code that lies behind all that could lead over it
    sure = F.when(F.col("coded") & (F.coalesce("__reach", F.col("region_offset")) <= F.col("offset")), F.col("offset"))
    places = reached_before(places.withColumn("__sure", sure), keys, "offset", F.col("__sure"), "__island")
    places = places.withColumn("__island", F.coalesce(F.greatest("__sure", "__island"), F.lit(-1).cast("long"))).drop("__reach", "__sure")

    def step(end, begin, offset, length, coded):
        end = begin if end is None else end
        if offset == end or offset > end and coded:
            return offset + (length or 1), 1
        return end, 0

    walked = fold_islands(places, keys, ["offset"], "__island", ["region_offset", "offset", "length", "coded"], step, "__met").where("__met = 1").drop("__met", "__island")
    walked = reached_before(checkpointed(walked), keys, "offset", F.col("offset") + F.coalesce("length", F.lit(0)), "__before")
    walked = walked.withColumn("skipped", F.col("offset") - F.coalesce("__before", "region_offset")).drop("__before", "region_offset", "region_end", "coded")
    if not resync:
        broken = walked.where("rejected is not null or skipped > 0").groupBy(*keys).agg(F.min("offset").alias("__broken"))
        walked = walked.join(broken, keys, "left").where("__broken is null or offset < __broken").drop("__broken")
    return walked.select(*keys, "offset", "kind", "length", "serial", "payload_offset", "payload_length", "rejected", "skipped")
