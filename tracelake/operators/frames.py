"""Whole descriptions of tagged frames: what the records of their extra headers say, payload places, and everything that speaks against a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import packed_clock
from ..sources.images import FileImages, as_images
from .decode import FRAME_KINDS, _bytes_at, tagged_frames
from .records import carve_frames, judge

#: Bytes ahead of the extra header, and of the trailer.
HEADER, TRAILER = 24, 8
#: Tags of an extra header's records of 4 bytes and of 8; of a size over eight, a codec, a size.
SHORT_TAGS = (0x80, 0x81, 0x84, 0x85, 0x8B, 0x94, 0x96, 0xA0, 0xB2, 0xB4)
LONG_TAGS = (0x82, 0x83, 0x88, 0x8C, 0x91, 0x92, 0x93, 0x95, 0x9A, 0x9B, 0xB3)
COARSE_SIZE, CODEC, EXACT_SIZE = 0x80, 0x81, 0x82
#: Codecs by number.
CODECS = {1: "MPEG-4", 2: "H.264", 3: "MJPEG", 4: "H.264", 8: "H.264", 12: "H.265"}


def _named(problems: dict[str, Column]) -> Column:
    """The names of the problems that hold, null if none does."""
    named = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in problems.items()])), ", ")
    return F.when(named != "", named)


def extra_header(data: Column) -> Column:
    """struct(tags, width, height, codec_id, frame_rate, problem) of an extra header's bytes.

    A record's size follows from its tag. The walk ends at a tag of unknown size ("unknown tag") and at a record that the header cuts off ("cut
    record"); the tag itself is listed. Later records overrule earlier ones. Null bytes have no tags.
    """
    octets = F.transform(F.regexp_extract_all(F.hex(F.coalesce(data, F.lit(b""))), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))
    none = F.lit(None).cast("int")
    names = ("at", "tags", "width", "height", "codec_id", "frame_rate", "problem")

    def state(*values):
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])

    def step(bytes_, s):
        byte = lambda k: F.get(bytes_, s["at"] + k)
        tag = byte(0)
        size = F.when(tag.isin(*SHORT_TAGS), 4).when(tag.isin(*LONG_TAGS), 8)
        problem = F.when(size.isNull(), "unknown tag").when(s["at"] + size > F.size(bytes_), "cut record")
        width = F.when(tag == COARSE_SIZE, byte(2) * 8).when(tag == EXACT_SIZE, byte(4) + byte(5) * 256)
        height = F.when(tag == COARSE_SIZE, byte(3) * 8).when(tag == EXACT_SIZE, byte(6) + byte(7) * 256)
        said = lambda c, name: F.when(problem.isNull() & c.isNotNull(), c).otherwise(s[name])
        following = state(
            s["at"] + F.coalesce(size, F.lit(0)), F.array_append(s["tags"], tag), said(width, "width"), said(height, "height"),
            said(F.when(tag == CODEC, byte(2)), "codec_id"), said(F.when((tag == CODEC) & (byte(3) > 0), byte(3)), "frame_rate"), problem)
        return F.when(s["problem"].isNotNull() | (s["at"] >= F.size(bytes_)), s).otherwise(following)

    begin = state(F.lit(0), F.array().cast("array<int>"), none, none, none, none, F.lit(None).cast("string"))
    walked = F.get(F.transform(F.array(octets), lambda b: F.aggregate(F.sequence(F.lit(0), F.ceil(F.size(b) / 4).cast("int")), begin, lambda s, _: step(b, s))), 0)
    return walked.dropFields("at")


def describe_frames(frames: DataFrame, chunks: DataFrame | FileImages, window: int) -> DataFrame:
    """Frames as ``tagged_frames`` finds them with ``rejected``, their payload's place, what the extra header says, ``problems`` and ``state``.

    Rejected are frames without a usable length, that end behind the image, or that have no room for their own headers. All others are
    described: PASS, or REVIEW with problems. A size of zero is no size. A codec's number that isn't known is kept as unrecognised-codec-id-0x<hex>.
    """
    images = as_images(chunks, window)
    rows = _bytes_at(images, frames, F.col("offset") + HEADER, F.col("extra_length"), "__extra")
    begin = F.lit(HEADER) + F.col("extra_length")
    rows = judge(rows, [("no length", F.col("length") > 0), ("past end", F.col("offset") + F.col("length") <= F.col("owned_len")), ("no room", begin + TRAILER <= F.col("length"))])
    good = F.col("rejected").isNull()
    rows = rows.withColumn("__read", F.when(good & (F.col("extra_length") > 0), F.col("__extra"))).withColumn("__said", extra_header(F.col("__read")))
    said = F.col("__said")
    flat = (said["width"] == 0) | (said["height"] == 0)
    codecs = F.create_map(*[F.lit(x) for pair in CODECS.items() for x in pair])
    codec = F.coalesce(F.try_element_at(codecs, said["codec_id"]), F.concat(F.lit("unrecognised-codec-id-0x"), F.lpad(F.hex(said["codec_id"]), 2, "0")))
    payload = F.col("length") - begin - TRAILER
    info = F.col("kind") == FRAME_KINDS[0xF1]
    problems = {
        "no payload": (payload == 0) & ~info, "unknown type": F.col("kind").startswith("unrecognised"), "extra header unreadable": (F.col("extra_length") > 0) & (F.octet_length("__read") == F.col("extra_length")).isNull(),
        "unknown tag": said["problem"] == "unknown tag", "cut record": said["problem"] == "cut record", "no size": flat, "no trailer": ~F.col("trailer_ok"),
        "back length": F.coalesce(F.col("back_length") != F.col("length"), F.lit(True)), "no time": packed_clock(F.col("packed_time"))["time"].isNull(),
    }
    own = lambda c: F.when(good, c)
    rows = rows.withColumns({
        "payload_offset": own(F.col("offset") + begin), "payload_length": own(payload), "tags": own(F.transform(said["tags"], lambda t: F.lpad(F.hex(t), 2, "0"))),
        "width": own(F.when(~F.coalesce(flat, F.lit(False)), said["width"])), "height": own(F.when(~F.coalesce(flat, F.lit(False)), said["height"])), "codec": own(codec), "frame_rate": own(said["frame_rate"]),
        "time": packed_clock(F.col("packed_time"))["time"], "problems": own(_named(problems)),
    })
    return rows.withColumn("state", own(F.when(F.col("problems").isNull(), "PASS").otherwise("REVIEW"))).drop("__extra", "__read", "__said")


def carve_described(chunks: DataFrame | FileImages, window: int, most: int, **layout) -> DataFrame:
    """All frames of images described; a frame that isn't rejected hides what lies inside of it, and behind ``most`` frames of an image the rest is "over the cap".

    A frame whose trailer or back-length is wrong stays, for review. ``layout`` goes to ``tagged_frames``.
    """
    found = describe_frames(tagged_frames(chunks, window, **layout), chunks, window)
    return carve_frames(found.drop("rejected"), most, [("no length", F.col("length") > 0), ("past end", F.col("offset") + F.col("length") <= F.col("owned_len")), ("no room", F.col("extra_length") + HEADER + TRAILER <= F.col("length"))])
