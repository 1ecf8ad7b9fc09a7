"""Byte decoders: fields and entries out of image bytes, in the form that the rules in ``records`` judge.

Tables of fixed entries are decoded by column expressions over a layout (see ``layouts``), which a row's profile may move; what is
found by a tag is searched in the chunks (see ``detect``) and its bytes are then read by region, so windows may cut anything
anywhere. Small layouts are dicts of name: (place, bytes); numbers are little-endian. Missing bytes give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as B
from ..functions.times import packed_clock, unix_clock
from ..sources.images import FileImages, TableImages, as_images
from . import detect, records
from .layouts import BLOCK_ENTRY, CLIP_SLOT, DIRECTORY_ENTRY, FRAME_ARRAY, FRAME_REFERENCE, LEAF_ENTRY, explode_entries, read_head, unsigned

#: The layouts of a boot record's slots and of a tagged frame.
BOOT_SLOT = {"type": (4, 1), "start_lba": (8, 4), "sectors": (12, 4)}
TAGGED_FRAME = {"type": (4, 1), "subtype": (5, 1), "raw_channel": (6, 2), "frame_number": (8, 4), "length": (12, 4), "packed_time": (16, 4), "sub_time": (20, 2), "extra_length": (22, 1), "checksum": (23, 1)}
#: Fixed value: the bytes of a tagged frame's header.
HEADER = 24
#: Kinds of a tagged frame by its type byte.
FRAME_KINDS = {0xFD: "video-key-frame", 0xFC: "video-delta-frame", 0xF0: "audio-frame", 0xF1: "info-frame"}


def unpack(data: Column, layout: dict[str, tuple[int, int]], base=0) -> dict[str, Column]:
    """The fields of a layout that begins at ``base``."""
    return {name: B.le_uint(data, base + at, size) for name, (at, size) in layout.items()}


def explode_table(rows: DataFrame, layout: dict[str, tuple[int, int]], size: int, count: Column, header: int = 0, most: int = 1 << 20) -> DataFrame:
    """``rows`` (with data) once for each entry of ``size`` bytes behind the header: entry, blank (all zero), truncated, and the fields.

    ``truncated``: the declared count is more than ``most`` or than the bytes have room for; what is there is read.
    """
    room = F.floor((F.octet_length("data") - header) / size)
    rows = rows.withColumns({"__count": count.cast("long"), "__room": F.least(room, F.lit(most).cast("long"))})
    rows = rows.withColumn("__n", F.least("__count", "__room")).where(F.col("__n") > 0)
    rows = rows.withColumns({"truncated": F.col("__count") > F.col("__room"), "entry": F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))})
    at = F.lit(header) + F.col("entry") * size
    blank = F.substring("data", (at + 1).cast("int"), F.lit(size)) == F.lit(bytes(size))
    return rows.withColumns({"blank": blank, **unpack(F.col("data"), layout, at)}).drop("__count", "__room", "__n", "data")


def probe_nonzero(data: Column) -> Column:
    """Whether any byte isn't zero."""
    return F.hex(data).rlike("[1-9A-F]")


def content_hash(data: Column, algorithm: str = "SHA-256") -> Column:
    """struct(algorithm, value): the digest of bytes, in lower-case hex."""
    value = F.md5(data) if algorithm == "MD5" else F.sha2(data, 256)
    return F.struct(F.lit(algorithm).alias("algorithm"), value.alias("value"))


def verify_hashes(stored: DataFrame, computed: DataFrame, id_col: str) -> DataFrame:
    """``stored`` (id_col, expected) against ``computed`` (id_col, actual), whatever the case: MATCH, MISMATCH, or UNKNOWN where one is missing."""
    rows = stored.join(computed.select(id_col, "actual"), id_col, "left")
    verdict = F.when(F.col("actual").isNull() | F.col("expected").isNull(), "UNKNOWN").when(F.lower("expected") == F.lower("actual"), "MATCH").otherwise("MISMATCH")
    return rows.withColumn("verdict", verdict)


def boot_entries(sectors: DataFrame) -> DataFrame:
    """(image_id, slot, type, start_lba, sectors, size_bytes) of boot records (image_id, size_bytes, data) that end in 55 AA."""
    marked = sectors.where((B.byte_at(F.col("data"), 510) == 0x55) & (B.byte_at(F.col("data"), 511) == 0xAA))
    return explode_table(marked, BOOT_SLOT, 16, F.lit(4), 446).select("image_id", F.col("entry").cast("int").alias("slot"), "type", "start_lba", "sectors", "size_bytes")


def block_entries(tables: DataFrame, block_bytes: int, first: int = 0, count: Column | None = None) -> DataFrame:
    """Entries of block tables (image_id, size_bytes, data, maybe layout) as blocks, each with its state, the problems, and its byte range.

    Empty: by its type. Malformed: a next below -1, a previous below -1, a first below 0, a last block without sectors or with more than a
    block, a place outside of the image or cut by its end. Else Occupied. A last block (next 0 or -1) has as many bytes as its sectors
    say, others are whole, empty ones have none; ranges are clipped to the image. Without ``count`` all whole entries are read.
    """
    rows = explode_entries(tables, BLOCK_ENTRY, F.floor(F.octet_length("data") / BLOCK_ENTRY.size) if count is None else count)
    empty, last = F.col("type").isin(0xFE, 0), F.col("next").isin(0, -1) | (F.col("next") < -1)
    declared, lo = F.col("sectors") * 512, F.lit(first) + F.col("entry") * block_bytes
    own = F.when(~last, F.lit(block_bytes)).when(F.col("sectors") > 0, F.least(declared, F.lit(block_bytes)))
    cut = F.when(own.isNotNull() & (lo < F.col("size_bytes")), F.least(lo + own, F.col("size_bytes")) - lo)
    problems = {"next": F.col("next") < -1, "previous": F.col("prev") < -1, "first": F.col("first") < 0, "no sectors": last & (F.col("sectors") <= 0), "too many sectors": last & (declared > block_bytes), "outside the image": lo >= F.col("size_bytes"), "cut by the image's end": cut < own}
    named = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in problems.items()])), ", ")
    flagged = F.col("channel_flag").bitwiseAND(F.lit(1)) == 1
    channel = F.when(flagged, F.col("extended_channel").bitwiseAND(F.lit(31))).otherwise(F.col("legacy_channel").bitwiseAND(F.lit(15)) + 1)
    rows = rows.withColumns({"channel": channel, "problems": F.when(~empty & (named != ""), named), "offset": F.when(~empty & (lo < F.col("size_bytes")), lo), "length": F.when(~empty, cut)})
    state = F.when(empty, "Empty").when(F.col("problems").isNotNull(), "Malformed").otherwise("Occupied")
    rows = rows.withColumns({"state": state, "start_time": packed_clock(F.col("start"))["time"], "end_time": packed_clock(F.col("end"))["time"], "next": F.greatest("next", F.lit(0).cast("long"))})
    return rows.drop("blank", "entry_at", "entry_size", "legacy_channel", "channel_flag", "extended_channel")


def footer_slots(footers: DataFrame, low: int = 946_684_800, high: int = 4_102_444_800, channels: int = 127) -> DataFrame:
    """Slots of block footers (block_id, data, maybe layout) for ``clip_slots``; a footer with a marker of 255, without slots or with more than it has room for has none.

    The start is the first of two places that holds a time. A channel above ``channels``, an end that is no time, are null; ``low`` and ``high`` bound
    what is a likely time.
    """
    rows = read_head(footers, CLIP_SLOT).where("head_marker is null or head_marker <> 255")
    rows = explode_entries(rows, CLIP_SLOT, F.col("head_count")).where(~F.col("truncated"))
    seconds = lambda name: F.when(unix_clock(F.col(name), low, high)["time"].isNotNull(), F.col(name))
    start = seconds("start")
    return rows.withColumns({"channel": F.when(F.col("raw_channel") <= channels, F.col("raw_channel") + 1), "from_fallback": start.isNull() & seconds("time_a").isNotNull(), "start": F.coalesce(start, seconds("time_a")), "end": seconds("end"), "frame_rate": F.when(F.col("frame_rate") != 0, F.col("frame_rate"))}).drop("head_marker", "head_count", "blank", "entry_at", "entry_size", "truncated", "time_a")


def leaf_entries(pages: DataFrame, channels: int = 127) -> DataFrame:
    """Entries of index pages (page_id, data; page_offset and layout if there) as blank, populated or malformed by their sentinel, with channel, times and place.

    The declared count is capped; entries that the page cuts off aren't read, which ``truncated`` tells. ``notes`` are what speaks against a
    populated entry: an unlikely channel, a place of zero or less, an end before the start, a page that isn't its own.
    """
    rows = explode_entries(read_head(pages, LEAF_ENTRY), LEAF_ENTRY, F.col("head_count"))
    state = F.when(F.coalesce(F.col("sentinel") == -1, F.lit(True)), "blank").when(F.col("sentinel") == 0, "populated").otherwise("malformed")
    incomplete = F.col("start") == 2**31 - 1
    notes = {"channel": F.col("raw_channel") > channels, "place": F.col("data_offset") <= 0, "not ended": incomplete, "end before start": ~incomplete & (F.col("start") > 0) & (F.col("end") > 0) & (F.col("end") < F.col("start"))}
    if "page_offset" in pages.columns:
        notes["other page"] = (F.col("page") != 0) & (F.col("page") != F.col("page_offset"))
    named = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in notes.items()])), ", ")
    there = F.col("state") == "populated"
    own = lambda c: F.when(there, c)
    rows = rows.withColumn("state", state).withColumns({"channel": own(F.when(F.col("raw_channel") <= channels, F.col("raw_channel") + 1)), "notes": own(F.when(named != "", named)), "data_offset": own(F.col("data_offset")), "start": own(F.when(F.col("start") > 0, F.col("start"))), "end": own(F.when(F.col("end") > 0, F.col("end"))), "status": own(F.col("status"))})
    return rows.select("page_id", "entry", "state", "data_offset", "channel", "start", "end", "status", "notes", "truncated")


def frame_references(indexes: DataFrame, tag: bytes = b"DHII") -> DataFrame:
    """Frame references of clip indexes (clip_id, clip_length, index_offset, data from there on, maybe layout) that carry the tag, for ``frame_index``.

    Two levels: the header's entries (array) name a kind, and where in the clip an array of references lies and its bytes. An array that doesn't
    begin inside the index has no references. An index shorter than its header is bounded by the clip. Columns: clip_id, array,
    kind, entry, offset, length, time, clip_length, index_offset, index_end, truncated (the array or the header's entries).
    """
    marked = read_head(indexes.where(F.substring("data", 1, len(tag)) == F.lit(tag)), FRAME_ARRAY)
    end = F.col("index_offset") + F.when(F.col("head_index_length") < FRAME_ARRAY.header, F.col("clip_length")).otherwise(F.col("head_index_length"))
    rows = marked.withColumns({"index_end": end.cast("long"), "__data": F.col("data"), **({"__layout": F.col("layout")} if "layout" in indexes.columns else {})})
    arrays = explode_entries(rows, FRAME_ARRAY, F.col("head_count")).withColumnsRenamed({"entry": "array", "truncated": "__cut", "__data": "data", "__layout": "layout"})
    inside = (F.col("first") >= F.col("index_offset")) & (F.col("first") < F.least("index_end", "clip_length"))
    arrays = arrays.where(inside).drop("entry_at", "entry_size", "blank")
    size = F.lit(FRAME_REFERENCE.size) if "layout" not in arrays.columns else F.coalesce(F.try_element_at("layout", F.lit("frame_reference.size")).try_cast("int"), F.lit(FRAME_REFERENCE.size))
    found = explode_entries(arrays, FRAME_REFERENCE, F.floor(F.col("bytes") / size), F.col("first") - F.col("index_offset"))
    return found.select("clip_id", "array", "kind", "entry", "offset", "length", packed_clock(F.col("packed_time"))["time"].alias("time"), "clip_length", "index_offset", "index_end", (F.col("truncated") | F.col("__cut")).alias("truncated"))


def directory(images: DataFrame, tag: bytes = b"DIDX") -> DataFrame:
    """Entries of flat directories (image_id, size_bytes, data, maybe layout) that carry the tag, for ``directory_entries``; places are unsigned, times of zero are none."""
    marked = read_head(images.where(F.substring("data", 1, len(tag)) == F.lit(tag)), DIRECTORY_ENTRY)
    rows = explode_entries(marked, DIRECTORY_ENTRY, F.col("head_count"))
    return rows.select("image_id", "entry", (F.col("raw_channel") + 1).alias("channel"), "frame_type", unsigned(F.col("offset")).alias("offset"), unsigned(F.col("length")).alias("length"), F.when(F.col("time") > 0, F.col("time")).alias("start"), "crc", "size_bytes", "truncated")


def image_sizes(chunks: DataFrame) -> DataFrame:
    """(image_id, size_bytes)."""
    return chunks.groupBy("image_id").agg(F.max(F.col("base_offset") + F.col("owned_len")).alias("size_bytes"))


def _bytes_at(images: FileImages | TableImages, places: DataFrame, at: Column, length: Column, name: str) -> DataFrame:
    """``places`` (image_id, offset, ...) with the bytes at ``at`` as a column."""
    wanted = places.select("image_id", F.col("offset").alias("region_id"), at.cast("long").alias("offset"), length.cast("long").alias("length"))
    if isinstance(images, FileImages):  # the rows go to the bytes, so nothing has to be joined again
        rest = [c for c in places.columns if c not in ("image_id", "offset")]
        wanted = places.select("image_id", F.col("offset").alias("region_id"), at.cast("long").alias("offset"), length.cast("long").alias("length"), *[F.col(c).alias(f"__{c}") for c in rest])
        return images.read(wanted).select("image_id", F.col("region_id").alias("offset"), *[F.col(f"__{c}").alias(c) for c in rest], F.col("data").alias(name))
    got = images.read(wanted).select("image_id", F.col("region_id").alias("offset"), F.col("data").alias(name))
    return places.join(got, ["image_id", "offset"], "left")


def tagged_frames(chunks: DataFrame | FileImages, window: int, tag: bytes = b"DHAV", trailer: bytes = b"dhav", header: int = HEADER, least: int = 32, longest: int = 64 << 20, hits: DataFrame | None = None) -> DataFrame:
    """Frames at each hit of the tag, for ``carve_frames``: the header's fields, and whether trailer and back-length agree.

    A declared length out of bounds counts as none. The trailer states how many bytes are ahead of it; ``back_length`` is the frame's length by that. With ``hits`` (image_id, offset, ...) only those are decoded;
    their other columns stay, and ``head`` among them are the bytes of the header, short where one can't be read or the image ends.
    """
    images = as_images(chunks, window)
    if hits is None:
        rows = detect.find_in_images(images, tag, follow=(0, header)).withColumnRenamed("bytes", "head")
    else:
        rows = hits if "head" in hits.columns else _bytes_at(images, hits, F.col("offset"), F.lit(header), "head")
    rows = rows.join(images.sizes().withColumnRenamed("size_bytes", "owned_len"), "image_id")
    if hits is not None:  # a header of which a byte can't be read says nothing
        rows = rows.withColumn("head", F.when(F.octet_length("head") >= F.least(F.lit(header), F.col("owned_len") - F.col("offset")), F.col("head")))
    declared = unpack(F.col("head"), TAGGED_FRAME)["length"]
    rows = rows.withColumn("length", declared).withColumn("length", F.when(F.col("length").between(least, longest), F.col("length")).otherwise(0))
    n = len(trailer)
    rows = _bytes_at(images, rows, F.col("offset") + F.col("length") - n - 4, F.when(F.col("length") > 0, n + 4).otherwise(0), "tail")
    # the other fields behind the read, so that only those that are asked for are made
    rows = rows.withColumns({name: value for name, value in unpack(F.col("head"), TAGGED_FRAME).items() if name != "length"}).drop("head")
    kinds = F.create_map(*[F.lit(x) for pair in FRAME_KINDS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, F.col("type").cast("int")), F.concat(F.lit("unrecognised-type-0x"), F.lpad(F.hex("type"), 2, "0")))
    return rows.withColumns({"kind": kind, "trailer_ok": F.coalesce(F.substring("tail", 1, n) == F.lit(trailer), F.lit(False)), "back_length": B.le_uint(F.col("tail"), n, 4) + n + 4}).drop("tail")


def start_codes(chunks: DataFrame | FileImages, window: int, images: DataFrame | None = None) -> DataFrame:
    """(image_id, pos, unit, h264, h265, boundary) of the start codes 00 00 01, for ``carve_runs``; a boundary is a first parameter set.

    With ``images`` (image_id) only theirs are searched.
    """
    searched = as_images(chunks, window)
    if images is not None:
        searched = searched.only(images)
    hits = detect.find_in_images(searched, b"\0\0\1", follow=(3, 1))
    rows = hits.select("image_id", F.col("offset").alias("pos"), B.byte_at(F.col("bytes"), 0).alias("unit")).where("unit is not null")
    avc, hevc = detect.unit_points(F.col("unit"))
    boundary = (F.col("unit") < 128) & ((F.col("unit").bitwiseAND(F.lit(31)) == 7) | (F.shiftright("unit", 1).bitwiseAND(F.lit(63)) == 32))
    return rows.withColumns({"h264": avc, "h265": hevc, "boundary": boundary})


def carve_streams(chunks: DataFrame | FileImages, window: int, max_gap: int = 256 << 10, least: int = 2, images: DataFrame | None = None) -> DataFrame:
    """Runs of start codes in image bytes, of all images or of ``images``."""
    return records.carve_runs(start_codes(chunks, window, images).drop("unit"), max_gap, least)


def stream_records(chunks: DataFrame | FileImages, window: int, needle: bytes = b"TPREC\1\0", size: int = 64) -> DataFrame:
    """Records of ``size`` bytes that begin with the needle: channel, time as it stands, codec, frames, description.

    Records cut off by the image's end are left out; an empty text field is null, nothing is made up for it.
    """
    rows = detect.find_in_images(as_images(chunks, window), needle, follow=(0, size)).withColumnRenamed("bytes", "record").where(F.octet_length("record") == size)
    d = F.col("record")

    def text(at, length):
        bare = F.trim(F.replace(F.try_validate_utf8(F.substring(d, at + 1, length).cast("string")), F.lit("\0"), F.lit("")))
        return F.when(bare != "", bare)

    time = (B.le_uint(d, 12, 4).cast("decimal(20,0)") * F.lit(1 << 32) + B.le_uint(d, 8, 4)).cast("decimal(20,0)")
    return rows.select("image_id", "offset", B.byte_at(d, 7).alias("channel"), time.alias("time"), text(16, 16).alias("codec"), B.le_uint(d, 40, 4).alias("frames"), text(48, 16).alias("description"))


def read_pointers(hits: DataFrame, chunks: DataFrame | FileImages, magic: bytes, window: int, width: int = 6) -> DataFrame:
    """Hits (image_id, hit_id, offset, weight) whose place holds a pointer, checked for the magic where it points to, as ``follow_pointers`` does."""
    images = as_images(chunks, window)
    rows = _bytes_at(images, hits, F.col("offset"), F.lit(width), "field")
    rows = rows.withColumn("pointer", B.le_uint(F.col("field"), 0, width)).drop("field", "offset").join(images.sizes(), "image_id")
    targets = rows.select("image_id", F.col("pointer").alias("offset")).where("offset is not null").distinct()
    found = _bytes_at(images, targets, F.col("offset"), F.lit(len(magic)), "there")
    return records.follow_pointers(rows, found.select("image_id", "offset", (F.col("there") == F.lit(magic)).alias("magic_ok")))
