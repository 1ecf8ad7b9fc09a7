"""Headers that stand at several places: the first one that carries its identifier is read, and each field says where its value is from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.images import FileImages, as_images
from .layouts import Layout, read_head


@dataclass(frozen=True)
class Rule:
    """What makes a stored value usable: between ``least`` and ``most``, and ``inside`` the image if it is a place.

    ``zero`` says what a stored zero means: "fallback" (the value ``fallback`` is taken, which has to be inside too), "absent" or "malformed". An
    ``optional`` field may be absent without being a problem; an ``anchor`` is one of those of which at least one has to be known.
    """

    zero: str
    fallback: int | None = None
    least: int = 1
    most: int = (1 << 63) - 1
    inside: bool = False
    optional: bool = False
    anchor: bool = False


@dataclass(frozen=True)
class Header:
    layout: Layout
    places: tuple[int, ...]
    identifier: bytes
    identifier_at: int
    rules: dict[str, Rule]


#: A volume's header of 512 bytes at two places, its identifier and fields. A block has to be longer than its footer of 1 MiB.
BOOT_HEADER = Header(
    Layout("boot_header", 512, 512, 1, {
        "video_start": (120, 8, "signed"), "block_size": (136, 8, "signed"), "blocks": (144, 4, "signed"), "tree_offset": (152, 8, "signed"),
        "tree_size": (160, 8, "signed"), "backup_tree_offset": (168, 8, "signed"), "backup_tree_size": (176, 8, "signed"),
    }),
    (512, 80044032), b"HIKVISION@HANGZHOU", 16,
    {
        "video_start": Rule("fallback", 80117760, inside=True, anchor=True), "block_size": Rule("fallback", 1 << 30, least=(1 << 20) + 1, most=64 << 30),
        "blocks": Rule("malformed", most=1 << 20), "tree_offset": Rule("absent", inside=True, anchor=True), "tree_size": Rule("absent"),
        "backup_tree_offset": Rule("absent", inside=True, optional=True, anchor=True), "backup_tree_size": Rule("absent", optional=True),
    },
)


def field_value(raw: Column, size_bytes: Column, rule: Rule) -> Column:
    """struct(raw, value, origin): declared, fallback, malformed or absent; without a value in the last two."""
    fits = lambda c: (c >= rule.least) & (c <= rule.most) & ((c < size_bytes) if rule.inside else F.lit(True))
    instead = F.lit(rule.fallback).cast("long")
    on_zero = F.when(fits(instead), "fallback").otherwise("malformed") if rule.zero == "fallback" else F.lit(rule.zero)
    origin = F.when(raw.isNull(), "absent").when(raw == 0, on_zero).when(fits(raw), "declared").otherwise("malformed")
    return F.struct(raw.alias("raw"), F.when(origin == "declared", raw).when(origin == "fallback", instead).alias("value"), origin.alias("origin"))


def decode_headers(chunks: DataFrame | FileImages, window: int, header: Header = BOOT_HEADER, layouts: DataFrame | None = None) -> DataFrame:
    """One row an image: recognition, state, header_offset, for each field ``x`` the columns x, x_raw and x_origin, and problems.

    The places are tried in their order and the first that carries the identifier is read; ``layouts`` (image_id, layout) may move fields, not places.
    recognised; malformed: no anchor is known; mismatch: no place carries the identifier; not found: no place can be read that far. State: PASS or REVIEW, by
    problems, of a recognised header, REVIEW of a malformed one, else UNKNOWN. A header cut off by the image's end is read as far as it goes.
    """
    images = as_images(chunks, window)
    at = F.posexplode(F.array(*[F.lit(p).cast("long") for p in header.places]))
    wanted = images.sizes().select("image_id", "size_bytes", at.alias("rank", "offset")).withColumns({"region_id": F.col("rank").cast("long"), "length": F.lit(header.layout.header).cast("long")})
    read = images.read(wanted.select("image_id", "region_id", "offset", "length", "size_bytes", "rank"))
    end = header.identifier_at + len(header.identifier)
    there = F.substring("data", header.identifier_at + 1, len(header.identifier)) == F.lit(header.identifier)
    tried = read.select("image_id", "size_bytes", "rank", F.struct("offset", "data").alias("found"), F.coalesce(F.octet_length("data") >= end, F.lit(False)).alias("readable"), F.coalesce(there, F.lit(False)).alias("there"))
    rows = tried.groupBy("image_id").agg(F.max("size_bytes").alias("size_bytes"), F.bool_or("readable").alias("__readable"), F.min_by("found", F.when(F.col("there"), F.col("rank"))).alias("found"), F.bool_or("there").alias("__there"))
    rows = rows.select("image_id", "size_bytes", "__readable", "__there", F.when(F.col("__there"), F.col("found.offset")).alias("header_offset"), F.when(F.col("__there"), F.col("found.data")).alias("data"))
    if layouts is not None:
        rows = rows.join(layouts.select("image_id", "layout"), "image_id", "left")
    rows = read_head(rows, header.layout)
    names = list(header.layout.head)
    rows = rows.withColumns({n: field_value(F.col(f"head_{n}"), F.col("size_bytes"), header.rules[n]) for n in names})
    bad = {n: (F.col(f"{n}.origin") != "declared") & ~((F.col(f"{n}.origin") == "absent") & F.lit(header.rules[n].optional)) for n in names}
    problems = F.array_join(F.array_compact(F.array(*[F.when(c, F.concat(F.lit(f"{n} "), F.col(f"{n}.origin"))) for n, c in bad.items()])), ", ")
    anchored = F.coalesce(*[F.col(f"{n}.value") for n in names if header.rules[n].anchor]).isNotNull()
    recognition = F.when(F.col("__there") & anchored, "recognised").when(F.col("__there"), "malformed").when(F.col("__readable"), "mismatch").otherwise("not found")
    rows = rows.withColumns({"recognition": recognition, "problems": F.when(F.col("__there") & (problems != ""), problems)})
    state = F.when(F.col("recognition") == "malformed", "REVIEW").when(F.col("recognition") != "recognised", "UNKNOWN").when(F.col("problems").isNull(), "PASS").otherwise("REVIEW")
    fields = [c for n in names for c in (F.col(f"{n}.value").alias(n), F.col(f"{n}.raw").alias(f"{n}_raw"), F.col(f"{n}.origin").alias(f"{n}_origin"))]
    return rows.select("image_id", "size_bytes", "header_offset", "recognition", state.alias("state"), "problems", *fields)
