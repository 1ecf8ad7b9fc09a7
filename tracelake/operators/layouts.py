"""Layouts as data: where a structure's fields stand, with defaults and with what a row's own profile says instead.

A layout names its header's size, the size, number and cap of its entries, and each field's place, width and sign. Rows may
bring a ``layout`` map (text to text, as rule profiles have it): ``<layout>.<field>`` is ``place`` or ``place:width`` or
``place:width:signed``, ``<layout>.header``, ``.size`` and ``.most`` are numbers. Places become columns, once for each row before its
entries are made, so one plan decodes the images of all vendors. Numbers are little-endian; missing bytes give nulls.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as B

Place = tuple[int, int] | tuple[int, int, str]


@dataclass(frozen=True)
class Layout:
    """A structure: ``head`` are fields of the header, ``fields`` those of each entry, all as (place, bytes) or (place, bytes, "signed")."""

    name: str
    header: int
    size: int
    most: int
    head: dict[str, Place] = field(default_factory=dict)
    fields: dict[str, Place] = field(default_factory=dict)


#: A block table, a footer's clip slots, an index page's entries, a clip's frame index and its arrays, a flat directory.
BLOCK_ENTRY = Layout(
    "block_entry", 0, 32, 1 << 20, {},
    {"type": (0, 1), "legacy_channel": (1, 1), "start": (4, 4), "end": (8, 4), "next": (12, 4, "signed"), "sectors": (16, 2, "signed"), "prev": (20, 4, "signed"), "first": (24, 4, "signed"), "channel_flag": (29, 1), "extended_channel": (31, 1)},
)
CLIP_SLOT = Layout(
    "clip_slot", 512, 512, 2047, {"marker": (13, 1), "count": (20, 2)},
    {"raw_channel": (13, 1), "time_a": (40, 4), "end": (48, 4), "start": (56, 4), "first": (72, 4), "last": (76, 4), "frame_rate": (88, 1)},
)
LEAF_ENTRY = Layout(
    "leaf_entry", 96, 48, 83, {"count": (16, 4, "signed")},
    {"page": (0, 8, "signed"), "sentinel": (8, 8, "signed"), "raw_channel": (17, 1), "start": (24, 4, "signed"), "end": (28, 4, "signed"), "data_offset": (32, 8, "signed"), "status": (40, 4, "signed")},
)
FRAME_ARRAY = Layout("frame_array", 12, 12, 4096, {"index_length": (4, 4), "count": (8, 4, "signed")}, {"kind": (0, 4), "first": (4, 4), "bytes": (8, 4)})
FRAME_REFERENCE = Layout("frame_reference", 0, 12, 1 << 20, {}, {"offset": (0, 4), "length": (4, 4, "signed"), "packed_time": (8, 4)})
DIRECTORY_ENTRY = Layout(
    "directory_entry", 16, 32, 1 << 20, {"count": (4, 4)},
    {"raw_channel": (0, 1), "frame_type": (1, 1), "offset": (4, 8, "signed"), "length": (12, 8, "signed"), "time": (20, 8, "signed"), "crc": (28, 4)},
)


def backwards(data: Column) -> Column:
    """The bytes in hex from the last digit to the first, so that a little-endian number is one stretch of it, with the halves of each byte exchanged."""
    return F.reverse(F.hex(data))


def number(back: Column, at: Column, width: Column, signed: Column) -> Column:
    """The number of ``width`` bytes at a place of bytes that are given ``backwards``; of eight bytes as a two's complement long, whatever ``signed`` says. Null where a byte is missing."""
    begin = F.char_length(back) - 2 * (at + width)
    value = B.halves_exchanged(F.conv(F.when((at >= 0) & (begin >= 0), F.substring(back, begin + 1, 2 * width)), 16, -10).cast("long"))
    free = F.when(signed & (width < 8), 64 - 8 * width).otherwise(0)
    return F.call_function("shiftright", F.call_function("shiftleft", value, free), free)


#: The first number that 64 bits don't hold.
BEYOND = str(1 << 64)


def unsigned(value: Column) -> Column:
    """A long that was read from eight bytes as the unsigned number they stand for, decimal(20,0)."""
    exact = value.cast("decimal(20,0)")
    return F.when(value < 0, (exact + F.lit(BEYOND).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(exact)


def _static(places: dict[str, Place], data: Column, begin: Column) -> dict[str, Column]:
    """The fields at their own places, each out of its own few bytes, as filters on them may make them again."""
    found = {}
    for name, (at, width, *sign) in places.items():
        first = begin + at
        value = B.le_long(F.when(first + width <= F.octet_length(data), F.substring(data, first.cast("int") + 1, F.lit(width))))
        free = 64 - 8 * width if sign else 0
        found[name] = F.shiftright(F.shiftleft(value, free), free) if free else value
    return found


def _said(layout: Layout, key: str) -> Column:
    return F.try_element_at(F.col("layout"), F.lit(f"{layout.name}.{key}"))


def _moved(places: dict[str, Place], back: Column, spots: Column) -> dict[str, Column]:
    """The fields at the places that the struct ``spots`` holds."""
    return {name: number(back, spots[name]["at"], spots[name]["width"], spots[name]["signed"]) for name in places}


def _spots(layout: Layout, places: dict[str, Place]) -> Column:
    """struct of struct(at, width, signed): each field's own or what the row's profile says."""
    out = []
    for name, (at, width, *sign) in places.items():
        parts = F.split(_said(layout, name), ":")
        part = lambda k, parts=parts: F.try_element_at(parts, F.lit(k))
        own = F.struct(
            F.coalesce(part(1).try_cast("int"), F.lit(at)).alias("at"), F.coalesce(part(2).try_cast("int"), F.lit(width)).alias("width"),
            F.when(F.size(parts) > 1, F.coalesce(part(3) == "signed", F.lit(False))).otherwise(F.lit(bool(sign))).alias("signed"))
        out.append(own.alias(name))
    return F.struct(*out)


def _sizes(rows: DataFrame, layout: Layout) -> tuple[Column, Column, Column]:
    """Header, entry size and cap."""
    own = (layout.header, layout.size, layout.most)
    if "layout" not in rows.columns:
        return tuple(F.lit(x).cast("long") for x in own)
    return tuple(F.coalesce(_said(layout, key).try_cast("long"), F.lit(x).cast("long")) for key, x in zip(("header", "size", "most"), own, strict=True))


def read_head(rows: DataFrame, layout: Layout) -> DataFrame:
    """``rows`` with the header's fields of their ``data``, each as head_<field>."""
    if "layout" in rows.columns:
        head = F.substring("data", F.lit(1), _sizes(rows, layout)[0].cast("int"))
        rows = rows.withColumns({"__back": backwards(head), "__spots": _spots(layout, layout.head)})
        found = _moved(layout.head, F.col("__back"), F.col("__spots"))
    else:
        found = _static(layout.head, F.col("data"), F.lit(0))
    return rows.withColumns({f"head_{n}": c for n, c in found.items()}).drop("__back", "__spots")


def explode_entries(rows: DataFrame, layout: Layout, count: Column, begin: Column | None = None) -> DataFrame:
    """``rows`` once for each entry of their ``data``: entry, entry_at, entry_size, truncated, blank (all zero), and the entry's fields.

    Entries stand behind the header, or from ``begin`` on. ``truncated``: the count is above the cap or above what the bytes have room for; what
    is there is read. The columns data and layout go.
    """
    header, size, most = _sizes(rows, layout)
    rows = rows.where(F.col("data").isNotNull() & count.isNotNull())
    rows = rows.withColumns({"__begin": header if begin is None else begin.cast("long"), "entry_size": size, "__count": count.cast("long")})
    room = F.floor((F.octet_length("data") - F.col("__begin")) / F.col("entry_size"))
    rows = rows.withColumn("__room", F.greatest(F.least(room, most), F.lit(0).cast("long")))
    by_profile = "layout" in rows.columns
    if by_profile:
        rows = rows.withColumn("__spots", _spots(layout, layout.fields))
    rows = rows.withColumn("__n", F.least("__count", "__room")).where(F.col("__n") > 0)
    rows = rows.withColumns({"truncated": F.col("__count") > F.col("__room"), "entry": F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))})
    rows = rows.withColumn("entry_at", F.col("__begin") + F.col("entry") * F.col("entry_size"))
    own = F.substring("data", F.col("entry_at").cast("int") + 1, F.col("entry_size").cast("int"))
    if by_profile:
        rows = rows.withColumn("__back", backwards(own))
        found = _moved(layout.fields, F.col("__back"), F.col("__spots"))
    else:
        found = _static(layout.fields, F.col("data"), F.col("entry_at"))
    return rows.withColumns({"blank": ~F.hex(own).rlike("[1-9A-F]"), **found}).drop("data", "layout", "__begin", "__count", "__room", "__n", "__spots", "__back")
