"""Unit indexes out of image bytes: the header's count, entries whose fields cross bytes, and what is left behind the declared ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.images import FileImages, as_images
from .layouts import Layout, explode_entries, read_head
from .records import packed_date_of


@dataclass(frozen=True)
class Units:
    """Where units stand. Units of a generation begin at its base, ``stride`` bytes apart, with their index first; data blocks count from the unit's base."""

    bases: tuple[tuple[str, int], ...]
    stride: int
    index_bytes: int
    block: int
    #: A count above this one is abnormal.
    most: int


#: Units of both generations; an index's entries, of which record 0 is the header.
UNITS = Units((("old", 81920), ("new", 268517376)), 268435456, 262144, 16384, 16384)
UNIT_ENTRY = Layout("unit_entry", 16, 16, 1 << 20, {"write_bytes": (0, 4, "signed"), "count": (4, 4)}, {"date": (0, 5), "bits": (5, 3)})
#: Bits of the first field behind the date, the pointer takes the rest; years that are likely.
FIELD_BITS, YEARS = 10, (2000, 2100)


def unit_places(images: DataFrame, units: Units = UNITS) -> DataFrame:
    """(image_id, unit, base, size_bytes) of each unit, from 1 on, whose index begins inside the image (image_id, generation, size_bytes); an unknown generation has none."""
    bases = F.create_map(*[F.lit(x) for name, at in units.bases for x in (name, at)])
    rows = images.withColumn("__first", F.try_element_at(bases, F.col("generation")).cast("long")).where(F.col("__first") < F.col("size_bytes"))
    unit = F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("size_bytes") - 1 - F.col("__first")) / units.stride) + 1))
    rows = rows.withColumn("unit", unit).withColumn("base", F.col("__first") + (F.col("unit") - 1) * units.stride)
    return rows.drop("__first", "generation")


def read_units(chunks: DataFrame | FileImages, places: DataFrame, window: int, units: Units = UNITS) -> DataFrame:
    """Units of ``unit_places`` with the bytes of their index as ``data``: short at the image's end, null where a byte can't be read."""
    names = places.columns
    wanted = places.select(*names, F.col("unit").alias("region_id"), F.col("base").alias("offset"), F.lit(units.index_bytes).cast("long").alias("length"))
    return as_images(chunks, window).read(wanted).select(*names, "data")


def unit_headers(indexes: DataFrame, units: Units = UNITS, counts_header: bool = True) -> DataFrame:
    """``indexes`` (image_id, unit, base, size_bytes, data, maybe layout) with write_bytes, declared, n_entries, n_readable and header_state.

    Absent: no bytes; truncated: the header or the declared entries are cut off; empty: a header of zeros; abnormal: a count above ``units.most``; valid. With
    ``counts_header`` the count includes the header, as on disks, else not, as in exports.
    """
    rows = read_head(indexes, UNIT_ENTRY).withColumnsRenamed({"head_write_bytes": "write_bytes", "head_count": "declared"})
    n = F.col("declared") - 1 if counts_header else F.col("declared")
    size = F.coalesce(F.octet_length("data"), F.lit(0))
    room = lambda c: F.greatest(F.floor((c - UNIT_ENTRY.header) / UNIT_ENTRY.size), F.lit(0))
    # what an index has room for bounds what a count may declare
    wanted = F.least(F.greatest(n, F.lit(0)), room(F.lit(units.index_bytes)))
    state = F.when(size == 0, "absent").when(size < UNIT_ENTRY.header, "truncated").when(~F.hex(F.substring("data", 1, UNIT_ENTRY.header)).rlike("[1-9A-F]"), "empty").when(F.col("declared") > units.most, "abnormal").when(room(size) < wanted, "truncated").otherwise("valid")
    return rows.withColumns({"n_entries": F.greatest(n, F.lit(0)), "n_readable": room(size), "header_state": state})


def pointer_class(pointer: Column, base: Column, size_bytes: Column, units: Units = UNITS) -> Column:
    """Where a pointer leads: into the index, outside of the image (also by its block's end), or to data."""
    inside = -(-units.index_bytes // units.block)
    return F.when(pointer < inside, "index").when(base + pointer * units.block + units.block > size_bytes, "outside").when(pointer.isNotNull(), "data")


def unit_index(indexes: DataFrame, units: Units = UNITS, counts_header: bool = True) -> DataFrame:
    """Entries of unit indexes, numbered from 1: time and time_state, field_a, pointer, pointer_class, data_offset, standing, usable.

    Declared are the entries that the header counts; where the count is abnormal, all that aren't blank. Behind the declared ones of a valid header, slots
    with a valid time and a pointer to data are residual: leftovers for examination, never recordings. Empty and absent indexes have none.
    """
    rows = unit_headers(indexes, units, counts_header).where("header_state not in ('absent', 'empty')")
    rows = explode_entries(rows, UNIT_ENTRY, F.col("n_readable")).drop("truncated", "entry_size")
    date = packed_date_of(F.col("date"), *YEARS)
    rows = rows.withColumns({
        "entry": F.col("entry") + 1, "entry_offset": F.col("base") + F.col("entry_at"), "time": date["time"], "time_state": date["state"],
        "field_a": F.col("bits").bitwiseAND(F.lit((1 << FIELD_BITS) - 1)), "pointer": F.shiftright("bits", FIELD_BITS),
    })
    rows = rows.withColumns({"data_offset": F.col("base") + F.col("pointer") * units.block, "pointer_class": pointer_class(F.col("pointer"), F.col("base"), F.col("size_bytes"), units)})
    abnormal = F.col("header_state") == "abnormal"
    residual = (F.col("header_state") == "valid") & ~F.col("blank") & (F.col("time_state") == "Valid") & (F.col("pointer_class") == "data")
    standing = F.when(abnormal, F.when(~F.col("blank"), "declared")).when(F.col("entry") <= F.col("n_entries"), "declared").when(residual, "residual")
    usable = F.col("time_state").isin("Valid", "Implausible") & (F.col("pointer_class") == "data")
    return rows.withColumns({"standing": standing, "usable": usable}).where("standing is not null").drop("bits", "date", "entry_at")
