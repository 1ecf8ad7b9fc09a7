"""Fixed-layout fields of BINARY columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, at) -> Column:
    """The byte at a place counted from 0 as an int; null beyond the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    one = F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1)))
    return F.when((at >= 0) & (at < F.octet_length(data)), F.conv(one, 16, 10).cast("int"))


def halves_exchanged(value: Column) -> Column:
    """A long with the two hex digits of each byte exchanged, as they are in hex that is read backwards."""
    low = F.lit(0x0F0F0F0F0F0F0F0F)
    return F.shiftleft(value.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(value, 4).bitwiseAND(low))


def le_long(data: Column) -> Column:
    """All bytes, eight at most, as a little-endian number; of eight as a two's complement long. Null without bytes."""
    return halves_exchanged(F.conv(F.reverse(F.hex(data)), 16, -10).cast("long"))


def le_uint(data: Column, at, size: int) -> Column:
    """A little-endian unsigned number of up to 7 bytes as a long; null if it doesn't fit."""
    at = at if isinstance(at, Column) else F.lit(at)
    there = F.when((at >= 0) & (at + size <= F.octet_length(data)), F.substring(data, (at + 1).cast("int"), F.lit(size)))
    return le_long(there)


def le_int(data: Column, at, size: int) -> Column:
    """A little-endian two's complement number of up to 7 bytes."""
    value = le_uint(data, at, size)
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)


def le_bytes(value: Column, size: int) -> Column:
    """A number as ``size`` little-endian bytes, two's complement."""
    digits = F.reverse(F.lpad(F.hex(halves_exchanged(value.cast("long"))), 16, "0"))
    return F.unhex(F.substring(digits, 1, 2 * size))


def channel_zero_based(value: Column) -> Column:
    """The low byte plus 1."""
    return value.bitwiseAND(F.lit(255)) + 1


def channel_flagged(value: Column, flag: Column) -> Column:
    """The whole low byte where the flag is set, else its low half."""
    return F.when(flag, value.bitwiseAND(F.lit(255))).otherwise(value.bitwiseAND(F.lit(15)))


def channel_bounded(value: Column, most: int, add: int) -> Column:
    """The value plus ``add``, null above ``most``."""
    return F.when(value.between(0, most), value + add)


def fragment_id(tag: str, image: Column, offset: Column, length: Column) -> Column:
    """frag- and the first 12 bytes of SHA-256 over the tag, the image's id and both numbers as 8 little-endian bytes, in hex."""
    data = F.concat(F.lit(tag).cast("binary"), image.cast("string").cast("binary"), le_bytes(offset, 8), le_bytes(length, 8))
    return F.concat(F.lit("frag-"), F.substring(F.sha2(data, 256), 1, 24))


def validation(state: Column, reason: Column, operation: str, subject: Column) -> Column:
    """A validation struct; null where the state isn't one of the four or the reason is blank."""
    good = state.isin("PASS", "REVIEW", "FAIL", "UNKNOWN") & (F.trim(reason) != "")
    return F.when(good, F.struct(state.alias("state"), reason.alias("reason"), F.lit(operation).alias("operation"), subject.alias("subject")))


def source_safety(mode: Column) -> Column:
    """accept read-only sources, reject writable ones, accept unknown ones with a warning."""
    return F.when(mode == "ReadOnly", "accept").when(mode == "ReadWrite", "reject").otherwise("accept with warning")


#: Other words for evidence states.
STATES = {"validated": "VALIDATED", "confirmed": "VALIDATED", "provisional": "PROVISIONAL", "indicative": "PROVISIONAL", "unvalidated": "UNVALIDATED", "unknown": "UNKNOWN"}


def normal_state(word: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(word))), F.lit("UNKNOWN"))


def integrity_flags(*flags: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, each once, in the order given."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in flags])))


def record_confidence(*terms: tuple[str, float, Column]) -> Column:
    """struct(score, basis): the sum of the terms that hold, between 0 and 0.95, and their names."""
    total = F.lit(0.0)
    for _, points, condition in terms:
        total = total + F.when(condition, points).otherwise(0.0)
    return F.struct(F.greatest(F.least(total, F.lit(0.95)), F.lit(0.0)).alias("score"), F.concat_ws("; ", *[F.when(c, F.lit(n)) for n, _, c in terms]).alias("basis"))
