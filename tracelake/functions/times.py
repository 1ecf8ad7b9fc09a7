"""Time expressions: parsing, zones and packed recorder clocks. Unknown stays null; nothing becomes UTC by default."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours of the zone abbreviations that recorders write.
ABBREVIATIONS = {
    "utc": 0, "etc/utc": 0, "z": 0, "gmt": 0, "wet": 0, "ist": 5.5, "wib": 7, "jst": 9, "kst": 9, "aest": 10, "aedt": 11, "nzst": 12, "gst": 4, "cet": 1, "cest": 2,
    "eet": 2, "eest": 3, "msk": 3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "akst": -9, "hst": -10, "brt": -3,
}
_OFFSET = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"


def parse_time(text: Column) -> Column:
    """struct(instant, explicit_tz) of an RFC 3339 text or a naive one with T or a space; null fields if it is neither."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*" + _OFFSET)
    naive = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$")
    parsed = F.when(zoned | naive, F.try_to_timestamp(F.regexp_replace(text, "^(.{10}) ", "$1T")))
    return F.struct(parsed.alias("instant"), F.when(parsed.isNotNull(), zoned).alias("explicit_tz"))


def comparable(text: Column, zone: Column) -> Column:
    """The instant of a normalized time, null where the zone is unknown or the time can't be read."""
    return F.when(zone.isNotNull(), parse_time(text)["instant"])


def numeric_offset(zone: Column) -> Column:
    """Seconds of an offset such as +05:30, 0530, UTC+5 or Z; null for more than 14 hours, 60 minutes or any other text."""
    bare = F.trim(F.regexp_replace(F.trim(zone), "^(UTC|utc|GMT|gmt)", ""))
    sign = F.when(bare.startswith("-"), -1).otherwise(1)
    rest = F.trim(F.regexp_replace(bare, "^[+-]", ""))
    pair, four, two = r"^\s*(\d{1,8})\s*:\s*(\d{1,8})\s*$", r"^(\d{2})(\d{2})$", r"^(\d{1,2})$"
    hours = F.when(rest.rlike(pair), F.regexp_extract(rest, pair, 1)).when(rest.rlike(four), F.regexp_extract(rest, four, 1)).when(rest.rlike(two), rest).cast("int")
    minutes = F.when(rest.rlike(pair), F.regexp_extract(rest, pair, 2)).when(rest.rlike(four), F.regexp_extract(rest, four, 2)).when(rest.rlike(two), "0").cast("int")
    good = hours.between(0, 14) & minutes.between(0, 59)
    return F.when(bare.isin("", "Z", "z") & (F.trim(zone) != ""), 0).when(good, sign * (hours * 3600 + minutes * 60))


def resolve_zone(df: DataFrame, zone: str, local: str, name: str = "offset_seconds") -> DataFrame:
    """``df`` with the zone's offset at the local time (TIMESTAMP): IANA names in any case first, then abbreviations, then numbers.

    A time that occurs twice has the earlier offset; one that a change skips has the offset of an hour later. The names are
    the zone database's, some hundred rows.
    """
    names = df.sparkSession.createDataFrame(sorted((n.lower(), n) for n in available_timezones()), "__low string, __iana string")
    rows = df.join(F.broadcast(names), F.lower(F.replace(F.trim(zone), F.lit(" "), F.lit("_"))) == F.col("__low"), "left")

    def at(t: Column) -> Column:
        return F.unix_seconds(t) - F.unix_seconds(F.to_utc_timestamp(t, F.coalesce("__iana", F.lit("UTC"))))

    t = F.coalesce(F.col(local), F.lit("2026-01-15 12:00:00").cast("timestamp"))
    zone_or_utc = F.coalesce("__iana", F.lit("UTC"))
    skipped = F.from_utc_timestamp(F.to_utc_timestamp(t, zone_or_utc), zone_or_utc) != t
    iana = F.when(skipped, at(t + F.expr("interval 1 hour"))).otherwise(at(t))
    known = F.create_map(*[F.lit(x) for k, h in ABBREVIATIONS.items() for x in (k, int(h * 3600))])
    found = F.when(F.col("__iana").isNotNull(), iana).otherwise(F.coalesce(F.try_element_at(known, F.lower(F.trim(zone))), numeric_offset(F.col(zone))))
    return rows.withColumn(name, F.when(F.trim(zone) != "", found)).drop("__low", "__iana")


def packed_clock(value: Column) -> Column:
    """struct(time, reason) of a 32-bit clock: seconds 6 bits, minutes 6, hours 5, day 5, month 4, year 6 from 2000, low bits first."""
    def bits(shift, n):
        return F.shiftright(value, shift).bitwiseAND(F.lit((1 << n) - 1)).cast("int")

    time = F.try_make_timestamp(bits(26, 6) + 2000, bits(22, 4), bits(17, 5), bits(12, 5), bits(6, 6), bits(0, 6).cast("decimal(16,6)"))
    good = (bits(22, 4).between(1, 12)) & (bits(17, 5) >= 1) & (bits(12, 5) < 24) & (bits(6, 6) < 60) & (bits(0, 6) < 60)
    time = F.when(good, time)
    reason = F.when(value.isNull() | (value == 0), "absent").when(time.isNull(), "invalid calendar")
    return F.struct(F.when(value != 0, time).alias("time"), reason.alias("reason"))


def unix_clock(value: Column, low: int, high: int, incomplete: int = 2**31 - 1) -> Column:
    """struct(time, confidence, reason) of Unix seconds: a sentinel for a recording not ended, none for zero or less, low outside of [low, high]."""
    reason = F.when(value.isNull(), "absent").when(value == incomplete, "incomplete").when(value == 0, "zero").when(value < 0, "negative").when(~value.between(low, high), "implausible")
    sure = F.when(reason.isNull(), "High").when(reason == "implausible", "Low").otherwise("None")
    return F.struct(F.when(sure != "None", F.timestamp_seconds(value)).alias("time"), sure.alias("confidence"), reason.alias("reason"))


def start_and_span(primary: Column, secondary: Column, end: Column, limit_seconds: int = 7 * 86400) -> Column:
    """struct(start, from_secondary, span_ok): the first start that is there, and whether the end is at or up to a limit after it."""
    start = F.coalesce(primary, secondary)
    return F.struct(start.alias("start"), (primary.isNull() & secondary.isNotNull()).alias("from_secondary"), F.coalesce((end >= start) & (end - start <= limit_seconds), F.lit(False)).alias("span_ok"))
