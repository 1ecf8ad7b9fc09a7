"""Records out of fixed layouts: which slots are accepted, the first reason why others are not, and where values come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fields as B
from ..sources.images import FileImages, as_images
from .islands import fold_islands, number_islands
from .layouts import BEYOND


def packed_date(data: Column, at: int, first_year: int, last_year: int) -> Column:
    """struct(time, state) of a five-byte date: year 12 bits, month 4, day 5, hour 5, minute 6, second 6, low bits first.

    State: Truncated, Empty (all zero), Invalid (no such date), Implausible (year out of range) or Valid; Implausible ones are decoded too.
    """
    b = [B.byte_at(data, at + k) for k in range(5)]
    low = lambda x, n: x.bitwiseAND(F.lit(n))
    year, month, day = b[0] + low(b[1], 15) * 256, F.shiftright(b[1], 4), low(b[2], 31)
    hour, minute, second = low(b[3], 3) * 8 + F.shiftright(b[2], 5), F.shiftright(b[3], 2), low(b[4], 63)
    good = month.between(1, 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60) & (year >= 1)
    time = F.when(good, F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(16,6)")))
    state = F.when(b[4].isNull(), "Truncated").when(b[0] + b[1] + b[2] + b[3] + b[4] == 0, "Empty").when(time.isNull(), "Invalid").when(~year.between(first_year, last_year), "Implausible").otherwise("Valid")
    return F.struct(F.when(state.isin("Valid", "Implausible"), time).alias("time"), state.alias("state"))


def packed_date_of(value: Column, first_year: int, last_year: int) -> Column:
    """As ``packed_date``, of the date's five bytes as one little-endian number; null is Truncated."""
    bits = lambda at, n: F.shiftright(value, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    year, month, day, hour, minute, second = bits(0, 12), bits(12, 4), bits(16, 5), bits(21, 5), bits(26, 6), bits(32, 6)
    good = month.between(1, 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60) & (year >= 1)
    time = F.when(good, F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(16,6)")))
    state = F.when(value.isNull(), "Truncated").when(value == 0, "Empty").when(time.isNull(), "Invalid").when(~year.between(first_year, last_year), "Implausible").otherwise("Valid")
    return F.struct(F.when(state.isin("Valid", "Implausible"), time).alias("time"), state.alias("state"))


def judge(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``rows`` with the reason of the first rule that fails (a rule fails where its condition isn't true), null if all hold."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        reason = F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(reason)
    return rows.withColumn("rejected", reason)


def clip_slots(slots: DataFrame, block_bytes: int, longest: int = 7 * 86400) -> DataFrame:
    """Slots of a block's footer (channel, start, end, first, last as bytes in the block): accepted or the first reason against. A clip without a start is kept."""
    span = (F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") <= longest)
    return judge(slots, [("unknown channel", F.col("channel").isNotNull()), ("no end time", F.col("end").isNotNull()), ("span", F.col("start").isNull() | span), ("empty range", F.col("last") > F.col("first")), ("beyond block", F.col("last") <= block_bytes)])


def frame_index(entries: DataFrame) -> DataFrame:
    """Frame references of a clip (offset, length; clip_length, index_offset, index_end if the clip goes on behind its index): accepted or the first reason against."""
    end = F.col("offset") + F.col("length")
    behind = F.col("offset") >= F.col("index_end") if "index_end" in entries.columns else F.lit(False)
    return judge(entries, [("sentinel", F.col("offset") != 0xFFFFFFFF), ("no length", F.col("length") > 0), ("past clip", end <= F.col("clip_length")), ("overlaps index", (end <= F.col("index_offset")) | behind)])


def unit_entries(slots: DataFrame) -> DataFrame:
    """Slots of a unit (slot, declared, value) as declared or residual entries; blank ones go."""
    rows = slots.where("value is not null and value <> 0")
    return rows.withColumn("standing", F.when(F.col("slot") < F.col("declared"), "declared").otherwise("residual"))


def partition_entries(entries: DataFrame, sector: int = 512) -> DataFrame:
    """Boot-record entries (image_id, slot, type, start_lba, sectors, size_bytes): byte range, finding and severity.

    An out-of-bounds range is cut to the image; overflow goes to a finding instead of wrapping.
    """
    offset, length = F.try_multiply("start_lba", F.lit(sector)), F.try_multiply("sectors", F.lit(sector))
    end = F.try_add(offset, length)
    unused = F.col("type") == 0
    finding = F.when(unused & ((F.col("start_lba") != 0) | (F.col("sectors") != 0)), "unused with geometry").when(unused, None).when(F.col("sectors") == 0, "zero length").when(end.isNull(), "overflow").when(end > F.col("size_bytes"), "out of bounds")
    severity = F.when(finding == "unused with geometry", "info").when(finding == "overflow", "error").when(finding.isNotNull(), "warning")
    there = ~unused & (F.col("sectors") > 0) & end.isNotNull()
    lo = F.least(offset, "size_bytes")
    return entries.select("image_id", "slot", finding.alias("finding"), severity.alias("severity"), F.when(there, lo).alias("offset"), F.when(there, F.least(end, "size_bytes") - lo).alias("length"), (there & finding.isNull()).alias("candidate"))


def follow_pointers(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits (image_id, hit_id, pointer, size_bytes, weight) checked at the place they point to (targets: image_id, offset, magic_ok).

    A second hit that points to the same place adds no weight; a pointer out of the image is a warning.
    """
    rows = hits.join(targets.select("image_id", F.col("offset").alias("pointer"), "magic_ok"), ["image_id", "pointer"], "left")
    status = F.when((F.col("pointer") < 0) | (F.col("pointer") >= F.col("size_bytes")), "out of image").when(F.coalesce("magic_ok", F.lit(False)), "match").otherwise("mismatch")
    again = F.row_number().over(Window.partitionBy("image_id", "pointer").orderBy("hit_id")) > 1
    return rows.select("image_id", "hit_id", "pointer", status.alias("status"), F.when((status == "match") & ~again, F.col("weight")).otherwise(0.0).alias("weight"))


def with_origin(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each field ``x`` of primary_x and backup_x its value and where it is from: declared, fallback or absent; values below 0 are malformed."""
    out = {}
    for n in names:
        p, b = F.col(f"primary_{n}"), F.col(f"backup_{n}")
        out[n] = F.when(p >= 0, p).when(b >= 0, b)
        out[f"{n}_origin"] = F.when(p >= 0, "declared").when(b >= 0, "fallback").when(p.isNotNull() | b.isNotNull(), "malformed").otherwise("absent")
    return rows.withColumns(out)


def carve_runs(codes: DataFrame, max_gap: int, least: int) -> DataFrame:
    """Start codes (image_id, pos, h264, h265, boundary) grouped into runs; runs of fewer than ``least`` units go.

    A run ends at a gap above ``max_gap``, or at a boundary once it has ``least`` units.
    """
    w = Window.partitionBy("image_id").orderBy("pos")
    step = F.col("pos") - F.lag("pos").over(w)
    rows = number_islands(codes, ["image_id"], ["pos"], step.isNull() | (step > max_gap), "__island")

    def number(state, pos, boundary):
        start, n = state or (pos, 0)
        if boundary and n >= least:
            start, n = pos, 0
        return (start, n + 1), start

    runs = fold_islands(rows, ["image_id"], ["pos"], "__island", ["pos", "boundary"], number, "run")
    by = runs.groupBy("image_id", "run").agg(F.count(F.lit(1)).alias("n_units"), F.max("pos").alias("last"), F.sum("h264").alias("h264"), F.sum("h265").alias("h265")).where(F.col("n_units") >= least)
    codec = F.when((F.col("h264") == 0) & (F.col("h265") == 0), "unknown").when(F.col("h265") > F.col("h264"), "H265").otherwise("H264")
    return by.select("image_id", "run", "last", "n_units", codec.alias("codec"))


def partition_geometry(rows: DataFrame, sector: int = 512) -> DataFrame:
    """Sector fields (first_sector, n_sectors, size_bytes) as byte ranges, with the first reason why one can't be used."""
    offset, length = F.try_multiply("first_sector", F.lit(sector)), F.try_multiply("n_sectors", F.lit(sector))
    ranged = rows.withColumns({"offset": offset, "length": length})
    return judge(ranged, [("absent", F.col("first_sector").isNotNull() & F.col("n_sectors").isNotNull()), ("overflow", F.try_add("offset", "length").isNotNull()), ("empty", F.col("length") > 0), ("beyond image", F.col("offset") + F.col("length") <= F.col("size_bytes"))])


def unit_consistency(units: DataFrame) -> DataFrame:
    """Per image declared and usable entries, and whether the one current unit is the last one written."""
    by = units.groupBy("image_id").agg(F.sum("declared").alias("declared"), F.sum("usable").alias("usable"), F.count_if("current").alias("n_current"), F.max(F.when(F.col("current"), F.col("unit"))).alias("__current"), F.max_by("unit", F.struct("written", "unit")).alias("__last"))
    state = F.when(F.col("n_current") == 0, "UNKNOWN").when(F.col("n_current") > 1, "REVIEW").when(F.col("__current") == F.col("__last"), "PASS").otherwise("REVIEW")
    return by.select("image_id", "declared", "usable", "n_current", state.alias("state"))


def build_index(clips: DataFrame, matched: DataFrame) -> DataFrame:
    """Per image accessible records (clips with an index entry), unreferenced ones and the number of entries that were used."""
    rows = clips.select("image_id", "clip_id").join(matched.select("image_id", "clip_id", "entry_id"), ["image_id", "clip_id"], "left")
    return rows.groupBy("image_id").agg(F.count_if(F.col("entry_id").isNotNull()).alias("n_accessible"), F.count_if(F.col("entry_id").isNull()).alias("n_unreferenced"), F.count_distinct("entry_id").alias("n_entries"))


def extract_payload(ranges: DataFrame, chunks: DataFrame | FileImages, most: int, window: int = 16 << 20) -> DataFrame:
    """Per recording the bytes of its ranges (recording_id, image_id, seq, offset, length) in order: digest, bytes and an error instead of a cut.

    ``chunks`` hold the images in windows of ``window`` bytes; a range may lie in any number of them. Bytes are read only of
    recordings without an error.
    """
    images = as_images(chunks, window)
    sizes = images.sizes().withColumnRenamed("size_bytes", "__size")
    rows = ranges.join(sizes, "image_id", "left")
    inside = (F.col("offset") >= 0) & (F.col("length") >= 0) & (F.try_add(F.col("offset").cast("long"), F.col("length").cast("long")) <= F.col("__size"))
    found = rows.groupBy("recording_id").agg(F.sum("length").alias("n_bytes"), F.bool_or(~F.coalesce(inside, F.lit(False))).alias("__outside"))
    good = found.where((F.col("n_bytes") <= most) & ~F.col("__outside")).select("recording_id")
    order = F.row_number().over(Window.partitionBy("recording_id").orderBy("seq", "image_id", "offset", "length"))
    wanted = ranges.join(good, "recording_id", "left_semi").withColumn("region_id", F.struct("recording_id", order.alias("place"))).select("image_id", "region_id", "seq", "offset", "length")
    pieces = images.read(wanted).select(F.col("region_id.recording_id").alias("recording_id"), "seq", F.coalesce(F.hex("data"), F.lit("")).alias("piece"))
    parts = pieces.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("parts"))
    digests = parts.select("recording_id", F.sha2(F.unhex(F.array_join(F.transform("parts", lambda p: p["piece"]), "")), 256).alias("sha256"))
    error = F.when(F.col("__outside"), "range outside image").when(F.col("n_bytes") > most, "over the cap")
    return found.join(digests, "recording_id", "left").select("recording_id", "n_bytes", "sha256", error.alias("error"))


def assemble_report(images: DataFrame, **sections: DataFrame) -> DataFrame:
    """One row an image: each section (one row an image) as a struct of its columns, null where it has none."""
    out = images.select("image_id")
    for name, df in sections.items():
        part = df.select("image_id", F.struct(*[c for c in df.columns if c != "image_id"]).alias(name))
        out = out.join(part, "image_id", "left")
    return out


def carve_frames(hits: DataFrame, most: int, rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Tag hits (image_id, offset, length, owned_len, trailer_ok, back_length) as frames: the reason against, or kept by a greedy pass.

    A kept frame hides hits inside of it ("inside a frame"); behind ``most`` frames of an image the rest is "over the cap". ``rules``, as ``judge`` takes
    them, stand instead of those on length, end, trailer and back-length.
    """
    end = F.col("offset") + F.col("length")
    judged = judge(hits, rules or [("no length", F.col("length") > 0), ("past end", end <= F.col("owned_len")), ("no trailer", F.col("trailer_ok")), ("back length", F.col("back_length") == F.col("length"))])
    good = judged.where("rejected is null")
    w = Window.partitionBy("image_id").orderBy("offset")
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = number_islands(good.withColumn("__reach", reach), ["image_id"], ["offset"], F.col("__reach").isNull() | (F.col("offset") >= F.col("__reach")), "__island").drop("__reach")

    def step(last, offset, length):
        return (offset + length, 1) if last is None or offset >= last else (last, 0)

    kept = fold_islands(rows, ["image_id"], ["offset"], "__island", ["offset", "length"], step, "__kept").drop("__island")
    place = F.when(F.col("__kept") == 1, F.sum("__kept").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.withColumn("__place", place).withColumn("rejected", F.when(F.col("__kept") == 0, "inside a frame").when(F.col("__place") > most, "over the cap")).drop("__kept", "__place")
    return kept.unionByName(judged.where("rejected is not null"))


def evaluate_candidates(rows: DataFrame, conditions: dict[str, Column], required: list[str]) -> DataFrame:
    """``rows`` with the names of the conditions that hold, and whether all required ones do; an unknown condition doesn't hold."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
    return rows.withColumns({"held": F.array_join(held, ","), "recoverable": F.size(F.array_except(F.array(*map(F.lit, required)), held)) == 0})


def directory_entries(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """Entries of a flat directory (image_id, entry, offset, length, size_bytes; places of 64 bits): the first reason against, and the payload of the frame at the offset.

    The places of accepted entries are longs; those of others may not fit and are kept as decimals in declared_offset and declared_length.
    """
    wide = entries.withColumns({f"declared_{c}": F.col(c).cast("decimal(20,0)") for c in ("offset", "length")})
    end = F.col("declared_offset") + F.col("declared_length")
    judged = judge(wide, [("zero length", F.col("declared_length") > 0), ("overflow", end < F.lit(BEYOND).cast("decimal(20,0)")), ("past end", end <= F.col("size_bytes"))])
    judged = judged.withColumns({c: F.when(F.col("rejected").isNull(), F.col(f"declared_{c}").cast("long")) for c in ("offset", "length")})
    return judged.join(frames.select("image_id", "offset", "payload"), ["image_id", "offset"], "left").withColumn("payload", F.when(F.col("rejected").isNull(), F.col("payload")))


def walk_parts(regions: DataFrame, resync: bool) -> DataFrame:
    """Parts of containers (region_id, data): a start code 00 00 01, a kind, and a two-byte big-endian length of what follows.

    Stops at the first place without a start code, or with ``resync`` goes on at the next one. Each region is walked in one pass; regions are independent.
    """
    import pyarrow as pa

    def walk(batches):
        for batch in batches:
            out = {"region_id": [], "offset": [], "kind": [], "length": [], "complete": []}
            for region, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, at = data or b"", 0
                while at + 6 <= len(data):
                    if data[at : at + 3] != b"\0\0\1":
                        at = data.find(b"\0\0\1", at) if resync else -1
                        if at < 0:
                            break
                        continue
                    length = 6 + int.from_bytes(data[at + 4 : at + 6], "big")
                    for name, value in zip(out, (region, at, data[at + 3], length, at + length <= len(data)), strict=True):
                        out[name].append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(out["region_id"], pa.int64()), pa.array(out["offset"], pa.int64()), pa.array(out["kind"], pa.int32()), pa.array(out["length"], pa.int64()), pa.array(out["complete"], pa.bool_())], names=list(out))

    return regions.select(F.col("region_id").cast("long"), "data").mapInArrow(walk, "region_id long, offset long, kind int, length long, complete boolean")


def reconstruct(grouped: DataFrame) -> DataFrame:
    """Recordings out of grouped clips (image_id, channel, clip_group, block, start, end, offset, length): times, bytes and ranges in block order."""
    parts = F.array_sort(F.collect_list(F.struct("block", "offset", "length")))
    return grouped.groupBy("image_id", "channel", "clip_group").agg(F.count(F.lit(1)).alias("n_clips"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("bytes"), F.array_join(F.transform(parts, lambda p: F.concat(p["offset"].cast("string"), F.lit("+"), p["length"].cast("string"))), ",").alias("ranges"), F.when(F.count("start") == F.count(F.lit(1)), "time").when(F.count("start") == 0, "place on disk").otherwise("mixed").alias("ordering"))
