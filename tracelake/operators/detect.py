"""Finding patterns and signatures in chunks of bytes, and deciding which vendor wrote an image.

Chunks are (image_id, base_offset, owned_len, data): data may run on behind owned_len, so that a needle on a border is found
once, in the chunk in which it starts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.images import FileImages, TableImages, as_images

#: Thresholds, and factors of evidence states and of matches.
THRESHOLDS = {"min_confidence": 0.65, "min_margin": 0.20, "min_quality": 0.50}
STATE_FACTORS = {"validated": 1.00, "provisional": 0.80, "model_specific": 0.70, "firmware_specific": 0.60, "unvalidated": 0.40}
MATCH_FACTORS = {"match": 1.00, "partial": 0.50, "mismatch": 0.00, "absent": 0.00}


def find_pattern(chunks: DataFrame, needle: bytes, start: int = 0, follow: tuple[int, int] | None = None) -> DataFrame:
    """(image_id, offset) of all hits from ``start`` on, overlapping ones too; with ``follow`` (place behind the hit's begin, length) also the ``bytes`` there, as far as the data of the chunk runs."""
    def search(batches):
        for batch in batches:
            images, offsets, found = [], [], []
            for image, base, owned, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = data.find(needle)
                while 0 <= at < owned:
                    if base + at >= start:
                        images.append(image)
                        offsets.append(base + at)
                        if follow:
                            found.append(data[at + follow[0] : at + sum(follow)])
                    at = data.find(needle, at + 1)
            columns = {"image_id": pa.array(images, pa.int64()), "offset": pa.array(offsets, pa.int64()), **({"bytes": pa.array(found, pa.binary())} if follow else {})}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    shape = "image_id long, offset long" + ", bytes binary" * bool(follow)
    return chunks.select("image_id", "base_offset", "owned_len", "data").where(F.col("data").isNotNull()).mapInArrow(search, shape)


def find_in_images(images: FileImages | TableImages, needle: bytes, touching: DataFrame | None = None, follow: tuple[int, int] | None = None) -> DataFrame:
    """``find_pattern`` over images: files are cut in windows that run on as far as is asked for, and only those that ``touching`` (image_id, offset, length) touches.

    Of a table of windows all are searched, and bytes that its windows don't hold are read by region.
    """
    if isinstance(images, FileImages):
        return find_pattern(images.chunks(max(len(needle) - 1, sum(follow or (0,))), touching, joined=True), needle, follow=follow)
    hits = find_pattern(images.chunks(), needle)
    if follow is None:
        return hits
    wanted = hits.select("image_id", F.col("offset").alias("region_id"), (F.col("offset") + follow[0]).alias("offset"), F.lit(follow[1]).cast("long").alias("length"))
    got = images.read(wanted).select("image_id", F.col("region_id").alias("offset"), F.col("data").alias("bytes"))
    return hits.join(got, ["image_id", "offset"], "left")


def first_hit(hits: DataFrame) -> DataFrame:
    return hits.groupBy("image_id").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("n_hits"))


def evaluate_rules(chunks: DataFrame | FileImages, rules: DataFrame, window: int = 16 << 20, overlap: int = 64) -> DataFrame:
    """Evidence rows of rules (vendor, rule, pattern BINARY, kind, at, stop, step) on images cut in windows of ``window`` bytes.

    kind exact: the pattern has to stand at ``at``; aligned: at ``at`` or a multiple of ``step`` behind it, before ``stop``; header: the same with step 1.
    match, or mismatch if the place is there but holds something else, or absent if the image is too short. The rules are a
    small table of profiles, which goes to all tasks. The window doesn't change results: where a pattern is longer than the
    ``overlap`` by which data runs on, each window of a table is joined with the bytes behind it first. Images are looked at once, and no
    bytes of windows behind the last place of a rule; of files such windows aren't read.
    """
    table = rules.collect()
    looked = []  # number, pattern, first place, last place, step
    for k, r in enumerate(table):
        if r["pattern"] is not None and r["at"] is not None:
            last = r["at"] if r["kind"] == "exact" or r["stop"] is None else max(r["stop"] - 1, r["at"])
            looked.append((k, bytes(r["pattern"]), r["at"], last, max(r["step"] or 1, 1)))
    longest = max((len(x[1]) for x in looked), default=0)
    images, sizes = as_images(chunks, window), None
    if isinstance(images, FileImages):
        sizes = images.sizes()
        head = sizes.select("image_id", F.lit(0).cast("long").alias("offset"), F.least("size_bytes", F.lit(max((x[3] for x in looked), default=-1) + 1)).alias("length"))
        rows = images.chunks(max(longest - 1, 0), touching=head, joined=True)
    else:
        rows = images.chunks().select("image_id", "base_offset", "owned_len", "data")
    if longest > overlap + 1 and sizes is None:
        number = F.floor(F.col("base_offset") / window)
        behind = rows.select("image_id", number.alias("region_id"), (F.col("base_offset") + F.col("owned_len")).alias("offset"), F.lit(longest - 1).cast("long").alias("length"))
        tails = TableImages(rows, window).read(behind).select("image_id", F.col("region_id").alias("__n"), F.col("data").alias("__tail"))
        whole = F.concat(F.substring("data", F.lit(1), F.col("owned_len").cast("int")), F.coalesce("__tail", F.lit(b"")))
        rows = rows.withColumn("__n", number).join(tails, ["image_id", "__n"], "left").select("image_id", "base_offset", "owned_len", whole.alias("data"))
    touched = F.col("base_offset") <= max((x[3] for x in looked), default=-1)
    # rules met as bits of longs, which are hashed where lists would be sorted
    masks = [f"met_{j}" for j in range(max(1, -(-len(table) // 63)))]

    def search(batches):
        for batch in batches:
            images, ends, met = [], [], [[] for _ in masks]
            for image, base, owned, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [0] * len(masks)
                for k, pattern, first, last, step in looked if data is not None else ():
                    stop = min(last, base + owned - 1) - base + len(pattern)
                    at = data.find(pattern, max(first, base) - base, stop) if last >= base else -1
                    while at >= 0 and (base + at - first) % step:
                        at = data.find(pattern, at + 1, stop)
                    if at >= 0:
                        own[k // 63] |= 1 << k % 63
                images.append(image)
                ends.append(None if owned is None else base + owned)
                for column, bits in zip(met, own, strict=True):
                    column.append(bits)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()) for values in (images, ends, *met)], names=["image_id", "end", *masks])

    found = rows.select(F.col("image_id").cast("long"), "base_offset", F.col("owned_len").cast("long"), F.when(touched, F.col("data")).alias("data")).mapInArrow(search, "image_id long, end long" + "".join(f", {m} long" for m in masks))
    if sizes is not None:
        found = found.unionByName(sizes.select(F.col("image_id").cast("long"), F.col("size_bytes").cast("long").alias("end"), *[F.lit(0).cast("long").alias(m) for m in masks]))
    images = found.groupBy("image_id").agg(F.max("end").alias("size"), F.array(*[F.bit_or(m) for m in masks]).alias("met"))
    kinds = {f.name: f.dataType for f in rules.schema}
    given = lambda r, c: F.lit(r[c]).cast(kinds[c]).alias(c)
    listed = [F.struct(F.lit(k).alias("k"), F.lit(None if r["pattern"] is None or r["at"] is None else r["at"] + len(r["pattern"])).cast("long").alias("least"), *[given(r, c) for c in ("vendor", "rule", "state", "weight", "exclusive")]) for k, r in enumerate(table)]
    each = images.select("image_id", "size", "met", F.explode(F.array(*listed)).alias("r")) if listed else images.join(rules.limit(0).select(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("least"), "vendor", "rule", "state", "weight", "exclusive").alias("r")), F.lit(False))
    bits = F.element_at("met", F.floor(F.col("r.k") / 63).cast("int") + 1)
    status = F.when(F.getbit(bits, F.col("r.k") % 63) == 1, "match").when(F.col("size") < F.col("r.least"), "absent").otherwise("mismatch")
    return each.select("image_id", "r.vendor", "r.rule", status.alias("match_status"), "r.state", "r.weight", "r.exclusive")


def _factor(table: dict, col: str):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(col)), F.lit(0.0))


def vendor_scores(hits: DataFrame, most: DataFrame) -> DataFrame:
    """Per image and vendor: raw score, confidence = raw / the vendor's most (0.01 at least) in 0..1, mean quality, an exclusive match, status.

    ``most``: vendor, max_score; a vendor without one has 1.
    """
    quality = _factor(MATCH_FACTORS, "match_status")
    by = hits.groupBy("image_id", "vendor").agg(F.sum(F.col("weight") * _factor(STATE_FACTORS, "state") * quality).alias("raw_score"), F.avg(quality).alias("quality"), F.bool_or(F.col("exclusive") & (F.col("match_status") == "match")).alias("has_exclusive"), F.count_if(F.col("match_status") == "match").alias("n_matches"))
    rows = by.join(F.broadcast(most), "vendor", "left")
    confidence = F.greatest(F.least(F.col("raw_score") / F.greatest(F.coalesce("max_score", F.lit(1.0)), F.lit(0.01)), F.lit(1.0)), F.lit(0.0))
    return rows.select("image_id", "vendor", "raw_score", confidence.alias("confidence"), "quality", "has_exclusive", (F.col("n_matches") <= 1).alias("insufficient"))


def detection_status(hits: DataFrame) -> DataFrame:
    """Per image and vendor: Confirmed with an exclusive and another match, Insufficient with one match or none, else Compatible."""
    by = hits.groupBy("image_id", "vendor").agg(F.count_if(F.col("match_status") == "match").alias("n_matches"), F.bool_or(F.col("exclusive") & (F.col("match_status") == "match")).alias("has_exclusive"))
    return by.withColumn("status", F.when(F.col("n_matches") < 2, "Insufficient").when(F.col("has_exclusive"), "Confirmed").otherwise("Compatible"))


def _classified(scores: DataFrame, thresholds: dict) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy(F.col("confidence").desc(), "vendor")
    rows = scores.withColumns({"rank": F.row_number().over(w), "second": F.lead("vendor").over(w), "__next": F.lead("confidence").over(w)})
    margin = F.when(F.col("__next").isNull(), F.col("confidence")).otherwise(F.greatest(F.col("confidence") - F.col("__next"), F.lit(0.0)))
    rows = rows.withColumn("margin", margin)
    low = F.col("confidence") < thresholds["min_confidence"]
    top = F.when(F.col("insufficient"), "Insufficient").when(low, "Unknown").when(F.col("second").isNotNull() & (F.col("margin") < thresholds["min_margin"]), "Ambiguous").when((F.col("margin") >= thresholds["min_margin"]) & (F.col("quality") >= thresholds["min_quality"]) & F.col("has_exclusive"), "Confirmed").otherwise("CompatibleCandidate")
    rest = F.when(F.col("insufficient"), "Insufficient").otherwise("Unknown")
    return rows.withColumn("classification", F.when(F.col("rank") == 1, top).otherwise(rest)).drop("__next")


def classify_top(scores: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    """The decision of each image by its best vendor, ties by name."""
    return _classified(scores, thresholds).where("rank = 1").select("image_id", "vendor", "second", "confidence", "margin", "quality", "classification")


def classify_all(scores: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    return _classified(scores, thresholds).select("image_id", "rank", "vendor", "confidence", "classification")


def detection_depth(hits: DataFrame) -> DataFrame:
    """Per image: bytes examined, highest offset, and the indicators that matched, sorted."""
    return hits.groupBy("image_id").agg(F.sum("length").alias("bytes_examined"), F.max(F.col("offset") + F.col("length")).alias("highest_offset"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("match_status") == "match", F.col("rule")))), ",").alias("indicators"))


def scan_report(chunks: DataFrame, limit: int) -> DataFrame:
    """Per image the range that was read, its bytes, and why the scan ended."""
    by = chunks.groupBy("image_id").agg(F.min("base_offset").alias("first"), F.max(F.col("base_offset") + F.col("owned_len")).alias("end"), F.sum("owned_len").alias("bytes"))
    return by.withColumn("termination", F.when(F.col("bytes") >= limit, "limit").otherwise("end of image"))


def unit_points(unit):
    """Points for H.264 and for H.265 of the first byte behind a start code."""
    a, h, clear = unit.bitwiseAND(F.lit(31)), F.shiftright(unit, 1).bitwiseAND(F.lit(63)), unit < 128
    avc = F.when(clear & a.isin(7, 8), 2).when(clear & a.isin(1, 5), 1).otherwise(0)
    hevc = F.when(clear & h.isin(32, 33, 34), 2).when(clear & h.isin(1, 19, 20), 1).otherwise(0)
    return avc, hevc


def codec_vote(units: DataFrame) -> DataFrame:
    """Per region votes of start-code units (region_id, unit: first byte behind a start code) for H.264 and H.265, and the codec.

    A codec needs 4 points and a lead of more than 2; less is a REVIEW.
    """
    a, clear = F.col("unit").bitwiseAND(F.lit(31)), F.col("unit") < 128
    avc, hevc = unit_points(F.col("unit"))
    by = units.groupBy("region_id").agg(F.sum(avc).alias("h264"), F.sum(hevc).alias("h265"), F.count_if(clear & (a == 5)).alias("keyframes"))
    lead = F.col("h264") - F.col("h265")
    codec = F.when((F.col("h264") >= 4) & (lead > 2), "H264").when((F.col("h265") >= 4) & (-lead > 2), "H265")
    return by.withColumns({"codec": codec, "state": F.when(codec.isNull(), "REVIEW").otherwise("PASS")})
