"""Sources and sinks, and byte work that must not depend on the window."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import fields, times
from tracelake.operators import detect, media
from tracelake.sources import images, tables


def test_images_in_windows(spark, tmp_path):
    rng = random.Random(1)
    raw = bytearray(rng.randbytes(5000))
    for at in (0, 61, 127, 1000, 1023, 4995):
        raw[at : at + 5] = b"MAGIC"
    (tmp_path / "a.img").write_bytes(raw)
    (tmp_path / "b.img").write_bytes(b"")
    paths = [str(tmp_path / "a.img"), str(tmp_path / "b.img")]
    found = []
    for window in (64, 128, 1000, 1 << 20):
        chunks = images.read_images(spark, paths, window, 8)
        found.append(sorted((r.image_id, r.offset) for r in detect.find_pattern(chunks, b"MAGIC").collect()))
    assert found[0] == [(0, p) for p in range(4996) if raw[p : p + 5] == b"MAGIC"] and all(f == found[0] for f in found)
    regions = spark.createDataFrame([(0, 1, 60, 200), (0, 2, 4990, 50), (0, 3, 9000, 5), (0, 4, 0, 64)], "image_id long, region_id long, offset long, length long")
    got = {r.region_id: r.data and bytes(r.data) for r in images.read_regions(images.read_images(spark, paths, 64, 8), regions, 64).collect()}
    assert got == {1: bytes(raw[60:260]), 2: bytes(raw[4990:]), 3: None, 4: bytes(raw[:64])}
    with pytest.raises(Exception):
        images.read_images(spark, paths, 0).count()


def test_rules(spark, tmp_path):
    good = {"id": "p1", "version": "1", "vendor": "Acme", "models": [], "firmware": ["f1"], "signatures": [{"name": "s", "pattern_hex": "0aFF", "weight": 0.5, "exclusive": True}]}
    bad = [good | {"id": " "}, good | {"signatures": []}, good | {"signatures": [good["signatures"][0] | {"weight": 0}]}, good | {"signatures": [good["signatures"][0] | {"pattern_hex": "xyz"}]}]
    (tmp_path / "rules.json").write_text("\n".join(map(json.dumps, [good, *bad])))
    kept, rejected = tables.load_rules(spark, str(tmp_path / "rules.json"))
    assert kept.count() == 1 and sorted(r.reason for r in rejected.collect()) == ["blank id or version", "no signatures", "pattern is no hex", "weight not above zero"]
    cases = spark.createDataFrame([(1, "ACME", "m", "f1"), (2, "acme", "m", "f2"), (3, None, None, None)], "image_id long, vendor string, model string, firmware_version string")
    assert {r.image_id: r.profile_id for r in tables.applicable_rules(cases, kept).collect()} == {1: "p1", 2: None, 3: None}


def test_corpus_and_reports(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"case_id": "x", "source_path": "p", "expected_detection": "d"}, {"case_id": "", "source_path": "p", "expected_detection": "d"}]))
    kept, rejected = tables.read_corpus(spark, str(tmp_path / "c.json"))
    assert kept.count() == 1 and rejected.count() == 1
    rows = spark.createDataFrame([(None, 5, "k", 'say "x"'), (2, 6, "k", "y")], "channel int, instant long, kind string, description string")
    tables.write_csv_report(rows.coalesce(1), "timeline", str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text.splitlines()[0] == "channel,instant,kind,description" and "Unknown,5,k," in text and '""x""' in text
    log = spark.createDataFrame([(1, "a"), (2, "b")], "case_id long, action string")
    for _ in range(2):
        tables.append_custody(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_zones_and_clocks(spark):
    known = {"Europe/Berlin": 7200, "europe/berlin": 7200, "America/New York": -14400, "+0530": 19800, "UTC-3": -10800, "ist": 19800, "Z": 0, "utc": 0, "": None, "+15": None, "5:61": None, "x": None, "CET": 7200}
    rows = spark.createDataFrame([(z,) for z in known], "z string").withColumn("t", F.lit("2024-07-01 12:00:00").cast("timestamp"))
    assert {r.z: r.offset_seconds for r in times.resolve_zone(rows, "z", "t").collect()} == known
    gap = spark.createDataFrame([("2024-03-31 02:30:00",), ("2024-10-27 02:30:00",)], "s string").select(F.lit("Europe/Berlin").alias("z"), F.col("s").cast("timestamp").alias("t"), "s")
    assert {r.s[5:7]: r.offset_seconds for r in times.resolve_zone(gap, "z", "t").collect()} == {"03": 7200, "10": 7200}
    packed = (24 << 26) | (2 << 22) | (29 << 17) | (23 << 12) | (59 << 6) | 58
    got = spark.range(1).select(times.packed_clock(F.lit(packed).cast("long")).alias("p"), times.packed_clock(F.lit((24 << 26) | (2 << 22) | (30 << 17)).cast("long")).alias("q")).first()
    assert str(got.p.time) == "2024-02-29 23:59:58" and got.q.time is None and got.q.reason == "invalid calendar"


def test_fields(spark):
    data = F.lit(bytes([1, 2, 255, 255, 0x80]))
    got = spark.range(1).select(fields.le_uint(data, 0, 2).alias("a"), fields.le_int(data, 2, 2).alias("b"), fields.le_int(data, 1, 4).alias("c"), fields.le_uint(data, 4, 2).alias("d"), fields.le_bytes(F.lit(-2), 4).alias("e")).first()
    assert (got.a, got.b, got.c, got.d, bytes(got.e)) == (513, -1, int.from_bytes(bytes([2, 255, 255, 0x80]), "little", signed=True), None, b"\xfe\xff\xff\xff")


def test_bad_frames(spark):
    frames = spark.createDataFrame([(1, 0, 0.0)], "artifact_id long, frame_index long, pts double")
    for bad in ({"every": 0}, {"seconds": 0}, {"between": (2, 1)}):
        with pytest.raises(ValueError):
            media.sample_frames(frames, **bad)
    with pytest.raises(ValueError):
        media.crop_and_shrink(frames, 8, 8, (4, 4, 8, 8), 2)
