"""Images in files: windows, regions and payloads by seeking, whatever the windows, pieces and holes; no plan shuffles their bytes."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import decode, detect
from tracelake.sources import images

SHAPE = "image_id long, region_id long, offset long, length long"


@pytest.fixture(scope="module")
def raws(tmp_path_factory):
    rng, at = random.Random(9), tmp_path_factory.mktemp("files")
    raws = [bytearray(rng.randbytes(n)) for n in (3000, 700, 0)]
    for p in (0, 61, 126, 1000, 2995):
        raws[0][p : p + 5] = b"MAGIC"
    paths = []
    for k, cuts in enumerate(((0, 1000, 1001, 3000), (0, 700), (0, 0))):
        paths.append([])
        for i, j in zip(cuts, cuts[1:]):
            (at / f"{k}-{i}.img").write_bytes(raws[k][i:j])
            paths[-1].append(str(at / f"{k}-{i}.img"))
    return paths, [bytes(r) for r in raws]


REGIONS = [(0, 1, 60, 200), (0, 2, 990, 20), (0, 3, 2990, 50), (0, 4, 9000, 5), (0, 5, -1, 5), (0, 6, 5, 0), (1, 7, 0, 700), (2, 8, 0, 5), (9, 9, 0, 5), (0, 10, None, 5)]


@pytest.mark.parametrize("window", [7, 64, 1000, 1 << 20])
def test_regions_and_windows(spark, raws, window):
    paths, raws = raws
    files = images.FileImages.of_paths(spark, paths, window)
    got = {r.region_id: r.data and bytes(r.data) for r in files.read(spark.createDataFrame(REGIONS, SHAPE)).collect()}
    assert got == {1: raws[0][60:260], 2: raws[0][990:1010], 3: raws[0][2990:], 4: None, 5: None, 6: None, 7: raws[1], 8: None, 9: None, 10: None}
    chunks = files.chunks(8).collect()
    assert len(chunks) == sum(-(-len(r) // window) for r in raws)
    for c in chunks:
        raw = raws[c.image_id]
        assert c.owned_len == min(window, len(raw) - c.base_offset) and bytes(c.data) == raw[c.base_offset : c.base_offset + c.owned_len + 8]
    hits = detect.find_in_images(files, b"MAGIC", follow=(5, 3)).collect()
    assert sorted((r.offset, bytes(r.bytes)) for r in hits) == [(p, raws[0][p + 5 : p + 8]) for p in (0, 61, 126, 1000, 2995)]
    touched = files.chunks(8, touching=spark.createDataFrame([(0, 1, 0, 1), (0, 2, 2999, 1), (1, 3, 100, 2)], SHAPE))
    assert {(r.image_id, r.base_offset) for r in touched.collect()} == {(0, 0), (0, 2999 // window * window), *((1, k * window) for k in range(100 // window, 101 // window + 1))}


@pytest.mark.parametrize("scheme", ["file://", "file:"])
def test_paths_with_a_scheme(spark, raws, scheme):
    paths, raws = raws
    files = images.FileImages.of_paths(spark, [[scheme + p for p in own] for own in paths], 100)
    assert bytes(files.read(spark.createDataFrame(REGIONS[:1], SHAPE)).first().data) == raws[0][60:260]
    chunks = images.read_images(spark, [scheme + paths[1][0]], 100, 8).collect()
    assert [bytes(c.data) for c in sorted(chunks, key=lambda c: c.base_offset)] == [raws[1][k : k + 108] for k in range(0, 700, 100)]
    with pytest.raises(FileNotFoundError):
        images.FileImages.of_paths(spark, [scheme + "/nowhere.img"])


def test_holes_and_lost_files(spark, raws):
    paths, raws = raws
    rows = [(0, 0, 100, paths[1][0], 0), (0, 200, 100, paths[1][0], 200), (1, 0, 50, "/nowhere.img", 0)]
    files = images.FileImages(spark.createDataFrame(rows, images.CATALOG), 64)
    got = {(c.image_id, c.base_offset): c.data and bytes(c.data) for c in files.chunks(8).collect()}
    assert got == {(0, 0): raws[1][:72], (0, 64): None, (0, 128): None, (0, 192): None, (0, 256): raws[1][256:300], (1, 0): None}
    regions = [(0, 1, 90, 10), (0, 2, 90, 11), (0, 3, 200, 100), (0, 4, 150, 10), (1, 5, 0, 5)]
    assert {r.region_id: r.data is not None for r in files.read(spark.createDataFrame(regions, SHAPE)).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    targets = [(0, 1, 0, 64), (0, 2, 60, 10), (0, 3, 260, 40), (0, 4, 260, 500), (5, 5, 0, 1)]
    assert {r.region_id: r.readable for r in files.readable(spark.createDataFrame(targets, SHAPE)).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    table = images.TableImages(files.chunks(8), 64)
    assert {r.region_id: r.readable for r in table.readable(spark.createDataFrame(targets, SHAPE)).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_written_images_come_back(spark):
    rows = [(k, s, bytearray(f"{k}:{s}:".encode() * 20)) for k in range(30) for s in (0, 500)] + [(99, 0, None), (98, 0, bytearray())]
    files = images.FileImages.written(spark.createDataFrame(rows, "image_id long, start long, data binary").repartition(3), 64)
    wanted = spark.createDataFrame([(k, k, 500, 5) for k in range(30)], SHAPE)
    assert {r.region_id: bytes(r.data) for r in files.read(wanted).collect()} == {k: f"{k}:500:".encode()[:5] if k > 9 else f"{k}:500"[:5].encode() for k in range(30)}
    assert {r.image_id: r.size_bytes for r in files.sizes().collect()}[98] == 0
    assert {r.image_id for r in files.only(spark.createDataFrame([(3,)], "image_id long")).chunks().select("image_id").collect()} == {3}


def test_no_exchange_holds_bytes(spark, raws):
    paths, _ = raws
    files = images.FileImages.of_paths(spark, paths, 64)
    for df in (files.read(spark.createDataFrame(REGIONS, SHAPE)), decode.tagged_frames(files, 64), decode.start_codes(files, 64), decode.stream_records(files, 64)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        held = [line for line in plan.splitlines() if "MapInArrow" in line]
        # below the first exchange from the top nothing may have made bytes
        assert held and "data#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_filters_reach_the_reader(spark, raws):
    paths, raws = raws
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        chunks = images.read_images(spark, [p for own in paths for p in own], 100, 8)
        got = chunks.where((F.col("image_id") == 2) & (F.col("base_offset") >= 300) & (F.col("base_offset") < 600)).collect()
        assert sorted(c.base_offset for c in got) == [300, 400, 500]
        reader = images._FilteringReader({"paths": ",".join(p for own in paths for p in own), "window": "100"})
        from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

        assert len(list(reader.pushFilters([EqualTo(("image_id",), 2), GreaterThanOrEqual(("base_offset",), 300), LessThan(("base_offset",), 600)]))) == 3
        assert sum(p.count for p in reader.partitions()) == 4  # up to the bound, which the filter itself then leaves out
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
