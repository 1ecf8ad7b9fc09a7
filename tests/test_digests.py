"""Digests over windows of any size against hashlib over whole bytes."""

import hashlib
import random

import pytest

from tracelake.operators import digests
from tracelake.sources.images import FileImages, TableImages

IMAGES = {0: random.Random(1).randbytes(10_000), 1: b"x" * 64, 2: random.Random(2).randbytes(777)}
REGIONS = [(0, "a", 0, 10_000), (0, "b", 63, 66), (0, "c", 9_990, 11), (1, "d", 0, 0), (1, "e", 64, 1), (2, "f", 128, 649), (7, "g", 0, 5), (0, "h", -1, 5), (None, "i", 0, 5), (0, "j", None, 5)]


def table(spark, window, overlap=5, lost=()):
    rows = [(i, at, min(window, len(data) - at), None if (i, at // window) in lost else bytearray(data[at : at + window + overlap])) for i, data in IMAGES.items() for at in range(0, len(data), window)]
    return TableImages(spark.createDataFrame(rows + rows[:1], "image_id long, base_offset long, owned_len long, data binary").repartition(5), window)


def both(data):
    return hashlib.md5(data).hexdigest(), hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    for i, data in IMAGES.items():
        (folder / f"{i}.img").write_bytes(data)
    return [str(folder / f"{i}.img") for i in IMAGES]


@pytest.mark.parametrize("window", [64, 1000, 1 << 20])
def test_window_sizes_change_nothing(spark, window):
    got = {r.image_id: (r.size_bytes, r.md5, r.sha256) for r in digests.image_digests(table(spark, window)).collect()}
    assert got == {i: (len(data), *both(data)) for i, data in IMAGES.items()}


@pytest.mark.parametrize("kind", ["table", "files"])
def test_regions(spark, files, kind):
    images = table(spark, 64) if kind == "table" else FileImages.of_paths(spark, files, 64)
    got = {r.region_id: (r.md5, r.sha256) for r in digests.region_digests(images, spark.createDataFrame(REGIONS, "image_id long, region_id string, offset long, length long")).collect()}
    want = {}
    for i, name, at, length in REGIONS:
        if i is not None and at is not None and at >= 0:
            data = IMAGES.get(i, b"")[at : at + length]
            want[name] = both(data) if len(data) == length else (None, None)
    assert got == want


def test_second_pass(spark, files):
    first = [(0, both(IMAGES[0])[0].upper(), both(IMAGES[0])[1]), (1, both(IMAGES[1])[0], "00"), (2, None, both(IMAGES[2])[1]), (9, "a", "b")]
    acquired = spark.createDataFrame(first, "image_id long, md5 string, sha256 string")
    for images in (table(spark, 100), FileImages.of_paths(spark, files)):
        assert {r.image_id: r.verdict for r in digests.verify_images(acquired, images).collect()} == {0: "MATCH", 1: "MISMATCH", 2: "UNKNOWN", 9: "UNKNOWN"}


def test_missing_window_is_unknown(spark):
    lost = table(spark, 100, lost={(0, 3)})
    gone = TableImages(table(spark, 100).rows.where("not (image_id = 0 and base_offset = 300)"), 100)
    acquired = spark.createDataFrame([(i, *both(d)) for i, d in IMAGES.items()], "image_id long, md5 string, sha256 string")
    for images in (lost, gone):
        assert {r.image_id: r.verdict for r in digests.verify_images(acquired, images).collect()} == {0: "UNKNOWN", 1: "MATCH", 2: "MATCH"}
        assert digests.image_digests(images).where("image_id = 0").first().read_bytes == 300


def test_a_table_has_the_digests_of_its_files(spark, files):
    images = FileImages.of_paths(spark, files, 256)
    again = TableImages(images.chunks(9), 256)
    assert sorted(digests.image_digests(images).collect()) == sorted(digests.image_digests(again).collect())


def test_nothing(spark):
    none = TableImages(spark.createDataFrame([], "image_id long, base_offset long, owned_len long, data binary"), 64)
    assert digests.image_digests(none).collect() == []


def test_windows_of_an_image_shuffle_once(spark):
    images = table(spark, 1000)
    plan = digests.image_digests(images)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_window_short_of_the_next_one_ends_the_reading(spark):
    rows = [(0, 0, 64, b"a" * 64), (0, 64, 10, b"b" * 10), (0, 128, 5, b"c" * 5), (1, 0, 0, None), (2, 64, 64, b"d" * 64), (None, 0, 3, b"abc")]
    found = digests.image_digests(TableImages(spark.createDataFrame(rows, "image_id long, base_offset long, owned_len long, data binary"), 64))
    got = {r.image_id: tuple(r)[1:] for r in found.collect()}
    assert got == {0: (133, 64, None, None), 1: (0, 0, *both(b"")), 2: (128, 0, None, None), None: (3, None, None, None)}


def test_the_list_of_images_laid_out_does_not_grow_by_the_pieces(spark):
    """Two extents an image at most here, not one a piece: a list of pieces is what the driver can't hold."""
    rows = [(k % 3, k, b"%d," % k if k % 7 else None if k % 2 else b"") for k in range(2000)]
    files = FileImages.laid(spark.createDataFrame(rows, "image_id long, k long, data binary").repartition(6), ["k"], 64)
    whole = {i: b"".join(d for j, _, d in rows if j == i and d is not None) for i in range(3)}
    assert {r.image_id: (r.size_bytes, r.md5, r.sha256) for r in digests.image_digests(files).collect()} == {i: (len(d), *both(d)) for i, d in whole.items()}
    assert files.catalog.count() <= 3 * 4
    pieces = spark.createDataFrame([(1, k * 5, b"12345") for k in range(100) if k != 50], "image_id long, start long, data binary").coalesce(1)
    assert sorted(tuple(r) for r in FileImages.written(pieces, 64).catalog.select("start", "size").collect()) == [(0, 250), (255, 245)]


def test_lists_of_extents_are_not_broadcast(spark):
    files = FileImages.laid(spark.createDataFrame([(0, 0, b"abc")], "image_id long, k long, data binary"), ["k"], 64)
    regions = spark.createDataFrame([(0, "r", 0, 3)], "image_id long, region_id string, offset long, length long")
    for found in (digests.region_digests(files, regions), files.read(regions), files.readable(regions), files.chunks(touching=regions)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
