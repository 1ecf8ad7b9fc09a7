"""Rules and payloads on images in windows: results don't depend on the window."""

import hashlib
import random

import pytest

from tracelake.operators import detect, records
from tracelake.sources import images

RULES = "vendor string, rule string, pattern binary, kind string, at long, stop long, step long, state string, weight double, exclusive boolean"


@pytest.fixture(scope="module")
def raws(tmp_path_factory):
    rng, at = random.Random(4), tmp_path_factory.mktemp("images")
    raws = [bytearray(rng.randbytes(n)) for n in (3000, 700, 90)]
    for raw, places in zip(raws, ((0, 126, 1000, 2990), (640,), (40,)), strict=True):
        for p in places:
            raw[p : p + 5] = b"MAGIC"
    raws[0][1500:1530] = b"L" * 30
    paths = [str(at / f"{k}.img") for k in range(3)]
    for path, raw in zip(paths, raws, strict=True):
        with open(path, "wb") as f:
            f.write(raw)
    return paths, [bytes(r) for r in raws]


@pytest.mark.parametrize("window,overlap", [(64, 8), (7, 2), (128, 4), (1 << 20, 64)])
def test_evaluate_rules(spark, raws, window, overlap):
    paths, raws = raws
    shapes = [(b"MAGIC", "exact", 1000, 1001, 1), (b"MAGIC", "aligned", 0, 3000, 640), (b"MAGIC", "header", 2000, 3000, 1), (b"MAGIC", "header", 100, 126, 1), (b"MAGIC", "header", 100, 127, 1), (b"L" * 30, "header", 1400, 1600, 1), (b"M", "exact", 5000, 5001, 1)]
    rules = [("v", f"r{k}", *x, "validated", 0.5, False) for k, x in enumerate(shapes)]
    want = {}
    for i, raw in enumerate(raws):
        for k, (pattern, kind, at, stop, step) in enumerate(shapes):
            met = any(raw[p : p + len(pattern)] == pattern for p in ([at] if kind == "exact" else range(at, stop, step)))
            want[i, f"r{k}"] = "match" if met else "absent" if len(raw) < at + len(pattern) else "mismatch"
    got = detect.evaluate_rules(images.read_images(spark, paths, window, overlap), spark.createDataFrame(rules, RULES), window, overlap).collect()
    assert {(r.image_id, r.rule): r.match_status for r in got} == want and len(got) == len(want)
    assert set(want.values()) == {"match", "mismatch", "absent"}


@pytest.mark.parametrize("window", [64, 1000, 1 << 20])
def test_extract_payload(spark, raws, window):
    paths, raws = raws
    ranges = [(1, 0, 2, 60, 200), (1, 0, 1, 2900, 100), (2, 0, 1, 2900, 101), (3, 1, 1, 640, 5), (3, 1, 2, 640, 0), (4, 2, 1, -1, 5), (5, 9, 1, 0, 5), (6, 0, 1, 0, 900), (7, 1, 1, 100, 64), (7, 1, 2, 100, 64)]
    df = spark.createDataFrame(ranges, "recording_id long, image_id long, seq int, offset long, length long")
    got = {r.recording_id: (r.n_bytes, r.sha256, r.error) for r in records.extract_payload(df, images.read_images(spark, paths, window, 8), 800, window).collect()}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    outside = "range outside image"
    assert got == {1: (300, digest(raws[0][2900:] + raws[0][60:260]), None), 2: (101, None, outside), 3: (5, digest(raws[1][640:645]), None), 4: (5, None, outside), 5: (5, None, outside), 6: (900, None, "over the cap"), 7: (128, digest(raws[1][100:164] * 2), None)}
