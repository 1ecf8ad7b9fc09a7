"""Recovery that scans, against a search by hand: any window, unreadable windows, budgets."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import decode, detect, scan

CHUNKS = "image_id long, base_offset long, owned_len long, data binary"
RECORDS = "image_id long, offset long, length long, accessible boolean"


def frame(n, kind=0xFD, good=True, declared=None):
    body = b"y" * (n - 32)
    head = b"DHAV" + bytes([kind, 0, 2, 0]) + (7).to_bytes(4, "little") + (declared or n).to_bytes(4, "little") + ((24 << 26) | (5 << 22) | (10 << 17) | 5).to_bytes(4, "little") + bytes(4)
    return head + body + (b"dhav" if good else b"nope") + (n - 8).to_bytes(4, "little")


def image(seed, n=40):
    rng, data, at = random.Random(seed), b"", []
    for _ in range(n):
        data += b"z" * rng.randrange(0, 90)
        size, kind, good, declared = rng.randrange(40, 120), rng.choice([0xFD, 0xFC, 9]), rng.random() < 0.8, rng.choice([None, None, None, 1 << 30])
        at.append((len(data), kind in (0xFD, 0xFC), good and declared is None))
        data += frame(size, kind, good, declared)
    return data, at


def cut(spark, raws, window, broken=()):
    rows = [(i, b, min(window, len(d) - b), None if (i, b // window) in broken else bytearray(d[b : b + window + 8])) for i, d in raws.items() for b in range(0, len(d), window)]
    return spark.createDataFrame(rows, CHUNKS)


def by_hand(at, size, claims, available, scope, skipped=()):
    """State of each frame: claims and available are disjoint (lo, hi); skipped are (lo, hi) of targets that can't be read."""
    out = {}
    for place, known, good in at:
        if not known or any(lo <= place < hi for lo, hi in skipped):
            continue
        if not good:
            state = "Corrupted"
        elif any(lo <= place < hi for lo, hi in claims):
            state = "Active"
        elif any(lo <= place < hi for lo, hi in available):
            state = "Deleted"
        else:
            state = "Orphaned" if scope and scope[0] <= place < scope[1] else "Unindexed"
        out[place] = state
    return out


@pytest.fixture(scope="module")
def images():
    return {i: image(i) for i in range(3)}


def search(spark, images, window, broken=(), **bounds):
    raws = {i: d for i, (d, _) in images.items()}
    chunks = cut(spark, raws, window, broken)
    records = spark.createDataFrame([(0, 100, 900, True), (0, 1500, 700, False), (1, 0, 600, True)], RECORDS)
    scope = spark.createDataFrame([(0, 0, 2500), (1, 0, 1 << 40)], "image_id long, offset long, length long")
    found, report = scan.scan_recovery(chunks, decode.image_sizes(chunks), records, scope, window, **bounds)
    return {i: {r.offset: r.data_state for r in found.where(f"image_id = {i}").collect()} for i in images}, {r.image_id: r for r in report.collect()}


LAYOUT = {0: ([(100, 1000)], [(1500, 2200)], (0, 2500)), 1: ([(0, 600)], [], (0, 1 << 40)), 2: ([], [], None)}


@pytest.mark.parametrize("window", [64, 1000, 1 << 20])
def test_any_window(spark, images, window):
    found, report = search(spark, images, window)
    for i, (data, at) in images.items():
        want = by_hand(at, len(data), *LAYOUT[i])
        assert found[i] == want and want
        r = report[i]
        assert (r.bytes, r.n_skipped, r.truncated, r.state, r.n_candidates) == (len(data), 0, False, "PASS", len(want))
        assert r.n_corrupted == sum(s == "Corrupted" for s in want.values()) == r.n_candidates - r.n_valid


def test_unreadable_and_bounds(spark, images):
    """The window at 1600 of image 0 can't be read: the freed range is skipped, all else is searched."""
    found, report = search(spark, images, 200, {(0, 8)})
    data, at = images[0]
    want = by_hand(at, len(data), *LAYOUT[0], skipped=[(1500, 2200)])
    cut_off = {p for p, _, _ in at if p < 1500 and p + 120 > 1600}
    assert {p: s for p, s in found[0].items() if p not in cut_off} == {p: s for p, s in want.items() if p not in cut_off}
    assert (report[0].n_skipped, report[0].bytes_skipped, report[0].state) == (1, 700, "PASS")
    _, report = search(spark, images, 1000, max_bytes=1100)
    assert report[0].truncated and report[0].state == "REVIEW" and report[0].bytes == 1000


def test_empty(spark):
    none = spark.createDataFrame([], CHUNKS)
    found, report = scan.scan_recovery(none, decode.image_sizes(none), spark.createDataFrame([], RECORDS), spark.createDataFrame([], "image_id long, offset long, length long"), 64)
    assert found.count() == 0 and report.count() == 0


def test_hits_are_grouped_where_they_met_their_targets(spark):
    hits = spark.createDataFrame([(0, 10, b"a"), (0, 99, b"b"), (0, 70_000, b"c")], "image_id long, offset long, head binary")
    targets = spark.createDataFrame([(0, "available", 0, 90_000), (0, "claimed", 5, 10), (1, "claimed", 0, 10)], "image_id long, kind string, offset long, length long")
    found = scan.place_hits(hits, targets.hint("merge"))
    assert sorted(tuple(r) for r in found.select("image_id", "offset", "target", F.hex("head")).collect()) == [(0, 10, "claimed", "61"), (0, 99, "available", "62"), (0, 70_000, "available", "63")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_many_rules_are_met_without_lists(spark):
    """Rules beyond the bits of one long, met in several windows of an image."""
    rules = [("v", f"r{k}", b"%03d" % k, "exact", k * 3, None, 1, "validated", 1.0, False) for k in range(130)]
    rules = spark.createDataFrame(rules, "vendor string, rule string, pattern binary, kind string, at long, stop long, step long, state string, weight double, exclusive boolean")
    data = {0: b"".join(b"%03d" % k if k % 5 else b"---" for k in range(130)), 1: b"000"}
    chunks = spark.createDataFrame([(i, at, min(64, len(d) - at), bytearray(d[at : at + 72])) for i, d in data.items() for at in range(0, len(d), 64)], "image_id long, base_offset long, owned_len long, data binary")
    found = detect.evaluate_rules(chunks, rules, 64, 8)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.image_id, int(r.rule[1:])): r.match_status for r in found.collect()}
    assert got == {(i, k): "absent" if i and k else "match" if i or k % 5 else "mismatch" for i in data for k in range(130)}
