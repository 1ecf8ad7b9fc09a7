"""Container walks against a plain loop."""

import random

from tracelake.operators import records


def plain(data, resync):
    out, at = [], 0
    while at + 6 <= len(data):
        if data[at : at + 3] != b"\0\0\1":
            at = data.find(b"\0\0\1", at) if resync else -1
            if at < 0:
                break
            continue
        n = 6 + data[at + 4] * 256 + data[at + 5]
        out.append((at, data[at + 3], n, at + n <= len(data)))
        at += n
    return out


def test_walk_parts(spark):
    rng, rows = random.Random(3), [(0, None), (1, b""), (2, b"\0\0\1")]
    for k in range(30):
        parts = [b"\0\0\1" + bytes([rng.randrange(256), 0, n]) + bytes(n) if rng.random() < 0.8 else b"\5\5" for n in (rng.randrange(20) for _ in range(6))]
        rows.append((10 + k, b"".join(parts)))
    for resync in (True, False):
        got = {}
        for r in records.walk_parts(spark.createDataFrame(rows, "region_id long, data binary"), resync).collect():
            got.setdefault(r.region_id, []).append((r.offset, r.kind, r.length, r.complete))
        assert all(sorted(got.get(i, [])) == plain(d or b"", resync) for i, d in rows)
