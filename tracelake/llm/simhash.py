"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints at 3 or fewer differing bits have a
segment that differs in at most one, so they share that segment whole or with one bit wiped out. Each distinct
fingerprint is indexed under its 2 whole segments and 64 one-wildcard variants; an equality shuffle on the variant brings
the candidates together, and each is verified on all 64 bits.

Buckets of more than ``limit`` fingerprints are dealt out again by variants of the other 32 bits (two halves of 16, one of
which differs in at most one bit). What meets there shares all but 17 bits at most, so such a bucket has a bound.
Within a bucket a search over not yet reached fingerprints gives a spanning forest, never all pairs.

Defined results: a null or empty text, or one of white space alone, has fingerprint zero and is linked like any
other. Rows with equal fingerprints are in one component, repeated rows and ids included. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, stored
from .components import connected_components

RADIUS = 3
#: Distinct fingerprints in a bucket, above which it is dealt out again.
LIMIT = 2048
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text as an unsigned number; words by ASCII white space, A-Z lower-cased."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h64(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist()
        hashes = [h64(joined[i:j], 42) for i, j in zip(first, last, strict=True)]
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(raw[k : k + CHUNK], axis=1, bitorder="little").sum(axis=0, dtype=np.int32) for k in range(0, len(raw), CHUNK))
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _variants(fp, tag=None):
    """Index keys of 64-bit values: the segment's number, the wildcard (32: none) and the bits that are left."""
    segments = [fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)]
    return F.array(*[s.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << k) if k < 32 else 0xFFFFFFFF)).bitwiseOR(F.lit((n << 38) | (k << 32))) for n, s in enumerate(segments) for k in range(33)])


def _finer(key: int, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For a large bucket: second keys by the halves of the other segment, each whole and with one bit wiped out."""
    other = (fps >> np.uint64(0 if key >> 38 else 32)) & np.uint64(0xFFFFFFFF)
    for half in (0, 1):
        bits = (other >> np.uint64(16 * half)) & np.uint64(0xFFFF)
        for k in range(17):
            yield bits & np.uint64(0xFFFF & ~(1 << k) if k < 16 else 0xFFFF) | np.uint64((half << 21) | (k << 16)), fps


def _reach(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all of ``fps`` which reach each other in steps of RADIUS bits."""
    out, rest = [], np.unique(fps)
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        root = todo[0]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= RADIUS
            if near.any():
                found = rest[near]
                out += [(root, x) for x in found]
                todo += list(found)
                rest = rest[~near]
    return out


def _rows(kind: int, key, finer, a, b) -> pa.RecordBatch:
    signed = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(np.full(len(a), key, np.int64)), signed(finer), signed(a), signed(b)], names=["kind", "key", "finer", "a", "b"])


def _bucket_links(limit: int | None):
    """Of rows sorted by key: links of each bucket; of a bucket above ``limit`` its rows with finer keys."""

    def settle(key: int, fps: np.ndarray):
        if limit is not None and len(fps) > limit:
            for finer, same in _finer(key, fps):
                yield _rows(1, key, finer, same, same)
        elif got := _reach(fps):
            yield _rows(0, 0, np.zeros(len(got), np.uint64), *zip(*got, strict=True))

    def links(batches):
        keys, fps, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None  # what is held back is the last bucket so far
        for batch in batches:
            new = batch.column(0).to_numpy()
            if batch.num_columns > 2:
                new = new * np.int64(1_000_003) + batch.column(2).to_numpy()  # keys that fall together only add candidates
            keys, fps = np.concatenate([keys, new]), np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            if large is not None:  # more of a bucket that was passed on already
                n = int((keys == large).argmin()) if not (keys == large).all() else len(keys)
                if n:
                    for finer, same in _finer(large, fps[:n]):
                        yield _rows(1, large, finer, same, same)
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                large = None
            starts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1]
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[:-1][sizes[:-1] == 2]
            a, b = fps[two], fps[two + 1]
            near = np.bitwise_count(a ^ b) <= RADIUS
            if near.any():
                yield _rows(0, 0, np.zeros(int(near.sum()), np.uint64), a[near], b[near])
            for g in np.flatnonzero(sizes[:-1] > 2):
                yield from settle(int(keys[starts[g]]), fps[starts[g] : starts[g] + sizes[g]])
            keys, fps = keys[starts[-1] :], fps[starts[-1] :]
            if limit is not None and len(fps) > limit:
                large = int(keys[0])
                yield from settle(large, fps)
                keys, fps = keys[:0], fps[:0]
        if len(fps) > 1:
            yield from settle(int(keys[0]), fps)

    return links


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): links among the distinct values of the long column ``fp`` that join all within reach of each other."""
    shape = "kind byte, key long, finer long, a long, b long"
    keyed = fps.select(F.explode(_variants(F.col("fp"))).alias("key"), "fp")
    first = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(limit), shape), "buckets")
    finer = first.where("kind = 1").select("key", F.col("a").alias("fp"), "finer").repartition("key", "finer").sortWithinPartitions("key", "finer")
    second = finer.mapInArrow(_bucket_links(None), shape)
    return first.where("kind = 0").select("a", "b").unionByName(second.select("a", "b"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row for each row of ``docs``: id_col, fingerprint (16 hex digits), component_id (the smallest id in reach)."""
    shared_dir(docs.sparkSession)
    rows = stored(docs.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("fp")), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(links(fps.select("fp"), limit))
    labelled = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("component_id"))
    found = labelled.join(smallest, F.col("root") == F.col("__root")).select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(found, F.col("fp") == F.col("__fp")).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
