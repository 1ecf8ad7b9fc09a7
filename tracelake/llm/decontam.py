"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

A document's windows have as many words as a benchmark item. A window's fingerprint is the SimHash of its shingles of
five words. The items' fingerprints are cut into five blocks; two fingerprints within RADIUS = 19 bits have a block that
differs in three bits at most, so an index of each item under all such variants of its blocks gives every item within the radius of
a window. Items of the window's size that the index gives are then verified by the exact weighted Jaccard similarity of window
and item, which has to reach ``similarity``. A shingle of the item weighs by how few items of the whole benchmark
hold it, any other as one that no item but one holds.

A window that shares no shingle with the benchmark has similarity zero to all items, so only windows around shared shingles are
fingerprinted; that loses nothing. The benchmark is handled in slices of bounded size, one broadcast at a time. With more than
one slice, a first pass keeps the documents that share a shingle with the whole benchmark, by a bitmap of at most 32 MB, and
only these are searched for each slice.

Words are runs of other than ASCII white space, lower-cased, without ASCII punctuation. An item of fewer words than a
shingle is one shingle itself; an item without words never matches. A document shorter than an item is one window.

Defined results: a null or empty text has no match. Equal items each count. Repeated rows and null ids are judged
as any other. An empty benchmark matches nothing; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, repeat
from math import ceil, log
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PAGE, apart, bitmaps, filter_bits, stored

#: Words in a shingle and the similarity from which a window is the item.
WIDTH, SIMILARITY = 5, 0.8
#: First bit and number of bits of each block, differing bits in a block, and the radius that they guarantee.
BLOCKS, IN_BLOCK = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)), 3
RADIUS = len(BLOCKS) * (IN_BLOCK + 1) - 1
#: Bounds of a slice of the benchmark.
SLICE_ITEMS, SLICE_CHARS = 2000, 8_000_000
_PUNCTUATION = string.punctuation.encode()
_FOUND = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("similarity", T.DoubleType())]))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(None, _PUNCTUATION).split()


def _shingles(own: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(own[k : k + width]) for k in range(len(own) - width + 1)]


def _hash(shingle: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingle, 7)


def _codes(numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs of ``width`` words that are all in the benchmark, with a code of their word numbers."""
    n = len(numbers) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = numbers >= 0
    runs = known[:n].copy()
    for k in range(1, width):
        runs &= known[k : k + n]
    at = np.flatnonzero(runs)
    code = np.zeros(len(at), np.uint64)
    for k in range(width):
        code = (code + numbers[at + k].astype(np.uint64) + np.uint64(1)) * _MIX
    return at, code


class Slice:
    """Some items, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float = SIMILARITY, total: int | None = None, holders: dict[int, int] | None = None):
        """``total`` and ``holders``: the benchmark's number of items with words, and by hash of a shingle how many hold it; without them the slice is the benchmark."""
        self.similarity = similarity
        self.ids, self.sizes, self.shingles = [], [], []
        self.vocabulary: dict[bytes, int] = {}
        codes: dict[int, dict[int, set[int]]] = {}
        for item_id, text in items:
            if own := words(text):
                k, width = len(self.ids), min(WIDTH, len(own))
                self.ids.append(item_id)
                self.sizes.append(len(own))
                self.shingles.append(Counter(_shingles(own, width)))
                numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own])
                for code in _codes(numbers, width)[1].tolist():
                    codes.setdefault(width, {}).setdefault(code, set()).add(k)
        self.codes = {width: (np.array(sorted(by), np.uint64), by) for width, by in codes.items()}
        if holders is None:
            total, holders = len(self.ids), Counter(_hash(s) for own in self.shingles for s in own)
        self.most = log(1 + max(1, total))
        self.weights = [{s: log(1 + total / holders[_hash(s)]) for s in own} for own in self.shingles]
        self.prints = np.array([self._print(own) for own in self.shingles], np.uint64)
        self.index = []
        for first, bits in BLOCKS:
            masks = np.array([sum(1 << b for b in c) for n in range(IN_BLOCK + 1) for c in combinations(range(bits), n)], np.int64)
            values = ((self.prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            keys = (values[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            self.index.append((np.searchsorted(keys[order], np.arange((1 << bits) + 1)), (order // len(masks)).astype(np.int32)))

    def _signs(self, shingles: list[bytes]) -> np.ndarray:
        """Of each shingle 1 or -1 for each bit of its hash."""
        hashes = np.array([_hash(s) for s in shingles], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        return 2 * bits - 1

    def _print(self, own: Counter) -> int:
        total = self._signs(list(own.elements())).sum(axis=0)
        return int(np.packbits(total > 0, bitorder="little").view(np.uint64)[0])

    def near(self, fingerprint: int) -> set[int]:
        """The items within RADIUS bits of a fingerprint."""
        found = np.unique(np.concatenate([at[cuts[v] : cuts[v + 1]] for (cuts, at), (first, bits) in zip(self.index, BLOCKS, strict=True) for v in [(fingerprint >> first) & ((1 << bits) - 1)]]))
        return set(found[np.bitwise_count(self.prints[found] ^ np.uint64(fingerprint)) <= RADIUS].tolist())

    def alike(self, window: Counter, item: int) -> float:
        """Weighted Jaccard similarity; a shingle counts as often as it stands there."""
        other, weights, both, either = self.shingles[item], self.weights[item], 0.0, 0.0
        for s in window.keys() | other.keys():
            a, b, weight = window[s], other[s], weights.get(s, self.most)
            both += weight * min(a, b)
            either += weight * max(a, b)
        return both / either if either else 0.0

    def search(self, text: str | None) -> dict[int, float]:
        """The items that a text holds, by position in the slice, with the best similarity of a window."""
        own = words(text)
        if not own or not self.ids:
            return {}
        numbers = np.fromiter(map(self.vocabulary.get, own, repeat(-1)), np.int32, len(own))
        best: dict[int, float] = {}
        for width, (known, by) in self.codes.items():
            at, codes = _codes(numbers, width)
            there = known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes
            if not there.any():
                continue
            starts: dict[int, set[int]] = {}  # by size of window: where windows around the shingles begin
            for p, code in zip(at[there].tolist(), codes[there].tolist(), strict=True):
                for k in by[code]:
                    size = min(self.sizes[k], len(own))
                    starts.setdefault(size, set()).update(range(max(0, p + width - size), min(p, len(own) - size) + 1))
            for size, where in starts.items():
                of_size = {k for k, n in enumerate(self.sizes) if min(n, len(own)) == size and min(WIDTH, n) == width}
                self._windows(own, width, size, np.array(sorted(where)), of_size, best)
        return {k: s for k, s in best.items() if s >= self.similarity}

    def _windows(self, own: list[bytes], width: int, size: int, where: np.ndarray, of_size: set[int], best: dict[int, float]) -> None:
        """Fingerprint the windows that begin at ``where``, look them up and verify the near items of that size."""
        count = size - width + 1
        for run in np.split(where, np.flatnonzero(np.diff(where) > 1) + 1):
            for at in range(0, len(run), 4096):
                part = run[at : at + 4096]
                shingles = _shingles(own[part[0] : part[-1] + size], width)
                sums = np.vstack([np.zeros(64, np.int64), np.cumsum(self._signs(shingles), axis=0)])
                totals = sums[count : count + len(part)] - sums[: len(part)]
                prints = np.packbits(totals > 0, axis=1, bitorder="little").view(np.uint64).ravel()
                near = [(int((prints[j] ^ self.prints[k]).bit_count()), j, k) for j in range(len(part)) for k in self.near(int(prints[j])) & of_size]
                for _, j, k in sorted(near):
                    if best.get(k, 0.0) < 1.0:
                        best[k] = max(best.get(k, 0.0), self.alike(Counter(shingles[j : j + count]), k))


def _items(batches):
    """(item, text, shingles: hashes of the item's distinct shingles) of the items that have words."""
    for batch in batches:
        for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own := words(text):
                hashes = {_hash(x) - (1 << 63) for x in _shingles(own, min(WIDTH, len(own)))}
                yield pa.RecordBatch.from_pylist([{"item": item, "text": text, "shingles": sorted(hashes)}], pa.schema([("item", pa.int64()), ("text", pa.string()), ("shingles", pa.list_(pa.int64()))]))


def slices(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[int, Iterator[tuple]]:
    """The number of slices, and for each its items, the number of all items, and how many items of the whole benchmark hold each of its shingles."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    rows = stored(rows.mapInArrow(_items, "item long, text string, shingles array<long>"), "items")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")).first()
    n = max(1, ceil(total["n"] / SLICE_ITEMS), ceil((total["chars"] or 0) / SLICE_CHARS))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(n)))
    holders = stored(rows.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).cast("int").alias("n")), "holders")

    def each():
        for k in range(n):
            own = rows.where(F.col("slice") == k)
            items = sorted(((r["item"], r["text"]) for r in own.select("item", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            many = holders.join(own.select(F.explode("shingles").alias("shingle")).distinct(), "shingle").toArrow()
            yield items, total["n"], {x + (1 << 63): y for x, y in zip(many["shingle"].to_pylist(), many["n"].to_pylist(), strict=True)}

    return n, each()


def _searcher(spark: SparkSession, own: tuple, similarity: float):
    rows = spark.sparkContext.broadcast((own[0], similarity, *own[1:]))

    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Slice(*rows.value)
        for texts in batches:
            yield pd.Series([[{"item": own.ids[k], "similarity": s} for k, s in own.search(t if isinstance(t, str) else None).items()] for t in texts])

    return search


def _word_codes(own: list[bytes], width: int) -> np.ndarray:
    """A 64-bit code of each run of ``width`` words, by the words' checksums."""
    numbers = np.fromiter(map(crc32, own), np.uint64, len(own))
    n = len(numbers) - width + 1
    code = np.full(max(0, n), width, np.uint64)
    for k in range(width):
        code = (code + numbers[k : k + n] + np.uint64(1)) * _MIX if n > 0 else code
    return code ^ (code >> np.uint64(32))


def touches(docs: DataFrame, benchmark: DataFrame, text_col: str):
    """A condition on ``docs``: the text shares a shingle with the benchmark, or seems to. The bitmap has 32 MB at most."""
    spark = docs.sparkSession

    def codes(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if own := words(text):
                    width = min(WIDTH, len(own))
                    found = np.unique(_word_codes(own, width))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), width, np.int32)), pa.array(found.view(np.int64))], names=["width", "code"])

    found = stored(benchmark.select(text_col).mapInArrow(codes, "width int, code long").distinct(), "codes")
    widths = sorted(r["width"] for r in found.select("width").distinct().collect())
    bits = filter_bits(found.count())
    pages = bitmaps(found.select(F.col("code").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot"))).collect()
    bitmap = np.zeros((1 << bits) // PAGE * (PAGE // 8), np.uint8)
    for page in pages:
        bitmap[page["page"] * (PAGE // 8) :][: len(page["bitmap"])] = np.frombuffer(bytes(page["bitmap"]), np.uint8)
    there = spark.sparkContext.broadcast((widths, bits, bitmap))

    def one(text) -> bool:
        widths, bits, bitmap = there.value
        own = words(text if isinstance(text, str) else None)
        for width in widths:
            slots = (_word_codes(own, width) & np.uint64((1 << bits) - 1)).astype(np.int64)
            if (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).any():
                return True
        return False

    @F.pandas_udf(T.BooleanType())
    def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=bool)

    return shares(F.col(text_col))


def _found(docs: DataFrame, benchmark: DataFrame, key, text_col: str, similarity: float, item_text: str = "text") -> DataFrame | None:
    """(key, found) of the documents that hold an item of a benchmark of several slices."""
    few = stored(docs.where(touches(docs, benchmark, item_text)).select(key.alias("key"), F.col(text_col).alias("text")).distinct(), "touched")
    out = None
    for own in slices(benchmark)[1]:
        part = stored(few.select("key", _searcher(docs.sparkSession, own, similarity)("text").alias("found")).where(F.size("found") > 0), "found")
        out = part if out is None else out.unionByName(part)
    return stored(out.groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found")), "leaks")


def _key(id_col: str, text_col: str):
    """16 bytes that stand for a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit("")))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs``: id_col, contaminated, n_items, item_ids (sorted), max_similarity (0 if none)."""
    n, each = slices(benchmark)
    if n == 1:
        out = docs.select(F.col(id_col), _searcher(docs.sparkSession, next(each), similarity)(F.col(text_col)).alias("__found"))
    else:
        found = _found(docs, benchmark, _key(id_col, text_col), text_col, similarity)
        rows = docs.select(F.col(id_col), _key(id_col, text_col).alias("__key"))
        out = rows.join(found, F.col("__key") == F.col("key"), "left").select(id_col, F.coalesce("found", F.array().cast(_FOUND)).alias("__found"))
    ids = F.array_sort(F.transform("__found", lambda x: x["item"]))
    best = F.coalesce(F.array_max(F.transform("__found", lambda x: x["similarity"])), F.lit(0.0))
    return out.select(id_col, (F.size("__found") > 0).alias("contaminated"), F.size("__found").cast("long").alias("n_items"), ids.alias("item_ids"), best.alias("max_similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item of the benchmark."""
    n, each = slices(benchmark)
    if n == 1:
        return docs.where(F.size(_searcher(docs.sparkSession, next(each), similarity)(F.col(text_col))) == 0)
    key = _key(id_col, text_col)
    found = _found(docs, benchmark, key, text_col, similarity).select(F.col("key").alias("__key"))
    straight, maybe = apart(docs, key, found)
    return straight.unionByName(maybe.join(found, key == F.col("__key"), "left_anti"))
