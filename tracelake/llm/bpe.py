"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens once. Each task writes, for blocks of some MB of text, the block's distinct words and, for each
text, the positions where they stand, as a sequence of word numbers. The distinct words are dealt out by a hash of the word over
the whole cluster, those of one block and hash bucket packed in one row. Equal words of all blocks meet in one bucket, where
each is encoded once; the ids go back to every block that asked for them, and each block puts its texts together again by
position. Decoding looks each id up in the token-byte table, which has a fixed size and is broadcast.

Both the words and the positions are read from the written blocks, so neither the order of the input nor a lost executor
can set them apart. Words that come often in a block have low numbers, which makes the positions compress well.

Defined results: a null text counts as empty and has no ids. Repeated rows and ids stay as they are, null ids
too. A table without rows gives none. Other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Characters of text in a block, a longer text being a block of its own.
BLOCK = 32_000_000
#: Tokens that are put together at once.
TOKENS = 300_000
#: Least number of buckets that words are dealt into, and blocks for each bucket beyond that.
BUCKETS, BLOCKS_PER_BUCKET = 64, 128
#: A block's texts sort behind its buckets of words.
LAST = (1 << 31) - 1

_BLOCKS = "block long, doc_ids array<long>, sizes array<int>, positions binary, n_words int, words binary"
_WORDS = "bucket int, block long, numbers binary, words binary"
_IDS = "block long, bucket int, numbers binary, ids binary"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ids."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    return [ranks[k] for k in range(len(ranks))]


@lru_cache(maxsize=4)
def _encoding(pattern: str, tokens: tuple[bytes, ...]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})


def _pack(*arrays: np.ndarray) -> bytes:
    """int32 arrays, each as compressed byte planes."""
    import zstandard

    planes = [x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    head = np.array([len(p) for p in planes], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(planes))


def _unpack(packed: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    ends = 8 * n + np.r_[0, np.cumsum(data[: 8 * n].view("<i8"))]
    return [np.ascontiguousarray(data[i:j].reshape(4, -1).T).view("<i4").ravel() for i, j in zip(ends, ends[1:], strict=False)]


def _row(schema: str, **values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values[name]], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _pack_words(words: list[bytes]) -> bytes:
    import zstandard

    lengths = _pack(np.fromiter(map(len, words), np.int32, len(words)))
    return len(lengths).to_bytes(8, "little") + lengths + zstandard.ZstdCompressor(level=6).compress(b"".join(words))


def _unpack_words(packed: bytes) -> list[bytes]:
    import zstandard

    n = 8 + int.from_bytes(packed[:8], "little")
    (lengths,) = _unpack(packed[8:n], 1)
    joined, ends = zstandard.ZstdDecompressor().decompress(packed[n:]), np.cumsum(lengths).tolist()
    return [joined[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _cut(pattern: str):
    """Blocks of texts: their distinct words, and the texts as numbers of those words."""

    def cut(batches):
        import regex

        find = regex.compile(pattern).findall
        first, made = TaskContext.get().partitionId() << 32, 0

        def fresh():
            words = defaultdict()
            words.default_factory = words.__len__
            return words

        def close():
            raw = [w.encode("utf-8", "replace") for w in words]
            all_ = np.concatenate(found)
            # frequent words first, by powers of two; words of one class in order, so that they compress well
            rare = -np.log2(np.bincount(all_, minlength=len(raw)).clip(1)).astype(np.int32)
            order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
            order = order[np.argsort(rare[order], kind="stable")]
            number = np.empty(len(raw), np.int32)
            number[order] = np.arange(len(raw), dtype=np.int32)
            return _row(_BLOCKS, block=first + made, doc_ids=ids, sizes=sizes, positions=_pack(number[all_]), n_words=len(raw), words=_pack_words([raw[i] for i in order]))

        chars, ids, sizes, found, words = 0, [], [], [], fresh()
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.fromiter(map(words.__getitem__, find(text or "")), np.int32)
                ids.append(doc_id)
                sizes.append(len(own))
                found.append(own)
                chars += len(text or "")
                if chars >= BLOCK:
                    yield close()
                    made += 1
                    chars, ids, sizes, found, words = 0, [], [], [], fresh()
        if ids:
            yield close()

    return cut


def _deal(buckets: int):
    """A block's distinct words by bucket, with their numbers."""

    def deal(batches):
        for batch in batches:
            for block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _unpack_words(packed)
                own = np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(own, kind="stable")
                cuts = np.r_[0, np.flatnonzero(np.diff(own[order])) + 1, len(order)] if len(order) else [0]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    some = order[i:j]
                    yield _row(_WORDS, bucket=own[some[0]], block=block, numbers=_pack(np.diff(some, prepend=0)), words=_pack_words([words[k] for k in some]))

    return deal


def _encode(pattern: str, table):
    """Of rows sorted by bucket, so that all equal words come together: each distinct word is encoded once."""

    def encode(batches):
        encoding, at, known = _encoding(pattern, tuple(table.value)), None, {}
        for batch in batches:
            for bucket, block, numbers, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                out = []
                for word in _unpack_words(packed):
                    if (ids := known.get(word)) is None:
                        ids = known[word] = encoding.encode_ordinary(word.decode("utf-8"))
                    out.append(ids)
                counts = np.fromiter(map(len, out), np.int32, len(out))
                yield _row(_IDS, block=block, bucket=bucket, numbers=numbers, ids=_pack(counts, np.fromiter(chain.from_iterable(out), np.int32)))

    return encode


def _assemble(tokens=None):
    """Of rows sorted by block and bucket, a block's texts last: the ids of each text in order, and the bytes that ``tokens`` has for them."""

    def assemble(batches):
        for doc_ids, offsets, ids in _put_together(batches):
            columns = {"id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))}
            if tokens is not None:
                columns["decoded"] = pa.array(_decoded(tokens.value, offsets, ids), pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return assemble


def _decoded(table: list[bytes], offsets, ids: np.ndarray) -> list[bytes]:
    """For each list of ids the bytes of its tokens."""
    found = list(map(table.__getitem__, ids.tolist()))
    return [b"".join(found[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)]


def _put_together(batches):
    at, numbers, counts, ids = None, [], [], []
    for batch in batches:
        for block, bucket, own, packed, doc_ids, sizes, positions, n_words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != at:
                at, numbers, counts, ids = block, [], [], []
            if bucket != LAST:
                numbers.append(np.cumsum(_unpack(own, 1)[0]))
                some = _unpack(packed, 2)
                counts.append(some[0])
                ids.append(some[1])
                continue
            (positions,) = _unpack(positions, 1)
            all_ = np.concatenate([np.zeros(0, np.int64), *numbers])
            if n_words != len(all_):
                raise RuntimeError("a block's words did not all come back")
            came = np.concatenate([np.zeros(0, np.int64), *counts])
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            lengths, starts = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
            lengths[all_], starts[all_] = came, np.cumsum(came) - came
            ends = np.r_[0, np.cumsum(np.array(sizes, np.int64))]
            first = 0
            while first < len(sizes):  # some of the block's texts at a time
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + TOKENS, "right")) - 1)
                own = positions[ends[first] : ends[last]]
                many = lengths[own]
                before = np.r_[0, np.cumsum(many)]
                take = np.repeat(starts[own] - before[:-1], many) + np.arange(before[-1])
                offsets = before[ends[first : last + 1] - ends[first]]
                yield doc_ids[first:last], offsets, flat[take]
                first = last


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids: array of int), a row for each row of ``docs``; with ``decoded`` also the bytes that the ids stand for.

    That is ``bpe_decode`` within the tasks that put the ids together, for a round trip.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(read_ranks(ranks_path))
    blocks = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut(pattern), _BLOCKS), "blocks")
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count() // BLOCKS_PER_BUCKET)
    words = blocks.select("block", "words").mapInArrow(_deal(buckets), _WORDS)
    encoded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode(pattern, table), _IDS)
    texts = blocks.select("block", F.lit(LAST).alias("bucket"), "doc_ids", "sizes", "positions", "n_words")
    both = encoded.unionByName(texts, allowMissingColumns=True)
    by_block = both.repartition("block").sortWithinPartitions("block", "bucket")
    shape = "id long, ids array<int>" + ", decoded binary" * decoded
    return by_block.mapInArrow(_assemble(table if decoded else None), shape).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that the ids stand for; null ids give no bytes."""
    spark: SparkSession = encoded.sparkSession
    table = spark.sparkContext.broadcast(read_ranks(ranks_path))
    names = encoded.columns

    def decode(batches):
        for batch in batches:
            lists = batch.column(names.index(ids_col)).fill_null([])
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_decoded(table.value, offsets, ids), pa.binary())], names=[*names, "decoded"])

    shape = T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(decode, shape)


def ids_digest(ids):
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
