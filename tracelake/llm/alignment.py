"""Alignment of two tokenizers' tokens over the same bytes, and how often two tokens stand for each other in a corpus.

A is byte-level BPE and gets a space and the text, B is a piece BPE and gets the text, before which it puts a space itself. Every
token points to the token of the other side that reaches farthest right of those it overlaps; the pointers are doubled for all tokens
at once until they stay, and then name the last token of each token's group. Two tokens that overlap are linked.

Both sides always end a token before a space that follows a character which is no white space (checked for B's vocabulary when
it is loaded). So a text is cut there into units, and each block of texts encodes and aligns its distinct units once; a document's
tokens, groups and links are those of its units. Blocks are written with the pairs of ids that each document has linked. Documents
are counted for each pair over all blocks, the counts are joined to the blocks that asked for them, and each block sums them up.

Defined results: a document has no tokens if its text is null or empty or if the bytes of A's or B's tokens aren't those of space
and text. Ids may be of any type, null or repeated; each row counts as a document. A table without rows gives none. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import _pack, _unpack
from .common import stored

#: Characters of text in a block, a longer text being a block of its own; characters that are encoded in one call; units of documents worked on at once.
BLOCK, CALL, UNITS = 8_000_000, 20_000, 200_000
#: A pair of ids as one number: A's id above B's.
B_BITS = 32

#: Before a space behind another character than white space, unless only spaces follow; and what tells that not all single spaces are such places.
_CUT, _ODD = re.compile(r"(?<=\S)(?= )(?! +\Z)"), re.compile(r"\s | \Z")
_TOTALS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_level(token: str) -> bytes:
    """The bytes of a byte-level token: printable Latin-1 characters stand for themselves, the others of the 256, in order, for 256 and up."""
    return bytes(map(_byte_of().__getitem__, token))


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """The two tokenizers, out of the bytes of their files, and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_buffer(a_file), sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.a.encode_special_tokens = True
        self.a_bytes = [b""] * self.a.get_vocab_size()
        special = self.a.get_added_tokens_decoder()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = token.encode() if k in special else byte_level(token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        #: Whether B's tokens end before each space behind another character.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def units(self, text: str) -> list[str]:
        """The units of space and text, each without its first character, the space."""
        if not self.cuts:
            return [text]
        if not _ODD.search(" " + text):
            return text.split(" ")
        return [u[1:] for u in _CUT.split(" " + text)]

    def encode(self, units: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A's and B's ids of all units, each with the numbers of ids of each unit; a unit whose bytes don't come back has none.

        Units that end without white space go in calls of many.
        """
        units_of, ids_of, counts_of = [], ([], []), ([], [])

        def settle(ks: list[int]):
            text = "".join(" " + units[k] for k in ks)
            found = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
            tokens = [list(map(table.__getitem__, ids)) for table, ids in zip((self.a_bytes, self.b_bytes), found, strict=True)]
            if b"".join(tokens[0]) == text.encode() == b"".join(tokens[1]):
                ends = np.cumsum([len(units[k].encode()) + 1 for k in ks])
                units_of.append(ks)
                for ids, own, all_ids, counts in zip(found, tokens, ids_of, counts_of, strict=True):
                    all_ids.append(np.array(ids, np.int32))
                    counts.append(np.diff(np.searchsorted(np.cumsum(list(map(len, own))), ends, "right"), prepend=0))
            elif len(ks) > 1:
                for k in ks:
                    settle([k])

        call, size = [], 0
        for k, unit in enumerate(units):
            if not self.cuts or not unit or unit[-1].isspace():
                settle([k])
                continue
            call.append(k)
            size += len(unit) + 1
            if size > CALL:
                settle(call)
                call, size = [], 0
        if call:
            settle(call)
        which = np.array([k for ks in units_of for k in ks], np.int64)
        out = []
        for ids, counts in zip(ids_of, counts_of, strict=True):
            ids, counts = np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])
            n = np.zeros(len(units), np.int64)
            n[which] = counts
            out.append((ids[np.argsort(np.repeat(which, counts), kind="stable")], n))
        return tuple(out)


@lru_cache(maxsize=2)
def _loaded(a_file: bytes, b_file: bytes) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def group_labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B, given where they end, the last token of A in its group; both sides end at the same place.

    Pointers: to the other side's token that holds a token's last byte, which is the overlapping one that reaches farthest right.
    A token of A that ends together with one of B points to itself.
    """
    n = len(a_ends)
    to_b, to_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    to = np.concatenate([np.where(b_ends[to_b] > a_ends, n + to_b, np.arange(n)), to_a]) if n else np.zeros(0, np.int64)
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            return to[:n], to[n:]
        to = farther


class _Units:
    """A block's distinct units: their tokens, groups and links."""

    def __init__(self, units: list[str], tokenizers: Tokenizers):
        (a_ids, self.n_a), (b_ids, self.n_b) = tokenizers.encode(units)
        self.good = self.n_a > 0
        a_ends, b_ends = np.cumsum(tokenizers.a_sizes[a_ids]), np.cumsum(tokenizers.b_sizes[b_ids])
        a_last, b_last = group_labels(a_ends, b_ends)
        last = np.unique(a_last)
        unit_of_a = np.repeat(np.arange(len(units)), self.n_a)
        self.n_groups = np.bincount(unit_of_a[last], minlength=len(units))
        # a link is a stretch between two neighbouring ends of either side: two tokens overlap in one stretch
        ends = np.union1d(a_ends, b_ends)
        on_a, on_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        self.pairs, link_pair = np.unique((a_ids[on_a].astype(np.int64) << B_BITS) | b_ids[on_b], return_inverse=True)
        self.link_pair = link_pair.astype(np.int32)
        self.n_links = np.bincount(unit_of_a[on_a], minlength=len(units))
        self.first_link = np.cumsum(self.n_links) - self.n_links
        names = tokenizers.names
        self.texts = self._texts([names[k] for k in a_ids], [names[k] for k in b_ids], (last + 1).tolist(), np.searchsorted(b_last, last, "right").tolist())

    def _texts(self, a_ids: list[str], b_ids: list[str], a_upto: list[int], b_upto: list[int]) -> list[str]:
        """Each unit's groups as text."""
        groups = [",".join(a_ids[i:j]) + "|" + ",".join(b_ids[k:m]) for i, j, k, m in zip([0, *a_upto], a_upto, [0, *b_upto], b_upto, strict=False)]
        upto = np.cumsum(self.n_groups).tolist()
        return [";".join(groups[i:j]) for i, j in zip([0, *upto], upto, strict=False)]


def _close(ids: list, sizes: list[int], numbers: list[np.ndarray], units: list[str], tokenizers: Tokenizers, block: int, id_type) -> pa.RecordBatch:
    """A block's row: totals and texts of its documents, the pairs that each has linked and how often, and for each pair its documents."""
    own = _Units(units, tokenizers)
    flat, upto = np.concatenate([np.zeros(0, np.int32), *numbers]), np.cumsum(np.array(sizes, np.int64))
    totals, digests, n_pairs, linked, times = {t: [] for t in _TOTALS}, [], [], [], []
    holding, first = np.zeros(len(own.pairs), np.int64), 0
    while first < len(sizes):  # some documents at a time
        begin = upto[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(upto, begin + UNITS, "right")))
        u, doc = flat[begin : upto[last - 1]], np.repeat(np.arange(last - first), sizes[first:last])
        good = np.bincount(doc[~own.good[u]], minlength=last - first) == 0
        good &= np.array(sizes[first:last]) > 0
        digests += [hashlib.sha256(";".join(map(own.texts.__getitem__, u[j - n - begin : j - begin].tolist())).encode()).hexdigest() if ok else "" for n, j, ok in zip(sizes[first:last], upto[first:last].tolist(), good, strict=True)]
        u, doc = u[good[doc]], doc[good[doc]]
        for t in _TOTALS:
            totals[t].append(np.bincount(doc, getattr(own, t)[u], last - first).astype(np.int64))
        many = own.n_links[u]
        link = np.arange(many.sum()) + np.repeat(own.first_link[u] - np.cumsum(many) + many, many)
        key, n = np.unique(np.repeat(doc, many) * len(own.pairs) + own.link_pair[link], return_counts=True)
        pair = key % max(1, len(own.pairs))
        n_pairs.append(np.bincount(key // max(1, len(own.pairs)), minlength=last - first))
        linked.append(pair.astype(np.int32))
        times.append(n.astype(np.int32))
        holding += np.bincount(pair, minlength=len(own.pairs))
        first = last
    # a pair that only documents without tokens have has no count
    columns = {"block": pa.array([block]), "ids": pa.array([ids], pa.list_(id_type)), **{t: pa.array([np.concatenate(x)], pa.list_(pa.int64())) for t, x in totals.items()}, "digests": pa.array([digests]), "n_pairs": pa.array([np.concatenate(n_pairs)], pa.list_(pa.int64())), "linked": pa.array([_pack(np.concatenate(linked), np.concatenate(times))], pa.binary()), "pairs": pa.array([own.pairs], pa.list_(pa.int64())), "holding": pa.array([holding], pa.list_(pa.int64()))}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _align(files):
    def align(batches):
        tokenizers, made, first = _loaded(*files.value), 0, TaskContext.get().partitionId() << 32
        chars, ids, sizes, numbers, units, id_type = 0, [], [], [], None, None

        def fresh():
            units = defaultdict()
            units.default_factory = units.__len__
            return units

        units = fresh()
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.fromiter(map(units.__getitem__, tokenizers.units(text) if text else ()), np.int32)
                ids.append(doc_id)
                sizes.append(len(own))
                numbers.append(own)
                chars += len(text or "")
                if chars >= BLOCK:
                    yield _close(ids, sizes, numbers, list(units), tokenizers, first + made, id_type)
                    made += 1
                    chars, ids, sizes, numbers, units = 0, [], [], [], fresh()
        if ids:
            yield _close(ids, sizes, numbers, list(units), tokenizers, first + made, id_type)

    return align


def _sum_up(batches):
    """Of a block with the counts of its pairs, in their order: each document's row."""
    for batch in batches:
        for row in range(batch.num_rows):
            values = lambda name: batch.column(name)[row].values
            linked, times = _unpack(batch.column("linked")[row].as_py(), 2)
            n_pairs = values("n_pairs").to_numpy()
            doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
            counts, best = ([] if batch.column(c)[row].as_py() is None else values(c).to_numpy(zero_copy_only=False) for c in ("counts", "best"))
            if len(linked) and len(counts) <= linked.max():
                raise RuntimeError("the counts of a block's pairs did not all come back")
            sums = list(map(pa.array, _sums(doc, len(n_pairs), times, linked, counts, best)))
            yield pa.RecordBatch.from_arrays([values("ids"), *map(values, _TOTALS), *sums, values("digests")], names=["id", *_TOTALS, "n_best", "count_sum", "digest"])


def _sums(doc, n_docs, times, linked, counts, best):
    """Links whose pair is the best of its id, and the sum of the links' counts, of each document."""
    for weight in (np.asarray(best, np.int64), np.asarray(counts, np.int64)):
        upto = np.r_[0, np.cumsum(times * weight[linked])] if len(linked) else np.zeros(1, np.int64)
        ends = np.searchsorted(doc, np.arange(n_docs), "right")
        yield np.diff(upto[ends], prepend=0)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id_col, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is the number of documents that hold its pair of ids linked; ``n_best`` are the links whose count is the highest of
    their A id. The digest is of the groups in order, ``a1,a2|b1;a3|b2,b3``; empty for a document without tokens.
    """
    blocks = stored(aligned_blocks(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = pair_counts(blocks)
    best = F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", B_BITS)))
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(counts.withColumn("best", best), "pair", "left")
    by_block = asked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(False)).alias("best")))).alias("found"))
    by_block = by_block.select("block", F.col("found.n").alias("counts"), F.col("found.best").alias("best"))
    kind = docs.schema[id_col].dataType
    shape = T.StructType([T.StructField("id", kind), *[T.StructField(t, T.LongType()) for t in (*_TOTALS, "n_best", "count_sum")], T.StructField("digest", T.StringType())])
    joined = blocks.drop("pairs", "holding").join(by_block, "block", "left")
    return joined.mapInArrow(_sum_up, shape).withColumnsRenamed({"id": id_col, "digest": "groups_sha256"})


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with their totals, linked pairs and digests; the files are read on the driver and broadcast (some MB)."""
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as file:
            files.append(file.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(files))
    many = T.ArrayType(T.LongType())
    shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *[T.StructField(t, many) for t in _TOTALS], T.StructField("digests", T.ArrayType(T.StringType())), T.StructField("n_pairs", many), T.StructField("linked", T.BinaryType()), T.StructField("pairs", many), T.StructField("holding", many)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_align(shared), shape)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n) of the pairs that documents hold linked, n being the number of those documents."""
    rows = blocks.select(F.explode(F.arrays_zip("pairs", "holding")).alias("p")).select("p.pairs", "p.holding").where("holding > 0")
    return rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holding").alias("n"))
