"""Spelling variants: words that differ by one inserted, deleted or replaced character, and the frequent form each stands for.

Words are counted over all texts. A word's neighbourhood is generated, not searched: each letter deleted, and each letter
replaced by a later one of the alphabet (the other pairs are found from their other word). A candidate is looked up in Bloom
filters of the vocabulary, one for each length, whose blocks of 64 bytes hold all bits of a word; the filters are broadcast (32 MB
at most). Only candidates that pass shuffle, to an exact join with the vocabulary, which takes away those that passed by chance.
Beyond some 17 million words the filters get denser: more candidates shuffle, the result is exact at any size.

Defined results: a null text has no words, a null id counts as the empty string. Repeated rows count again. Words of any
length are compared, their candidates being made in pieces. A table without rows gives none. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BITS, PAGE, bitmaps, stored

#: Letters of a run, A-Z being lower-cased; least length of a word, least number of its occurrences, and how many times as often its form must occur.
LETTERS, LEAST, OFTEN, TIMES = "a-zÀ-ÿ", 6, 5, 5
#: Words from this length on share one filter; bits of a block; bits that a word sets; filter bits for each word.
LONG, BLOCK, SET, BITS_PER_WORD = 40, 512, 4, 16
#: Candidates that are made at once.
PIECE = 2_000_000
#: The odd base of the words' hash, its inverse modulo 2**64, and the factors that mix it.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 199, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n) of the maximal runs of letters with at least ``least`` characters and ``often`` occurrences.

    Of a run whose CRC-32 of ``id:run`` is divisible by ``divisor`` one character is deleted, the one at that CRC modulo the length.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # a run shorter than a word can't become one
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"([A-Z{LETTERS}]{{{least},}})"), F.lit(1))
    rows = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run")))
    rows = rows.withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % divisor == 0, shorter).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


class _Words:
    """Words as one array of characters, with what is needed to hash any edit of them."""

    def __init__(self, found: list[str]):
        self.codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.first = np.cumsum(self.lengths) - self.lengths
        self.word = np.repeat(np.arange(len(found)), self.lengths)
        self.at = np.arange(len(self.codes)) - self.first[self.word]
        self.power = np.r_[np.uint64(1), np.full(int(self.lengths.max(initial=0)), BASE)].cumprod(dtype=np.uint64)
        self.upto = np.r_[np.uint64(0), np.cumsum(self.codes * self.power[self.at], dtype=np.uint64)]
        self.whole = self.upto[self.first + self.lengths] - self.upto[self.first]

    def without(self, k: np.ndarray) -> np.ndarray:
        """Hashes of the words without their character ``k`` (a place in the array)."""
        begin, end = self.first[self.word[k]], self.first[self.word[k]] + self.lengths[self.word[k]]
        return self.upto[k] - self.upto[begin] + (self.upto[end] - self.upto[k + 1]) * INVERSE

    def replaced(self, k: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Hashes of the words with another character at ``k``."""
        return self.whole[self.word[k]] + (letter - self.codes[k]) * self.power[self.at[k]]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), MIX, strict=True):
        h = (h ^ (h >> np.uint64(shift))) * factor
    return h ^ (h >> np.uint64(31))


class Shards:
    """Where the filter of each length lies: its first block and its number of blocks, a power of two."""

    def __init__(self, counts: dict[int, int]):
        bits = {n: max(0, math.ceil(math.log2(max(1, c * BITS_PER_WORD / BLOCK)))) for n, c in counts.items()}
        while sum(1 << b for b in bits.values()) * BLOCK > 1 << MAX_BITS and any(bits.values()):
            bits = {n: max(0, b - 1) for n, b in bits.items()}
        self.first, self.bits, blocks = np.full(LONG + 1, -1, np.int64), np.zeros(LONG + 1, np.uint64), 0
        for n, b in sorted(bits.items()):
            self.first[n], self.bits[n] = blocks, b
            blocks += 1 << b
        self.size = blocks * BLOCK

    def blocks(self, lengths: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The first slot of the block that a word of this length and mixed hash has; below 0 where no word is that long."""
        n = np.minimum(lengths, LONG)
        # a shift by 64 isn't defined, so by one and then by the rest
        block = ((h >> np.uint64(1)) >> (np.uint64(63) - self.bits[n])).astype(np.int64)
        return np.where(self.first[n] < 0, -1, (self.first[n] + block) * BLOCK)


def _bit(h: np.ndarray, k: int) -> np.ndarray:
    """The place in its block of the bit number ``k`` that a mixed hash sets."""
    return ((h >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)).astype(np.int64)


def _bits(shards: Shards):
    def bits(batches):
        for batch in batches:
            own = _Words(batch.column(0).to_pylist())
            h = _mixed(own.whole)
            blocks = shards.blocks(own.lengths, h)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([blocks + _bit(h, k) for k in range(SET)]))], names=["slot"])

    return bits


def _probe(shards: Shards, filters, alphabet: str):
    """For words (word, n), the candidates that the filters let pass: (word, n, near)."""
    letters = np.array(sorted(map(ord, alphabet)), np.uint64)

    def passing(lengths, h):
        """Places of the hashes whose bits are all set; the later bits are looked at only for those that have the earlier ones."""
        h = _mixed(h)
        blocks = shards.blocks(lengths, h)
        left = np.flatnonzero(blocks >= 0)
        for k in range(SET):
            slot = blocks[left] + _bit(h[left], k)
            left = left[(filters.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
        return left

    def edits(found: list[str], own: _Words):
        step = max(1, PIECE // (len(letters) + 1))
        for k in range(0, len(own.codes), step):
            places = np.arange(k, min(k + step, len(own.codes)))
            # of equal letters in a row the first stands for all: the words without one of them are equal
            fresh = places[(own.at[places] == 0) | (own.codes[places] != own.codes[np.maximum(places - 1, 0)])]
            for p in fresh[passing(own.lengths[own.word[fresh]] - 1, own.without(fresh))].tolist():
                w, at = own.word[p], own.at[p]
                yield w, found[w][:at] + found[w][at + 1 :]
            later = np.searchsorted(letters, own.codes[places], "right")
            many = len(letters) - later
            at = np.repeat(places, many)
            letter = letters[np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(later, many)]
            good = passing(own.lengths[own.word[at]], own.replaced(at, letter))
            for p, c in zip(at[good].tolist(), letter[good].tolist(), strict=True):
                w, i = own.word[p], own.at[p]
                yield w, found[w][:i] + chr(c) + found[w][i + 1 :]

    def probe(batches):
        for batch in batches:
            found, n = batch.column(0).to_pylist(), batch.column(1)
            hits = list(edits(found, _Words(found)))
            which = pa.array([w for w, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), n.take(which), pa.array([x for _, x in hits], pa.string())], names=["word", "n", "near"])

    return probe


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all pairs of the vocabulary (word, n: distinct, stored) that one edit sets apart, each pair both ways."""
    spark = vocabulary.sparkSession
    counts = dict(vocabulary.groupBy(F.least(F.char_length("word"), F.lit(LONG))).count().collect())
    shards = Shards(counts)
    slots = vocabulary.select("word").mapInArrow(_bits(shards), "slot long")
    filters = np.zeros(-(-max(shards.size, 1) // PAGE) * PAGE // 8, np.uint8)
    for page, bitmap in bitmaps(slots).collect():
        filters[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(bitmap, np.uint8)
    alphabet = "".join(r[0] for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect())
    probe = _probe(shards, spark.sparkContext.broadcast(filters), alphabet)
    maybe = vocabulary.select("word", "n").mapInArrow(probe, "word string, n long, near string")
    pairs = maybe.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    ways = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(ways))


def roots(forms: DataFrame, n_max: int, times: int = TIMES) -> DataFrame:
    """(word, root) of forms (word, form): the last form that is reached, by doubled pointers.

    A form occurs ``times`` as often as its word, so a way has log(n_max) steps to that base at most.
    """
    steps = max(1, math.ceil(math.log(max(n_max, 2), times)))
    to = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = stored(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return to


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 199, least: int = LEAST, often: int = OFTEN, times: int = TIMES) -> DataFrame:
    """A row for each word of at least ``least`` characters and ``often`` occurrences: word, n, form, form_n, root, n_near.

    The form is the word's near word of largest count, then first in code-point order, if it occurs ``times`` as often; the root
    is the last word that forms lead to, or the word itself.
    """
    vocabulary = stored(words(docs, id_col, text_col, divisor, least, often), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    near = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    frequent = -F.col("best.minus") >= times * F.col("n")
    rows = vocabulary.join(near, "word", "left").select("word", "n", F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    rows = stored(rows, "variants")
    n_max = rows.agg(F.max("n")).first()[0] or 0
    to = roots(rows.where("form is not null"), n_max, times)
    return rows.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))
