"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes: how often each byte followed each context of 0 to ORDER
bytes. The statistics are counted in Spark over a bounded sample of labelled rows and then frozen. A text's code length
under a language is the sum over its bytes of -log2 of the probability in the longest known context; a byte new to
a context costs an escape, q / (n + q) for a context seen n times with q different bytes, and falls back to the next
shorter context, at last to 1/256. The language with the shortest code wins; the score is its posterior.

The frozen trees of all languages are one table for each order: the bytes of a context and its next byte as
a number, and the finished code length in each language. So a byte of text takes one look-up, whatever the number of languages.

Defined results: a null text, an empty one or one without letters is ``und`` with score 0. Ties go to the language
that sorts first. Without any labelled row each text is ``und``. Repeated rows and null ids are scored as any other. Rows with
a null or empty label aren't learnt from. A table without rows gives none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Longest context in bytes.
ORDER = 4
#: The sample's bounds: most rows of each language, and the longest text (in characters) that is learnt from.
ROWS_PER_LANGUAGE, LONGEST = 700, 20_000
#: Bytes that are scored at once.
CHUNK = 1 << 18
#: Bits of a draw.
DRAW_BITS = 48
UNKNOWN = "und"


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte after the first ORDER the number of its ``order`` bytes of context and itself."""
    n = len(data) - ORDER
    out = data[ORDER:].astype(np.int64)
    for k in range(1, order + 1):
        out |= data[ORDER - k : ORDER - k + n].astype(np.int64) << (8 * k)
    return out


def _padded(text: str) -> np.ndarray:
    return np.frombuffer(b"\n" * ORDER + text.encode("utf-8", "replace"), np.uint8)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            for k in range(0, len(texts), 200):
                data = [_padded(t) for t in texts.iloc[k : k + 200]]
                for order in range(ORDER + 1):
                    grams, counts = np.unique(np.concatenate([_grams(d, order) for d in data]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "depth": np.int32(order), "gram": grams, "n": counts})


class _Table:
    """Open addressing: numbers to row numbers, -1 where there is none."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, slots = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slots] == -1
            _, first = np.unique(slots[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slots[put]], self.rows[slots[put]] = keys[left[put]], left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slots = left[stay], (slots[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.rows[slots], -1)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.rows[slots[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


@dataclass
class Model:
    """Frozen trees: for each order the grams with their bits, and the contexts with their escape's bits, by language."""

    langs: list[str]
    grams: list[_Table]
    bits: list[np.ndarray]
    contexts: list[_Table]
    escapes: list[np.ndarray]

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ORDER in each language."""
        rows = self.grams[ORDER].find(full := _grams(data, ORDER))
        out = self.bits[ORDER][rows]
        for order in range(ORDER, 0, -1):
            if order == ORDER:
                left = np.flatnonzero(rows < 0)
                out[left] = 0
            if not len(left):
                break
            context = self.contexts[order].find((full[left] >> 8) & ((1 << (8 * order)) - 1))
            known = context >= 0
            out[left[known]] += self.escapes[order][context[known]]
            shorter = self.grams[order - 1].find(full[left] & ((1 << (8 * order)) - 1))
            known = shorter >= 0
            out[left[known]] += self.bits[order - 1][shorter[known]]
            left = left[~known]
        if len(left := left if len(rows) else []):
            out[left] += self.escapes[0][0] + 8.0
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its bytes and its bits in each language; null counts as empty."""
        sizes, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        group, length = [], 0

        def close():
            data = np.concatenate([d for _, d in group])
            # the padding stands between texts; what is predicted there is left out
            bits = np.vstack([np.zeros((ORDER, len(self.langs)), np.float32), self.code_lengths(data)])
            starts = np.cumsum([0, *(len(d) for _, d in group)])
            for start, (k, d) in zip(starts, group, strict=False):
                total[k] += bits[start + ORDER : start + len(d)].sum(axis=0, dtype=np.float64)

        for k, text in enumerate(texts):
            data = _padded(text or "")
            sizes[k] = len(data) - ORDER
            for at in range(0, max(1, len(data) - ORDER), CHUNK):
                piece = data[at : at + CHUNK + ORDER]
                group.append((k, piece))
                length += len(piece)
                if length >= CHUNK:
                    close()
                    group, length = [], 0
        if group:
            close()
        return sizes, total


def _build(langs: list[str], counts: pd.DataFrame) -> Model:
    grams, bits, contexts, escapes = [], [], [], []
    for order in range(ORDER + 1):
        own = counts[counts["depth"] == order]
        keys = np.unique(own["gram"].to_numpy(np.int64))
        ctx = np.unique(keys >> 8)
        cost, esc = np.zeros((len(keys), len(langs))), np.zeros((max(1, len(ctx)), len(langs)))
        lower = np.full((len(keys), len(langs)), 8.0) if order == 0 else bits[-1][grams[-1].find(keys & ((1 << (8 * order)) - 1))]
        for k in range(len(langs)):
            part = own[own["lang"] == k]
            g, n = part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.float64)
            at = np.searchsorted(ctx, g >> 8)
            times, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
            seen = kinds > 0
            esc[: len(ctx)][seen, k] = -np.log2(kinds[seen] / (times + kinds)[seen])
            cost[:, k] = lower[:, k] + esc[np.searchsorted(ctx, keys >> 8), k]
            cost[np.searchsorted(keys, g), k] = -np.log2(n / (times + kinds)[at])
        grams.append(_Table(keys))
        contexts.append(_Table(ctx))
        bits.append(cost)
        escapes.append(esc)
    return Model(langs, grams, [b.astype(np.float32) for b in bits], contexts, [e.astype(np.float32) for e in escapes])


def pick(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE, longest: int = LONGEST) -> tuple[DataFrame, list[str]]:
    """The sample and its languages: (lang, text) of the ``rows`` rows of each language with the smallest hashes of their text, of all if there are fewer.

    Texts longer than ``longest`` characters, null and empty ones, and those of no language aren't picked. Equal texts have one hash; the bound cuts them too.
    """
    usable = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and lang <> '' and text is not null").where(F.char_length("text").between(1, longest))
    usable = usable.withColumn("draw", F.shiftrightunsigned(F.xxhash64("text"), 64 - DRAW_BITS))
    there = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()
    # twice the rows by expectation, so that hardly more than the sample is ranked; at least the smallest draw, so that a language of few texts isn't lost
    share = {r["lang"]: max(r["least"] + 1, min(1 << DRAW_BITS, (2 * rows + 100 << DRAW_BITS) // r["n"])) for r in there}
    most = F.create_map(*[x for lang, at in share.items() for x in (F.lit(lang), F.lit(at).cast("long"))]) if share else F.lit(None).cast("map<string,bigint>")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    return usable.where(F.col("draw") < most[F.col("lang")]).withColumn("place", place).where(F.col("place") <= rows).select("lang", "text"), sorted(share)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE, longest: int = LONGEST) -> Model | None:
    """The frozen trees of the languages in ``labelled``, None if it has no language. Learns from the rows that ``pick`` picks."""
    sample, langs = pick(labelled, text_col, lang_col, rows, longest)
    if not langs:
        return None
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])
    counts = sample.withColumn("lang", number[F.col("lang")]).mapInPandas(_count, "lang int, depth int, gram long, n long").groupBy("lang", "depth", "gram").agg(F.sum("n").cast("int").alias("n"))
    counts = counts.toArrow().to_pandas()
    if not len(counts):
        return None
    seen = sorted(counts["lang"].unique())
    return _build([langs[k] for k in seen], counts.assign(lang=np.searchsorted(seen, counts["lang"])))


def predictions(model: Model | None, texts: list[str | None]) -> pd.DataFrame:
    """lang_pred, score and bits_per_byte of the winner."""
    out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts)), "bits_per_byte": np.zeros(len(texts))})
    lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    if model is None or not lettered.any():
        return out
    sizes, bits = model.score([t if ok else None for t, ok in zip(texts, lettered, strict=True)])
    best = bits.argmin(axis=1)
    gap = np.clip(bits - bits.min(axis=1, keepdims=True), 0, 1000)
    out.loc[lettered, "lang_pred"] = np.array(model.langs, object)[best][lettered]
    out.loc[lettered, "score"] = (1 / np.exp2(-gap).sum(axis=1))[lettered]
    out.loc[lettered, "bits_per_byte"] = (bits.min(axis=1) / np.maximum(sizes, 1))[lettered]
    return out


_SHAPE = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])


def predictor(spark, model: Model | None):
    """A function from a text column to struct(lang_pred, score, bits_per_byte); the model's size is bound by fit's sample."""
    frozen = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_SHAPE)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predictions(frozen.value, [t if isinstance(t, str) else None for t in texts])

    return predict


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, columns to carry along, lang_pred, score, bits_per_byte), a row for each row of ``docs``."""
    found = predictor(docs.sparkSession, model)(F.col(text_col))
    return docs.select(id_col, *carry, found.alias("__found")).select(id_col, *carry, "__found.*")


def accepts(spark, model: Model | None, least_score: float):
    """A function from a text column to whether the text has a language with at least ``least_score``; without a model all with letters have."""
    frozen = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.BooleanType())
    def accept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            texts = [t if isinstance(t, str) else None for t in column]
            if frozen.value is None:
                yield pd.Series([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            else:
                found = predictions(frozen.value, texts)
                yield (found["lang_pred"] != UNKNOWN) & (found["score"] >= least_score)

    return accept
