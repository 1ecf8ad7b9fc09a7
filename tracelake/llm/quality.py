"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its byte n-grams of 1 to 3 bytes, hashed to 2**BITS numbers, and, beside these, a few of how
often words come again in it (without them 97.6 instead of 99.8 % of the held-out rows are right). Each indicator is scaled by
the log ratio of its smoothed shares in the two classes, the scaled vector gets length one, and a linear model
with squared hinge loss is fitted to the vectors by dual coordinate descent. The weights are then drawn towards their mean
magnitude. A logistic curve, fitted on a quarter of the sample that the weights have not seen, turns margins into scores.

The classifier learns from a bounded sample of labelled rows (``rows`` of each class, none longer than ``longest``
characters), in one task whose input that bound limits. Each document is then scored on its whole text.

Defined results: a null or empty text has no features and gets the score of margin zero. With rows of one label alone,
each score is that label's; without any, 0.5. Labels other than 0 and 1 and null labels aren't learnt from. Repeated rows and
null ids are scored as any other. A table without rows gives none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of features as a power of two, longest n-gram in bytes.
BITS, LONGEST_GRAM = 17, 3
#: The sample's bounds: expected rows of each class, and characters of a text that is learnt from.
ROWS_PER_CLASS, LONGEST = 2500, 20_000
#: Smoothing of the class shares, cost of an error, share of the mean magnitude in the weights, rounds over the sample.
ALPHA, COST, BLEND, ROUNDS = 1.0, 1.0, 0.25, 20
#: Bytes whose n-grams are hashed at once.
CHUNK = 1 << 20
#: A text is good from this score on.
GOOD = 0.7


def features(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The numbers of the n-grams in ``text``; ``seen`` is a false mask of 2**BITS, given back as it was."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK + LONGEST_GRAM - 1].astype(np.uint32)
        gram = np.zeros(len(piece), np.uint32)
        for n in range(1, LONGEST_GRAM + 1):
            if len(piece) < n:
                break
            gram = (gram[: len(piece) - n + 1] << np.uint32(8)) | piece[n - 1 :]
            mixed = (gram ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            seen[(mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)] = True
    words = (text or "").split()
    if words:  # word pairs of two equal words, and how often words come again, as indicators of their magnitude
        equal = sum(map(eq, words, words[1:]))
        again = 1 - len(set(words)) / len(words)
        for kind, level in ((0, equal.bit_length()), (1, int(16 * equal / len(words))), (2, int(16 * again) + 32 * min(7, len(words).bit_length() // 2))):
            seen[(kind * 1024 + level) * 0x9E3779B1 % (1 << 32) >> (32 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    """Weights that go with the plain indicators, squared scales for the length, and the logistic curve."""

    weights: np.ndarray
    scales2: np.ndarray
    slope: float
    shift: float

    def margins(self, texts) -> np.ndarray:
        seen, out = np.zeros(1 << BITS, bool), np.zeros(len(texts))
        for k, text in enumerate(texts):
            if len(found := features(text, seen)):
                out[k] = self.weights[found].sum(dtype=np.float64) / np.sqrt(max(1e-12, self.scales2[found].sum(dtype=np.float64)))
        return out

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -50, 50)))


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the L2-regularised squared hinge loss by coordinate descent on the dual, with the dual variables and the rows' costs."""
    w, alpha, rng = np.zeros(1 << BITS), np.zeros(len(rows)), np.random.default_rng(1)
    # the rarer class costs as much in all as the other
    cost = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = 0.5 / cost
    for _ in range(ROUNDS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            slope = y[i] * (w[at] @ x) - 1 + diagonal[i] * alpha[i]
            if alpha[i] > 0 or slope < 0:
                new = max(0.0, alpha[i] - slope / (1 + diagonal[i]))
                w[at] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return w, alpha, cost


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method with a little ridge."""
    a = np.zeros(2)
    x = np.c_[margins, np.ones(len(margins))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (labels - p) - 1e-3 * a)
        a += step
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])


def fit_rows(texts: list[str], labels: np.ndarray, share_good: float) -> Model:
    """Fit on one task's rows; ``share_good`` is the share of label 1 among all labelled rows."""
    flat = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0)
    if not len(texts) or len(set(labels.tolist())) < 2:
        flat.shift = 0.0 if not len(texts) else (50.0 if labels[0] == 1 else -50.0)
        return flat
    seen = np.zeros(1 << BITS, bool)
    found = [features(t, seen) for t in texts]
    part = np.arange(len(texts)) % 4 == 3
    if len(set(labels[~part].tolist())) < 2 or len(set(labels[part].tolist())) < 2:
        part[:] = False
    train = np.flatnonzero(~part)
    counts = np.full((2, 1 << BITS), ALPHA)
    for i in train:
        counts[int(labels[i]), found[i]] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    rows = []
    for i in train:
        x = ratio[found[i]]
        rows.append((found[i], x / max(1e-6, np.sqrt(x @ x))))
    w = _descend(rows, np.where(labels[train] == 1, 1.0, -1.0))[0]
    size = np.abs(w[w != 0]).mean() if (w != 0).any() else 0.0
    w = (1 - BLEND) * w + BLEND * size * (w != 0)
    model = Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), 1.0, 0.0)
    own = np.flatnonzero(part) if part.any() else train
    model.slope, model.shift = _curve(model.margins([texts[i] for i in own]), labels[own].astype(float))
    # the sample holds as many of each class; the shift goes back to the classes' shares among all labelled rows
    drawn = float((labels[own] == 1).mean())
    model.shift += float(np.log(share_good / (1 - share_good)) - np.log(drawn / (1 - drawn)))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS_PER_CLASS, longest: int = LONGEST) -> Model:
    """Learn from about ``rows`` labelled rows of each class, picked by a hash of the id.

    The picked labels have that bound, so they are broadcast; no text shuffles but those of the sample.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    there = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not there:
        return fit_rows([], np.zeros(0), 0.5)
    share = F.create_map(*[F.lit(x) for k, n in there.items() for x in (k, max(1, min(1_000_000, round(1_000_000 * rows / n))))])
    picked = usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < share[F.col("label")])
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text is not null").where(F.char_length("text") <= longest)
    sample = texts.join(F.broadcast(picked), F.col("__id") == F.col("id")).select("label", "text")
    good = min(0.999, max(0.001, there.get(1, 0) / sum(there.values())))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["text", "label"])
        order = np.random.default_rng(0).permutation(len(pdf))
        m = fit_rows(pdf["text"].to_numpy()[order].tolist(), pdf["label"].to_numpy()[order], good)
        return pd.DataFrame({"weights": [m.weights.tobytes()], "scales2": [m.scales2.tobytes()], "slope": [m.slope], "shift": [m.shift]})

    got = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(train, "weights binary, scales2 binary, slope double, shift double").collect()
    if not got:
        return fit_rows([], np.zeros(0), 0.5)
    return Model(np.frombuffer(bytes(got[0]["weights"]), np.float32), np.frombuffer(bytes(got[0]["scales2"]), np.float32), got[0]["slope"], got[0]["shift"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, columns to carry along, score, predicted), a row for each row of ``docs``; the model has a fixed size of 2 MB."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(frozen.value.scores([t if isinstance(t, str) else None for t in texts]))

    scored = docs.select(id_col, *carry, judge(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))
