"""URL filter: rules by host and path first, then the ratio of two character language models.

A rule (host, path, verdict) fits a URL of its host or of any subdomain whose path begins with the rule's path; the longest
rule wins. URLs that rules decide are the labels of the method: one variable-order Markov model learns the bytes of allowed
URLs, one those of blocked ones, from all such URLs but a held-out fifth. A URL's score is the difference of its two
log-likelihoods by symbol, less the threshold that the held-out fifth calibrates; from 0 on it is allowed.

A model has the contexts of 0 to ``ORDER`` bytes that a symbol follows often enough: a gram (context and symbol) is kept if it
holds at least one in ``SHARE`` of its class's symbols. So there are ``SHARE`` grams at most of each length and class, however
large the corpus is, all counts are over all URLs, and the rule is the same at every size. The probability of a symbol is
interpolated from the shortest context to the longest (Witten and Bell): what a context's kept symbols leave, and one count for
each of them, goes to the next shorter context, in the end to 257 equally likely symbols (256 bytes and the end).

Counting shuffles the distinct grams of each task; scoring is one narrow pass with the models broadcast (30 MB at most).

Defined results: a null URL counts as empty; it has neither host nor path. Repeated rows count as often as they stand and stay
as they are, whatever their ids. If no URL is allowed by rules or none is blocked, there is no ratio: scores are null and URLs
without a rule are allowed. A table without rows gives none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Longest context in bytes; one in so many symbols of its class a gram must hold.
ORDER, SHARE = 5, 50_000
#: Bytes that UTF-8 never has: before a URL's first symbol, and its end.
BEGIN, END = b"\xff" * ORDER, b"\xfe"
#: Symbols that are worked on at once; one in so many labelled URLs calibrates; bins of the scores for one unit, and the range they cover.
PIECE, HELD_OUT, BINS, RANGE = 1_000_000, 5, 1024, 16


def host_of(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host, path, verdict) that fits, then of the one with the longest host; null if none does.

    Rules are taken into the plan one by one, so this is for a list of some hundred at most.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _keys(urls: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some symbols at a time the numbers of their rows, and the symbols with the ``ORDER`` bytes before them as one number, the symbol's byte last."""
    rows, parts, size = [], [], 0

    def made():
        data = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        row = np.repeat(np.array(rows, np.int64), lengths)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        own = np.flatnonzero(np.arange(len(data)) - first >= ORDER)
        for k in range(0, len(own), PIECE):
            at, key = own[k : k + PIECE], 0
            for back in range(ORDER, -1, -1):
                key = (key << np.int64(8)) | data[at - back].astype(np.int64)
            yield row[at], key

    for k, url in enumerate(urls):
        rows.append(k)
        parts.append(BEGIN + (url or "").encode("utf-8", "replace") + END)
        size += len(parts[-1])
        if size >= PIECE:
            yield from made()
            rows, parts, size = [], [], 0
    if rows:
        yield from made()


def _count(batches):
    """Grams of ``ORDER`` + 1 bytes with how often they stand in allowed and in blocked URLs."""
    for batch in batches:
        allowed = np.array(batch.column(1).to_pylist(), bool)
        for row, key in _keys(batch.column(0).to_pylist()):
            grams, place = np.unique(key, return_inverse=True)
            n = [np.bincount(place[allowed[row] == kind], minlength=len(grams)) for kind in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(grams), *map(pa.array, n)], names=["gram", "n0", "n1"])


@dataclass
class UrlModel:
    """For each class and length, kept grams with their counts, and contexts with (what goes to the shorter one, 1) over their total; the threshold."""

    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    contexts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    threshold: float = 0.0

    def _log_likelihood(self, keys: np.ndarray, kind: int) -> np.ndarray:
        p = np.full(len(keys), 1 / 257)
        for length in range(1, ORDER + 2):
            own, n = self.grams[kind, length]
            before, rest, one = self.contexts[kind, length]
            if len(before):
                there, at = _found(before, (keys >> 8) & ((1 << 8 * (length - 1)) - 1))
                seen, place = _found(own, keys & ((1 << 8 * length) - 1))
                p = np.where(there, np.where(seen, n[place], 0) * one[at] + rest[at] * p, p)
        return np.log(p)

    def raw_scores(self, urls: list) -> np.ndarray:
        """Difference of the log-likelihoods by symbol, the end being one."""
        total, n = np.zeros(len(urls)), np.zeros(len(urls))
        for row, key in _keys(urls):
            distinct, place = np.unique(key, return_inverse=True)
            ratio = self._log_likelihood(distinct, 0) - self._log_likelihood(distinct, 1)
            total += np.bincount(row, ratio[place], len(urls))
            n += np.bincount(row, minlength=len(urls))
        return total / n


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and a place in it, the key's own if it is."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def raw_score(df: DataFrame, model: UrlModel) -> Column:
    """The raw score of the column ``url``, in one narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(shared.value.raw_scores(urls.tolist()), dtype=float)

    return scores(F.coalesce(F.col("url"), F.lit("")))


def _learn(labelled: DataFrame) -> UrlModel | None:
    """The two models of URLs (url, allowed); None if a class has no URL."""
    counts = stored(labelled.mapInArrow(_count, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    totals = counts.agg(F.sum("n0"), F.sum("n1")).first()
    if not all(totals):
        return None
    length = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("length")
    ends = counts.select(length, "gram", "n0", "n1").withColumn("gram", F.expr("gram & (shiftleft(1L, 8 * length) - 1)"))
    by_length = stored(ends.groupBy("length", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    # a kept gram counts what it holds, another nothing
    kept = [F.when(F.col(f"n{k}") * SHARE >= total, F.col(f"n{k}")).otherwise(0) for k, total in enumerate(totals)]
    rows = by_length.withColumns({f"k{k}": c for k, c in enumerate(kept)})
    grams = rows.where("k0 > 0 or k1 > 0").select("length", "gram", "k0", "k1").toPandas()
    sums = [x for k in (0, 1) for x in (F.sum(f"n{k}").alias(f"n{k}"), F.sum(f"k{k}").alias(f"k{k}"), F.count_if(F.col(f"k{k}") > 0).alias(f"d{k}"))]
    contexts = rows.groupBy("length", F.shiftright("gram", 8).alias("context")).agg(*sums).where("d0 > 0 or d1 > 0").toPandas()
    model = UrlModel({}, {})
    for kind in (0, 1):
        for n in range(1, ORDER + 2):
            own = grams[(grams["length"] == n) & (grams[f"k{kind}"] > 0)].sort_values("gram")
            model.grams[kind, n] = own["gram"].to_numpy(), own[f"k{kind}"].to_numpy(float)
            before = contexts[(contexts["length"] == n) & (contexts[f"d{kind}"] > 0)].sort_values("context")
            all_, seen, types = (before[f"{c}{kind}"].to_numpy(float) for c in "nkd")
            model.contexts[kind, n] = before["context"].to_numpy(), (all_ - seen + types) / (all_ + types), 1 / (all_ + types)
    return model


def calibrate(bins: list[tuple[int, bool, int]]) -> float:
    """The score from which URLs are allowed, out of (bin of scores, allowed, number of URLs).

    It is the edge of a bin with the least sum of the two shares that come out wrong; of several in one stretch, the middle. 0 if a class is missing.
    """
    lo, hi = min((b for b, _, _ in bins), default=0), max((b for b, _, _ in bins), default=0)
    n = np.zeros((2, hi - lo + 2))
    for b, allowed, count in bins:
        n[0 if allowed else 1, b - lo] += count
    total = n.sum(axis=1)
    if not total.all():
        return 0.0
    below = np.c_[[0, 0], np.cumsum(n, axis=1)][:, :-1] / total[:, None]  # share below each edge
    wrong = np.round(below[0] + 1 - below[1], 12)
    best = int(np.argmin(wrong))
    last = best + int(np.argmin(np.r_[wrong[best:] == wrong[best], False])) - 1
    return (lo + (best + last) / 2) / BINS


def fit(labelled: DataFrame) -> UrlModel | None:
    """The model of all URLs (url, allowed: boolean, null ones are left out); None if one kind is missing.

    Equal URLs fall together into the part that is learnt or into the part that calibrates.
    """
    rows = labelled.where("allowed is not null").select(F.coalesce(F.col("url"), F.lit("")).alias("url"), "allowed")
    fold = F.crc32(F.col("url").cast("binary")) % HELD_OUT
    model = _learn(rows.where(fold != 0))
    if model is not None:
        held = rows.where(fold == 0)
        place = F.floor(F.greatest(F.least(raw_score(held, model), F.lit(RANGE)), F.lit(-RANGE)) * BINS).cast("int")
        model.threshold = calibrate([tuple(r) for r in held.groupBy(place.alias("place"), "allowed").count().collect()])
    return model


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each row of ``pages``: id_col, host, path, rule (host and path of the one that decided, or null), verdict (allow or block), score."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    judged = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    model = fit(judged.select("url", (F.col("found.verdict") == "allow").alias("allowed")))
    score = F.lit(None).cast("double") if model is None else raw_score(judged, model) - model.threshold
    judged = judged.withColumn("score", score)
    by_model = F.when(F.coalesce(F.col("score") >= 0, F.lit(True)), "allow").otherwise("block")
    return judged.select(F.col("__id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_model).alias("verdict"), "score")
