"""Cases at the edges: long texts, ties, repeated rows, other row orders, empty tables, clashing names, and the learners against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import SHAPE, frame, rows
from tracelake.llm import bpe, common, components, exact_dedup, lang_id, line_dedup, quality


def labelled(rng, n):
    good = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(20))
    return [good() if k % 2 else " $$$ ".join(good().split()) for k in range(n)], np.array([k % 2 for k in range(n)])


def test_log_count_ratios():
    texts, labels = labelled(random.Random(1), 6)
    seen, counts = np.zeros(1 << quality.BITS, bool), [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        counts[label].update(set(quality.features(text, seen).tolist()))
    total = [sum(c.values()) + (1 << quality.BITS) for c in counts]
    model = quality.fit_rows(texts, labels, 0.5)
    some = list(counts[0].keys() | counts[1].keys())
    ratio = [np.log((counts[1][f] + 1) / total[1]) - np.log((counts[0][f] + 1) / total[0]) for f in some]
    plain = [i for i in range(6) if i % 4 != 3]  # the rows the weights are fitted to, unless a class is missing in one part
    assert {int(labels[i]) for i in range(6) if i % 4 == 3} == {1} and len(plain) == 5
    assert np.allclose(model.scales2[some], np.square(ratio), rtol=1e-4, atol=1e-6)


def test_dual_optimum():
    """The duality gap of the squared hinge loss, from primal and dual written out."""
    rng = np.random.default_rng(3)
    x = [(np.sort(rng.choice(400, 30, replace=False)), rng.normal(size=30)) for _ in range(200)]
    x = [(at, v / np.linalg.norm(v)) for at, v in x]
    y = np.where(rng.random(200) < 0.3, 1.0, -1.0)
    w, alpha, cost = quality._descend(x, y)
    margin = y * np.array([w[at] @ v for at, v in x])
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - margin) ** 2).sum()
    dual = alpha.sum() - 0.5 * w @ w - 0.25 * (alpha**2 / cost).sum()
    own = np.zeros_like(w)
    for a, t, (at, v) in zip(alpha, y, x, strict=True):
        own[at] += a * t * v
    assert np.allclose(own, w) and (alpha >= 0).all() and 0 <= primal - dual < 1e-3


def test_quality_of_long_and_equal_texts(monkeypatch):
    texts, labels = labelled(random.Random(2), 40)
    model = quality.fit_rows(texts, labels, 0.5)
    long = " ".join(texts[1::2]) * 50
    whole = model.scores([long])
    monkeypatch.setattr(quality, "CHUNK", 1000)
    assert np.allclose(model.scores([long]), whole) and model.scores([texts[3], texts[3]])[0] == model.scores([texts[3]])[0]


def test_language_of_long_texts_ties_and_repeats(spark, monkeypatch):
    known = [("en", "the cat sat on the mat"), ("aa", "zzz"), ("bb", "zzz")] + [("de", "der hund")] * 50
    model = lang_id.fit(spark.createDataFrame(known, "lang string, text string"), rows=1)
    assert model.langs == ["aa", "bb", "de", "en"]  # no language is lost, though fifty rows share one text
    _, whole = model.score(["the cat sat " * 500])
    monkeypatch.setattr(lang_id, "CHUNK", 700)
    assert np.allclose(model.score(["the cat sat " * 500])[1], whole, rtol=1e-5)
    docs = frame(spark, [(1, "zzz"), (2, "the cat"), (2, "the cat"), (3, "the cat sat " * 20_000)])
    got = sorted((r.doc_id, r.lang_pred) for r in lang_id.identify(docs, model).collect())
    assert got == [(1, "aa"), (2, "en"), (2, "en"), (3, "en")]


def test_language_sample_is_bound(spark):
    """Equal rows are cut like any others, languages of few rows are whole, and the sample doesn't hang on partitions."""
    rows = [("en", "one text")] * 20_000 + [("de", f"satz {k}") for k in range(3000)] + [("fr", f"mot {k}") for k in range(9)] + [("", "x"), (None, "y"), ("en", None), ("it", "z" * 50)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    picked, langs = lang_id.pick(docs.repartition(7), rows=700, longest=40)
    assert langs == ["de", "en", "fr"]
    assert {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()} == {"en": 700, "de": 700, "fr": 9}
    texts = lambda df: sorted((r.lang, r.text) for r in df.collect())
    assert texts(picked) == texts(lang_id.pick(docs.coalesce(1), rows=700, longest=40)[0])
    assert lang_id.pick(docs.limit(0))[0].count() == 0 and lang_id.fit(docs.limit(0)) is None


def test_lines_near_the_threshold(spark):
    """Counts by brute force in and around the sketch's band, with null sites and a long text."""
    docs = [(100 * n + k, f"line {n}\nown {n} {k}", "en", f"s{k}", 0, "x", "y", "z") for n in (8, 9, 10, 11, 12, 40) for k in range(n)]
    docs += [(9000 + k, "line 9", "en", None, 0, "x", "y", "z") for k in range(5)] + [(9000, "line 9", "en", "s0", 0, "x", "y", "z"), (9100, "word " * 100_000 + "\nline 10", "en", "s0", 0, "x", "y", "z")]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(docs, SHAPE).repartition(5), min_sites=10).collect()
    assert sorted({r.doc_id // 100 for r in got if r.n_removed}) == [10, 11, 12, 40, 91]
    assert next(r for r in got if r.doc_id == 9100).text == "word " * 100_000


def test_one_of_repeated_rows(spark):
    docs = frame(spark, [(1, "a b"), (1, "a  b"), (1, "ab"), (2, "ab"), (3, "other"), (None, "c"), (None, "c"), (4, "")])
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a  b"), ("3", "other"), ("4", ""), ("None", "c")]


def test_filter_lets_others_pass(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "id text").unionByName(spark.createDataFrame([(None, 7)], "doc_id long, text long"))
    ids = common.stored(spark.createDataFrame([(3,), (4999,), (None,)], "k long"), "k")
    straight, maybe = common.apart(docs, docs["doc_id"], ids)
    some = [r.doc_id for r in maybe.collect()]
    assert {3, 4999, None} <= set(some) and len(some) < 50 and straight.count() + len(some) == 5001
    assert sorted(r.doc_id for r in common.drop_ids(docs, ids).collect()) == [k for k in range(4999) if k != 3]


def test_bpe_in_any_order_and_empty(spark, monkeypatch):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = frame(spark, [(k, f"words of text {k % 7} and some more " * (k % 5)) for k in range(200)] + [(3, "x"), (None, "x")])
    want = sorted((str(r.doc_id), list(r.ids)) for r in bpe.bpe_encode(docs, path, pattern).collect())
    monkeypatch.setattr(bpe, "BLOCK", 300)  # many blocks, some of equal content
    from pyspark.sql import functions as F

    shuffled = docs.repartition(7).orderBy(F.rand())
    assert sorted((str(r.doc_id), list(r.ids)) for r in bpe.bpe_encode(shuffled, path, pattern).collect()) == want
    empty = spark.createDataFrame([], SHAPE)
    assert bpe.bpe_decode(bpe.bpe_encode(empty, path, pattern), path).count() == 0


def test_components_of_empty_and_repeated_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    got = components.connected_components(spark.createDataFrame([(1, 2), (2, 1), (2, 2), (5, 4), (4, 5), (7, 7)], "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(1, 1), (2, 1), (4, 4), (5, 4)]


@pytest.mark.parametrize("docs", [[], [(None, "some english words here"), (None, "some english words here"), (None, None), (1, "some english words here"), (2, ""), (3, "other words of english")]])
def test_pipeline_of_odd_tables(spark, tmp_path, docs):
    """An empty table, null ids, repeated rows, and columns whose names clash with those that operators use."""
    extra = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, id string, page long, maybe string"
    table = spark.createDataFrame([(*r, 1, "y") for r in rows(docs)], extra)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame_ = common.stored(stage(spark, frame_, str(tmp_path)), name)
        assert frame_.columns == table.columns
    got = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == (["1", "3"] if docs else [])
