"""A gram that stands in very many documents isn't held in one task."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SHAPE, rows, windows
from tracelake.llm import substrings


def documents():
    """A phrase of 60 and one of 130 bytes, each in every document with other words around it."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    short, long = noise(60), noise(130)
    return [(k, noise(rng.randint(80, 150)) + short + noise(rng.randint(80, 150)) + (long if k % 3 == 0 else "") + noise(90)) for k in range(60)]


@pytest.mark.parametrize("bound", [50, 1 << 18])
def test_results(monkeypatch, spark, bound):
    monkeypatch.setattr(substrings, "HEAVY", bound)
    docs = documents()
    got = {r.doc_id: (sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in substrings.remove_repeats(spark.createDataFrame(rows([*docs, docs[7]]), SHAPE).repartition(5)).collect()}
    assert got == windows([(i, t.encode()) for i, t in docs]) and sum(x[0] for x in got.values()) >= 19 * 130


def test_no_group_over_the_bound(monkeypatch, spark):
    monkeypatch.setattr(substrings, "HEAVY", 200)
    texts = spark.createDataFrame(documents(), "key long, text string").repartition(5)
    found = texts.mapInArrow(substrings._find_runs(b"key"), substrings._RUNS)
    compared = found.repartition(F.when(F.col("kind") == 1, F.col("gram")).otherwise(F.col("key"))).sortWithinPartitions(*substrings._ORDER).mapInArrow(substrings._compare_runs, substrings._RUNS)
    runs = compared.where("kind = 2").groupBy("gram").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))
    assert runs.agg(F.max("n")).first()[0] > 1000
    dealt = substrings.undecided_runs(texts, compared).where("bytes is not null")
    assert dealt.groupBy("gram", "part").agg(F.sum(F.octet_length("bytes") - substrings.WINDOW + 1).alias("n")).agg(F.max("n")).first()[0] <= 200


def test_equal_windows_are_sent_once():
    text = documents()[0][1]
    runs = [{"gram": 1, "first": 0, "last": 20, "heavy": True}]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 3, 9]), pa.array([text] * 3), pa.array([runs] * 3)], names=["key", "text", "runs"])
    got = [r for b in substrings._fetch([batch]) for r in b.to_pylist()]
    assert sorted({r["key"] for r in got if r["bytes"] is not None}) == [3, 5]
    assert [(r["key"], r["first"], r["part"]) for r in got if r["bytes"] is None] == [(9, 0, 20)]


def test_texts_made_to_have_one_polynomial_hash(spark):
    """Two texts without a common window whose runs were equal under a polynomial modulo 2**64."""
    one = "eshqxpdzcabsthkescaueonhkuwbbbxoywzeeudgflfsamaisnywqakjofxznreuojgiwtcattmiackmatqugokpseeonxrcjsaejpwadsquvwhwpafonipsqcfuwvxenaheyvbcgbaemmjrimfgckbdizcxccrvbgslmifqecxtpsid"
    two = "ashqxpdzcbbsthkescaueonhkuwabbxoywzeaudgflfsemaisnywqekjofxznrauojgiwtcattmiackmatqugokpseeonxrcjsaejpwaasquvwhwpcfonipsqcauwvxenahayvbcgbaammjrimfgakbdizcxcarvbgslmiaqecxtpsia"
    docs = spark.createDataFrame([(1, one), (2, two), (3, two)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: len(r.kept) for r in substrings.remove_repeats(docs).collect()} == {1: 176, 2: 176, 3: 0}
