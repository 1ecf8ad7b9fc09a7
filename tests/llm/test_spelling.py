"""Spelling variants against all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tracelake.llm import spelling

SCHEMA = "doc_id long, text string"


def plain(rows, divisor=199, least=6, often=5, times=5):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= often}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = [], {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if v != w and near(w, v))
        if close and -close[0][0] >= times * n:
            form[w] = close[0][1]
        out.append((w, n, len(close)))

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, m, words[form[w]] if w in form else None) for w, n, m in out)


def grouped(docs, **more):
    return sorted((tuple(r) for r in spelling.group_variants(docs, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_random_words_against_all_pairs(spark):
    rnd, rows = random.Random(2), []
    stems = ["".join(rnd.choice("abÀé") for _ in range(rnd.randrange(5, 9))) for _ in range(12)]
    for k in range(400):
        words = []
        for _ in range(rnd.randrange(30)):
            w = rnd.choice(stems[: rnd.randrange(1, 13)])
            if rnd.random() < 0.35:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "a", "é", "Z", "b"]) + w[at + rnd.randrange(2) :]
            words.append(w)
        rows.append((k if k % 50 else None, rnd.choice([" ", ", ", "×" if k % 7 == 0 else "-", "\n"]).join(words) if k % 41 else None))
    got = grouped(spark.createDataFrame(rows, SCHEMA).repartition(3), divisor=7)
    assert got == plain(rows, divisor=7) and any(r[1] for r in got)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = grouped(docs)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()]) and len(got) > 100


def test_ways_of_many_steps_lead_to_the_last_form(spark):
    words = ["abcdefg" + "h" * k for k in range(5)]
    rows = [(k, f"{w} " * 5 ** (k + 1)) for k, w in enumerate(words)]
    assert {r[2] for r in grouped(spark.createDataFrame(rows, SCHEMA), divisor=1 << 40)} == {words[-1]}


def test_very_long_words_and_pieces(spark, monkeypatch):
    rnd = random.Random(3)
    long = "".join(rnd.choice("abc") for _ in range(20_000))
    rows = [(1, f"{long} " * 30), (2, f"{long[:777] + long[778:]} " * 6), (3, f"{long[:50] + 'z' + long[51:]} " * 5), (4, f"{'x' * 45} {'x' * 46} {'x' * 39} {'x' * 40} " * 5)]
    got = {r[0]: r for r in grouped(spark.createDataFrame(rows, SCHEMA), divisor=1 << 40)}
    assert len(got) == 7 and got[long][4] == 2 and all(got[w][1] == long for w in (long[:777] + long[778:], long[:50] + "z" + long[51:]))
    assert got["x" * 45][4] == got["x" * 39][4] == 1


def test_hashes_of_edits_are_those_of_the_edited_words():
    found = ["abcab", "é", "zzzz", "abcdefghij"]
    own = spelling._Words(found)
    flat = [(w, k) for w, word in enumerate(found) for k in range(len(word))]
    places = np.arange(len(flat))
    assert own.without(places).tolist() == spelling._Words([found[w][:k] + found[w][k + 1 :] for w, k in flat]).whole.tolist()
    assert own.replaced(places, np.full(len(flat), ord("q"), np.uint64)).tolist() == spelling._Words([found[w][:k] + "q" + found[w][k + 1 :] for w, k in flat]).whole.tolist()


@pytest.mark.parametrize("bits", [9, 12])
def test_full_filters_change_nothing(spark, monkeypatch, bits):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = grouped(docs)
    monkeypatch.setattr(spelling, "MAX_BITS", bits)
    assert grouped(docs) == whole


def test_empty_tables_and_clashing_columns(spark):
    assert grouped(spark.createDataFrame([], SCHEMA)) == []
    docs = spark.createDataFrame([(1, "Lantern lantern lantern LANTERN lantern")], SCHEMA).selectExpr("*", "1 as word", "2 as n", "3 as run", "4 as id", "5 as h")
    assert grouped(docs, divisor=1 << 40) == [("lantern", None, "lantern", 5, 0, None)]
