"""Differences of nested values by path."""

import pytest

from tracelake.operators import quality

SHAPE = "k long, s struct<a:struct<b:array<struct<c:int,d:string>>>,e:double>, m map<string,array<int>>, plain string"


def differences(spark, left, right, shape=SHAPE, other=None):
    found = quality.diff_results(spark.createDataFrame(left, shape), spark.createDataFrame(right, other or shape), ["k"])
    return sorted(((r.k, r.path, r.left, r.right) for r in found.collect()), key=str)


def row(k=1, b=((1, "x"), (2, "y")), e=0.5, m=None, plain="p"):
    return (k, ((list(b) if b is not None else None,), e), {"u": [1, 2]} if m is None else m, plain)


@pytest.mark.parametrize(("left", "right", "want"), [
    (row(), row(), []),
    (row(), row(b=((1, "x"), (3, "y"))), [("s.a.b[1].c", '{"v":2}', '{"v":3}')]),
    (row(), row(b=((1, "x"),)), [("s.a.b[1].c", '{"v":2}', None), ("s.a.b[1].d", '{"v":"y"}', None)]),
    (row(b=()), row(b=((1, None),)), [("s.a.b", '{"v":[]}', None), ("s.a.b[0].c", None, '{"v":1}'), ("s.a.b[0].d", None, "{}")]),
    (row(b=None), row(b=()), [("s.a.b", "{}", '{"v":[]}')]),
    (row(), row(m={"u": [1, 5], "w": []}), [("m.u[1]", '{"v":2}', '{"v":5}'), ("m.w", None, '{"v":[]}')]),
    (row(), row(e=None, plain=None), [("plain", '{"v":"p"}', "{}"), ("s.e", '{"v":0.5}', "{}")]),
    (row(), (1, None, {"u": [1, 2]}, "p"), [("s", None, "{}"), ("s.a.b[0].c", '{"v":1}', None), ("s.a.b[0].d", '{"v":"x"}', None), ("s.a.b[1].c", '{"v":2}', None), ("s.a.b[1].d", '{"v":"y"}', None), ("s.e", '{"v":0.5}', None)]),
])
def test_paths(spark, left, right, want):
    assert differences(spark, [left], [right]) == sorted(((1, *w) for w in want), key=str)


def test_rows_and_types(spark):
    assert differences(spark, [row(), row(2), row(None)], [row(), row(3)]) == sorted([(2, "(row)", "there", None), (None, "(row)", "there", None), (3, "(row)", None, "there")], key=str)
    assert differences(spark, [(1, 5)], [(1, [5])], "k long, v int", "k long, v array<int>") == sorted([(1, "v", '{"v":5}', None), (1, "v[0]", None, '{"v":5}')], key=str)
    assert differences(spark, [(1, 5)], [(1, 5)], "k long, `a.b` int") == []
    assert differences(spark, [], [], "k long, v int") == []
    assert differences(spark, [(1,)], [(2,)], "k long") == sorted([(1, "(row)", "there", None), (2, "(row)", None, "there")], key=str)
