"""The URL filter against plain dicts of counts."""

import math
import random
from collections import Counter
from zlib import crc32

import pytest

from tracelake.llm import queries, url_filter

SCHEMA = "page_id long, url string"
RULES = queries.URL_RULES


def split(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_of(host, path):
    fit = [(len(h + p), h, h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def plain(rows):
    """(page_id, host, path, rule, verdict) and the scores, by dicts."""
    order, share = url_filter.ORDER, url_filter.SHARE
    counts = [Counter(), Counter()]

    def grams(url):
        data = url_filter.BEGIN + (url or "").encode() + url_filter.END
        return [data[k - order : k + 1] for k in range(order, len(data))]

    judged = [(p, u, *split(u), *rule_of(*split(u))) for p, u in rows]
    for _, u, _, _, _, verdict in judged:
        if verdict and crc32((u or "").encode()) % 5:
            counts[verdict == "block"].update(grams(u))
    models = []
    for c in counts:
        total, model = sum(c.values()), []
        for n in range(1, order + 2):
            own, context = Counter(), {}
            for g, k in c.items():
                own[g[-n:]] += k
            for g, k in own.items():
                x = context.setdefault(g[:-1], [0, 0, 0])
                x[0] += k
                if k * share >= total:
                    x[1] += k
                    x[2] += 1
            model.append(({g: k for g, k in own.items() if k * share >= total}, {g: x for g, x in context.items() if x[2]}))
        models.append(model)

    def chance(model, gram):
        p = 1 / 257
        for n, (own, context) in enumerate(model, 1):
            if (x := context.get(gram[-n:][:-1])) is not None:
                p = (own.get(gram[-n:], 0) + (x[0] - x[1] + x[2]) * p) / (x[0] + x[2])
        return p

    def raw(url):
        found = [math.log(chance(models[0], g)) - math.log(chance(models[1], g)) for g in grams(url)]
        return sum(found) / len(found)

    if not all(counts):
        return [(*j[:1], *j[2:5], j[5] or "allow", None) for j in judged]
    bins = Counter((math.floor(max(-16, min(16, raw(u))) * 1024), verdict == "allow") for _, u, _, _, _, verdict in judged if verdict and crc32((u or "").encode()) % 5 == 0)
    edge = url_filter.calibrate([(b, a, n) for (b, a), n in bins.items()])
    return [(p, h, q, rule, verdict or ("allow" if raw(u) - edge >= 0 else "block"), raw(u) - edge) for p, u, h, q, rule, verdict in judged]


def same(pages, rows):
    got = sorted((tuple(r) for r in url_filter.filter_urls(pages, RULES).collect()), key=str)
    want = sorted(plain(rows), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and (g[5] == w[5] or abs(g[5] - w[5]) < 1e-9)
    return got


ODD = [None, "", "://", "http://", "HTTP://Www.Example.COM/en/x", "http://example.com", "http://example.com/EN/", "http://xexample.com/en/", "x://a.com:80/en/", "http://a.net/es/?q=/fr/", "http://a.net?/es/", "http://a.net#/es/", "a://b://c.com/x", "http://ÄÖ.Net/es/é", "no scheme.com/en/", "http://a.com/\n/en/", "http://net/fr/", "http://www.example.com/en", "http://b.www.example.com/en/x"]


def test_odd_urls_and_random_ones(spark):
    rnd = random.Random(4)
    urls = ODD + [f"http{rnd.choice(['', 's'])}://{rnd.choice(['www.', 'm.', '', 'ads.'])}{rnd.choice(['one', 'two', 'three'])}.example.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'de', 'fr', 'es'])}/{rnd.randrange(999)}" for _ in range(600)]
    rows = [(k if k % 100 else None, u) for k, u in enumerate(urls)] + [(7, urls[7]), (7, urls[7])]
    same(spark.createDataFrame(rows, SCHEMA).repartition(3), rows)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    same(pages, [(r.page_id, r.url) for r in pages.collect()])


def test_grams_below_the_share_go_to_the_shorter_context(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARE", 300)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    same(pages, [(r.page_id, r.url) for r in pages.collect()])
    model = url_filter._learn(pages.select("url", (url_filter.longest_rule(url_filter.host_of(pages.url), url_filter.path_of(pages.url), RULES).verdict == "allow").alias("allowed")).where("allowed is not null"))
    assert all(len(g) <= 300 for g, _ in model.grams.values())


def test_held_out_urls_come_out_right(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").dropDuplicates(["url"])
    verdict = url_filter.longest_rule(url_filter.host_of(pages.url), url_filter.path_of(pages.url), RULES).verdict
    rows = pages.select("url", (verdict == "allow").alias("allowed")).where("allowed is not null")
    fresh = "crc32(cast(concat('t', url) as binary)) % 3 = 0"
    model = url_filter.fit(rows.where(f"not {fresh}"))
    held = rows.where(fresh)
    right = held.select((url_filter.raw_score(held, model) >= model.threshold).alias("p"), "allowed").selectExpr("avg(cast(p = allowed as double))").first()[0]
    assert right > 0.95


def test_one_kind_only_empty_tables_and_clashing_columns(spark):
    rows = [(1, "http://a.com/x"), (2, "http://a.org/x"), (2, "http://a.org/x"), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as path", "3 as score", "4 as found", "5 as rule")
    assert {(r.page_id, r.rule, r.verdict, r.score) for r in url_filter.filter_urls(docs, RULES).collect()} == {(1, "com/", "allow", None), (2, None, "allow", None), (None, None, "allow", None)}
    assert url_filter.filter_urls(spark.createDataFrame([], SCHEMA), RULES).collect() == []


def test_very_long_urls_in_pieces(spark, monkeypatch):
    urls = ["http://a.com/" + "ab" * 40_000, "http://a.net/es/" + "ba" * 40_000]
    rows = [(k, u) for k, u in enumerate(urls * 3)]
    found = same(spark.createDataFrame(rows, SCHEMA), rows)
    monkeypatch.setattr(url_filter, "PIECE", 1000)
    assert [tuple(r)[:5] for r in url_filter.filter_urls(spark.createDataFrame(rows, SCHEMA), RULES).orderBy("page_id").collect()] == [r[:5] for r in sorted(found)]


@pytest.mark.parametrize(("bins", "edge"), [([], 0.0), ([(3, True, 5)], 0.0), ([(0, False, 4), (10, True, 4)], 5.5 / 1024), ([(0, True, 4), (10, False, 4)], 0.0)])
def test_threshold(bins, edge):
    assert url_filter.calibrate(bins) == edge
