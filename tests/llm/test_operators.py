"""Each operator against a brute-force version on small tables with nulls, repeats, ties, empty and long texts and clashing columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelake.llm import bpe, decontam, exact_dedup, html_text, lang_id, line_dedup, pii, quality, simhash, substrings
from tracelake.llm.components import connected_components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, id string"


def rows(texts):
    return [(i, t, "en", f"s{k % 12}", 0, "x", "y", "z") for k, (i, t) in enumerate(texts)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SHAPE).repartition(3)


def passages(seed=3, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ñ") for _ in range(rng.randint(2, 9))).strip() or "x" for _ in range(80)]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 50))) for _ in range(12)]
    texts = [(k, "\n".join(rng.choice(parts) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(30)) for _ in range(rng.randint(0, 4)))) for k in range(n)]
    texts += [(100, None), (101, ""), (102, " \t\n"), (None, "no id here"), (None, None), (103, texts[5][1]), (104, texts[5][1].upper()), (5, texts[5][1]), (105, "a" * 3000), (106, "ab" * 400 + "c"), (107, "word " * 20000)]
    return texts


@pytest.fixture(scope="module")
def texts():
    return passages()


def test_exact_dedup(spark, texts):
    got = sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.exact_dedup(frame(spark, texts)).collect())
    groups = defaultdict(list)
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in texts:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0))
    want = []
    for i, t in texts:
        best = min(groups[bare(t)])
        keep = None if best[1] else best[2]
        want.append((i, keep, len(groups[bare(t)]), i == keep, hashlib.sha256(bare(t).encode()).hexdigest()))
    assert got == sorted(map(str, want))
    kept = exact_dedup.keep_one(frame(spark, texts)).collect()
    assert sorted(Counter(bare(r.text) for r in kept).values()) == [1] * len(groups)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SHAPE)
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert simhash.simhash_components(docs).count() == 0
    assert pii.find_pii(docs).count() == 0
    assert substrings.remove_repeats(docs).count() == 0
    assert line_dedup.remove_boilerplate(docs).count() == 0
    assert lang_id.identify(docs, lang_id.fit(docs)).count() == 0
    assert decontam.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality.score(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def fingerprint(text):
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, texts):
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_components(frame(spark, texts)).collect())
    prints = [fingerprint(t) for _, t in texts]
    root, members = classes(prints), defaultdict(list)
    for (i, _), r in zip(texts, root, strict=True):
        if i is not None:
            members[r].append(i)
    want = sorted((str(i), f"{p:016x}", min(members[r], default=None)) for (i, _), p, r in zip(texts, prints, root, strict=True))
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("limit", [2048, 16])
def test_simhash_dense_cloud(spark, limit):
    rng, cloud = np.random.default_rng(0), set()
    for _ in range(2):
        base = int(rng.integers(0, 2**63))
        for _ in range(200):
            x = base
            for k in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(k)
            cloud.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in cloud)
    found = connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit)).collect()
    label = {r.node: r.root for r in found}
    root = classes([x % (1 << 64) for x in signed])
    assert [label.get(x, x) for x in signed] == [signed[r] for r in root]


def test_pii(spark):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]

    rng = random.Random(3)
    bits = ["a", "b.c", "@", "1", "4111111111111111", "1.2.3.4", "+49 30 123456", "300", " ", "-", ".", "(", ")", "é", "😀", "_", "x@y.z", "DE89370400440532013000", "", ""]
    texts = ["".join(rng.choice(bits) for _ in range(25)) for _ in range(300)] + [None, "", "9" * 20000, "a." * 10000 + "@", "a@b" + ".c" * 9000]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in base.items() for m in re.finditer(p, t or "") if good(k, m.group())]
        assert [s for s in got[i] if s[0] in base] == want, t
    one = pii.find_pii(spark.createDataFrame([(1, "my iban DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00")], "doc_id long, text string")).first()
    assert [(s.kind, s.start, s.score) for s in one.spans if s.kind == "iban"] == [("iban", 8, 100)]


def test_bpe_round_trip(spark, texts):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = texts + [(200, "it's \x1c\x85  tabs\t\tand　spaces   ½ 中文 🙂\n\n  x "), (201, "<|endoftext|>")]
    encoded = bpe.bpe_encode(frame(spark, odd), path, public_tokenizers.PATTERN)
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in bpe.bpe_decode(encoded, path).collect())
    assert got == sorted((str(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd)


def windows(docs):
    seen, out = set(), {}
    for key, raw in sorted(docs):
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if (w := raw[p : p + 100]) in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        out[key] = (sum(covered), len(re.findall(b"\1+", covered)), bytes(c for c, m in zip(raw, covered, strict=True) if not m))
    return out


def test_substrings(spark, texts):
    known = {i: t for i, t in texts if i is not None}
    got = {r.doc_id: (sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in substrings.remove_repeats(frame(spark, [*known.items(), (5, known[5])])).collect()}
    assert got == windows([(i, (t or "").encode()) for i, t in known.items()])


def test_substrings_without_ids(spark):
    text = "".join(random.Random(k).choice("abcdefgh ") for k in range(400))
    got = substrings.remove_repeats(frame(spark, [(None, text), (7, text), (None, "short"), (None, None)])).collect()
    assert sorted((str(r.doc_id), len(r.kept)) for r in got) == [("7", 400), ("None", 0), ("None", 0), ("None", 5)]


def test_long_text_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(substrings, "CHUNK", 700)
    rng = random.Random(1)
    part = "".join(rng.choice("abcdefgh") for _ in range(300)).encode()
    raw = part + b"".join(bytes([rng.choice(b"abcdefgh")]) for _ in range(2500)) + part
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([raw.decode()])], names=["key", "text"])
    seen = sorted((f, l) for r in substrings._find_runs(b"key")([batch]) for f, l in zip(r.column("first").to_pylist(), r.column("last").to_pylist(), strict=True))
    starts = [p for f, l in seen for p in range(f, l + 1)]
    assert sorted(starts) == list(range(len(raw) - 99))


def test_blind_trie():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(200)]
    order = substrings.blind_trie(strings, 0)
    assert [strings[g[0]] for g in order] == sorted(set(strings))
    assert all(len({strings[k] for k in g}) == 1 for g in order) and sum(map(len, order)) == 200


def test_decontamination(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 60)))) for k in range(25)] + [(90, None), (91, "..."), (92, "")]
    docs = []
    for k, (_, t) in enumerate(items[:25]):
        for kind in range(4):
            w = t.split()
            if kind == 1:
                w[rng.randrange(len(w))] = "other"
            if kind == 2:
                w = w[:-1] or w
            if kind == 3:
                w = [x.upper() + "," for x in w]
            pre = [rng.choice(words) for _ in range(rng.randint(0, 30))]
            docs.append((k * 10 + kind, " ".join(pre + w + pre[:5])))
    docs += [(900, None), (901, ""), (902, "..."), (None, items[3][1])]
    own = decontam.Slice([x for x in items if x[1]])
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontam.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in docs:
        w, want = decontam.words(t), []
        for k, n in enumerate(own.sizes):
            size, width = min(n, len(w)), min(decontam.WIDTH, n)
            shingles = decontam._shingles(w, width) if size >= width else []
            if any(own.alike(Counter(shingles[p : p + size - width + 1]), k) >= 0.8 for p in range(len(w) - size + 1) if shingles):
                want.append(own.ids[k])
        assert got[i] == (bool(want), sorted(want)), i


def test_hamming_index_is_complete():
    own = decontam.Slice([(k, f"item number {k} has these words and {k * k} more of them") for k in range(30)])
    rng = random.Random(4)
    for _ in range(300):
        k = rng.randrange(30)
        x = int(own.prints[k])
        for b in rng.sample(range(64), rng.randint(0, decontam.RADIUS)):
            x ^= 1 << b
        assert k in own.near(x)


def test_line_dedup(spark):
    text = [(k, f"own line {k}\n  shared \n\nshared\nhalf{k % 2}") for k in range(24)] + [(50, None), (51, ""), (None, "shared")]
    docs = frame(spark, text)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_boilerplate(docs, min_sites=6).collect()}
    assert got[3] == ("own line 3\n", 5, 3)
    assert got[50] == ("", 1, 0) and got[51] == ("", 1, 0) and got[None] == ("", 1, 1)
    assert line_dedup.remove_boilerplate(docs, min_sites=7).where("doc_id = 3").first().text == "own line 3\n\nhalf1"


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<div class="ad">buy</div><!-- c --><div>Site slogan</div><article><h1>T &amp; U</h1><p><b>One<br>two
 three<p>Four &eacute;</p><ul><li>five</li><li>six</li></ul><div class="comments"><p>reader</p></div></article><script>var t="</p>";</script>
<aside>side</aside><form><input value="q">search</form><footer>&copy; foot</footer></body></html>"""


def test_html_text(spark):
    assert html_text.main_text(PAGE) == "T & U\n\nOne two three\n\nFour é\n\nfive\n\nsix"
    assert html_text.main_text(None) == "" and html_text.main_text("<p>a<script>x") == "a"
    plain = [(k, f"http://h.example/{k}", f"<body><div>Site slogan</div><p>text {k}</p><p>more</p></body>") for k in range(6)]
    pages = [*plain, *[(10 + k, "http://g.example/", "<body><div>Site slogan</div><p>same</p></body>") for k in range(6)], (20, None, PAGE), (None, None, None)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[2] == "text 2\n\nmore"  # the slogan recurs on pages of different text
    assert got[12] == "Site slogan\n\nsame"  # copies of one page count once
    assert got[20].startswith("T & U") and got[None] == ""


def test_lang_id(spark):
    import math

    known = [("en", "hello there the cat sat"), ("de", "der hund und die katze"), ("en", "the dog"), (None, "nothing"), ("", "nothing")]
    model = lang_id.fit(spark.createDataFrame(known, "lang string, text string"))
    trees = {}
    for lang, text in known[:3]:
        data = b"\n" * 4 + text.encode()
        for i in range(4, len(data)):
            for o in range(5):
                trees.setdefault(lang, [{} for _ in range(5)])[o].setdefault(data[i - o : i], Counter())[data[i]] += 1

    def bits(lang, text):
        data, total = b"\n" * 4 + text.encode(), 0.0
        for i in range(4, len(data)):
            for o in range(4, -1, -1):
                seen = trees[lang][o].get(data[i - o : i])
                if seen is None:
                    continue
                n, q = sum(seen.values()), len(seen)
                if data[i] in seen:
                    total -= math.log2(seen[data[i]] / (n + q))
                    break
                total -= math.log2(q / (n + q))
            else:
                total += 8
        return total

    texts = ["the hat", "xyz", "die", "é there", "", "1234"]
    _, found = model.score(texts)
    assert np.allclose(found, [[bits(lang, t) for lang in model.langs] for t in texts], atol=1e-3)
    docs = frame(spark, [(1, "the cat"), (2, "die katze"), (3, None), (4, "12 !"), (None, "hund")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(docs, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == ("und", 0.0) and got[4] == ("und", 0.0) and got[None][0] == "de"


def test_quality(spark):
    rng = random.Random(0)
    good = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(40))
    texts = [(k, good() if k % 2 else " $$$ ".join(good().split())) for k in range(200)] + [(300, None), (None, "x"), (301, "")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(300, 1), (301, None), (None, 1), (7, 5)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(frame(spark, texts), quality.fit(frame(spark, texts), labels)).collect()}
    assert len(got) == 203 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[k].predicted == k % 2 for k in range(120, 200))
    one = quality.fit(frame(spark, texts), labels.where("quality = 1"))
    assert quality.score(frame(spark, texts), one).where("predicted = 0").count() == 0


def test_pii_many_spans_in_one_text(spark):
    import time

    part = "mail ab@cd.ef tel +49 30 123456 "
    text, one = part * 50_000, re.finditer(r"[a-z]+@[a-z.]+", part * 3)
    began = time.time()
    spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert time.time() - began < 60 and len(spans) == 100_000
    assert [(s.start, s.end, s.score) for s in spans[:3]] == [(m.start(), m.end(), 70) for m in one]
    assert spans[49_999].start == 49_999 * len(part) + 5 and spans[99_999].score == 70


def test_pii_context_across_spans(spark):
    text = "call 1.2.3.4 5.6.7.8 " + "x" * 40 + " 9.9.9.9 then host é 8.8.8.8"
    spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [(s.start, s.score) for s in spans if s.kind == "ip"] == [(5, 70), (13, 70), (62, 50), (82, 70)]


def test_substrings_of_repeated_ids(spark):
    """Rows that repeat an id with other text are documents of their own."""
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    a, u = noise(300), noise(900)
    got = substrings.remove_repeats(spark.createDataFrame([(1, a), (5, a + "x"), (5, u), (5, u), (None, u), (None, u[:500] + a)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in got) == [("1", 300, 300), ("5", 301, 1), ("5", 900, 900), ("5", 900, 900), ("None", 800, 0), ("None", 900, 0)]


def test_decontamination_in_slices(monkeypatch, spark):
    """Several slices give what one gives, with the weights of the whole benchmark, repeated item ids and a long text."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    items = [(k % 17, " ".join(rng.choice(words) for _ in range(rng.randint(2, 40)))) for k in range(20)] + [(50, None), (51, "!")]
    items += [(60 + k, items[2][1] + f" more {k}") for k in range(3)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(50)) + " " + items[k % 20][1].upper()) for k in range(30)] + [(90, None), (91, "")]
    docs += [(92, "word " * 100_000 + items[4][1]), (None, items[5][1]), (3, items[6][1]), (3, items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontam.find_leaks(frame(spark, docs), bench).collect()))
    left = Counter(r.doc_id for r in decontam.clean(frame(spark, docs), bench).collect())
    monkeypatch.setattr(decontam, "SLICE_ITEMS", 4)
    assert decontam.slices(bench)[0] > 3
    assert sorted(map(str, decontam.find_leaks(frame(spark, docs), bench).collect())) == one
    assert Counter(r.doc_id for r in decontam.clean(frame(spark, docs), bench).collect()) == left
    assert 90 in left and 92 not in left and 3 not in left and None not in left
