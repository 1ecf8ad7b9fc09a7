"""The alignment of two tokenizers against a plain one, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelake.llm import alignment

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def paths():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain(rows, paths):
    """What the contract says, a document at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    a_name = {k: t for t, k in a.get_vocab().items()}
    docs = []
    for doc_id, text in rows:
        tokens = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            made = [alignment.byte_level(a_name[k]) for k in ids[0]], [bytes([int(b.id_to_piece(k)[1:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids[1]]
            if b"".join(made[0]) == b"".join(made[1]) == (" " + text).encode():
                tokens = [(i, [len(x) for x in m]) for i, m in zip(ids, made)]
        groups, links = [], Counter()
        if tokens:
            spans = [list(zip(ids, np.cumsum(n) - n, np.cumsum(n))) for ids, n in tokens]
            common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            for lo, hi in zip([0, *common], common):
                groups.append("|".join(",".join(str(k) for k, s, e in side if lo < e <= hi) for side in spans))
            j = 0
            for k, s, e in spans[0]:
                while spans[1][j][2] <= s:
                    j += 1
                m = j
                while m < len(spans[1]) and spans[1][m][1] < e:
                    links[k, spans[1][m][0]] += 1
                    m += 1
        docs.append((doc_id, [len(t[0]) for t in tokens] or [0, 0], groups, links))
    count = Counter(p for d in docs for p in d[3])
    best = defaultdict(int)
    for (k, _), n in count.items():
        best[k] = max(best[k], n)
    return sorted(
        (d, *n, len(groups), sum(links.values()), sum(c for p, c in links.items() if count[p] == best[p[0]]), sum(c * count[p] for p, c in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for d, n, groups, links in docs
    )


def aligned(docs, paths):
    return sorted(tuple(r) for r in alignment.align_tokens(docs, *paths).collect())


ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a \n b", "\n\n a\n\n", "x\ty  z \n", "<|endoftext|> <s> </s> <unk> <0x0A>", "a▁b c d", "ﬁne ①²", "日本語 テキスト です", "naïve café", "\x00 \x1f a\x1c b\x85 c", "a\u00a0 b\u3000 c\u180e d", "😀 👩‍👩‍👧 x", "don't can't  we'll", "1234567 89", "the the the", "ab" * 3000]


def test_odd_texts_and_random_ones(spark, paths):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice(["the", "re", " ", " ", "  ", "\n", "é", ",", "'s", "9", "▁" if k % 9 == 0 else "q", "\u00a0", "\x1c", "漢", "<s>"]) for _ in range(rnd.randrange(60))) for k in range(150)]
    rows = [*enumerate(texts), (900, None), (901, "the the the")]
    assert aligned(spark.createDataFrame(rows, SCHEMA).repartition(3), paths) == plain(rows, paths)


def test_given_documents(spark, paths):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert aligned(docs, paths) == plain([(r.doc_id, r.text) for r in docs.collect()], paths)


def test_small_blocks_and_slices_change_nothing(spark, paths, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    own = [r for b in docs.select("doc_id", "text").toArrow().to_batches() for r in b.to_pylist()]
    assert len(own) == docs.count()
    tokenizers = alignment._loaded(*[open(p, "rb").read() for p in paths])
    units, sizes, numbers = {}, [], []
    for r in own:
        mine = tokenizers.units(r["text"]) if r["text"] else []
        numbers.append(np.fromiter((units.setdefault(u, len(units)) for u in mine), np.int32))
        sizes.append(len(mine))
    import pyarrow as pa

    whole = alignment._close([r["doc_id"] for r in own], sizes, numbers, list(units), tokenizers, 0, pa.int64())
    monkeypatch.setattr(alignment, "UNITS", 50)
    monkeypatch.setattr(alignment, "CALL", 30)
    assert alignment._close([r["doc_id"] for r in own], sizes, numbers, list(units), tokenizers, 0, pa.int64()).equals(whole)


def test_labels_name_the_last_token_of_each_group():
    a, b = alignment.group_labels(np.array([2, 4, 6, 9, 10]), np.array([3, 5, 6, 10]))
    assert a.tolist() == [2, 2, 2, 4, 4] and b.tolist() == [2, 2, 2, 4]
    assert [x.tolist() for x in alignment.group_labels(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [[], []]
    n = 5000  # a chain without a common end before the last
    a, b = alignment.group_labels(np.r_[np.arange(1, n) * 2, 2 * n], np.r_[np.arange(1, n) * 2 + 1, 2 * n])
    assert set(a) == set(b) == {n - 1}


def test_empty_tables_text_ids_and_clashing_columns(spark, paths):
    assert aligned(spark.createDataFrame([], SCHEMA), paths) == []
    rows = [("x", "the thing", 1), (None, None, 2), ("x", "the thing", 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, block int").selectExpr("*", "7 as pairs", "8 as n_a", "9 as id")
    found = alignment.align_tokens(docs, *paths)
    assert dict(found.dtypes)["doc_id"] == "string"
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert [r[0] for r in got] == ["x", "x", None] and got[0] == got[1] and got[2][1:] == (0, 0, 0, 0, 0, 0, "")
    assert got[0][6] == 2 * got[0][4]  # each pair is held by both documents
