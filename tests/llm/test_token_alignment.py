import hashlib
import os
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import token_alignment as ta

pytestmark = pytest.mark.skipif(not os.path.isdir(ta.FOLDER), reason="no tokenizers")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  a  b ", "\tx\ny z\r\n", "<s></s><unk><|endoftext|> a <0x41>", "▁x ▁", "naïve café é ﬁ  x", "日本語 テキスト a b", "😀 a😀b c",
    "\x00a b\x1f", "it's we're A'S don't", "a b a b a b", "aaaa" * 5_000, "ab " * 3_000 + "x", " lead and trail ", "1234567 89 0", "...!!! a ... b", "Zoë B ö a", "x  y z\u0085 w",
]


@pytest.fixture(scope="module")
def tokenizers():
    return ta.Tokenizers(*((Path(ta.FOLDER) / f).read_bytes() for f in (ta.BYTE_FILE, ta.PIECE_FILE)))


def plain(tokenizers, texts):
    """The contract in plain Python, each text encoded whole."""
    docs = []
    for text in texts:
        if not text:
            docs.append([])
            continue
        (a, b), _, same = tokenizers._single([text])
        a, b = a.tolist(), b.tolist()
        if not same[0]:
            docs.append([])
            continue
        ends = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
        ea, eb = ends(a, tokenizers.a_bytes), ends(b, tokenizers.b_bytes)
        cuts = sorted(set(ea) & set(eb))
        groups = [([], []) for _ in cuts]
        for side, ids, at in ((0, a, ea), (1, b, eb)):
            for i, end in zip(ids, at, strict=True):
                groups[next(k for k, c in enumerate(cuts) if c >= end) if len(cuts) < 50 else int(np.searchsorted(cuts, end))][side].append(i)
        docs.append(groups)
    links = [[p for xs, ys in groups for p in product(xs, ys)] for groups in docs]
    held = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for groups, own in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own), sum(held[p] == best[p[0]] for p in own), sum(held[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def check(spark, tokenizers, texts, **more):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_a long").repartition(3)
    found = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in ta.align_tokenizers(docs, **more).collect()}
    assert [found[i] for i in range(len(texts))] == plain(tokenizers, texts)


@pytest.mark.parametrize("head", [ta.HEAD, 300, 0])
def test_odd_texts(spark, tokenizers, head):
    check(spark, tokenizers, ODD + ["a b a b a b", "it's we're"], head=head)


def test_documents(spark, tokenizers):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    check(spark, tokenizers, texts, head=1000)


def test_units_have_the_tokens_of_the_whole_text(tokenizers):
    rng = np.random.default_rng(11)
    bits = [" ", " ", " ", "a", "Bc", "the", "'s", "'", ".", ", ", "-", "1", "23", "\n", "\t", "é", "ß", "日本", "▁", "\u00a0", "\u2003", "😀", "<|endoftext|>", "</s>", "<0x41>", "_", "I'll", "\x1f", "\u0301"]
    texts = ["".join(bits[i] for i in rng.integers(0, len(bits), int(rng.integers(1, 60)))) for _ in range(3000)]
    for (a, b), text in zip(tokenizers._sides(texts), texts, strict=True):
        units = ta._CUT.split(text)
        parts = list(tokenizers._sides(units))
        assert [i for x, _ in parts for i in x] == list(a) and [i for _, y in parts for i in y] == list(b)
    units = list(dict.fromkeys(u for t in texts for u in ta._CUT.split(t)))
    ids, sizes, same = tokenizers.encode(units)
    one, n, good = tokenizers._single(units)
    assert all((x == y).all() for x, y in zip([*ids, *sizes, same], [*one, *n, good], strict=True))


def test_small_chunks(tokenizers, monkeypatch):
    whole = list(ta.Aligner(tokenizers).align(ODD))
    for name, size in (("_CHUNK", 7), ("_CACHED", 3), ("_LINKS", 5)):
        monkeypatch.setattr(ta, name, size)
    assert list(ta.Aligner(tokenizers).align(ODD)) == whole


def test_groups_against_common_offsets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 40))
        a, b = (np.append(np.flatnonzero(rng.random(size - 1) < rng.random()) + 1, size) for _ in "ab")
        ga, gb, n = ta.groups(a, b)
        cuts = np.intersect1d(a, b)
        assert n == len(cuts) and ga.tolist() == np.searchsorted(cuts, a).tolist() and gb.tolist() == np.searchsorted(cuts, b).tolist()


def test_large_groups_count_equal_ids_first():
    a, b = np.array([1, 1, 2] * 40), np.array([3, 4] * 60)
    doc, code, links = ta._distinct_pairs(np.array([0]), np.array([120]), np.array([120]), a, b, 10)
    assert dict(zip(code.tolist(), links.tolist(), strict=True)) == {13: 4800, 14: 4800, 23: 2400, 24: 2400} and not doc.any()


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ta.align_tokenizers(docs).count() == 0
    rows = ta.align_tokenizers(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id int, text string")).collect()
    assert [(r["n_a"], r["count_sum"]) for r in rows] == [(2, 6)] * 3


def test_a_unit_that_differs_is_checked_in_its_whole_text(tokenizers):
    aligner = ta.Aligner(tokenizers)
    aligner.units.look_up(["and"])
    aligner.units.same[0] = False
    assert next(iter(aligner.align(["and"])))[0] == 1
    aligner.units.ids[1][0] += 1
    assert next(iter(aligner.align(["and", "or"]))) == (0, 0, 0, 0, "", ta.packed(np.zeros(0, np.uint64)), ta.packed(np.zeros(0, np.uint64)))
