import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import language_model as lm

SPACE = " \t\n\x0b\f\r"


def tokens(text):
    """The contract's words and the end, in plain Python."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        folded = folded.replace(c, " ")
    return [*filter(None, folded.split(" ")), None]


def is_train(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def documents(n=150):
    rng = np.random.default_rng(5)
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "İx", "dog x", "w" * 90, *(f"w{i}" for i in range(60))]
    rows = [(i, "".join(words[int(w)] + SPACE[int(s)] for w, s in zip(rng.zipf(1.4, 30) % len(words), rng.integers(0, 6, 30), strict=True))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t"), (None, "the cat"), (None, "the cat"), (7, "the cat sat"), (n + 3, "onlyhere " * 40), (n + 4, "x " * 3_000), (n + 5, "y" * 100_000)]


@pytest.mark.parametrize("head", [lm.HEAD, 200, 0])
def test_base_scores_against_plain_python(spark, head):
    rows = documents()
    found = lm.score_documents(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string"), head=head, most=1 << 20).collect()
    counts = Counter(t for i, text in rows if is_train(i) for t in tokens(text))
    total, types = sum(counts.values()), len(counts)
    expected = []
    for i, text in rows:
        own = tokens(text)
        expected.append((str(i), len(own), sum(counts[t] > 0 for t in own), total, round(sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in own), 6)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == sorted(expected)
    assert all(r["score"] < 0 for r in found)


def exact(rows, order=3):
    counts = Counter()
    for _, text in rows:
        seq = ["<", *tokens(text)]
        counts.update(tuple(seq[i - n + 1 : i + 1]) for i in range(len(seq)) for n in range(1, order + 1) if i - n + 1 >= 0)
    return counts


def keys_of(grams):
    """The hashes of n-grams of words, the begin being '<' and the end None."""
    out = []
    for gram in grams:
        h = np.array([lm._BEGIN if w == "<" else lm._END if w is None else lm.hashes_of(pa.array([w]))[0] for w in gram], np.uint64)
        out.append(lm.ngrams(h, np.zeros(len(h), int), len(gram))[-1][-1])
    return np.array(out, np.uint64)


@pytest.mark.parametrize("range_size, fan", [(lm.RANGE, lm.FAN), (500, 4)])
def test_filter_holds_every_level(spark, monkeypatch, range_size, fan):
    """With several ranges and steps too: no n-gram has a level that is too low, few have one that is too high."""
    monkeypatch.setattr(lm, "FAN", fan)
    rows = documents()
    counts = exact(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = lm.build_filter(docs, sum(len(tokens(t)) for _, t in rows), range_size=range_size)
    assert made.lowest == 1 and made.shape.ranges == (0 if range_size == lm.RANGE else 6)
    grams = sorted(counts, key=str)
    true, found = lm.level(np.array([counts[g] for g in grams])), made.levels(keys_of(grams))
    assert (found >= true).all() and (found == true).mean() > 0.9
    absent = made.levels(np.random.default_rng(1).integers(1, 1 << 62, 20_000).astype(np.uint64) * np.uint64(3))
    assert (absent > 0).mean() < 0.1


def test_a_small_filter_keeps_the_frequent(spark):
    rows = documents()
    counts = exact(rows)
    made = lm.build_filter(spark.createDataFrame(rows, "doc_id long, text string"), sum(len(tokens(t)) for _, t in rows), most=1 << 14)
    assert made.lowest > 1 and made.segments.nbytes == 1 << 11
    grams = sorted(counts, key=str)
    true, found = lm.level(np.array([counts[g] for g in grams])), made.levels(keys_of(grams))
    assert (found >= np.where(true >= made.lowest, true, 0)).all() and (found[true < made.lowest] == 0).mean() > 0.8


def test_levels_and_means():
    counts = np.arange(1, 2000)
    q = lm.level(counts)
    assert q.tolist() == [1 + math.floor(math.log(c) / math.log(lm.BASE) + 1e-9) for c in counts]
    assert all(counts[q == k].mean() == lm.MEAN[k] for k in range(1, q.max()))


class Exact:
    """Stands for a filter with exact counts of small levels."""

    def __init__(self, counts):
        grams = list(counts)
        self.known = dict(zip(keys_of(grams).tolist(), (int(lm.level(np.array([counts[g]]))[0]) for g in grams), strict=True))

    def levels(self, hashes, most=None):
        return np.array([self.known.get(int(h), 0) for h in hashes])


def test_scores_are_dirichlet_smoothed():
    """Counts up to 3 have levels of their own, so that quantised counts are exact here."""
    rows = [(1, "a b a c"), (2, "a b d"), (3, "b")]
    counts = exact(rows)
    total, types = 11, 5  # with the ends
    model = lm.Model(Exact(counts), 3, total, types, (2.0, 5.0))

    def p(word, history):
        if not history:
            return (counts[(word,)] + 1) / (total + types + 1)
        low = p(word, history[1:])
        m = (2.0, 5.0)[len(history) - 1]
        return (counts[(*history, word)] + m * low) / (counts[tuple(history)] + m)

    texts = ["a b a c", "c z a", "", None]
    for text, got in zip(texts, model.score(lm.Words.of(pa.array(texts))), strict=True):
        seq = ["<", *tokens(text)]
        assert math.isclose(got, sum(math.log10(p(seq[i], tuple(seq[max(i - 2, 0) : i]))) for i in range(1, len(seq))), rel_tol=1e-9)
    for history in (("a", "b"), ("z", "a"), ("<",)):
        assert math.isclose(sum(p(w, history) for w in ("a", "b", "c", "d", None, "unknown")), 1.0)


def test_model_beats_the_base_where_words_follow_each_other(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{(int(s) + k * 7) % 40}" for k in range(25))) for i, s in enumerate(rng.integers(0, 40, 200))]
    found = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where(lm.held_out()).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert found["s"] > 0.3 * found["b"]


def test_empty_table_and_no_training_rows(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if not is_train(i))
    r = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_chunks_do_not_change_scores(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, "c" * 50, "", "d e f"])], ["text"])
    assert sum(len(p) for p in lm.chunks(batch)) == 5
    monkeypatch.setattr(lm, "_CHUNK", 4)
    assert [p.column(0).to_pylist() for p in lm.chunks(batch)] == [["a b", None], ["c" * 50], [""], ["d e f"]]
