"""More n-grams than a broadcast filter may hold: ranges hold them, and none stays out."""

import zlib

import numpy as np
import pytest

from scoreloom.llm import language_model as lm


def documents():
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{int(w)}" for w in rng.zipf(1.3, 40) % 900)) for i in range(400)]
    return [*rows, *((i + 400, text) for i, text in rows[:200]), (1000, None), (1001, ""), (None, "w1 w2"), (1002, "y" * 9_000)]


def scores(found):
    return {(r["row"], r["doc_id"]): (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in found.collect()}


@pytest.mark.parametrize("range_size, fan, chunk", [(lm.RANGE, lm.FAN, lm._CHUNK), (700, 4, 3_000)])
def test_scores_do_not_depend_on_the_size_of_a_broadcast_filter(spark, monkeypatch, range_size, fan, chunk):
    monkeypatch.setattr(lm, "FAN", fan)
    monkeypatch.setattr(lm, "_CHUNK", chunk)
    docs = spark.createDataFrame(documents(), "doc_id long, text string").repartition(3, "doc_id")
    whole, dealt = scores(lm.score_documents(docs, range_size=range_size)), scores(lm.score_documents(docs, most=1 << 14, range_size=range_size))
    assert len(whole) == 604 and {k: v[:2] for k, v in whole.items()} == {k: v[:2] for k, v in dealt.items()}
    a, b = (np.array([x[k][3] for k in sorted(whole, key=str)]) for x in (whole, dealt))
    held = np.array([zlib.crc32(("" if k[1] is None else str(k[1])).encode()) % 7 == 2 for k in sorted(whole, key=str)])
    off = np.abs(a / b - 1)  # false positives of the filters; 0.6 and more where low levels stay out
    assert held.any() and off.max() < 0.05 and off.mean() < 0.005


def test_every_n_gram_of_training_rows_has_its_level(spark):
    rows = [(i, i % 5 > 0, text) for i, (_, text) in enumerate(documents())]
    shape = lm.Shape(3, 0, 0)
    found = lm.dealt_levels(spark.createDataFrame(rows, "row long, train boolean, text string").coalesce(1), 3, shape).collect()
    words = lm.Words.of(lm.pa.array([t for _, _, t in rows]))
    grams, keys, row = lm.piece_keys(words, 3, shape)
    train = np.array([x for _, x, _ in rows])[row]
    distinct, counts = lm.summed(keys, np.concatenate([train[g != 0] for g in grams]).astype(np.int64))
    assert {r["piece"] for r in found} == {0}
    levels = lm.gathered_levels(lm.pa.Table.from_pylist([r.asDict() for r in found]), shape, distinct)
    true = lm.level(counts)
    assert len(levels) == len(distinct) and (levels >= true).all() and (levels == true).mean() > 0.95
    assert (counts == 1).any() and (levels[counts == 1] > 0).all()


@pytest.mark.parametrize("bits", [40, 63])
def test_keys_are_ordered_and_sent_as_gaps(bits):
    draw = np.random.default_rng(bits)
    keys = draw.integers(0, 1 << bits, 5_000, dtype=np.uint64)
    keys = np.concatenate([keys, keys[:500], keys[:500] ^ np.uint64(1)])  # some differ in the lowest bit only
    at = lm.ordering(keys, bits)
    assert sorted(at.tolist()) == list(range(len(keys))) and (keys[at] == np.sort(keys)).all()
    for some in (np.sort(keys), keys[:1], keys[:0]):
        assert (lm.unspaced(lm.spaced(some, 8), 8) == some).all()
