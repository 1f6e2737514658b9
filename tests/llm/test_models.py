"""Toxicity and language identification: brute force for the scan, held-out accuracy for the models."""

import itertools
import random
import zlib

import numpy as np

from scoreloom.llm import language_id, toxicity


def test_segments_are_all_maximal_ones():
    """Against the recursive definition: the best segment, then what is left and right of it."""

    def maximal(scores, offset=0):
        best = max(((sum(scores[i:j]), i - j, i, j) for i, j in itertools.combinations(range(len(scores) + 1), 2)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        total = best[0]
        # of equally good ones the shortest, then the first, as a scan that only extends for gain finds it
        i, j = next((i, j) for n in range(1, len(scores) + 1) for i in range(len(scores) - n + 1) for j in [i + n] if abs(sum(scores[i:j]) - total) < 1e-9)
        return [*maximal(scores[:i], offset), (total, i + offset, j + offset), *maximal(scores[j:], offset + j)]

    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-5.3, -2.1, -1.7, 1.9, 2.3, 4.1]) + rng.random() / 10 for _ in range(rng.randrange(12))]
        found = toxicity.segments(np.array(scores))
        assert [(i, j) for _, i, j in found] == [(i, j) for _, i, j in maximal(scores)]


def _corpus(rng, n=600):
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("the of and er tion ing lo mi ka du re fa".split()) + rng.choice("abcde") for _ in range(rng.randrange(1, 150))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(rng.randrange(2, 8)):
                words.insert(rng.randrange(len(words)), "vile" + rng.choice(["", "st", "ness", "ly", "x"]))
        docs.append((i, " ".join(words), "tox" if toxic else "ok", 1))
        labels.append((i, toxic, "x"))
    return docs, labels


def test_toxicity_held_out_accuracy_and_odd_rows(spark):
    docs, labels = _corpus(random.Random(2))
    odd = [(9000, None, None, 1), (9001, "", "x", 1), (9002, "vile vileness " * 5, "x", 1), (9002, "vile vileness " * 5, "x", 1), (9003, "the of " * 40_000, "x", 1), (None, "fine", "x", 1)]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, toxic string, score long")
    y = spark.createDataFrame([*labels, (9001, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(d.drop("toxic"), y)
    rows = toxicity.score(d, model).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r.predicted for r in rows}
    out = [i for i, _, _, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([found[i] == labels[i][1] for i in out]) > 0.97
    assert found[9002] == 1 and found[9000] == found[9001] == found[9003] == 0
    kept = toxicity.remove_toxic(d, model)
    assert kept.columns == d.columns and kept.where("doc_id = 9002").count() == 0 and kept.where("doc_id >= 9000").count() == 3


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(d, toxicity.fit(d, none)).first().predicted == 0
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), none)).count() == 0


def test_language_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(3)
    syllables = {"xx": "ba do ki lu".split(), "yy": "sch ung ein tz".split(), "zz": "ção nh ñe ou".split()}
    docs = [(i, "".join(rng.choice(syllables[k]) + rng.choice(["", " "]) for _ in range(rng.randrange(5, 80))), k, k) for i in range(400) for k in [rng.choice(list(syllables))]]
    odd = [(9000, None, "xx", ""), (9001, "", "xx", ""), (9002, "12 34 ²", "xx", ""), (9003, "bado " * 60_000, None, ""), (9003, "bado", None, "")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, lang_pred string")
    model = language_id.fit(d, rounds=2, shards=2)
    rows = language_id.predict(d, model).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r.lang_pred for r in rows}
    assert found[9000] == found[9001] == found[9002] == "und" and found[9003] == "xx"
    out = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([found[i] == docs[i][2] for i in out]) > 0.97
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_language_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.predict(d, language_id.fit(d)).count() == 0


def test_ftrl_against_plain_python():
    """One pass, coordinate by coordinate, from weights that are not 0."""
    import math

    rng = np.random.default_rng(8)
    texts, labels = ["ab ab c", "bd", "xyz x", "ab", "zz top", "c d e"], np.array([0, 1, 2, 0, 2, 1])
    start = rng.normal(0, 0.3, (3, language_id.BUCKETS)) * (rng.random((3, language_id.BUCKETS)) < 0.5)
    model = language_id.Model(["a", "b", "c"], rng.random(language_id.BUCKETS) + 0.5, start)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    found = language_id._ftrl(model, texts, labels, alpha, beta, l1, l2)
    z, n = {}, {}

    def weight(c, k):
        if (c, k) not in z:
            w = start[c, k]
            z[c, k], n[c, k] = -w * (beta / alpha + l2) - math.copysign(l1, w) * (w != 0), 0.0
        v = z[c, k]
        return 0.0 if abs(v) <= l1 else (math.copysign(l1, v) - v) / ((beta + math.sqrt(n[c, k])) / alpha + l2)

    for text, label in zip(texts, labels, strict=True):
        at, x = model.features(text)
        scores = [sum(weight(c, k) * v for k, v in zip(at.tolist(), x, strict=True)) for c in range(3)]
        odds = [math.exp(s - max(scores)) for s in scores]
        for c in range(3):
            for k, v in zip(at.tolist(), x, strict=True):
                w, g = weight(c, k), (odds[c] / sum(odds) - (c == label)) * v
                sigma = (math.sqrt(n[c, k] + g * g) - math.sqrt(n[c, k])) / alpha
                z[c, k] += g - sigma * w
                n[c, k] += g * g
    assert all(math.isclose(found[c, k], weight(c, k), abs_tol=1e-9) for c, k in z)
    assert len(z) > 30


def test_temperature_is_the_least_loss():
    rng = np.random.default_rng(9)
    for scale in (0.01, 1.0, 300.0):
        y = rng.integers(0, 4, 200)
        z = rng.normal(0, scale, (200, 4))
        z[np.arange(200), y] += scale
        t = language_id.temperature(z, y)

        def loss(t):
            p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            p = np.log(p / p.sum(axis=1, keepdims=True))
            return -((1 - 1 / 201) * p[np.arange(200), y] + p.mean(axis=1) / 201).mean()  # noqa: B023

        assert all(loss(t) <= loss(t * f) for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2))
    separable = np.eye(3)[[0, 1, 2, 0]] * 5
    assert 0 < language_id.temperature(separable, np.array([0, 1, 2, 0])) < 5
    assert np.isfinite(language_id.temperature(np.zeros((3, 2)), np.array([0, 1, 0])))
