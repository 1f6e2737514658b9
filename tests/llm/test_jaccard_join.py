import random

from scoreloom.llm import jaccard_join as m


def brute(docs, width, per_cent):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()

    sets = [(d, shingles(t)) for d, t in docs]
    name = list(range(len(docs)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= per_cent * len(a | b) and name[i] != name[j]:
                x, y = name[i], name[j]
                name = [y if n == x else n for n in name]
    least = {}
    for (d, _), n in zip(sets, name, strict=True):
        least[n] = min(d, least.get(n, d))
    return sorted((d, len(s), least[n]) for (d, s), n in zip(sets, name, strict=True))


def frame(spark, docs):
    return spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, node string")


def copies(rng, n):
    docs = []
    for d in range(n):
        size = rng.choice([1, 3, 5, 12, 60, 300])
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        docs.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(1 + size // 60)):
                words[rng.randrange(size)] = "new"
            docs.append(" ".join(words))
    return list(enumerate(docs))


def test_random_copies_against_brute_force(spark):
    docs = [*copies(random.Random(2), 60), (900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B"), (903, "A b")]
    for width, per_cent in ((4, 85), (5, 80)):
        found = sorted(tuple(r) for r in m.jaccard_classes(frame(spark, docs), width, per_cent).collect())
        assert found == brute(docs, width, per_cent)


def test_large_groups_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(m, "TILE_ROWS", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    docs = []
    for d in range(90):
        own = list(words)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(150)] = f"x{rng.randrange(99)}"
        docs.append((d, " ".join(own)))
    found = sorted(tuple(r) for r in m.jaccard_classes(frame(spark, docs)).collect())
    assert found == brute(docs, 4, 85)


def test_one_of_each_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = frame(spark, [(5, text), (3, text + " end"), (4, "other words here"), (6, None)])
    assert sorted(r.doc_id for r in m.keep_one_of_each(docs).collect()) == [3, 4, 6]
    assert m.jaccard_classes(docs.limit(0)).count() == 0


def test_parts_leave_no_similar_pair_apart():
    import numpy as np

    rng, bands = np.random.default_rng(0), m.Bands(85)
    for n in (7, 20, 77, 400, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            d = 15 * 2 * len(a) // 185 // 2
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[d:]], rng.integers(0, 1 << 63, d).astype(np.uint64))))
            if m.similar(a, b, 85):
                assert set(np.concatenate(list(m._part_keys(a, bands)))) & set(np.concatenate(list(m._part_keys(b, bands)))) if d else True


def test_ids_that_repeat_or_are_null_keep_their_links(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(60))
    docs = [(5, a, "x"), (5, b, "x"), (6, b + " end", "x"), (None, a + " end", "x"), (None, "alone here", "x"), (9, None, "x"), (9, None, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, node string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in m.jaccard_classes(frame).collect()), key=str)
    assert found == sorted([(5, 57, 5), (5, 57, 5), (6, 58, 5), (None, 58, 5), (None, 1, None), (9, 0, 9), (9, 0, 9)], key=str)
    frame = spark.createDataFrame([(5, a, "x"), (5, b, "y"), (3, b + " end", "z"), (None, a + " end", "x"), (None, "alone here", "x")], "doc_id long, text string, _text string")
    assert sorted(map(str, (r["_text"] + str(r["doc_id"]) for r in m.keep_one_of_each(frame).collect()))) == ["x5", "xNone", "z3"]


def test_other_words_with_equal_letters_do_not_link(spark):
    from test_line_dedup import thue_morse

    word = thue_morse(1024)
    docs = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    assert sorted(tuple(r) for r in m.jaccard_classes(frame(spark, docs)).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_keys_of_many_sets_are_dealt_out(spark, monkeypatch):
    for name, value in (("OFTEN", 2), ("SALTS", 4), ("FEW", 3), ("HELD", 20)):
        monkeypatch.setattr(m, name, value)
    docs = copies(random.Random(7), 25)
    base = [f"c{i}" for i in range(80)]
    for d in range(40):  # a passage that many share
        docs.append((500 + d, " ".join(base + [f"y{d}x{i}" for i in range(d % 9)])))
    found = sorted(tuple(r) for r in m.jaccard_classes(frame(spark, docs)).collect())
    assert found == brute(docs, 4, 85)
