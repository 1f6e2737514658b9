import random

from scoreloom.llm import line_dedup as m


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(docs, per_cent=80):
    lines = sorted({(d, i, frozenset(low(x).split())) for d, t in docs for i, x in enumerate((t or "").split("\n"))}, key=lambda x: x[:2])
    gone = {}
    for k, (d, i, s) in enumerate(lines):
        if s and any(u and 100 * len(s & u) >= per_cent * len(s | u) for _, _, u in lines[:k]):
            gone.setdefault(d, []).append(i)
    return {d: gone.get(d, []) for d, _ in docs}


def frame(spark, docs):
    return spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, node string")


def test_random_lines_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 9, 20, 40]))] for _ in range(40)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words))
        docs.append((d, "\n".join(lines)))
    docs += [(70, None), (71, ""), (72, "\n\n"), (73, "  \t")]
    found = {r.doc_id: r.removed for r in m.removed_lines(frame(spark, docs)).collect()}
    assert found == brute(docs)


def test_groups_of_many_tiles(spark, monkeypatch):
    from scoreloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 8)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(d, " ".join(w if rng.random() > 0.15 else f"x{rng.randrange(9)}" for w in words)) for d in range(80)]
    found = {r.doc_id: r.removed for r in m.removed_lines(frame(spark, docs)).collect()}
    assert found == brute(docs)


def test_texts_lose_lines_and_rows_stay(spark):
    docs = spark.createDataFrame([(2, "a b c\nnew", 9), (1, "A  b c\n\na b c", 11), (3, None, 0), (None, "a b c", 5)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: (r.text, r.n_chars) for r in m.remove_lines(docs).collect()}
    assert found == {None: ("a b c", 5), 1: ("", 0), 2: ("new", 3), 3: (None, 0)}
    assert m.remove_lines(docs.limit(0)).count() == 0


def test_frequent_words_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 16)
    rng = random.Random(6)
    docs = [(d, " ".join(f"w{rng.randrange(14)}" for _ in range(rng.choice([4, 6, 10])))) for d in range(150)]
    found = {r.doc_id: r.removed for r in m.removed_lines(frame(spark, docs)).collect()}
    assert found == brute(docs)


def thue_morse(n):
    text = "ab"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_other_words_never_pass_for_equal_and_ids_may_be_extreme(spark):
    word = thue_morse(1024)
    twin = word.translate(str.maketrans("ab", "ba"))
    least = -(1 << 63)
    docs = [(least, f"{word}\na b c"), (None, f"{twin}\nc b a"), (7, "x " * 5000 + "\n" + word)]
    found = {r.doc_id: r.removed for r in m.removed_lines(frame(spark, docs)).collect()}
    assert found == {None: [], least: [1], 7: [1]}


def test_more_lines_than_the_packed_order_tells_apart(monkeypatch):
    held = ["\n".join(f"w{i % 7} w{i % 5}" for i in range(300)).encode()]
    h, _, first, lines, *_ = m.line_sets(held)
    monkeypatch.setattr(m, "_LINES", 100)
    other = m.line_sets(held)
    assert (other[0] == h).all() and (other[2] == first).all() and (other[3] == lines).all() and len(lines) == 300
