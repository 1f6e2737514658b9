import random

from scoreloom.llm import decontamination as m

BENCH = "item_id long, text string, doc_id string"
DOCS = "doc_id long, text string, item_id string"


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = m.words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).update([str(item)] if item is not None else [])
    out = []
    for doc, text in docs:
        w, hit, items = m.words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    items |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, bench, **more):
    d = spark.createDataFrame([(*r, "x") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "x") for r in bench], BENCH)
    found = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in m.judged(m.scan(d, b, **more)).collect()]
    assert sorted(found, key=str) == brute(docs, bench)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["ab", "Ab", "c", "é-d"]) for _ in range(n))
    bench = [(i, text(rng.choice([1, 3, 14, 20]) + 4)) for i in range(6)] + [(10, None), (11, "..."), (3, "AB c")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)] + [(61, None), (62, ""), (63, bench[3][1]), (63, bench[3][1])]
    docs += [(63, bench[2][1] + " zz"), (None, "ab"), (None, bench[1][1]), (64, "ab " * 300)]
    bench += [(None, "ab ab ab"), (12, "ab " * 400), (13, "Ab c " * 40)]
    check(spark, docs, bench)
    check(spark, docs, bench, block_chars=40)  # several blocks


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")])
    check(spark, [(1, "a b")], [])


def test_clean_documents_stay(spark):
    long = " ".join(f"w{i}" for i in range(400))
    item = " ".join(f"b{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"{long} {item}", "x"), (2, item.upper(), "x"), (3, None, "x")], DOCS)
    bench = spark.createDataFrame([(1, item, "x")], BENCH)
    assert sorted(r.doc_id for r in m.decontaminate(docs, bench).collect()) == [1, 3]
    assert m.decontaminate(docs, bench).columns == docs.columns


def test_short_spans_are_cut_and_rows_judged_alone(spark):
    long = " ".join(f"w{i}," for i in range(400))
    item = " ".join(f"b{i}" for i in range(13))
    schema = "doc_id long, text string, n_chars long"
    docs = spark.createDataFrame([(1, f"Ä {long} {item.upper()}; {item}!", 9), (1, item, 9), (None, item, 9), (None, "clean", 5), (2, None, None)], schema)
    bench = spark.createDataFrame([(1, item, "x")], BENCH)
    kept = f"Ä {long} !"
    for block_chars in (1 << 22, 10):
        found = sorted((tuple(r) for r in m.decontaminate(docs, bench, share=15, cut=True, block_chars=block_chars).collect()), key=str)
        assert found == sorted([(1, kept, len(kept)), (None, "clean", 5), (2, None, None)], key=str)
    found = sorted((r.doc_id for r in m.decontaminate(docs, bench, share=15).collect()), key=str)
    assert found == [1, 2, None]
    assert m.decontaminate(docs.limit(0), bench, cut=True).count() == 0


def test_items_of_equal_words_take_linear_time():
    import time

    began = time.monotonic()
    automaton = m.SuffixAutomaton([("a", [b"x"] * 60_000)])
    assert automaton.scan([b"x"] * 50_000) == ([(0, 50_000)], {"a"}) and time.monotonic() - began < 20
