"""Each stage of the pipeline against brute force on its own input."""

import random

import corpus_pipeline
from test_decontamination import brute as brute_contaminated
from test_jaccard_join import brute as brute_jaccard
from test_line_dedup import brute as brute_lines


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, line(20)) for i in range(3)]
    docs, labels = [], []
    for i in range(240):
        text = "\n".join(line(rng.randrange(8, 30)) for _ in range(3))
        if i % 8 == 0:
            text += " " + " ".join(f"vile{rng.choice(['', 'st', 'ness'])}" for _ in range(6))
        docs.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, 1, int(i % 8 == 0)))
    docs[11][1] = docs[9][1] + " end"
    docs[13][1] = docs[13][1] + "\n" + docs[9][1].split("\n")[0]
    docs[14][1] = bench[1][1]
    docs[15][1] = docs[9][1]
    docs[17][1] = "\n".join(line(60) for _ in range(9)) + "\n" + bench[2][1]
    docs += [[300, None, None, None, None], [301, "", "en", None, 0]]
    frame = spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def rows(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    given, kept = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, given, str(tmp_path)).write.parquet(path)
        before, given = rows(given), spark.read.parquet(path)
        kept[name] = (before, rows(given))
        if name != "mixing":
            assert given.columns == frame.columns
    before, after = kept["toxicity"]
    assert {d for d, _ in before} - {d for d, _ in after} == {i for i in range(240) if i % 8 == 0}
    before, after = kept["line_dedup"]
    gone = brute_lines(before)
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) if t is not None else None for d, t in before}
    emptied = {d for d, t in before if t and t.split() and not expected[d].split()}
    assert dict(after) == {d: t for d, t in expected.items() if d not in emptied} and gone[13] == [3] and len(gone[11]) >= 2
    assert 15 in emptied and {300, 301} <= set(dict(after))
    before, after = kept["ngram_jaccard"]
    assert sorted(d for d, _ in after) == sorted(d for d, _, c in brute_jaccard(before, 5, 80) if d == c)
    before, after = kept["decontamination"]
    assert sorted(d for d, _ in after) == sorted(d for d, *_, bad in brute_contaminated(before, bench) if not bad) and 14 not in dict(after)
    assert bench[2][1] in dict(before)[17] and dict(after)[17] == dict(before)[17]
    before, after = kept["mixing"]
    assert sorted(map(str, before)) == sorted(map(str, after))
    assert given.select("slot", "place").distinct().count() == given.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)
