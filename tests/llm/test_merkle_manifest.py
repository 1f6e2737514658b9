import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import merkle_manifest as mm


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and, for each node, its siblings level by level, in plain Python."""
    paths, at, below = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(below) > 1:
        for i, k in enumerate(at):
            run = below[k // 3 * 3 : k // 3 * 3 + 3]
            paths[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            at[i] = k // 3
        below = [H(*below[k : k + 3]) for k in range(0, len(below), 3)]
    return below[0], paths


def expected(rows):
    sources = {}
    for doc_id, source, leaf in rows:
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s])]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for (has, doc_id, leaf), path in zip(sorted(sources[s]), trees[s][1], strict=True):
            text = "".join(x + y for x, y in path + up)
            out.append((doc_id if has else None, s, leaf, trees[s][0], root, H(text)))
    return sorted(out, key=str)


SHAPES = {
    "several sources": [(i, f"s{i % 3}") for i in range(50)] + [(i, "big") for i in range(100, 400)],
    "lone leaves": [(7, "only"), (8, "other")],
    "one leaf": [(1, "a")],
    "nulls, ties and repeats": [(None, None), (None, None), (1, None), (1, None), (2, ""), (2, ""), (3, "é"), (3, "z"), (3, "Z")],
    "a full subtree and one more": [(i, "x") for i in range(82)],
}


@pytest.mark.parametrize("stride", [1, 2, 4])
@pytest.mark.parametrize("name", SHAPES)
def test_trees_and_proofs(spark, name, stride):
    if stride != 4 and name not in ("nulls, ties and repeats", "a full subtree and one more"):
        return
    rows = [(i, s, H(f"{i}{s}{k % 5}")) for k, (i, s) in enumerate(SHAPES[name])]
    random.Random(1).shuffle(rows)
    leaves = spark.createDataFrame(rows, "doc_id long, source string, leaf string").withColumn("tree", F.lit("clash")).withColumn("n", F.lit(0))
    found = mm.proofs(mm.build(leaves, ["doc_id"], stride=stride)).withColumn("folded", mm.folded(F.col("leaf"), F.col("path"))).collect()
    assert all(r["folded"] == r["root"] for r in found)
    got = [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], H("".join(p["left"] + p["right"] for p in r["path"]))) for r in found]
    assert sorted(got, key=str) == expected(rows)


def test_proofs_of_some_leaves(spark):
    rows = [(i, "a", H(str(i))) for i in range(200)]
    made = mm.build(spark.createDataFrame(rows, "doc_id long, source string, leaf string"), ["doc_id"], stride=2)
    assert [level.count() for level in made.levels] == [200, 23, 3, 1]
    wanted = spark.createDataFrame([("sa", 0), ("sa", 199), ("sa", 500)], "tree string, idx long")
    found = mm.proofs(made, wanted).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 199]
    whole = {r["doc_id"]: r["path"] for r in mm.proofs(made).collect()}
    assert all(r["path"] == whole[r["doc_id"]] for r in found)


def test_empty_table(spark):
    made = mm.build(spark.createDataFrame([], "doc_id long, source string, leaf string"), ["doc_id"])
    assert made.root is None and mm.proofs(made).count() == 0


def test_leaf_fields_have_their_lengths(spark):
    docs = spark.createDataFrame([(1, "é", None, 5, "a\nb"), (1, None, "", None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    found = docs.select(mm.leaf([F.col(c) for c in mm.FIELDS]).alias("h")).collect()
    assert [r["h"] for r in found] == [H("1:1", "2:é", "-", "1:5", "3:a\nb"), H("1:1", "-", "0:", "-", "-")]


def test_query_tells_tampered_texts(spark, tmp_path):
    rows = [(i, "s", "en", 3, "a\nb" if i % 3 else "ab") for i in range(40)] + [(50, "t", None, None, None), (51, "t", "", 0, "x" * 300_000 + "\n")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("idx", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    for r in mm.query(spark, str(tmp_path)).collect():
        text = next(x[4] for x in rows if x[0] == r["doc_id"])
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (text or "")
        assert r["verified"] == (not changed)
