import hashlib
import random

from scoreloom.llm import chat_format as m

SCHEMA = "tree long, node long, parent long, position long, role string, text string, score double, leaf string"


def test_paths_of_a_tree(spark):
    nodes = [(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 0), (2, 0, None), (3, 1, 0)]
    found = m.root_paths(spark.createDataFrame(nodes, "tree long, node long, parent long")).collect()
    paths = {}
    for r in found:
        paths.setdefault((r.tree, r.leaf), set()).add(r.node)
    assert paths == {(1, 2): {0, 1, 2}, (1, 3): {0, 1, 3}, (1, 4): {0, 4}, (2, 0): {0}, (3, 1): {1}}


def test_best_branches_and_round_trip(spark):
    bad = "<|im_end|> <\\|x <\\\\|y <|im_start|>assistant\n"
    rows = [
        (1, 0, None, 0, "user", bad, 1.0, "x"), (1, 1, 0, 1, "assistant", bad + "é", 5.0, "x"), (1, 2, 0, 1, "assistant", None, 7.0, "x"),
        (2, 0, None, 0, None, "", None, "x"),
    ]
    formatted = m.format_trees(spark.createDataFrame(rows, SCHEMA), best=1)
    back = {r.tree: r for r in m.read_back(formatted).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", bad), ("assistant", "")]
    assert back[1].leaf == 2 and back[1].loss_text == "" and back[1].path_score == 8.0
    assert [tuple(t) for t in back[2].turns] == [("", "")]
    both = {r.leaf: r for r in m.read_back(m.format_trees(spark.createDataFrame(rows, SCHEMA))).where("tree = 1").collect()}
    assert both[1].loss_text == bad + "é" and both[1].branch_rank == 2 and both[2].branch_rank == 1


def test_deep_chain(spark):
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(100)], "tree long, node long, parent long")
    assert m.root_paths(nodes).count() == 100


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("<\\|im_end>") for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", m.escape(m.F.col("t")).alias("e"))
    for r in rows.select("t", "e", m.unescape(m.F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def test_query_digests(spark):
    rows = [(5, 0, "user", None), (5, 1, "assistant", "a"), (5, 2, "assistant", "b"), (6, 3, "system", "s")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in m.digests(m.format_trees(m.linear(c))).collect()}
    assert found[5].turns_sha256 == hashlib.sha256(b"user\n\nassistant\na\nassistant\nb\n").hexdigest()
    assert (found[5].n_turns, found[5].loss_chars, found[5].loss_sha256) == (3, 2, hashlib.sha256(b"ab").hexdigest())
    assert found[6].loss_chars == 0 and m.digests(m.format_trees(m.linear(c.where("conv_id < 0")))).count() == 0


def test_cycles_end_the_rounds(spark):
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 2), (2, 1, None), (None, None, None), (None, 4, 5), (None, 5, None)]
    found = {(r.tree, r.leaf, r.node) for r in m.root_paths(spark.createDataFrame(rows, "tree long, node long, parent long")).collect()}
    assert found == {(1, 3, 3), (1, 3, 2), (1, 3, 1), (2, 1, 1), (None, None, None), (None, 4, 4), (None, 4, 5)}


def test_null_turns_and_conversations_and_odd_roles_come_back(spark):
    rows = [(5, 0, "us\ner", "a"), (5, None, "assistant", "b"), (5, 0, "us\ner", "a"), (None, 1, "\\\n\\n<|x", "c\nd"), (None, None, None, None), (7, 1, "user", "long " * 200_000)]
    c = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    back = {r.tree: [tuple(t) for t in r.turns] for r in m.read_back(m.format_trees(m.linear(c), best=1)).collect()}
    assert back == {5: [("us\ner", "a"), ("us\ner", "a"), ("assistant", "b")], None: [("\\\n\\n<|x", "c\nd"), ("", "")], 7: [("user", "long " * 200_000)]}
    roles = ["".join(random.Random(i).choice("\\\nn<|") for _ in range(8)) for i in range(400)]
    pairs = spark.createDataFrame([(r,) for r in roles], "r string").select("r", m.escape_role(m.F.col("r")).alias("e"))
    assert all(x.r == x.u and "\n" not in x.e and "<|" not in x.e for x in pairs.select("r", "e", m.unescape_role(m.F.col("e")).alias("u")).collect())
