from pyspark.sql import functions as F

from scoreloom.functions import fractions, geometry, text
from scoreloom.operators import components, grouped, matching, notation, ranking, sequences, spatial
from scoreloom.plans import score_jobs


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_fractions(spark):
    df = spark.createDataFrame([("3/8", "1/4"), ("6/8", " 2 / 4 "), ("", "1"), ("-1/2", "1/2")], "a string, b string")
    a, b = fractions.frac_parse(F.col("a")), fractions.frac_parse(F.col("b"))
    found = [tuple(r) for r in df.select(fractions.frac_str(fractions.frac_add(a, b)), fractions.frac_str(fractions.frac_sub(a, b))).collect()]
    assert found == [("5/8", "1/8"), ("5/4", "1/4"), ("1", "-1"), ("0", "-1")]
    one = spark.range(1)
    assert one.select(fractions.frac_str(fractions.dotted(F.lit(1), F.lit(4), F.lit(2)))).first()[0] == "7/16"
    assert one.select(fractions.lcm_of(F.array(*(F.lit(x).cast("long") for x in (4, 6, 10))))).first()[0] == 60


def test_pitch(spark):
    one = spark.range(1)
    d = text.diatonic(F.lit(10), F.lit("G"), F.lit(2))
    assert tuple(one.select(d.alias("d")).first().d) == ("C", 4)  # the ledger line below the treble staff
    assert tuple(one.select(text.diatonic(F.lit(2), F.lit("F"), F.lit(4)).alias("d")).first().d) == ("F", 3)
    assert one.select(text.midi(F.lit("C#4")), text.midi(F.lit("?")), text.pitch_text(F.lit("C"), F.lit(3), F.lit(4))).first() == (61, 2147483647, "C(+3)4")
    assert one.select(text.key_alter(F.lit("B"), F.lit(-1)), text.key_alter(F.lit("F"), F.lit(1)), text.key_alter(F.lit("C"), F.lit(1))).first() == (-1, 1, 0)


def test_geometry(spark):
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (3.0, 0.0), (3.0, 4.0))))
    row = spark.range(1).select(geometry.poly_length(points), geometry.signed_area(points), geometry.point_segment(*map(F.lit, (0.0, 2.0, -1.0, 0.0, 1.0, 0.0)))).first()
    assert tuple(row) == (7.0, 6.0, 2.0)


def test_pairs_and_islands(spark):
    marks = spark.createDataFrame([("a", i, k) for i, k in enumerate(["stop", "start", "start", "x", "stop", "stop"])], "p string, i int, k string")
    found = sequences.pair_spans(marks, ["p"], ["i"], F.col("k") == "start", F.col("k") == "stop")
    assert rows(found, "start_i", "stop_i") == [(2, 4)]
    spans = spark.createDataFrame([(1, 3), (3, 4), (6, 7), (5, 6), (9, 9)], "lo int, hi int").withColumn("p", F.lit(1))
    assert rows(sequences.overlap_islands(spans, ["p"], "lo", "hi"), "lo", "island") == [(1, 1), (3, 1), (5, 2), (6, 2), (9, 3)]
    trimmed = sequences.trim_trailing(marks.where("i < 1 OR k = 'x'"), ["p"], ["i"], F.col("k") == "x")
    assert rows(trimmed, "i") == [(0,)]


def test_asof_ties_and_gaps(spark):
    states = spark.createDataFrame([("s", 2, "A"), ("s", 5, "B")], "s string, m int, v string")
    asked = spark.createDataFrame([("s", 1), ("s", 2), ("s", 9), ("t", 9)], "s string, m int")
    assert rows(sequences.asof_state(asked, states, ["s"], ["m"], ["v"]), "s", "m", "v") == [("s", 1, None), ("s", 2, "A"), ("s", 9, "B"), ("t", 9, None)]


def test_assignments(spark):
    c = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 2), (3, 10, 3), (3, 12, 9)], "l int, r int, cost int")
    assert rows(matching.greedy_assignment(c, "l", "r", ["cost"]), "l", "r") == [(1, 10), (3, 12)]
    most = matching.max_assignment(c.withColumn("g", F.lit(0)), ["g"], "l", "r", "cost")
    assert rows(most, "l", "r") == [(1, 11), (2, 10), (3, 12)]
    labels = spark.createDataFrame([("1", "5", 8), ("1", "6", 1), ("2", "6", 4), ("3", "7", 1)], "a string, b string, n int")
    assert rows(matching.align_labels(labels, "a", "b", "n"), "a", "b") == [("1", "5"), ("2", "6")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (52, 51), (60, 60), (None, 1)], "a int, b int")
    found = dict(rows(components.components(edges), "node", "component"))
    assert set(found.values()) == {0, 50, 60} and found[20] == 0 and found[52] == 50


def test_bags_null_keys_and_tiers(spark):
    a, b = spark.createDataFrame([("x",), ("x",), (None,)], "k string"), spark.createDataFrame([("x",), (None,), ("y",)], "k string")
    assert rows(matching.bag_diff(a, b, ["k"]), "k", "missing", "extra") == [("x", 1, 0), ("y", 0, 1)]
    pairs = matching.match_occurrences(a.withColumn("i", F.lit(1)), b.withColumn("i", F.lit(1)), ["k"], ["i"], ["i"])
    assert rows(pairs, "k", "side") == [("x", "both"), ("x", "missing"), ("y", "extra"), (None, "both")]


def test_lanes_lines_and_staffs(spark):
    items = spark.createDataFrame([("m", i, n, None) for i, n in enumerate([4, 2, 2, 4])], "m string, i int, n int, v int")
    lanes = grouped.capacity_lanes(items, ["m"], ["i"], "n", 8, prefer="v")
    assert {r.lane for r in lanes.collect()} == {1, 2} and lanes.where("lane IS NULL").count() == 0
    lines = [(1, i, 10.0 * i + (300 if i >= 5 else 0), 0.0, 100.0) for i in range(10)] + [(1, 10, 20.0, 0.0, 9.0)]
    staffs = grouped.scan_staffs(spark.createDataFrame(lines[:10], "page int, line int, y double, x_start double, x_end double"), ["page"])
    assert rows(staffs, "staff", "first_line", "spacing") == [(1, 0, 10.0), (2, 5, 10.0)]


def test_spatial(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, None, 1.0)], "id int, x double, y double")
    anchors = spark.createDataFrame([(7, 0.5, 0.0), (8, -0.5, 0.0), (9, 5.9, 5.9)], "a int, ax double, ay double")
    assert rows(spatial.nearest_within(points, anchors, [], "id", "a", 1.0), "id", "a") == [(1, 7)]
    orders = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "o int, f string")
    assert rows(spatial.divide(orders, ["o"], "f", orders.select("f")), "o") == [(1,)]


def test_ranking(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 8.0), (1, 4.0), (1, -1.0), (2, None)], "k int, v double")
    assert rows(ranking.upper_median(df, ["k"], "v", 30.0), "k", "median") == [(1, 4.0), (2, 30.0)]


def test_notation_steps(spark):
    notes = spark.createDataFrame([("s", 1, 1, "n1", 1.0, 4, ), ("s", 1, 1, "n2", 2.0, 4), ("s", 2, 1, "n3", 1.0, 4)], "score_id string, measure_no int, staff int, note_id string, x double, staff_step int")
    clefs = spark.createDataFrame([("s", 1, 1, 0.0, "G", 2)], "score_id string, measure_no int, staff int, x double, sign string, line int")
    keys = spark.createDataFrame([("s", 1, 1, -2)], "score_id string, measure_no int, staff int, fifths int")
    acc = spark.createDataFrame([("s", 1, 1, "a1", "natural", 1.5, 4.1)], "score_id string, measure_no int, staff int, accidental_id string, kind string, x double, step double")
    assert rows(notation.pitches(notes, clefs, keys, acc), "note_id", "pitch", "is_explicit") == [("n1", "Bb4", False), ("n2", "B4", True), ("n3", "Bb4", False)]
    items = spark.createDataFrame([(1, "i1", 0.0), (1, "i2", 9.0)], "m int, i string, x double")
    heads = spark.createDataFrame([(1, "h1", 0.1), (1, "h2", 0.12)], "m int, h string, hx double")
    gap = F.abs(F.col("x") - F.col("hx"))
    assert rows(notation.attach(items, heads, ["m"], "i", "h", gap < 1, gap, 0.05), "i", "decision") == [("i1", "ambiguous"), ("i2", "no-candidate")]


def test_discovery(spark):
    files = spark.createDataFrame([("/c/a/x.musicxml",), ("/c/a/p-1.svg",), ("/c/a/p-2.svg",), ("/c/b/x.musicxml",), ("/c/out/x.musicxml",), ("/c/out/p-1.svg",)], "path string")
    assert rows(score_jobs.discover_cases(files), "folder") == [("/c/a/",)]
    assert rows(score_jobs.discover_pages(files.where("path LIKE '/c/a/%'")), "page_no") == [(1,), (2,)]
