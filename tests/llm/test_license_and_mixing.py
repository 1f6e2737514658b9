import random
from fractions import Fraction

from pyspark.sql import functions as F

from scoreloom.llm import license_scan, mixing


def test_licenses_by_canonical_digest(spark):
    rows = [
        (1, "Copyright (c) 2020 A\nReleased under the  mit licence!"), (2, "x\nLICENSED under the Apache License, version 2.0\nReleased under the MIT License."),
        (3, None), (4, ""), (5, "Released under the MIT License. Not quite."), (6, "..."), (2, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license_id string")
    found = {r.doc_id: tuple(r)[1:] for r in license_scan.scan_licenses(docs).collect()}
    assert found == {1: ("MIT", "MIT", 1, 2), 2: ("MIT", "Apache-2.0,MIT", 3, 4), 3: ("", "", 0, 1), 4: ("", "", 0, 1), 5: ("", "", 0, 1), 6: ("", "", 0, 1)}
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_whole_texts_notices_and_clauses(spark):
    import textwrap

    from scoreloom.llm.license_texts import TEXTS

    wrap = lambda text, n: "\n\n".join(textwrap.fill(p, n) for p in text.split("\n\n"))
    rows = [(i, f"Copyright (c) {1990 + i} Some One\nAll rights reserved.\n\n" + wrap(text.upper(), 40 + i)) for i, (_, text) in enumerate(TEXTS)]
    notice = dict(TEXTS)["MPL-2.0"]
    rows += [(50, f"Some code.\n\n{wrap(notice, 50)}\n\nMore code."), (51, "(c) You may copy."), (52, "(c) You may never copy."), (53, "© 2020 A\n" + "x " * 200_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license_id string")
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert all(found[i].whole_license == name for i, (name, _) in enumerate(TEXTS))
    assert found[50].license_ids == "MPL-2.0" and found[50].whole_license == "" and found[53].license_ids == ""
    known = spark.createDataFrame([("B", "(c) You may copy."), ("A", "(C) you may COPY")], "license_id string, text string")
    found = {r.doc_id: r.whole_license for r in license_scan.scan_licenses(docs, known).collect()}
    assert found[51] == "A" and found[52] == ""


def test_titles_signs_and_licences_inside_files(spark):
    from scoreloom.llm.license_texts import TEXTS

    mit, bsd = dict(TEXTS)["MIT"], dict(TEXTS)["BSD-3-Clause"]
    comment = lambda text: "/*\n" + "\n".join(f" * {x}" for x in text.split("\n")) + "\n */\n\nint main() {}\n"
    texts = [
        f"The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n\n{mit}", f"MIT License\n{mit}", mit.replace('"', "\u201d"), "Released under the MIT\u00a0License.", comment(f"Copyright 2020 A\n\n{mit}"),
        comment(mit) + comment(bsd), f"Intro\n\nBSD 3-Clause License\n\n{bsd}\n\nMore.", mit.replace("\n\n", " "), mit.replace("free of charge", "for a fee"), "The MIT License", f"v v v\n{mit} v",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.whole_license, r.license_ids) for r in license_scan.scan_licenses(docs).collect()}
    one = ("MIT", "MIT")
    assert [found[i] for i in range(11)] == [one, one, one, one, ("", "MIT"), ("", "BSD-3-Clause,MIT"), ("", "BSD-3-Clause"), one, ("", ""), ("", ""), ("", "")]


def test_full_texts_by_their_digests(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(name, "\u2014 " + (folder / f).read_text().upper().replace("\n", " \r\n")) for f, name in files.items() if (folder / f).exists()]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert all(r.doc_id == r.whole_license for r in license_scan.scan_licenses(docs).collect())


def test_blocks_grow_so_that_the_schedule_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 50, f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    blocks = lambda **more: mixing.mix(docs, block_chars=51, **more).select("source", "block").distinct().count()
    assert blocks() == 600 and blocks(most_blocks=40) <= 40 + 3
    assert mixing.mix(docs, block_chars=51, most_blocks=40).select("doc_id").distinct().count() == 600


def test_every_row_once_and_targets_met(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(1, 40), "a" if i % 3 else rng.choice(["b", None]), i) for i in range(900)] + [(5000, None, "b", 0), (5001, "y" * 3000, "b", 0), (7, "x", "a", 0), (7, "x", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot long")
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("", 1.0), ("none", 9.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights, block_chars=200, frame=8, bucket_rows=50).cache()
    assert mixed.count() == len(rows)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r[0] for r in rows)
    slots = mixed.select("source", "block", "slot").distinct()
    assert slots.count() == slots.select("slot").distinct().count()
    first = [r.source for r in slots.where("slot < 8").orderBy("slot").collect()]
    assert first.count("a") == 4 and first.count("b") <= 2 and first.count("") <= 2
    order = mixed.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "block", "slot"))).alias("o")).collect()
    assert all(x.block <= y.block and x.slot <= y.slot for r in order for x, y in zip(r.o, r.o[1:], strict=False))


def test_empty_and_weightless(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(one, none.selectExpr("source", "CAST(doc_id AS DOUBLE) AS weight")).first().slot == 0


def test_targets_are_the_weights_over_many_frames():
    rng = random.Random(5)
    many = [(f"s{i:03}", 400, rng.random() + 0.001) for i in range(300)]
    for sources in ([("big", 60_000, 0.7071), ("mid", 60_000, 0.29279), ("tiny", 60_000, 0.0001)], [("a", 9000, 1 / 3), ("b", 20_000, 0.4137), ("c", 20_000, 1e-9)], many):
        weight, had, phase, start = {s: Fraction(w) for s, _, w in sources}, {}, -1, 0
        ends, total, seen = {s: n for s, n, _ in sources}, Fraction(0), dict.fromkeys(weight, 0)
        for source, block, p, slot in mixing.schedule(sources):
            if p != phase:
                phase, start, had = p, slot, {s: 0 for s in weight if seen[s] < ends[s]}
                total = sum(weight[s] for s in had)
                shares = {s: float(weight[s] / total) for s in had}
            assert block == seen[source] and slot == sum(seen.values()) if slot % 997 == 0 else block == seen[source]
            seen[source] += 1
            had[source] += 1
            if slot % 89 == 0 or seen[source] == ends[source]:
                assert all(abs(n - shares[s] * (slot + 1 - start)) < 1 + 1e-6 for s, n in had.items())
        assert seen == ends


def test_mixture_meets_an_uneven_weight(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 700)
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 99) AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source")
    weights = spark.createDataFrame([("a", 0.9937), ("b", 0.0063)], "source string, weight double")
    slots = mixing.mix(docs, weights, block_chars=100).select("source", "slot", "phase").collect()
    assert sorted(r.slot for r in slots) == list(range(4000))
    run = sorted((r.slot, r.source) for r in slots if r.phase == 0)
    assert abs(sum(s == "b" for _, s in run) - 0.0063 * len(run)) < 1 and sum(s == "a" for _, s in run) == 2000
