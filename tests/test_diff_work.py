"""What the score diff does not do again: equal measures are left alone, tables are written once, sides meet in one shuffle."""

from pyspark.sql import functions as F

from scoreloom.operators import matching
from scoreloom.plans import score_diff, score_queries

SF = "/root/testdata/sf0.001"


def test_events_are_written_once_and_equal_measures_are_not_matched(spark, monkeypatch):
    written, write = {}, score_diff.materialize
    monkeypatch.setattr(score_diff, "materialize", lambda df, name: written.setdefault(name, []).append(write(df, name)) or written[name][-1])
    issues = score_queries.s_score_diff(spark, SF)
    assert len(written["events"]) == 2  # no part has two staves and no staff two voices
    differing = written["differing"][0]
    place = ["case_id", "part_idx", "measure_no"]
    both = written["measures"][-2].select(place).intersect(written["measures"][-1].select(place))
    assert 0 < differing.count() < both.count()
    found = issues.where("code LIKE 'event.%' OR code LIKE 'note.%'").select(place).distinct()
    assert found.count() > 0 and found.join(differing, place, "left_anti").count() == 0


def test_equal_chords_with_a_repeated_pitch_are_still_compared(spark):
    note = "struct('C4' AS pitch, 1 AS staff, {} AS accidental)"
    kind = "CAST(NULL AS struct<type:string,cautionary:boolean,editorial:boolean,parentheses:boolean,bracket:boolean>)"
    sharp = "struct('sharp' AS type, false AS cautionary, false AS editorial, false AS parentheses, false AS bracket)"
    mark = "CAST(NULL AS array<struct<type:string,subtype:string,placement:string>>)"
    names = {"text": "string", "value": "string", "target": "string", "placement": "string", "beat_unit": "string", "bpm": "decimal(10,3)", "grace": "boolean"}
    events = spark.sql(
        f"SELECT 'c' AS case_id, 0 AS part_idx, 1 AS measure_no, 'e' AS event_id, 'chord' AS type, '0' AS at, 1 AS event_staff, 1 AS voice, '1/4' AS duration, array('C4/1', 'C4/1') AS content, "
        f"array({note.format(sharp)}, {note.format(kind)}) AS notes, named_struct('note_type', '', 'dots', 0, 'stem', '', 'notehead', '', 'articulations', {mark}, 'ornaments', {mark}, 'fermatas', {mark}) AS notation, "
        + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in names.items())
    )
    matches = spark.sql("SELECT 'c' AS case_id, 0 AS part_idx, 1 AS measure_no, 'e' AS expected_id, 'e' AS actual_id, 1 AS tier")
    assert {r.code for r in score_diff.event_issues(events, events, matches).collect()} == {"note.accidental"}


def test_occurrences_meet_in_one_shuffle(spark):
    rows = spark.range(40).select((F.col("id") % 7).alias("k"), F.col("id").alias("i"))
    pairs = matching.match_occurrences(rows, rows.where("i % 3 > 0"), ["k"], ["i"], ["i"])
    assert pairs.where("side = 'missing'").count() == 14
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
