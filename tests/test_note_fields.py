from pyspark.sql import functions as F

from scoreloom.sources import musicxml

XML = (
    '<score-partwise><part id="P1"><measure number="1"><attributes><divisions>4</divisions></attributes>'
    "<note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch><duration>4</duration><accidental cautionary='yes'>sharp</accidental>"
    "<notations><technical><fingering placement='above'>3</fingering></technical></notations></note>"
    "<note><pitch/><duration>4</duration><accidental-mark>flat</accidental-mark></note><note><rest/><duration>4</duration></note></measure></part></score-partwise>"
)


def test_elements_of_a_note_are_found_once_each(spark):
    docs = spark.createDataFrame([("s", XML)], "score_id string, xml string")
    notes = musicxml.note_rows(musicxml.timed_children(musicxml.measure_children(docs)))
    fields = notes.select("pos", "pitch", "accidental", "technical")
    rows = fields.orderBy("pos").collect()
    assert [r.pitch for r in rows] == ["C#4", "C0", None]
    assert [r.accidental and (r.accidental.type, r.accidental.cautionary, r.accidental.bracket) for r in rows] == [("sharp", True, None), None, None]
    assert [[(t.type, t.value, t.placement) for t in r.technical] for r in rows] == [[("fingering", "3", "above")], [], []]
    plan = fields.select(F.struct("pitch", "accidental").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<(pitch)") == 1 and plan.count("<(accidental)") == 1  # <pitch> was there 19 times
