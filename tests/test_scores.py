import pytest

from scoreloom.plans import score_diff as d
from scoreloom.sources import musicxml as m

NOTE = "<note>{chord}<pitch><step>{step}</step><octave>4</octave></pitch><duration>{dur}</duration>{tie}<voice>{voice}</voice><type>{kind}</type><staff>{staff}</staff><notations>{notations}</notations></note>"


def note(step="C", dur=2, chord="", voice=1, staff=1, kind="quarter", notations="", tie=""):
    return NOTE.format(step=step, dur=dur, chord="<chord/>" if chord else "", voice=voice, staff=staff, kind=kind, notations=notations, tie=tie)


def score(extra="", third="E", voice=5, text="dolce", wedge_at=0):
    return f"""﻿<?xml version="1.0"?><!-- a <note> in a comment --><score-partwise>
<work><work-title> A &amp; B </work-title></work><identification><creator type="composer">X</creator></identification>
<part-list><score-part id="P1"><part-name>Piano</part-name></score-part></part-list>
<part id="P1"><measure number="1"><attributes><divisions>2</divisions><key><fifths>-1</fifths></key><time><beats>4</beats><beat-type>4</beat-type></time><staves>2</staves>
<clef number="1"><sign>G</sign><line>2</line></clef><clef number="2"><sign>F</sign><line>4</line></clef></attributes>
<direction placement="below"><direction-type><words>{text}</words></direction-type><staff>1</staff></direction>
<direction><direction-type><wedge type="crescendo" number="1"/></direction-type><offset>{wedge_at}</offset><staff>1</staff></direction>
{note()}{note(third, chord="y")}{note("G", notations='<tied type="start"/><slur type="start" number="1"/>')}{note("G", notations='<tied type="stop"/>')}
<note><rest/><duration>2</duration><voice>1</voice><staff>1</staff></note>
<backup><duration>8</duration></backup>{note("A", 4, voice=voice, staff=2, kind="half", notations="<articulations><accent/></articulations>")}{note("B", 4, voice=voice, staff=2, kind="half")}
</measure><measure number="2">{note("D", 8, kind="whole", notations='<slur type="stop" number="1"/>')}
<direction><direction-type><wedge type="stop" number="1"/></direction-type><staff>1</staff></direction><barline location="right"><bar-style>light-heavy</bar-style></barline></measure>{extra}</part></score-partwise>"""


@pytest.fixture(scope="module")
def found(spark):
    variants = {
        "same": score(), "pitch": score(third="F"), "voice": score(voice=6), "text": score(text="  DOLCE "), "trailing": score(extra='<measure number="3"></measure>'),
        "hairpin": score(wedge_at=2), "extra": score(extra=f'<measure number="3">{note()}</measure>'),
    }
    docs = spark.createDataFrame([(k, v) for k, v in variants.items()], "score_id string, xml string")
    tables = m.read_scores(docs)
    cases = spark.createDataFrame([(k, "same", k) for k in variants], "case_id string, expected_id string, actual_id string")
    issues = d.diff(tables, tables, cases).cache()
    return tables, cases, issues


def test_cursor_and_chords(found):
    events = {(r.event_id, r.type, r.at, r.duration, r.voice) for r in found[0]["events"].where("score_id = 'same' AND measure_no = 1").collect()}
    assert events == {
        ("P1.m1.e1", "chord", "0", "1/4", 1), ("P1.m1.e2", "chord", "1/4", "1/4", 1), ("P1.m1.e3", "chord", "1/2", "1/4", 1), ("P1.m1.e4", "rest", "3/4", "1/4", 1),
        ("P1.m1.e5", "chord", "0", "1/2", 5), ("P1.m1.e6", "chord", "1/2", "1/2", 5), ("P1.m1.d1.1", "text", "0", None, None),
    }
    first = found[0]["events"].where("score_id = 'same' AND event_id = 'P1.m1.e1'").first()
    assert [n.pitch for n in first.notes] == ["C4", "E4"]


def test_header_measures_relations_spans(found):
    tables = found[0]
    head = tables["scores"].where("score_id = 'same'").first()
    assert (head.title, head.composer) == ("A & B", "X")
    rows = {r.measure_no: r for r in tables["measures"].where("score_id = 'same'").collect()}
    assert rows[2].right_barline == "final" and rows[1].staves == 2 and len(rows[1].clefs) == 2
    kinds = sorted((r.kind, [x.event_id for x in r.members]) for r in tables["relations"].where("score_id = 'same'").collect())
    assert kinds == [("slur", ["P1.m1.e2", "P1.m2.e1"]), ("tie", ["P1.m1.e2", "P1.m1.e3"])]
    span = tables["spans"].where("score_id = 'same'").first()
    assert (span.kind, span["from"].measure, span["from"].at, span.to.measure, span.to.at) == ("hairpin", 1, "0", 2, "1")


def test_issues_of_each_case(found):
    issues = {}
    for r in found[2].collect():
        issues.setdefault(r.case_id, []).append((r.code, r.severity))
    assert issues == {
        "pitch": [("note.pitch", "Critical")],
        "hairpin": [("relation.hairpin.span", "Warning")],
        "extra": [("measure.extra", "Error"), ("event.extra", "Critical")] if issues["extra"][0][0] == "measure.extra" else [("event.extra", "Critical"), ("measure.extra", "Error")],
    }


def test_summary_and_causes(found):
    _, cases, issues = found
    status = {r.case_id: (r.status, r.critical) for r in d.corpus_summary(cases, issues).collect()}
    assert status["same"] == ("clean", 0) and status["pitch"] == ("differences", 1)
    assert d.filter_severity(issues, "Critical").count() == 2
    causes = d.root_causes(issues).where("case_id = 'pitch'").collect()
    assert len(causes) == 1 and causes[0].summary == "note.pitch E4 -> F4"
