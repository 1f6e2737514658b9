"""Whole scores written and read again are the same scores."""

import pytest
from pyspark.sql import functions as F

from scoreloom.plans import score_diff, score_writing
from scoreloom.sources import musicxml as m


def note(step, dur, *, chord="", voice=1, staff=1, kind="quarter", octave=4, extra="", notations=""):
    return f"<note>{chord}<pitch><step>{step}</step><octave>{octave}</octave></pitch><duration>{dur}</duration><voice>{voice}</voice><type>{kind}</type>{extra}<staff>{staff}</staff>{notations and f'<notations>{notations}</notations>'}</note>"


def beam(text, level=1):
    return f'<beam number="{level}">{text}</beam>'


RATIO = "<time-modification><actual-notes>3</actual-notes><normal-notes>2</normal-notes></time-modification>"
FULL = f"""<score-partwise><work><work-title>A &amp; B</work-title></work><identification><creator type="composer">X &lt;Y&gt;</creator></identification>
<part-list><score-part id="P1"><part-name>Piano</part-name></score-part><score-part id="P2"><part-name>Flute "1"</part-name></score-part></part-list>
<part id="P1"><measure number="1"><attributes><divisions>12</divisions><key><fifths>-1</fifths><mode>minor</mode></key><time><beats>4</beats><beat-type>4</beat-type></time><staves>2</staves>
<clef number="1"><sign>G</sign><line>2</line></clef><clef number="2"><sign>F</sign><line>4</line><clef-octave-change>-1</clef-octave-change></clef></attributes>
<barline location="left"><bar-style>heavy-light</bar-style><repeat direction="forward"/></barline>
<direction placement="below"><direction-type><words>poco &amp; dolce</words></direction-type><staff>1</staff></direction>
<direction><direction-type><dynamics><mf/></dynamics></direction-type><offset>12</offset><staff>2</staff></direction>
<direction placement="above"><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>96</per-minute></metronome></direction-type><staff>1</staff></direction>
<direction><direction-type><wedge type="crescendo" number="1"/></direction-type><offset>6</offset><staff>1</staff></direction>
<direction><direction-type><wedge type="diminuendo" number="2"/></direction-type><offset>12</offset><staff>1</staff></direction>
<direction><direction-type><pedal type="start" line="yes"/></direction-type><staff>2</staff></direction>
{note("C", 6, kind="eighth", extra=beam("begin"), notations='<slur type="start" number="1" placement="above"/><articulations><staccato placement="below"/><accent/></articulations>')}
{note("D", 3, kind="16th", extra=beam("continue") + beam("begin", 2))}{note("E", 3, kind="16th", extra=beam("end") + beam("end", 2), notations='<slur type="stop" number="1"/><slur type="start" number="2"/>')}
{note("F", 4, kind="eighth", extra=RATIO, notations='<tuplet type="start" number="1" bracket="yes"/>')}{note("G", 4, kind="eighth", extra=RATIO)}{note("A", 4, kind="eighth", extra=RATIO, notations='<tuplet type="stop" number="1"/>')}
{note("C", 12, extra="<accidental cautionary='yes'>sharp</accidental><stem>up</stem><notehead>x</notehead>", notations='<arpeggiate/><technical><fingering placement="above">3</fingering></technical>')}{note("E", 12, chord="<chord/>", notations='<arpeggiate/><tied type="start"/>')}
{note("E", 12, notations='<tied type="stop"/><tied type="start"/><fermata type="upright"/>')}
<backup><duration>48</duration></backup><forward><duration>12</duration></forward>{note("A", 36, voice=5, staff=2, kind="half", extra="<dot/>", octave=3)}
</measure><measure number="2"><print new-system="yes"/>
<direction><direction-type><wedge type="stop" number="1"/></direction-type><staff>1</staff></direction><direction><direction-type><wedge type="stop" number="2"/></direction-type><offset>24</offset><staff>1</staff></direction>
<direction><direction-type><pedal type="stop"/></direction-type><offset>24</offset><staff>2</staff></direction>
<direction><direction-type><octave-shift type="down" size="8"/></direction-type><staff>1</staff></direction><direction><direction-type><octave-shift type="stop" size="8"/></direction-type><offset>36</offset><staff>1</staff></direction>
{note("E", 24, kind="half", notations='<tied type="stop"/><slur type="stop" number="2"/>')}<note><rest/><duration>24</duration><voice>1</voice><type>half</type><staff>1</staff></note>
<barline location="right"><bar-style>light-heavy</bar-style><repeat direction="backward" times="2"/></barline></measure><measure number="3"></measure></part>
<part id="P2"><measure number="1"><attributes><divisions>12</divisions></attributes>{note("C", 48, kind="whole")}</measure><measure number="2">{note("B", 48, kind="whole")}</measure><measure number="3"></measure></part></score-partwise>"""


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    docs = spark.createDataFrame([("full", FULL)], "score_id string, xml string")
    first = m.read_scores(docs)
    written = score_writing.score_documents(first, 12)
    path = str(tmp_path_factory.mktemp("written") / "docs")
    written.write.parquet(path)
    return first, m.read_scores(spark.read.parquet(path))


def rows(table, drop=()):
    return sorted((r.asDict(recursive=True) for r in table.drop(*drop).collect()), key=str)


def test_headers_measures_and_spans_come_back(both):
    a, b = both
    for name in ("scores", "parts", "measures"):
        assert rows(a[name]) == rows(b[name]) and rows(a[name]), name
    assert rows(a["spans"]) == rows(b["spans"]) and a["spans"].count() == 4


def test_events_come_back(both):
    a, b = both
    assert rows(a["events"], ["pos", "event_id", "part_of"]) == rows(b["events"], ["pos", "event_id", "part_of"]) and a["events"].count() == 16


def test_relations_come_back(both):
    a, b = both

    def placed(t):
        at = {(r["part_id"], r["event_id"]): (r["measure_no"], r["at"], r["voice"]) for r in t["events"].collect()}
        out = []
        for r in t["relations"].collect():
            d = r.asDict(recursive=True)
            d["members"] = [(at[(d["part_id"], x["event_id"])], x["pitch"]) for x in d["members"]]
            out.append(d)
        return sorted(out, key=str)

    assert placed(a) == placed(b)
    kinds = [r["kind"] for r in placed(a)]
    assert {k: kinds.count(k) for k in set(kinds)} == {"beam": 2, "slur": 2, "tie": 2, "tuplet": 1, "arpeggio": 1}


def test_the_diff_of_a_score_and_itself_is_empty(spark, both):
    a, b = both
    cases = spark.createDataFrame([("c", "full", "full")], "case_id string, expected_id string, actual_id string")
    assert score_diff.diff(a, b, cases).count() == 0


def test_markers_of_hooks_and_lone_members(spark):
    kind = "score_id string, part_id string, kind string, level int, hook string, members array<struct<event_id:string,pitch:string>>"
    relations = spark.createDataFrame([("s", "P", "beam", 2, "forward", [("e1", None)]), ("s", "P", "beam", 1, None, [("e1", None), ("e2", None), ("e3", None)])], kind)
    found = [(r["event_id"], r["xml"]) for r in score_writing.explode_markers(relations).orderBy("event_id", "nth").collect()]
    assert found == [("e1", '<beam number="1">begin</beam>'), ("e1", '<beam number="2">forward hook</beam>'), ("e2", '<beam number="1">continue</beam>'), ("e3", '<beam number="1">end</beam>')]
    assert score_writing.explode_markers(relations.where(F.lit(False))).count() == 0
