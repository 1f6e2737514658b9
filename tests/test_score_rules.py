"""Rules of the score diff, each by a case of its own."""

import pytest
from test_scores import note, score

from scoreloom.plans import score_diff as d
from scoreloom.sources import musicxml as m

LOWER = f"""<backup><duration>8</duration></backup>{note("A", 4, voice=5, staff=2, kind="half", notations="<articulations><accent/></articulations>")}{note("B", 4, voice=5, staff=2, kind="half")}"""


def split():
    """The score with its staves as two parts."""
    one = score().replace(LOWER, "").replace("<staves>2</staves>", "").replace('<clef number="2"><sign>F</sign><line>4</line></clef>', "")
    low = LOWER.replace("<backup><duration>8</duration></backup>", "").replace("<staff>2</staff>", "<staff>1</staff>")
    second = f"""<part id="P2"><measure number="1"><attributes><divisions>2</divisions><key><fifths>-1</fifths></key><time><beats>4</beats><beat-type>4</beat-type></time><clef><sign>F</sign><line>4</line></clef></attributes>{low}</measure><measure number="2"></measure></part>"""
    return one.replace("</score-partwise>", second + "</score-partwise>").replace("</part-list>", '<score-part id="P2"><part-name>Piano</part-name></score-part></part-list>')


def accidental(flag=""):
    return score().replace("</pitch>", f"</pitch><accidental{flag}>sharp</accidental>", 1)


@pytest.fixture(scope="module")
def found(spark):
    variants = {
        "same": score(), "pitch": score(third="F"),
        "split": split(), "renamed": score().replace('"P1"', '"X1"'), "other part": score().replace('"P1"', '"X1"').replace("Piano", "Flute"),
        "double": score(extra='<measure number="3"><barline location="right"><bar-style>light-light</bar-style></barline></measure>'),
        "chord": score().replace("<step>C</step>", "<step>D</step>", 1), "sharp": accidental(), "careful": accidental(' cautionary="yes"'), "a#b": score(third="F"),
    }
    docs = spark.createDataFrame([(k, v) for k, v in variants.items()], "score_id string, xml string")
    tables = m.read_scores(docs)
    cases = [(k, "same", k) for k in variants] + [("flag", "sharp", "careful"), ("grand", "split", "same")]
    cases = spark.createDataFrame(cases, "case_id string, expected_id string, actual_id string")
    return tables, cases, d.diff(tables, tables, cases).cache()


def codes(found, case):
    return sorted((r.code, r.expected, r.actual, r.severity) for r in found[2].where(found[2].case_id == case).collect())


def test_staves_as_parts_are_one_part(found):
    assert codes(found, "split") == codes(found, "grand") == []


def test_parts_match_by_id_then_name(found):
    assert codes(found, "renamed") == [("part.id", "P1", "X1", "Error")]
    found_codes = {c[:3] for c in codes(found, "other part")}
    assert {("part.missing", "Piano", None), ("part.extra", None, "Flute")} <= found_codes
    assert not any(c[0].startswith(("measure.", "event.", "note.")) for c in found_codes)


def test_a_last_barline_moves_with_its_empty_measure(found):
    assert codes(found, "double") == [("barline.right_barline", "final", "double", "Error")]


def test_notes_pair_by_the_nearest_pitch_and_accidentals_by_kind(found):
    assert codes(found, "chord") == [("note.pitch", "C4", "D4", "Critical")]
    assert codes(found, "flag") == [("note.accidental", "sharp:", "sharp:cautionary", "Warning")]
    assert [c[3] for c in codes(found, "sharp")] == ["Error"]


def test_root_causes_keep_any_case_name(found):
    causes = d.root_causes(found[2]).where("case_id = 'a#b'").collect()
    assert [(r.category, r.n, r.first_seq) for r in causes] == [("Pitch", 1, 1)]
    pages = found[2].sparkSession.createDataFrame([(1, 0), (2, 1)], "page int, offset int")
    origin = d.decorate_origin(found[2], pages).where("case_id = 'pitch'").first()
    assert (origin.page, origin.local_measure) == (1, 1)


def test_numeric_references_are_read(spark):
    docs = spark.createDataFrame([("r", score(text="d&#111;lc&#x65; &#8224;&#x1D11E; &amp;#65;"))], "score_id string, xml string")
    assert [r.text for r in m.read_scores(docs)["events"].where("type = 'text'").collect()] == ["dolce \u2020\U0001d11e &#65;"]
