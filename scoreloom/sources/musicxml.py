"""MusicXML corpora as tables.

Files are read whole, one row each, and cut with regular expressions into parts, measures and measure children in
their order, which the time cursor needs; all of it are built-in functions on columns. From then on everything is
relational: the cursor is a running sum, chords are runs, ties and slurs are start/stop pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fractions import frac, frac_str
from ..functions.text import pitch_text
from ..operators import sequences

#: Bar styles by their canonical names.
BAR_STYLES = {"light-heavy": "final", "light-light": "double", "regular": "normal", "heavy-light": "reverse-final"}
_MEASURE = ["score_id", "part_id", "part_idx", "measure_idx", "measure_no"]
_CHILD = "note|backup|forward|direction|attributes|barline|print"


def elements(xml: Column, name: str) -> Column:
    """All elements of that name (or name pattern), as text, in order."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)(<({name})(?=[\s/>])(?:[^>]*/>|.*?</\2\s*>))"), F.lit(1))


def has(xml: Column, name: str) -> Column:
    return xml.rlike(rf"<{name}[\s/>]")


def _decoded(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


#: Characters that stay references as long as markup is read.
_MARKUP = ((0x3C, "&lt;"), (0x3E, "&gt;"), (0x26, "&amp;"), (0x22, "&quot;"), (0x27, "&apos;"))


def _numeric_references(xml: Column) -> Column:
    """xml with the characters that its numeric references name, those of markup as named references; what is no
    character becomes U+FFFD."""
    for pattern, mark, base in ((r"&#x([0-9A-Fa-f]+);", "&#x", 16), (r"&#([0-9]+);", "&#", 10)):

        def char(n: Column, base: int = base) -> Column:
            code = F.conv(n, base, 10).cast("decimal(20,0)")
            valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
            found = F.decode(F.unhex(F.when(valid, F.lpad(F.conv(n, base, 16), 8, "0")).otherwise("0000FFFD")), "UTF-32")
            for number, name in _MARKUP:
                found = F.when(code == number, name).otherwise(found)
            return found

        numbers = F.array_distinct(F.regexp_extract_all(xml, F.lit(pattern), F.lit(1)))
        xml = F.aggregate(numbers, xml, lambda t, n: F.replace(t, F.concat(F.lit(mark), n, F.lit(";")), char(n)))  # noqa: B023
    return xml


def value(xml: Column, name: str) -> Column:
    """Trimmed text of the first element of that name; null without one."""
    found = F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
    return F.when(has(xml, name), _decoded(F.trim(found)))


def attribute(xml: Column, name: str) -> Column:
    """Of the first tag in xml; null without it."""
    head = F.regexp_extract(xml, r"(?s)^\s*<[^>]*>", 0)
    pattern = rf"(?s)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return F.when(head.rlike(pattern), _decoded(F.concat(F.regexp_extract(head, pattern, 1), F.regexp_extract(head, pattern, 2))))


def _int(c: Column, fallback: int | None = None) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(fallback).cast("int"))


def _yes_no(c: Column) -> Column:
    return F.when(c == "yes", True).when(c == "no", False)


def read_documents(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """score_id (the path) and xml of each file, without byte-order mark and comments."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("score_id"), F.col("value").alias("xml"))
    return clean_documents(files)


def clean_documents(files: DataFrame) -> DataFrame:
    """The files without byte-order mark and comments, numeric character references read."""
    return files.select("score_id", _numeric_references(F.regexp_replace(F.regexp_replace("xml", "^﻿", ""), r"(?s)<!--.*?-->", "")).alias("xml"))


def score_headers(docs: DataFrame) -> DataFrame:
    """score_id, title, composer, subtitle. The subtitle is the first words of the first credit of that type."""
    creator = F.filter(elements(F.col("xml"), "creator"), lambda c: attribute(c, "type") == "composer")
    credit = F.filter(elements(F.col("xml"), "credit"), lambda c: F.lower(value(c, "credit-type")) == "subtitle")
    work = F.get(elements(F.col("xml"), "work"), F.lit(0))
    return docs.select(
        "score_id", value(work, "work-title").alias("title"), value(F.get(creator, F.lit(0)), "creator").alias("composer"),
        value(F.get(credit, F.lit(0)), "credit-words").alias("subtitle"),
    )


def part_names(docs: DataFrame) -> DataFrame:
    """score_id, part_id, name of each listed part."""
    parts = docs.select("score_id", F.explode(elements(F.col("xml"), "score-part")).alias("p"))
    return parts.select("score_id", F.coalesce(attribute(F.col("p"), "id"), F.lit("")).alias("part_id"), F.coalesce(value(F.col("p"), "part-name"), F.lit("")).alias("name"))


def measure_children(docs: DataFrame) -> DataFrame:
    """score_id, part_id, part_idx, measure_idx, measure_no, pos, tag, xml: all children that count, in order. A measure
    without any has one row, in which the last three are null."""
    parts = docs.select("score_id", F.posexplode(elements(F.col("xml"), "part")).alias("part_idx", "p"))
    measures = parts.select("score_id", F.coalesce(attribute(F.col("p"), "id"), F.lit("P1")).alias("part_id"), "part_idx", F.posexplode(elements(F.col("p"), "measure")).alias("measure_idx", "m"))
    inner = F.regexp_replace("m", r"(?s)^<[^>]*>", "")
    numbered = measures.withColumn("measure_no", _int(attribute(F.col("m"), "number"), 0))
    rows = numbered.select(*_MEASURE, F.posexplode_outer(elements(inner, _CHILD)).alias("pos", "xml"))
    return rows.withColumn("tag", F.regexp_extract("xml", r"^<([a-z-]+)", 1))


def timed_children(children: DataFrame) -> DataFrame:
    """Adds divisions (in force, over parts in document order), units (duration), cursor (units before the child),
    event_no (of notes) and direction_no."""
    note, xml = F.col("tag") == "note", F.col("xml")
    set_here = F.when(F.col("tag") == "attributes", value(xml, "divisions").try_cast("long"))
    everything = ["part_idx", "measure_idx", "pos"]
    rows = children.withColumns({"divisions": set_here, "units": F.coalesce(value(xml, "duration").try_cast("long"), F.lit(0))})
    rows = sequences.carry_forward(rows, ["score_id"], everything, ["divisions"]).withColumn("divisions", F.coalesce("divisions", F.lit(1)))
    inside = ["score_id", "part_idx", "measure_idx"]
    rows = rows.withColumns({"is_rest": F.when(note, has(xml, "rest")), "joins": F.when(note, has(xml, "chord"))})
    # The note before, whatever stands between: a chord note after a rest, or first in its measure, is an event of its own.
    before = F.last("is_rest", ignorenulls=True).over(Window.partitionBy(*inside).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("starts", F.when(note, ~F.col("joins") | F.coalesce("before", F.lit(True))))
    delta = F.when(F.col("starts"), F.col("units")).when(F.col("tag") == "backup", -F.col("units")).when(F.col("tag") == "forward", F.col("units")).otherwise(0)
    rows = sequences.running_cursor(rows, inside, ["pos"], delta)
    until = Window.partitionBy(*inside).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({
        "event_no": F.when(note, F.sum(F.coalesce(F.col("starts").cast("int"), F.lit(0))).over(until)),
        "direction_no": F.when(F.col("tag") == "direction", F.sum((F.col("tag") == "direction").cast("int")).over(until)),
    }).drop("before")


def _time(units: Column, divisions: Column) -> Column:
    return frac(units.cast("long"), (divisions * 4).cast("long"))


def _marks(xml: Column, group: str) -> Column:
    """(type, subtype, placement) of what stands inside the group element."""
    inner = F.regexp_extract(xml, rf"(?s)<{group}(?:\s[^>]*)?>(.*?)</{group}\s*>", 1)
    return F.transform(elements(inner, "[a-z-]+"), lambda m: F.struct(F.regexp_extract(m, r"^<([a-z-]+)", 1).alias("type"), attribute(m, "type").alias("subtype"), attribute(m, "placement").alias("placement")))


def note_rows(timed: DataFrame) -> DataFrame:
    """One row per note child: its event, pitch, accidental, technical marks and notation fields."""
    xml, notes = F.col("xml"), timed.where("tag = 'note'")
    # Elements and their fields are columns of their own, so that each is found once, and only where its name stands.
    found = lambda name: F.when(xml.contains(f"<{name}"), F.get(elements(xml, name), F.lit(0)))
    notes = notes.withColumns({"_pitch": found("pitch"), "_accidental": found("accidental")})
    pitch, accidental = F.col("_pitch"), F.col("_accidental")
    notes = notes.withColumns({"_step": F.coalesce(value(pitch, "step"), F.lit("C")), "_alter": _int(value(pitch, "alter"), 0), "_octave": _int(value(pitch, "octave"), 0)})
    fermata = F.transform(elements(xml, "fermata"), lambda m: F.struct(F.lit("fermata").alias("type"), attribute(m, "type").alias("subtype"), attribute(m, "placement").alias("placement")))
    inner = F.regexp_extract(xml, r"(?s)<technical(?:\s[^>]*)?>(.*?)</technical\s*>", 1)
    text = lambda m: F.trim(F.regexp_replace(m, r"<[^>]*>", ""))
    technical = F.transform(F.when(xml.contains("<technical"), elements(inner, "[a-z-]+")).otherwise(F.array().cast("array<string>")), lambda m: F.struct(F.regexp_extract(m, r"^<([a-z-]+)", 1).alias("type"), F.when(text(m) != "", _decoded(text(m))).alias("value"), attribute(m, "placement").alias("placement")))
    return notes.select(
        *_MEASURE, "pos", "event_no", "starts", "is_rest",
        F.concat("part_id", F.lit(".m"), "measure_no", F.lit(".e"), "event_no").alias("event_id"),
        has(xml, "grace").alias("grace"), _int(value(xml, "staff"), 1).alias("staff"), _int(value(xml, "voice"), 1).alias("voice"),
        _time(F.col("cursor"), F.col("divisions")).alias("at"), _time(F.col("units"), F.col("divisions")).alias("duration"),
        F.when(pitch.isNotNull(), pitch_text(F.col("_step"), F.col("_alter"), F.col("_octave"))).alias("pitch"),
        F.when(accidental.isNotNull(), F.struct(value(accidental, "accidental").alias("type"), *(_yes_no(attribute(accidental, a)).alias(a) for a in ("cautionary", "editorial", "parentheses", "bracket")))).alias("accidental"),
        technical.alias("technical"), value(xml, "type").alias("note_type"), F.nullif(F.size(elements(xml, "dot")), F.lit(0)).alias("dots"),
        value(xml, "stem").alias("stem"), value(xml, "notehead").alias("notehead"),
        _marks(xml, "articulations").alias("articulations"), _marks(xml, "ornaments").alias("ornaments"), fermata.alias("fermatas"), xml,
    )


def note_events(notes: DataFrame) -> DataFrame:
    """Chord and rest events. The first note that has a notation field sets it; marks are united. Notes without pitch
    in a chord are left out."""
    by = [*_MEASURE, "event_no", "event_id"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    head = lambda c: F.min_by(c, "pos").alias(c)
    marks = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c]))).alias(c)
    chord = F.filter(F.array_sort(F.collect_list(F.struct("pos", "pitch", "staff", "accidental", "technical"))), lambda n: n["pitch"].isNotNull())
    rows = notes.groupBy(*by).agg(
        head("is_rest"), head("grace"), head("at"), head("duration"), head("voice"), head("staff"), chord.alias("notes"),
        *(first(c) for c in ("note_type", "dots", "stem", "notehead")), *(marks(c) for c in ("articulations", "ornaments", "fermatas")), F.min("pos").alias("pos"),
    )
    rest = F.col("is_rest")
    return rows.select(
        *by, F.when(rest, "rest").otherwise("chord").alias("type"), "pos", F.lit(0).alias("part_of"), frac_str(F.col("at")).alias("at"), F.col("at.num").alias("at_num"), F.col("at.den").alias("at_den"),
        F.when(rest | ~F.col("grace"), frac_str(F.col("duration"))).alias("duration"), F.when(rest, F.col("staff")).alias("staff"), "voice",
        F.when(~rest & F.col("grace"), True).alias("grace"), F.when(~rest, F.transform("notes", lambda n: F.struct(n["pitch"].alias("pitch"), n["staff"].alias("staff"), n["accidental"].alias("accidental"), n["technical"].alias("technical")))).alias("notes"),
        F.struct("note_type", "dots", "stem", "notehead", "articulations", "ornaments", "fermatas").alias("notation"),
    )


def _direction_parts(timed: DataFrame) -> DataFrame:
    xml = F.col("xml")
    types = elements(xml, "direction-type")
    inner = F.flatten(F.transform(types, lambda t: elements(F.regexp_replace(F.regexp_replace(t, r"^<direction-type[^>]*>", ""), r"</direction-type\s*>$", ""), "[a-z-]+")))
    at = _time(F.col("cursor") + F.coalesce(value(xml, "offset").try_cast("long"), F.lit(0)), F.col("divisions"))
    rows = timed.where("tag = 'direction'").select(
        *_MEASURE, "pos", "direction_no", at.alias("at"), _int(value(xml, "staff"), 1).alias("staff"), attribute(xml, "placement").alias("placement"),
        F.get(elements(xml, "sound"), F.lit(0)).alias("sound"), F.posexplode(inner).alias("n", "t"),
    )
    return rows.withColumns({"n": F.col("n") + 1, "kind": F.regexp_extract("t", r"^<([a-z-]+)", 1)})


def direction_events(timed: DataFrame) -> DataFrame:
    """text, dynamic, tempo and navigation events: words, dynamics, metronome marks, coda and segno."""
    t, kind = F.col("t"), F.col("kind")
    inner = F.regexp_extract(t, r"(?s)^<dynamics[^>]*>\s*<([a-z-]+)", 1)
    target = F.when(kind == "coda", attribute(F.col("sound"), "coda")).when(kind == "segno", attribute(F.col("sound"), "segno"))
    rows = _direction_parts(timed).withColumn("type", F.when(kind == "words", "text").when((kind == "dynamics") & (inner != ""), "dynamic").when(kind == "metronome", "tempo").when(kind.isin("coda", "segno"), "navigation"))
    return rows.where("type IS NOT NULL").select(
        *_MEASURE, F.concat("part_id", F.lit(".m"), "measure_no", F.lit(".d"), "direction_no", F.lit("."), "n").alias("event_id"), "type", "pos", F.col("n").alias("part_of"),
        frac_str(F.col("at")).alias("at"), F.col("at.num").alias("at_num"), F.col("at.den").alias("at_den"), "staff", "placement",
        F.when(kind == "words", value(t, "words")).alias("text"), F.when(kind == "dynamics", inner).when(F.col("type") == "navigation", kind).alias("value"),
        F.when(F.col("type") == "navigation", target).alias("target"), value(t, "beat-unit").alias("beat_unit"), value(t, "per-minute").try_cast("decimal(10,3)").alias("bpm"),
    )


def measure_rows(timed: DataFrame) -> DataFrame:
    """One row per measure: attributes (later blocks win field by field), barlines, repeats, break before."""
    xml, tag = F.col("xml"), F.col("tag")
    attributes, print_, bar = tag == "attributes", tag == "print", tag == "barline"
    field = lambda name, c: F.max_by(c, F.when(attributes & c.isNotNull(), F.col("pos"))).alias(name)
    time, key = F.get(elements(xml, "time"), F.lit(0)), F.get(elements(xml, "key"), F.lit(0))
    clefs = F.transform(elements(xml, "clef"), lambda c: F.struct(_int(attribute(c, "number"), 1).alias("staff"), F.coalesce(value(c, "sign"), F.lit("G")).alias("sign"), _int(value(c, "line"), 0).alias("line"), _int(value(c, "clef-octave-change")).alias("octave_change")))
    style = value(xml, "bar-style")
    named = style
    for code, name in BAR_STYLES.items():
        named = F.when(style == code, name).otherwise(named)
    repeat = F.get(elements(xml, "repeat"), F.lit(0))
    mark = F.when(F.trim(attribute(repeat, "direction")) != "", F.struct(attribute(repeat, "direction").alias("direction"), _int(attribute(repeat, "times")).alias("times")))
    left = bar & (F.coalesce(attribute(xml, "location"), F.lit("right")) == "left")
    last = lambda name, cond, c: F.max_by(c, F.when(cond, F.col("pos"))).alias(name)
    break_ = F.when(attribute(xml, "new-page") == "yes", "page").when(attribute(xml, "new-system") == "yes", "system")
    return timed.groupBy(*_MEASURE).agg(
        field("time", F.when(time.isNotNull(), F.struct(_int(value(time, "beats"), 0).alias("beats"), _int(value(time, "beat-type"), 0).alias("beat_type")))),
        field("key", F.when(key.isNotNull(), F.struct(_int(value(key, "fifths"), 0).alias("fifths"), value(key, "mode").alias("mode")))),
        field("staves", _int(value(xml, "staves"))), field("clefs", F.when(F.size(clefs) > 0, clefs)),
        last("left_barline", left, named), last("right_barline", bar & ~left, named), last("left_repeat", left, mark), last("right_repeat", bar & ~left, mark),
        last("break_before", print_ & break_.isNotNull(), break_),
    )


def _note_tags(notes: DataFrame, name: str) -> DataFrame:
    rows = notes.select("score_id", "part_id", "part_idx", "measure_idx", "measure_no", "pos", "event_id", "voice", "pitch", F.posexplode(elements(F.col("xml"), name)).alias("n", "t"))
    t = F.col("t")
    return rows.withColumns({"number": _int(attribute(t, "number"), 1), "type": F.coalesce(attribute(t, "type"), F.lit("")), "text": value(t, name), "placement": attribute(t, "placement")})


_ORDER = ["measure_idx", "pos", "n"]


def relations(notes: DataFrame) -> DataFrame:
    """score_id, part_id, kind, level, hook, placement, actual, normal, bracket, direction, members (event_id, pitch).

    Ties pair by part, voice, pitch and number; slurs by part and number; beams run from begin to end by part, voice
    and level, a hook alone; tuplets hold all events of the voice between start and stop; arpeggios share a number in
    a measure.
    """
    member = lambda event, pitch: F.struct(F.col(event).alias("event_id"), pitch.cast("string").alias("pitch"))
    none = F.lit(None)

    def pairs(name: str, kind: str, keys: list[str], with_pitch: bool) -> DataFrame:
        tags = _note_tags(notes, name)
        found = sequences.pair_spans(tags, ["score_id", "part_id", *keys], _ORDER, F.col("type") == "start", F.col("type") == "stop", ["event_id", "placement"])
        pitch = F.col("pitch") if with_pitch else none
        if with_pitch:
            found = found.where("pitch IS NOT NULL")
        return found.select("score_id", "part_id", F.lit(kind).alias("kind"), F.coalesce("start_placement", "stop_placement").alias("placement"), F.array(member("start_event_id", pitch), member("stop_event_id", pitch)).alias("members"))

    ties = pairs("tied", "tie", ["voice", "pitch", "number"], True)
    slurs = pairs("slur", "slur", ["number"], False)

    beams = _note_tags(notes, "beam").withColumn("level", F.col("number"))
    by = ["score_id", "part_id", "voice", "level"]
    hooks = beams.where(F.col("text").isin("forward hook", "backward hook")).select("score_id", "part_id", F.lit("beam").alias("kind"), "level", F.split("text", " ")[0].alias("hook"), F.array(member("event_id", none)).alias("members"))
    lines = beams.where(F.col("text").isin("begin", "continue", "end"))
    runs = sequences.group_runs(lines, by, _ORDER, F.col("text") == "begin", F.col("text") == "end")
    whole = runs.groupBy(*by, "run").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "event_id"))).alias("m"))
    lone = sequences.previous("text", by, _ORDER)
    ends = lines.withColumn("before", lone).where("text = 'end' AND (before IS NULL OR before = 'end')").select("score_id", "part_id", F.lit("beam").alias("kind"), "level", F.array(member("event_id", none)).alias("members"))
    beam = whole.select("score_id", "part_id", F.lit("beam").alias("kind"), "level", F.array_distinct(F.transform("m", lambda e: F.struct(e["event_id"].alias("event_id"), none.cast("string").alias("pitch")))).alias("members"))

    marks = notes.where(F.col("xml").rlike(r"<(time-modification|tuplet)[\s/>]"))
    tuplet, ratio = F.get(elements(F.col("xml"), "tuplet"), F.lit(0)), F.get(elements(F.col("xml"), "time-modification"), F.lit(0))
    marks = marks.select("score_id", "part_id", "voice", "measure_idx", "pos", F.lit(0).alias("n"), "event_id", _int(attribute(tuplet, "number"), 1).alias("number"), attribute(tuplet, "type").alias("type"),
                         _int(value(ratio, "actual-notes")).alias("actual"), _int(value(ratio, "normal-notes")).alias("normal"), _yes_no(attribute(tuplet, "bracket")).alias("bracket"))
    spans = sequences.pair_spans(marks, ["score_id", "part_id", "voice", "number"], _ORDER, F.col("type") == "start", F.col("type") == "stop", ["event_id", "bracket"])
    place = lambda prefix: F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in _ORDER))
    inside = spans.join(marks.select("score_id", "part_id", "voice", place("").alias("at"), F.col("event_id").alias("e"), "actual", "normal"), ["score_id", "part_id", "voice"]).where((F.col("at") >= place("start_")) & (F.col("at") <= place("stop_")))
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))), F.lit(0)).alias(c)
    tuplets = inside.groupBy("score_id", "part_id", "voice", "number", "start_event_id", place("start_").alias("s"), "start_bracket").agg(F.array_sort(F.collect_list(F.struct("at", "e"))).alias("m"), first("actual"), first("normal"))
    tuplets = tuplets.select("score_id", "part_id", F.lit("tuplet").alias("kind"), "actual", "normal", F.col("start_bracket").alias("bracket"), F.array_distinct(F.transform("m", lambda e: F.struct(e["e"].alias("event_id"), none.cast("string").alias("pitch")))).alias("members"))

    arpeggio = F.get(elements(F.col("xml"), "arpeggiate"), F.lit(0))
    arpeggios = notes.where(has(F.col("xml"), "arpeggiate")).select("score_id", "part_id", "measure_idx", "pos", "event_id", _int(attribute(arpeggio, "number"), 1).alias("number"), attribute(arpeggio, "direction").alias("direction"))
    arpeggios = arpeggios.groupBy("score_id", "part_id", "measure_idx", "number").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id"))).alias("m"), F.min_by("direction", F.when(F.col("direction").isNotNull(), F.col("pos"))).alias("direction"))
    arpeggios = arpeggios.select("score_id", "part_id", F.lit("arpeggio").alias("kind"), "direction", F.array_distinct(F.transform("m", lambda e: F.struct(e["event_id"].alias("event_id"), none.cast("string").alias("pitch")))).alias("members"))

    found = ties
    for more in (slurs, hooks, beam, ends, tuplets, arpeggios):
        found = found.unionByName(more, allowMissingColumns=True)
    return found


def spans(timed: DataFrame) -> DataFrame:
    """Hairpins, pedals and octave shifts: score_id, part_id, kind, from and to (measure, at, staff), type, direction,
    size, line, start_mark, placement."""
    t, kind = F.col("t"), F.col("kind")
    rows = _direction_parts(timed).where(kind.isin("wedge", "pedal", "octave-shift"))
    rows = rows.withColumns({"number": _int(attribute(t, "number"), 1), "type": attribute(t, "type"), "size": _int(attribute(t, "size")), "line": _yes_no(attribute(t, "line")), "sign": _yes_no(attribute(t, "sign"))})
    starts = (kind == "wedge") & F.col("type").isin("crescendo", "diminuendo") | (kind == "pedal") & F.col("type").isin("start", "resume") | (kind == "octave-shift") & F.col("type").isin("up", "down")
    carried = ["measure_no", "at", "type", "size", "line", "sign", "placement"]
    found = sequences.pair_spans(rows, ["score_id", "part_id", "kind", "staff", "number"], _ORDER, F.coalesce(starts, F.lit(False)), F.coalesce(F.col("type") == "stop", F.lit(False)), carried)
    anchor = lambda side: F.struct(F.col(f"{side}_measure_no").alias("measure"), frac_str(F.col(f"{side}_at")).alias("at"), "staff")
    only = lambda k, c: F.when(kind == k, F.col(f"start_{c}"))
    return found.select(
        "score_id", "part_id", F.when(kind == "wedge", "hairpin").when(kind == "pedal", "pedal").otherwise("octaveShift").alias("kind"),
        anchor("start").alias("from"), anchor("stop").alias("to"), only("wedge", "type").alias("type"), only("octave-shift", "type").alias("direction"),
        only("octave-shift", "size").alias("size"), only("pedal", "line").alias("line"), only("pedal", "sign").alias("start_mark"), F.col("start_placement").alias("placement"),
    )


def read_scores(docs: DataFrame) -> dict[str, DataFrame]:
    """All canonical tables of docs (score_id, xml): scores, parts, measures, events, relations, spans."""
    docs = clean_documents(docs)
    timed = timed_children(measure_children(docs))
    notes = note_rows(timed)
    events = note_events(notes).unionByName(direction_events(timed), allowMissingColumns=True)
    return {"scores": score_headers(docs), "parts": part_names(docs), "measures": measure_rows(timed), "events": events, "relations": relations(notes), "spans": spans(timed)}
