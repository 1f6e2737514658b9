"""Whole scores as MusicXML: notes with their marks and relations, directions and spans, attributes, barlines and breaks.

Relations become marks of the events that they hold, spans a start and a stop; both carry numbers of their own in a part,
so that a reader pairs what belongs together however they overlap. Everything is joined by event or by measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fractions import frac_parse
from ..sources.musicxml import BAR_STYLES
from .score_jobs import Tables, musicxml_rows

_PLACE = ["score_id", "part_id", "part_idx", "measure_idx", "measure_no"]


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def tag(name: str, content: Column | None = None, **attributes: Column | str | None) -> Column:
    """An element with those attributes that are not null; '' if content is given and null."""
    head = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        value = F.lit(value) if isinstance(value, str) else value
        head.append(F.coalesce(F.concat(F.lit(f' {key.replace("_", "-")}="'), escaped(value.cast("string")), F.lit('"')), F.lit("")))
    if content is None:
        return F.concat(*head, F.lit("/>"))
    return F.coalesce(F.concat(*head, F.lit(">"), content.cast("string"), F.lit(f"</{name}>")), F.lit(""))


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").when(~flag, "no")


def explode_markers(relations: DataFrame) -> DataFrame:
    """score_id, part_id, event_id, pitch, place ('beam', 'modification' or 'notations'), nth, xml: what each member of a
    relation is marked with. nth orders the marks of an event; pitch is set where only one note has the mark.

    A beam begins, continues and ends, a hook stands alone; ties and slurs start and stop; a tuplet's members all have its
    ratio, the first and last its bracket; arpeggios are on each member.
    """
    kinds = {"level": "int", "hook": "string", "actual": "int", "normal": "int", "bracket": "boolean", "direction": "string", "placement": "string"}
    field = lambda c: (F.col(c) if c in relations.columns else F.lit(None)).cast(kinds[c]).alias(c)
    number = F.row_number().over(Window.partitionBy("score_id", "part_id", "kind").orderBy(F.to_json("members"), F.to_json(F.struct(*(c for c in relations.columns if c != "members")))))
    rows = relations.withColumn("number", number).withColumn("last", F.size("members") - 1)
    names = ["score_id", "part_id", "kind", "number", "last", *map(field, kinds)]
    rows = rows.select(*names, F.posexplode("members").alias("i", "m"))
    i, last, kind = F.col("i"), F.col("last"), F.col("kind")
    beam = F.when(F.col("hook").isNotNull(), F.concat("hook", F.lit(" hook"))).when((i == last), "end").when(i == 0, "begin").otherwise("continue")
    side = F.when(i == 0, "start").otherwise("stop")
    tuplet = F.concat(
        F.when(i == 0, tag("tuplet", type="start", number=F.col("number"), bracket=_yes_no(F.col("bracket")))).otherwise(""), F.when(i == last, tag("tuplet", type="stop", number=F.col("number"))).otherwise("")
    )
    ratio = F.when((kind == "tuplet") & (F.col("actual") > 0), tag("time-modification", F.concat(tag("actual-notes", F.col("actual")), tag("normal-notes", F.col("normal")))))
    main = (
        F.when(kind == "beam", tag("beam", beam, number=F.coalesce("level", F.lit(1))))
        .when(kind == "tie", tag("tied", type=side, number=F.col("number"), placement=F.when(i == 0, F.col("placement"))))
        .when(kind == "slur", tag("slur", type=side, number=F.col("number"), placement=F.when(i == 0, F.col("placement"))))
        .when(kind == "tuplet", tuplet).when(kind == "arpeggio", tag("arpeggiate", number=F.col("number"), direction=F.col("direction")))
    )
    marks = F.array(F.struct(F.when(kind == "beam", "beam").otherwise("notations").alias("place"), main.alias("xml")), F.struct(F.lit("modification").alias("place"), ratio.alias("xml")))
    rows = rows.select("score_id", "part_id", "m.event_id", "m.pitch", F.when(kind == "beam", F.coalesce("level", F.lit(1))).otherwise(F.col("number")).alias("nth"), F.explode(marks).alias("mark"))
    return rows.select("score_id", "part_id", "event_id", "pitch", "mark.place", "nth", "mark.xml").where("xml <> ''")


def measure_directions(events: DataFrame, spans: DataFrame, measures: DataFrame) -> DataFrame:
    """score_id, part_id, part_idx, measure_idx, measure_no, seq, at (struct<num, den>), xml: texts, dynamics, tempi and
    navigation, and starts and stops of spans, ordered by time, then starts, events and stops. xml has {offset} where the
    time goes."""
    kind = F.col("type")
    content = (
        F.when(kind == "text", tag("words", escaped(F.col("text")))).when(kind == "dynamic", tag("dynamics", F.concat(F.lit("<"), F.col("value"), F.lit("/>"))))
        .when(kind == "tempo", tag("metronome", F.concat(tag("beat-unit", F.col("beat_unit")), tag("per-minute", F.col("bpm").cast("string"))))).when(kind == "navigation", F.concat(F.lit("<"), F.col("value"), F.lit("/>")))
    )
    sound = F.when((kind == "navigation") & (F.col("value") == "coda"), tag("sound", coda=F.col("target"))).when(kind == "navigation", tag("sound", segno=F.col("target")))
    own = events.where(content.isNotNull()).select(*_PLACE, F.struct(F.col("at_num").alias("num"), F.col("at_den").alias("den")).alias("at"), F.lit(1).alias("rank"), F.coalesce("pos", F.lit(0)).alias("nth"), "part_of", content.alias("content"), "staff", "placement", F.when(F.col("target").isNotNull(), sound).alias("sound"))
    number = F.row_number().over(Window.partitionBy("score_id", "part_id", "kind").orderBy("from", "to", F.to_json(F.struct(*spans.columns))))
    what, n = F.col("kind"), F.col("number")
    start = F.when(what == "hairpin", tag("wedge", type=F.col("type"), number=n)).when(what == "pedal", tag("pedal", type="start", number=n, line=_yes_no(F.col("line")), sign=_yes_no(F.col("start_mark")))).otherwise(tag("octave-shift", type=F.col("direction"), number=n, size=F.col("size")))
    stop = F.when(what == "hairpin", tag("wedge", type="stop", number=n)).when(what == "pedal", tag("pedal", type="stop", number=n)).otherwise(tag("octave-shift", type="stop", number=n, size=F.col("size")))
    ends = F.array(F.struct(F.col("from").alias("a"), F.lit(0).alias("rank"), start.alias("content")), F.struct(F.col("to").alias("a"), F.lit(2).alias("rank"), stop.alias("content")))
    marks = spans.withColumn("number", number).select("score_id", "part_id", "number", "placement", F.explode(ends).alias("e")).select("score_id", "part_id", F.col("e.a.measure").alias("measure_no"), frac_parse(F.col("e.a.at")).alias("at"), "e.rank", F.col("number").alias("nth"), F.lit(0).alias("part_of"), "e.content", F.col("e.a.staff").alias("staff"), F.when(F.col("e.rank") == 0, F.col("placement")).alias("placement"), F.lit("").alias("sound"))
    marks = marks.join(measures.select(*_PLACE), ["score_id", "part_id", "measure_no"])
    rows = own.unionByName(marks.select(*own.columns))
    xml = tag("direction", F.concat(tag("direction-type", F.col("content")), F.lit("<offset>{offset}</offset>"), tag("staff", F.col("staff")), F.coalesce("sound", F.lit(""))), placement=F.col("placement"))
    seq = F.row_number().over(Window.partitionBy(*_PLACE[:4]).orderBy(F.col("at.num") / F.col("at.den"), "rank", "nth", "part_of", "content"))
    return rows.select(*_PLACE, seq.alias("seq"), "at", xml.alias("xml"))


def _attributes(divisions: int) -> Column:
    first = F.col("measure_idx") == F.min("measure_idx").over(Window.partitionBy("score_id", "part_id"))
    clef = lambda c: tag("clef", F.concat(tag("sign", c["sign"]), tag("line", c["line"]), tag("clef-octave-change", c["octave_change"])), number=c["staff"])
    whole = lambda c, xml: F.when(F.col(c).isNotNull(), xml).otherwise("")
    inner = F.concat(
        F.when(first, f"<divisions>{divisions}</divisions>").otherwise(""), whole("key", tag("key", F.concat(tag("fifths", F.col("key.fifths")), tag("mode", F.col("key.mode"))))),
        whole("time", tag("time", F.concat(tag("beats", F.col("time.beats")), tag("beat-type", F.col("time.beat_type"))))), tag("staves", F.col("staves")), F.coalesce(F.array_join(F.transform("clefs", clef), ""), F.lit("")),
    )
    return F.when(inner != "", tag("attributes", inner)).otherwise("")


def _barline(side: str) -> Column:
    style, repeat = F.col(f"{side}_barline"), F.col(f"{side}_repeat")
    code = style
    for printed, name in BAR_STYLES.items():
        code = F.when(style == name, printed).otherwise(code)
    inner = F.concat(tag("bar-style", code), F.when(repeat.isNotNull(), tag("repeat", direction=repeat["direction"], times=repeat["times"])).otherwise(""))
    return F.when(inner != "", tag("barline", inner, location=side)).otherwise("")


def score_documents(tables: Tables, divisions: int) -> DataFrame:
    """score_id and xml of whole scores, all tables of read_scores. divisions: units of a quarter in which every time is
    whole. Reading a document gives the tables again, but for ids, positions and the numbers of relations; measures
    without events stay, and directions stand at the start of their measure with an offset."""
    events, measures = tables["events"], tables["measures"]
    notes = musicxml_rows(events, divisions, explode_markers(tables["relations"]))
    units = F.col("at.num") * (4 * divisions) / F.col("at.den")
    directions = measure_directions(events, tables["spans"], measures).withColumn("xml", F.replace("xml", F.lit("{offset}"), units.cast("long").cast("string")))
    pack = lambda rows, name: rows.groupBy("score_id", "part_id", "measure_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "xml"))), lambda r: r["xml"]), "").alias(name))
    whole = measures.join(pack(notes, "_notes"), ["score_id", "part_id", "measure_idx"], "left").join(pack(directions, "_directions"), ["score_id", "part_id", "measure_idx"], "left")
    some = lambda c: F.coalesce(c, F.lit(""))
    broken = F.when(F.col("break_before") == "page", '<print new-page="yes"/>').when(F.col("break_before") == "system", '<print new-system="yes"/>').otherwise("")
    body = F.concat(broken, _attributes(divisions), _barline("left"), some("_directions"), some("_notes"), _barline("right"))
    ordered = lambda order, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda r: r[c]), "")
    rows = whole.withColumn("xml", tag("measure", body, number=F.col("measure_no"))).groupBy("score_id", "part_id", "part_idx").agg(ordered("measure_idx", "xml").alias("body"))
    rows = rows.withColumn("xml", tag("part", F.col("body"), id=F.col("part_id"))).groupBy("score_id").agg(ordered("part_idx", "xml").alias("body"))
    listed = measures.select("score_id", "part_id", "part_idx").distinct().join(tables["parts"], ["score_id", "part_id"], "left")
    named = listed.select("score_id", "part_idx", tag("score-part", tag("part-name", F.coalesce(escaped(F.col("name")), F.lit(""))), id=F.col("part_id")).alias("xml")).groupBy("score_id").agg(ordered("part_idx", "xml").alias("_list"))
    head = tables["scores"].select("score_id", F.concat(
        tag("work", tag("work-title", escaped(F.col("title")))), F.when(F.col("composer").isNotNull(), tag("identification", tag("creator", escaped(F.col("composer")), type="composer"))).otherwise(""),
        F.when(F.col("subtitle").isNotNull(), tag("credit", F.concat(tag("credit-type", F.lit("subtitle")), tag("credit-words", escaped(F.col("subtitle")))))).otherwise(""),
    ).alias("_head"))
    rows = rows.join(named, "score_id", "left").join(head, "score_id", "left")
    return rows.select("score_id", tag("score-partwise", F.concat(some("_head"), tag("part-list", some("_list")), "body")).alias("xml"))
