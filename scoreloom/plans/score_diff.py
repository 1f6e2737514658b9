"""Two scores compared, for any number of cases in one job: matched parts, measures, events, notes, relations and spans
become issues with a severity and a root cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import midi, norm_text
from ..operators import matching, sequences
from ..operators.components import materialize

Tables = dict[str, DataFrame]
_PLACE = ["case_id", "part_idx", "measure_no"]


def for_cases(tables: Tables, cases: DataFrame, side: str) -> Tables:
    """The tables of one side ('expected' or 'actual') with case_id in place of score_id; a score may serve many cases."""
    ids = cases.select("case_id", F.col(f"{side}_id").alias("score_id"))
    return {name: df.join(ids, "score_id").drop("score_id") for name, df in tables.items()}


# --- normalisation -------------------------------------------------------------------------------------------------


def event_staff_of() -> Column:
    """An event's own staff, else the only staff of its notes."""
    staves = F.array_distinct(F.transform("notes", lambda n: n["staff"]))
    return F.coalesce("staff", F.when(F.size(staves) == 1, F.get(staves, F.lit(0))))


def event_staff(events: DataFrame) -> DataFrame:
    """Adds event_staff."""
    return events.withColumn("event_staff", event_staff_of())


def normalize_monophonic(events: DataFrame) -> DataFrame:
    """Where a measure's staff has one voice only, that voice is 1."""
    over = Window.partitionBy("case_id", "part_idx", "measure_no", "event_staff")
    alone = F.min("voice").over(over) == F.max("voice").over(over)
    return events.withColumn("voice", F.when(F.col("voice").isNotNull() & F.col("event_staff").isNotNull() & alone, 1).otherwise(F.col("voice")))


def normalize_interstaff(events: DataFrame, measures: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events and spans; in parts of two staves, directions and spans below the first staff or above the second stand
    between, on the first."""
    two = measures.groupBy("case_id", "part_idx").agg((F.max("staves") >= 2).alias("two"))
    second = events.groupBy("case_id", "part_idx").agg(F.max(F.col("event_staff") == 2).alias("second"))
    two = two.join(second, ["case_id", "part_idx"], "left").where("two OR second").select("case_id", "part_idx", F.lit(True).alias("two"))
    two = materialize(two, "two_staves")
    if two.isEmpty():
        return events, spans
    inner = lambda staff: (staff == 1) & (F.col("placement") == "below") | (staff == 2) & (F.col("placement") == "above")

    def marked(df: DataFrame, between: Column) -> DataFrame:
        rows = df.join(two, ["case_id", "part_idx"], "left").withColumn("between", F.coalesce(F.col("two") & between, F.lit(False)))
        return rows.withColumn("placement", F.when(F.col("between"), "between").otherwise(F.col("placement"))).drop("two")

    direction = F.col("type").isin("dynamic", "text", "tempo", "navigation")
    rows = marked(events, direction & inner(F.col("staff")))
    rows = rows.withColumns({c: F.when(F.col("between"), 1).otherwise(F.col(c)) for c in ("staff", "event_staff")}).drop("between")
    lines = marked(spans, (F.col("from.staff") == F.col("to.staff")) & inner(F.col("from.staff")))
    first = lambda end: F.when(F.col("between"), F.col(end).withField("staff", F.lit(1))).otherwise(F.col(end))
    return materialize(rows, "events"), materialize(lines.withColumns({"from": first("from"), "to": first("to")}).drop("between"), "spans")


def trim_trailing_measures(measures: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """Without the empty measures at the end of a part, but the first: no events, no time, key or clefs, and no span of
    the case begins or ends there. The last barline and repeat on the right go to the measure that ends the part now."""
    busy = events.select(*_PLACE).distinct().withColumn("busy", F.lit(True))
    ends = spans.select("case_id", F.explode(F.array("from.measure", "to.measure")).alias("measure_no")).distinct().withColumn("spanned", F.lit(True))
    rows = measures.join(busy, _PLACE, "left").join(ends, ["case_id", "measure_no"], "left")
    empty = F.col("busy").isNull() & F.col("spanned").isNull() & F.col("time").isNull() & F.col("key").isNull() & (F.col("clefs").isNull() | (F.size("clefs") == 0))
    part = Window.partitionBy("case_id", "part_idx")
    last = F.coalesce(F.max(F.when(~empty, F.col("measure_idx"))).over(part), F.min("measure_idx").over(part))
    rows = rows.withColumn("_last", last)
    onwards = F.col("measure_idx") >= F.col("_last")
    moved = {c: F.max_by(c, F.when(onwards & F.col(c).isNotNull(), F.col("measure_idx"))).over(part) for c in ("right_barline", "right_repeat")}
    rows = rows.withColumns({f"_{c}": m for c, m in moved.items()}).where("measure_idx <= _last")
    ending = F.col("measure_idx") == F.col("_last")
    rows = rows.withColumns({c: F.when(ending, F.col(f"_{c}")).otherwise(F.col(c)) for c in moved})
    return rows.select(*measures.columns)


def collapse_split(split: Tables, grand: Tables) -> Tables:
    """split, in which the two parts of a case become the staves of one where the other side has one part of two staves
    with the same measures, and both parts use their first staff only."""
    parts = split["measures"].select("case_id", "part_idx", "part_id").distinct()
    numbers = split["measures"].groupBy("case_id", "part_idx").agg(F.sort_array(F.collect_list("measure_no")).alias("numbers"))
    two = parts.join(numbers, ["case_id", "part_idx"]).groupBy("case_id").agg(
        F.count("*").alias("n"), F.count_distinct("numbers").alias("kinds"), F.min("part_idx").alias("upper_idx"), F.max_by("part_id", "part_idx").alias("lower_id"), F.max("part_idx").alias("lower_idx")
    )
    two = two.where("n = 2 AND kinds = 1").drop("n", "kinds")
    other = lambda staff: staff.isNotNull() & (staff != 1)
    clefs = F.coalesce(F.exists("clefs", lambda c: other(c["staff"])), F.lit(False))
    off = split["events"].where(other(event_staff_of())).select("case_id").union(split["measures"].where(clefs).select("case_id")).distinct()
    one = grand["measures"].groupBy("case_id").agg(F.count_distinct("part_idx").alias("n"), F.max("staves").alias("staves"), F.min("part_id").alias("grand_id"), F.min("part_idx").alias("grand_idx"))
    second = grand["events"].where(event_staff_of() == 2).select("case_id").distinct().withColumn("second", F.lit(True))
    one = one.join(second, "case_id", "left").where("n = 1 AND (staves >= 2 OR second)").select("case_id", "grand_id", "grand_idx")
    plan = materialize(two.join(one, "case_id").join(off, "case_id", "left_anti"), "collapsed")
    if plan.isEmpty():
        return split
    found = dict(split)
    collapsed = F.col("grand_id").isNotNull()
    staff = F.when(F.col("part_idx") == F.col("lower_idx"), 2).otherwise(1)
    extra = [c for c in plan.columns if c != "case_id"]
    for name in ("events", "relations", "spans"):
        rows = split[name].join(plan, "case_id", "left")
        if name == "events":
            moved = F.when(collapsed & F.col("notes").isNotNull(), F.transform("notes", lambda n: n.withField("staff", staff))).otherwise(F.col("notes"))
            rows = rows.withColumns({"notes": moved, "staff": F.when(collapsed & F.col("staff").isNotNull(), staff).otherwise(F.col("staff"))})
        if name == "spans":
            lower = F.col("part_id") == F.col("lower_id")
            rows = rows.withColumns({end: F.when(collapsed & lower, F.col(end).withField("staff", F.lit(2))).otherwise(F.col(end)) for end in ("from", "to")})
        renamed = {c: F.when(collapsed, F.col(to)).otherwise(F.col(c)) for c, to in (("part_id", "grand_id"), ("part_idx", "grand_idx")) if c in rows.columns}
        found[name] = rows.withColumns(renamed).drop(*extra)
    rows = split["measures"].join(plan, "case_id", "left")
    tagged = F.when(collapsed, F.transform("clefs", lambda c: c.withField("staff", staff))).otherwise(F.col("clefs"))
    rows = rows.withColumns({"clefs": tagged, "_part": F.when(collapsed, F.lit(-1)).otherwise(F.col("part_idx"))})
    ordered = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("part_idx"))).alias(c)
    plain = [c for c in split["measures"].columns if c not in ("case_id", "measure_no", "clefs", "part_id", "part_idx", "staves")]
    both = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("clefs").isNotNull(), F.struct("part_idx", "clefs")))), lambda x: x["clefs"]))
    rows = rows.groupBy("case_id", "_part", "measure_no").agg(
        *(ordered(c) for c in plain), F.when(F.size(both) > 0, both).alias("clefs"), ordered("staves"), F.min("part_id").alias("part_id"), F.min("part_idx").alias("part_idx"), F.max("grand_id").alias("grand_id"), F.max("grand_idx").alias("grand_idx")
    )
    opening = F.min("measure_no").over(Window.partitionBy("case_id", "_part")) == F.col("measure_no")
    rows = rows.withColumns({"staves": F.when(collapsed & opening, 2).otherwise(F.col("staves")), "part_id": F.coalesce("grand_id", "part_id"), "part_idx": F.coalesce("grand_idx", "part_idx")})
    found["measures"] = rows.select(*split["measures"].columns)
    names = split["parts"].join(plan, "case_id", "left").where(~F.coalesce(collapsed & (F.col("part_id") == F.col("lower_id")), F.lit(False)))
    found["parts"] = names.withColumn("part_id", F.coalesce("grand_id", "part_id")).drop(*extra)
    return found


def match_parts(expected: Tables, actual: Tables) -> tuple[Tables, Tables, DataFrame]:
    """Both sides with the part_idx of the expected part that each is matched with, first by id, then by name, and the
    part issues. What has no partner keeps its relations and spans only; those of the actual side count from -1 down."""

    def listed(t: Tables) -> DataFrame:
        rows = t["measures"].select("case_id", "part_id", "part_idx").distinct().join(t["parts"].select("case_id", "part_id", "name").dropDuplicates(["case_id", "part_id"]), ["case_id", "part_id"], "left")
        return rows.select("case_id", "part_id", "part_idx", F.coalesce(norm_text(F.col("name")), F.lit("")).alias("plain"), "name")

    keyed = lambda df, x: df.select(F.struct("case_id", "part_idx").alias(f"{x}_key"), F.struct("case_id", "part_id").alias(f"{x}_id"), F.struct("case_id", "plain").alias(f"{x}_name"), F.col("name").alias(f"{x}_title"))
    e, a = materialize(keyed(listed(expected), "e"), "parts"), materialize(keyed(listed(actual), "a"), "parts")
    pairs = materialize(matching.priority_match(e, a, "e_key", "a_key", [("e_id", "a_id"), ("e_name", "a_name")]), "pairs")
    rows = e.join(pairs, "e_key", "full_outer").join(a, "a_key", "full_outer")
    place = F.coalesce("e_key", F.struct(F.col("a_key.case_id").alias("case_id"), (-1 - F.col("a_key.part_idx")).alias("part_idx")))
    rows = materialize(rows.select(place.alias("place"), "*").select("place.case_id", "place.part_idx", "*"), "matched_parts")
    lost, gained = F.col("a_key").isNull(), F.col("e_key").isNull()
    code = F.when(lost, "part.missing").when(gained, "part.extra").otherwise("part.id")
    shown = lambda x: F.when(lost | gained, F.col(f"{x}_title")).otherwise(F.col(f"{x}_id.part_id"))
    issues = _issue(rows.where(lost | gained | (F.col("tier") == 2)), code, "Structure", shown("e"), shown("a"))
    index = rows.where("a_key IS NOT NULL").select("a_key.case_id", F.col("a_key.part_idx").alias("part_idx"), F.col("part_idx").alias("_to"))
    moved = {name: df.join(index, ["case_id", "part_idx"]).withColumn("part_idx", F.col("_to")).drop("_to") if "part_idx" in df.columns else df for name, df in actual.items()}
    both = rows.where("tier IS NOT NULL").select("case_id", "part_idx")
    only = lambda t: t | {name: t[name].join(both, ["case_id", "part_idx"], "left_semi") for name in ("measures",)}
    return only(expected), only(moved), issues


def align_voices(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """actual with its voices renamed where the evidence of equal events is strong, part by part and staff by staff. A
    staff with one and the same voice on both sides has nothing to rename and gives no evidence."""
    staff = ["case_id", "part_idx", "event_staff"]
    voiced = lambda df: df.where("voice IS NOT NULL AND event_staff IS NOT NULL")
    voices = voiced(expected).select(*staff, "voice").unionByName(voiced(actual).select(*staff, "voice"))
    several = materialize(voices.groupBy(*staff).agg(F.min("voice").alias("lo"), F.max("voice").alias("hi")).where("lo <> hi").select(*staff), "several_voices")
    if several.isEmpty():
        return actual
    keys = [*_PLACE, "event_staff", "type", "at", "content_key"]
    key = lambda df: voiced(df).join(several, staff, "left_semi").withColumn("content_key", F.array_join("content", ",")).select(*keys, "voice")
    pairs = matching.match_occurrences(key(expected), key(actual), keys, ["voice"], ["voice"]).where("side = 'both'")
    label = lambda side: F.concat_ws("|", "case_id", "part_idx", "event_staff", F.col(side)["voice"])
    evidence = pairs.groupBy(label("expected").alias("to"), label("actual").alias("from")).agg(F.count("*").alias("n"))
    found = matching.align_labels(evidence, "to", "from", "n")
    voice = lambda c: F.element_at(F.split(c, r"\|"), -1).cast("int")
    renames = found.select(F.col("from").alias("_label"), voice("to").alias("_voice"))
    rows = actual.withColumn("_label", F.concat_ws("|", "case_id", "part_idx", "event_staff", "voice")).join(renames, "_label", "left")
    return materialize(rows.withColumn("voice", F.coalesce("_voice", "voice")).drop("_label", "_voice"), "events")


# --- comparison ----------------------------------------------------------------------------------------------------


def prepare_events(events: DataFrame) -> DataFrame:
    """Adds what is compared: event_staff, content (strings), when (a number)."""
    pitches = F.transform("notes", lambda n: F.concat(n["pitch"], F.lit("/"), n["staff"].cast("string")))
    words = F.array_compact(F.array(norm_text(F.col("text")), F.col("value"), F.col("beat_unit"), F.col("bpm").cast("string")))
    rows = event_staff(events).withColumn("content", F.coalesce(F.array_sort(pitches), words, F.array().cast("array<string>")))
    return rows.withColumn("when", F.col("at_num") / F.col("at_den"))


_COMPARED = ["type", "at", "event_staff", "voice", "duration", "grace", "text", "value", "target", "placement", "beat_unit", "bpm", "notation", "content", "notes"]


def differing_measures(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """case_id, part_idx, measure_no, expected and actual: the events of both sides (arrays, by id) of measures in which
    anything that is compared, or an id, differs. Events of other measures match one by one and have no issues."""
    event = F.struct("event_id", "when", *_COMPARED)
    one = lambda df, e, a: df.select(*_PLACE, e.alias("e"), a.alias("a"))
    none = F.lit(None).cast(expected.select(event.alias("x")).schema["x"].dataType)
    both = one(expected, event, none).unionByName(one(actual, none, event))
    events = lambda c: F.sort_array(F.collect_list(c))
    return both.groupBy(*_PLACE).agg(events("e").alias("expected"), events("a").alias("actual")).where("NOT (expected <=> actual)")


def measure_events(measures: DataFrame, side: str) -> DataFrame:
    """The events of one side ('expected' or 'actual') of differing_measures."""
    return measures.select(*_PLACE, F.explode(side).alias("x")).select(*_PLACE, "x.*")


def match_events(measures: DataFrame) -> DataFrame:
    """Events of both sides of differing_measures, measure by measure: case_id, part_idx, measure_no, expected_id,
    actual_id, tier.

    Measures whose events are equal but for what matching does not look at meet one by one; the others are matched tier
    by tier.
    """
    same = ["type", "when", "event_staff", "content", "voice", "duration"]
    bag = lambda side: F.sort_array(F.transform(side, lambda x: F.struct(*(x[c] for c in same))))
    rows = measures.withColumn("alike", bag("expected").eqNullSafe(bag("actual")))
    pick = lambda df, side: measure_events(df, side).select(*_PLACE, F.col("event_id").alias("id"), *same)
    equal, other = rows.where("alike"), rows.where("NOT alike")
    both = matching.match_occurrences(pick(equal, "expected"), pick(equal, "actual"), [*_PLACE, *same], ["id"], ["id"])
    plain = both.select(*_PLACE, F.col("expected.id").alias("expected_id"), F.col("actual.id").alias("actual_id"), F.lit(1).alias("tier"))
    agree = {"duration": 0.15, "voice": 0.10, "event_staff": 0.10}
    tiers = matching.tiered_match(pick(other, "expected"), pick(other, "actual"), _PLACE, "type", "when", "content", "event_staff", agree, 0.25)
    return plain.unionByName(tiers)


def _issue(df: DataFrame, code: Column | str, category: Column | str, expected: Column, actual: Column) -> DataFrame:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    place = [c for c in ("measure_no", "event_staff", "at") if c in df.columns]
    return df.select("case_id", "part_idx", *place, text(code).alias("code"), text(category).alias("category"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def category_of(kind: Column) -> Column:
    return F.when(kind == "rest", "Rhythm").when(kind == "chord", "Pitch").otherwise("Text")


def event_issues(expected: DataFrame, actual: DataFrame, matches: DataFrame) -> DataFrame:
    """Missing and extra events, and the fields in which matched ones differ."""
    side = lambda df, name: df.select(*_PLACE, F.col("event_id").alias(f"{name}_id"), F.struct(*_COMPARED).alias(name))
    both = matches.join(side(expected, "expected"), [*_PLACE, "expected_id"], "left").join(side(actual, "actual"), [*_PLACE, "actual_id"], "left")
    both = both.withColumns({"at": F.coalesce("expected.at", "actual.at"), "event_staff": F.coalesce("expected.event_staff", "actual.event_staff"), "type": F.coalesce("expected.type", "actual.type")})
    heads = F.transform("expected.notes", lambda n: F.struct(n["staff"], n["pitch"]))
    told = F.coalesce(F.size(heads) == F.size(F.array_distinct(heads)), F.lit(True))  # else equal chords may pair other notes
    both = materialize(both.where(~(F.col("expected").eqNullSafe(F.col("actual")) & told)), "pairs")
    describe = lambda c: F.concat_ws(" ", c["type"], F.array_join(c["content"], "+"))
    e, a, kind = F.col("expected"), F.col("actual"), F.col("type")
    found = _issue(both.where("actual_id IS NULL"), "event.missing", category_of(kind), describe(e), F.lit(None))
    found = found.unionByName(_issue(both.where("expected_id IS NULL"), "event.extra", category_of(kind), F.lit(None), describe(a)))
    pairs = both.where("expected_id IS NOT NULL AND actual_id IS NOT NULL")
    field = lambda f: (e[f], a[f])
    note = lambda f: (e["notation"][f], a["notation"][f])
    spec = [
        ("event.onset", "Rhythm", *field("at"), False), ("event.duration", "Rhythm", *field("duration"), False), ("event.voice", "Structure", *field("voice"), False),
        ("event.staff", "Structure", *field("event_staff"), False), ("event.grace", "Rhythm", *field("grace"), False), ("notation.type", "Notation", *note("note_type"), False),
        ("notation.dots", "Notation", *note("dots"), False), ("notation.stem", "Notation", *note("stem"), False), ("notation.notehead", "Notation", *note("notehead"), False),
        ("text.value", "Text", norm_text(e["text"]), norm_text(a["text"]), False), ("dynamic.value", "Text", *field("value"), False), ("text.placement", "Text", *field("placement"), True),
        ("tempo.unit", "Text", *field("beat_unit"), False), ("tempo.bpm", "Text", *field("bpm"), False), ("navigation.target", "Text", *field("target"), True),
    ]
    fields = matching.compare_fields(pairs.select(*_PLACE, "event_staff", F.col("at"), "expected", "actual"), [*_PLACE, "event_staff", "at"], spec)
    return found.unionByName(fields).unionByName(note_issues(pairs)).unionByName(mark_issues(pairs))


def _accidental(note: Column) -> Column:
    """Kind and flags of a note's accidental; null without one."""
    flags = [F.when(note["accidental"][f], F.lit(f)) for f in ("cautionary", "editorial", "parentheses", "bracket")]
    return F.when(note["accidental"].isNotNull(), F.concat_ws(":", note["accidental"]["type"], F.concat_ws("+", *flags)))


def paired_notes(expected: Column, actual: Column) -> Column:
    """Of two chords: an array of (expected, actual) notes. Expected notes, by staff and pitch, take in turn an equal
    note of their staff, one of another staff, the nearest of their staff, the nearest. What is left has one side null.
    """
    note = lambda n: F.struct(n["staff"].alias("staff"), midi(n["pitch"]).alias("midi"), n["pitch"].alias("pitch"), _accidental(n).alias("accidental"))
    none = F.array().cast("array<struct<staff:int,midi:int,pitch:string,accidental:string>>")
    notes = lambda c: F.coalesce(F.transform(c, note), none)
    kind = "struct<staff:int,midi:int,pitch:string,accidental:string>"
    begin = F.struct(notes(actual).alias("open"), F.array().cast(f"array<struct<e:{kind},a:{kind}>>").alias("pairs"))

    def take(state: Column, e: Column) -> Column:
        same, own = (lambda x: x["pitch"].eqNullSafe(e["pitch"])), (lambda x: x["staff"].eqNullSafe(e["staff"]))
        tier = lambda x: F.when(same(x) & own(x), 1).when(same(x), 2).when(own(x), 3).otherwise(4)
        ranked = F.transform(state["open"], lambda x, i: F.struct(tier(x).alias("tier"), F.when(tier(x) > 2, F.abs(x["midi"] - e["midi"])).otherwise(0).alias("far"), i.alias("i")))
        best = F.array_min(ranked)["i"]
        pair = F.struct(e.alias("e"), F.when(best.isNotNull(), F.get(state["open"], best)).cast(kind).alias("a"))
        left = F.when(best.isNull(), state["open"]).otherwise(F.filter(state["open"], lambda x, i: i != best))
        return F.struct(left.alias("open"), F.concat(state["pairs"], F.array(pair)).alias("pairs"))

    def finish(state: Column) -> Column:
        return F.concat(state["pairs"], F.transform(F.array_sort(state["open"]), lambda x: F.struct(F.lit(None).cast(kind).alias("e"), x.alias("a"))))

    return F.aggregate(F.array_sort(notes(expected)), begin, take, finish)


def note_issues(pairs: DataFrame) -> DataFrame:
    """Notes of matched chords, chord by chord, and in what paired notes differ."""
    rows = pairs.where("type = 'chord'").select(*_PLACE, "at", "event_staff", F.explode(paired_notes(F.col("expected.notes"), F.col("actual.notes"))).alias("n"))
    rows = materialize(rows.withColumn("event_staff", F.coalesce("n.e.staff", "n.a.staff", "event_staff")), "paired_notes")
    e, a = F.col("n.e"), F.col("n.a")
    lone = _issue(rows.where("n.e IS NULL OR n.a IS NULL"), F.when(F.col("n.a").isNull(), "note.missing").otherwise("note.extra"), "Pitch", e["pitch"], a["pitch"])
    spec = [("note.pitch", "Pitch", e["pitch"], a["pitch"], False), ("note.staff", "Pitch", e["staff"], a["staff"], False), ("note.accidental", "Notation", e["accidental"], a["accidental"], False)]
    return lone.unionByName(matching.compare_fields(rows.where("n.e IS NOT NULL AND n.a IS NOT NULL"), [*_PLACE, "event_staff", "at"], spec))


def mark_issues(pairs: DataFrame) -> DataFrame:
    """Articulations, ornaments and fermatas of matched events, as bags of (kind, type, subtype)."""
    key = [*_PLACE, "expected_id", "at", "event_staff"]
    label = lambda kind: lambda m: F.concat_ws(":", F.lit(kind), m["type"], m["subtype"])

    def side(name: str) -> DataFrame:
        marks = F.concat(*(F.coalesce(F.transform(F.col(f"{name}.notation.{c}"), label(c[:-1])), F.array().cast("array<string>")) for c in ("articulations", "ornaments", "fermatas")))
        return pairs.select(*key, F.explode(marks).alias("mark"))

    diff = matching.bag_diff(side("expected"), side("actual"), [*key, "mark"])
    mark = F.col("mark")
    return _issue(diff, F.when(F.col("missing") > 0, "mark.missing").otherwise("mark.extra"), "Notation", F.when(F.col("missing") > 0, mark), F.when(F.col("extra") > 0, mark))


def measure_issues(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing and extra measures, and what is in force in matched ones: attributes, barlines, repeats."""

    def side(df: DataFrame) -> DataFrame:
        rows = sequences.carry_forward(df, ["case_id", "part_idx"], ["measure_idx"], ["time", "key", "staves", "clefs"])
        clef = F.array_join(F.array_sort(F.transform("clefs", lambda c: F.concat_ws(":", c["staff"], c["sign"], c["line"], c["octave_change"]))), ",")
        flat = lambda c, *parts: F.when(F.col(c).isNotNull(), F.concat_ws("/", *(F.col(c)[p] for p in parts)))
        return rows.select(*_PLACE, flat("time", "beats", "beat_type").alias("time"), flat("key", "fifths", "mode").alias("key"), "staves", clef.alias("clefs"), "left_barline", "right_barline",
                           flat("left_repeat", "direction", "times").alias("left_repeat"), flat("right_repeat", "direction", "times").alias("right_repeat"))

    pairs = matching.align(side(expected), side(actual), _PLACE)
    number = F.col("measure_no")
    found = _issue(pairs.where("side <> 'both'"), F.concat(F.lit("measure."), "side"), "Structure", F.when(F.col("side") == "missing", number), F.when(F.col("side") == "extra", number))
    e, a = F.col("expected"), F.col("actual")
    spec = [(f"attributes.{c}", "Attributes", e[c], a[c], False) for c in ("time", "key", "staves", "clefs")] + [(f"barline.{c}", "Structure", e[c], a[c], False) for c in ("left_barline", "right_barline", "left_repeat", "right_repeat")]
    fields = matching.compare_fields(pairs.where("side = 'both'"), _PLACE, spec)
    return found.unionByName(fields, allowMissingColumns=True)


def _addresses(relations: DataFrame, events: DataFrame, keep: list[str]) -> DataFrame:
    """case_id, keep and `core` of relations: kind, level, ratio and the addresses of the members in order; unknown events
    say so. Equal relations find their members once."""
    address = F.concat(F.lit("m"), "measure_no", F.lit("@"), "at", F.lit("/"), F.coalesce(F.col("event_staff").cast("string"), F.lit("-")))
    known = events.select("case_id", "event_id", address.alias("address"), F.array_join("content", "+").alias("what"))
    core = ["kind", "level", "hook", "actual", "normal"]
    own = list(dict.fromkeys([*keep, *core, "members"]))
    rows = relations.groupBy("case_id", *own).agg(F.count("*").alias("n")).select("case_id", F.struct(*own, "n").alias("r"), F.posexplode("members").alias("i", "m"))
    members = rows.select("case_id", "r", "i", "m.event_id", "m.pitch").join(known, ["case_id", "event_id"], "left")
    name = F.concat_ws(" ", F.coalesce("address", F.concat(F.lit("<unresolved:"), "event_id", F.lit(">"))), F.coalesce("pitch", "what"))
    cores = members.groupBy("case_id", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("i", name.alias("a")))), lambda s: s["a"]), " > ").alias("members_at"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.n")))
    return cores.select("case_id", *(F.col(f"r.{c}") for c in keep), F.concat_ws("|", *(f"r.{c}" for c in core), "members_at").alias("core"), again.alias("_")).drop("_")


def relation_issues(expected: Tables, actual: Tables) -> DataFrame:
    """Relations and spans by content: the n-th of a core on one side meets the n-th on the other; then a null expected
    placement matches anything. Ids never count."""
    keys, rest = ["case_id", "part_idx", "kind", "core"], ["placement", "direction", "bracket"]
    e, a = (_addresses(t["relations"], t["events"], ["part_idx", "kind", *rest]) for t in (expected, actual))
    pairs = matching.match_occurrences(e, a, keys, rest, rest)
    core, code = F.col("core"), F.concat(F.lit("relation."), "kind", F.lit("."), "side")
    lone = lambda df: _issue(df.where("side <> 'both'"), code, "Relations", F.when(F.col("side") == "missing", core), F.when(F.col("side") == "extra", core))
    spec = [(f"relation.{c}", "Relations", F.col("expected")[c], F.col("actual")[c], True) for c in rest]
    found = lone(pairs).unionByName(matching.compare_fields(pairs.where("side = 'both'"), ["case_id", "part_idx"], spec))
    span = lambda t: t["spans"].withColumn("core", F.concat_ws("|", "kind", F.to_json("from"), F.to_json("to"), "type", "direction", "size"))
    near = F.concat_ws("|", F.col("from.measure"), F.col("to.measure"), "type")
    se, sa = (span(t).withColumn("near", near).select(*keys, "near") for t in (expected, actual))
    exact = materialize(matching.match_occurrences(se, sa, keys, ["near"], ["near"]), "spans")
    lost = exact.where("side = 'missing'").select("case_id", "part_idx", "kind", "core", F.col("expected.near").alias("near"))
    gained = exact.where("side = 'extra'").select("case_id", "part_idx", "kind", "core", F.col("actual.near").alias("near"))
    again = matching.match_occurrences(lost, gained, ["case_id", "part_idx", "kind", "near"], ["core"], ["core"])
    moved = (F.col("side") == "both") & (F.col("kind") == "hairpin")
    codes = F.when(moved, "relation.hairpin.span").otherwise(F.concat(F.lit("relation."), "kind", F.lit("."), F.when(F.col("side") == "both", "missing").otherwise(F.col("side"))))
    return found.unionByName(_issue(again, codes, "Relations", F.col("expected.core"), F.col("actual.core")))


def with_severity(issues: DataFrame) -> DataFrame:
    """Warning, Error or Critical; the first rule that applies counts."""
    code, category = F.col("code"), F.col("category")
    kind = lambda c: F.lower(F.trim(F.substring_index(c, ":", 1)))
    same_kind = (kind("expected") == kind("actual")) & (kind("expected") != "")
    severity = (
        F.when(code == "event.voice", "Warning")
        .when((code == "event.onset") & (category == "Text"), "Warning")
        .when((code == "note.accidental") & same_kind, "Warning")
        .when(code == "relation.hairpin.span", "Warning")
        .when(category.isin("Pitch", "Rhythm"), "Critical")
        .when(code.rlike(r"^relation\.(tie|hairpin)"), "Critical")
        .otherwise("Error")
    )
    return issues.withColumn("severity", severity)


def order_issues(issues: DataFrame, by_value: bool = False) -> DataFrame:
    """Adds seq from 1 in each case: by category, part, measure, at (as text, or by its value), staff, code, then what
    differs."""
    value = F.substring_index("at", "/", 1).cast("double") / F.coalesce(F.when(F.col("at").contains("/"), F.substring_index("at", "/", -1)).cast("double"), F.lit(1.0))
    order = ["category", "part_idx", "measure_no", value if by_value else "at", "event_staff", "code", "expected", "actual"]
    return issues.withColumn("seq", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))


def diff(expected: Tables, actual: Tables, cases: DataFrame) -> DataFrame:
    """diff_issues of cases (case_id, expected_id, actual_id). Tables: scores, parts, measures, events, relations,
    spans by score_id, as read_scores gives them; relations and spans carry part_idx or part_id."""
    e, a = for_cases(expected, cases, "expected"), for_cases(actual, cases, "actual")
    ready = lambda events: materialize(normalize_monophonic(prepare_events(events)), "events")
    for t in (e, a):
        t |= {"measures": materialize(t["measures"], "measures"), "events": ready(t["events"].withColumn("given_voice", F.col("voice")))}
        index = t["measures"].select("case_id", "part_id", "part_idx").distinct()
        for name in ("relations", "spans"):
            if "part_idx" not in t[name].columns:
                t[name] = t[name].join(index, ["case_id", "part_id"], "left").withColumn("part_idx", F.coalesce("part_idx", F.lit(-1)))
    sides = (e, collapse_split(e, a)), (a, collapse_split(a, e))
    e, a = (t if t is given else t | {"events": ready(t["events"].withColumn("voice", F.col("given_voice")))} for given, t in sides)
    e, a, part_issues = match_parts(e, a)
    for t in (e, a):
        t["measures"] = materialize(trim_trailing_measures(t["measures"], t["events"], t["spans"]), "measures")
        t["events"], t["spans"] = normalize_interstaff(t["events"], t["measures"], t["spans"])
    a["events"] = align_voices(e["events"], a["events"])
    header = matching.align(e["scores"].select("case_id", "title", "subtitle", "composer"), a["scores"].select("case_id", "title", "subtitle", "composer"), ["case_id"])
    spec = [(f"metadata.{c}", "Metadata", norm_text(F.col("expected")[c]), norm_text(F.col("actual")[c]), False) for c in ("title", "subtitle", "composer")]
    found = matching.compare_fields(header, ["case_id"], spec).unionByName(part_issues, allowMissingColumns=True)
    compared = materialize(e["measures"].select("case_id", "part_idx").distinct(), "compared")
    of_pairs = lambda t: t["events"].join(compared, ["case_id", "part_idx"], "left_semi")
    differing = materialize(differing_measures(of_pairs(e), of_pairs(a)), "differing")
    matches = materialize(match_events(differing), "matches")
    found = materialize(found, "issues")  # each kind in a job of its own: one plan of all is too large for the driver
    for more in (measure_issues(e["measures"], a["measures"]), event_issues(measure_events(differing, "expected"), measure_events(differing, "actual"), matches), relation_issues(e, a)):
        found = found.unionByName(materialize(more, "issues"), allowMissingColumns=True)
    return order_issues(with_severity(found))


def root_causes(issues: DataFrame) -> DataFrame:
    """case_id, category, cause, n, first_seq, summary: attributes by code, the rest by place."""
    place = F.concat_ws("/", "part_idx", "measure_no", "event_staff", "at")
    cause = F.when(F.col("category").isin("Metadata", "Attributes"), F.col("code")).otherwise(place)
    message = F.concat_ws(" ", "code", F.coalesce("expected", F.lit("-")), F.lit("->"), F.coalesce("actual", F.lit("-")))
    rows = issues.withColumns({"cause": cause, "message": message}).groupBy("case_id", "category", "cause")
    return rows.agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.min_by("message", "seq").alias("summary"))


def corpus_summary(cases: DataFrame, issues: DataFrame) -> DataFrame:
    """case_id, status ('FAILED', 'clean' or 'differences'), n and the count of each severity, for all cases. A case
    failed if cases has a column `error` that is set."""
    counts = issues.groupBy("case_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "Error", "Warning")))
    error = F.col("error").isNotNull() if "error" in cases.columns else F.lit(False)
    rows = cases.select("case_id", error.alias("_failed")).join(counts, "case_id", "left").na.fill(0, ["n", "critical", "error", "warning"])
    status = F.when(F.col("_failed"), "FAILED").when(F.col("n") == 0, "clean").otherwise("differences")
    return rows.withColumn("status", status).drop("_failed")


def corpus_totals(summary: DataFrame) -> DataFrame:
    """One row: how many cases there are of each status, and the sums of a corpus_summary."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("FAILED", "clean", "differences")]
    return summary.agg(F.count("*").alias("cases"), *counts, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "critical", "error", "warning")))


def filter_severity(issues: DataFrame, least: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ("Warning", "Error", "Critical"))), F.col("severity"))
    return issues.where(rank >= ("Warning", "Error", "Critical").index(least) + 1)


def decorate_origin(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page and local_measure; pages: page, offset (measures before it), and case_id if they are of one case each.
    The pages of a case, or of all, are few: they meet the issues in a range join whose other side is not moved."""
    by = ["case_id"] if "case_id" in pages.columns else []
    spans = sequences.until_next(pages.withColumn("_all", F.lit(1)), ["_all", *by], ["offset"])
    spans = spans.select(*(F.col(c).alias(f"_{c}") for c in by), "page", (F.col("offset") + 1).alias("_start"), F.col("until").alias("_until"))
    spans = spans if by else F.broadcast(spans)  # without cases the pages of one score
    inside = (F.col("measure_no") >= F.col("_start")) & (F.col("_until").isNull() | (F.col("measure_no") <= F.col("_until")))
    if by:
        inside = inside & F.col("case_id").eqNullSafe(F.col("_case_id"))
    found = issues.join(spans, inside, "left")
    return found.withColumn("local_measure", F.col("measure_no") - F.col("_start") + 1).drop("_start", "_until", "_case_id")
