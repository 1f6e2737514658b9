"""Jobs on canonical tables: pages merged to scores, excerpts, JSON and MusicXML documents written, files discovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fractions
from ..operators import sequences

Tables = dict[str, DataFrame]


def merge_pages(tables: Tables, pages: DataFrame) -> Tables:
    """Pages put in a row as one score. pages: score_id (of a page), merged_id, page_no.

    Measure numbers go on from page to page, event ids get the page as prefix, the first measure of a later page gets
    a page break, spans and relations move along, and the first page with a non-blank title, subtitle or composer
    gives it. Pages of one score must have the same parts; if not, an error says so.
    """
    counts = tables["measures"].groupBy("score_id", "part_idx", "part_id").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("score_id").agg(F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_idx", "part_id"))), lambda p: p["part_id"]), "\u0001").alias("parts"))
    offsets = sequences.concat_offsets(pages.join(sizes, "score_id"), ["merged_id"], ["page_no"], "n")
    same = F.min("parts").over(Window.partitionBy("merged_id")) == F.max("parts").over(Window.partitionBy("merged_id"))
    checked = offsets.withColumn("offset", F.when(same, F.col("offset")).otherwise(F.raise_error(F.lit("pages of one score must have the same parts")).cast("long")))
    at = checked.select("score_id", "merged_id", "page_no", "offset")
    prefix = lambda c: F.concat(F.lit("p"), F.lpad(F.col("page_no").cast("string"), 3, "0"), F.lit(":"), c)
    name = lambda df: df.drop("score_id").withColumnRenamed("merged_id", "score_id")
    out: Tables = {}
    first = F.row_number().over(Window.partitionBy("score_id", "part_idx").orderBy("measure_no")) == 1
    measures = tables["measures"].join(at, "score_id")
    measures = measures.withColumn("break_before", F.when((F.col("page_no") > 1) & first, "page").otherwise(F.col("break_before")))
    moved = lambda df: df.withColumns({"measure_no": F.col("measure_no") + F.col("offset").cast("int"), "measure_idx": F.col("measure_idx") + F.col("offset").cast("int")})
    out["measures"] = name(moved(measures).drop("page_no", "offset"))
    out["events"] = name(moved(tables["events"].join(at, "score_id")).withColumn("event_id", prefix(F.col("event_id"))).drop("page_no", "offset"))
    members = F.transform("members", lambda m: F.struct(prefix(m["event_id"]).alias("event_id"), m["pitch"].alias("pitch")))
    out["relations"] = name(tables["relations"].join(at, "score_id").withColumn("members", members).drop("page_no", "offset"))
    shift = lambda c: F.col(c).withField("measure", F.col(c)["measure"] + F.col("offset").cast("int"))
    out["spans"] = name(tables["spans"].join(at, "score_id").withColumns({"from": shift("from"), "to": shift("to")}).drop("page_no", "offset"))
    headers = tables["scores"].join(at, "score_id")
    filled = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col("page_no"))).alias(c)
    out["scores"] = headers.groupBy(F.col("merged_id").alias("score_id")).agg(*(filled(c) for c in ("title", "subtitle", "composer")))
    parts = tables["parts"].join(at, "score_id")
    out["parts"] = parts.groupBy(F.col("merged_id").alias("score_id"), "part_id").agg(F.coalesce(filled("name"), F.col("part_id")).alias("name"))
    return out


def limit_scope(measures: DataFrame, max_systems: int, max_measures: int) -> DataFrame:
    """The measures before the limit: max_systems systems or max_measures measures of the first part, whichever ends
    first, for all parts."""
    new = F.col("break_before").isin("system", "page").cast("int")
    first = measures.where("part_idx = 0").withColumns({"_system": 1 + F.sum(F.coalesce(new, F.lit(0))).over(Window.partitionBy("score_id").orderBy("measure_idx")), "_n": F.row_number().over(Window.partitionBy("score_id").orderBy("measure_idx"))})
    kept = first.where((F.col("_system") <= max_systems) & (F.col("_n") <= max_measures)).select("score_id", "measure_idx")
    return measures.join(kept, ["score_id", "measure_idx"], "left_semi")


def inherit_state(pages: DataFrame, cols: list[str]) -> DataFrame:
    """Time and key in force carried from page to page: pages: score_id, page_no and cols."""
    return sequences.carry_forward(pages, ["score_id"], ["page_no"], cols)


def canonical_documents(tables: Tables) -> DataFrame:
    """score_id and json: one document per score, events nested in measures nested in parts, nulls left out."""
    pack = lambda df, keys, order, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*(c for c in df.columns if c not in keys)).alias("row")))).alias(name)).withColumn(name, F.transform(name, lambda r: r["row"]))
    place = ["score_id", "part_id", "part_idx", "measure_idx"]
    events = pack(tables["events"].drop("measure_no"), place, ["pos", "part_of"], "events")
    measures = pack(tables["measures"].join(events, place, "left"), ["score_id", "part_id", "part_idx"], ["measure_idx"], "measures")
    names = tables["parts"].select("score_id", "part_id", "name")
    parts = pack(measures.join(names, ["score_id", "part_id"], "left"), ["score_id"], ["part_idx"], "parts")
    whole = tables["scores"].join(parts, "score_id", "left")
    for kind in ("relations", "spans"):
        rows = tables[kind].groupBy("score_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*(c for c in tables[kind].columns if c != "score_id"))))).alias(kind))
        whole = whole.join(rows, "score_id", "left")
    return whole.select("score_id", F.to_json(F.struct(F.lit("CanonicalNotation").alias("format"), F.struct("title", "subtitle", "composer").alias("metadata"), "parts", "relations", "spans")).alias("json"))


def read_canonical(docs: DataFrame, schema: str) -> Tables:
    """parts, measures and events of JSON documents (score_id, json) by a schema of canonical_documents' shape."""
    rows = docs.select("score_id", F.from_json("json", schema).alias("d")).select("score_id", "d.*")
    parts = rows.select("score_id", F.explode("parts").alias("p")).select("score_id", "p.*")
    measures = parts.select("score_id", "part_id", "part_idx", F.explode("measures").alias("m")).select("score_id", "part_id", "part_idx", "m.*")
    events = measures.select("score_id", "part_id", "part_idx", "measure_idx", "measure_no", F.explode("events").alias("e")).select("score_id", "part_id", "part_idx", "measure_idx", "measure_no", "e.*")
    return {"scores": rows.select("score_id", "metadata.*"), "parts": parts.drop("measures"), "measures": measures.drop("events"), "events": events}


def _tag(name: str, content: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), content.cast("string"), F.lit(f"</{name}>")), F.lit(""))


def musicxml_rows(events: DataFrame, divisions: int, markers: DataFrame | None = None) -> DataFrame:
    """score_id, part_idx, measure_idx, seq, xml: notes, rests and the forward and backup moves between them.

    Each voice is a stream from the measure's start: a gap before an event moves forward, an overlap back, and a
    backup returns to the start before the next voice. Chord notes after the first repeat its onset. divisions: units
    per quarter; times must be whole units. markers (explode_markers): what relations put on the notes; with them the
    notation's own fields are written too: dots, stems, noteheads, accidentals and marks.
    """
    units = lambda c: F.col(c)["num"] * (4 * divisions) / F.col(c)["den"]
    rows = events.where(F.col("type").isin("chord", "rest")).withColumn("_d", fractions.frac_parse(F.coalesce("duration", F.lit("0"))))
    rows = rows.withColumns({"_at": (F.col("at_num") * (4 * divisions) / F.col("at_den")).cast("long"), "_len": units("_d").cast("long"), "voice": F.coalesce("voice", F.lit(1))})
    by, order = ["score_id", "part_idx", "measure_idx", "voice"], ["_at", "pos", "event_id"]
    rows = rows.withColumn("_end", F.col("_at") + F.when(F.col("grace"), 0).otherwise(F.col("_len")))
    rows = rows.withColumn("_cursor", F.coalesce(sequences.previous("_end", by, order), F.lit(0)))
    rows = rows.withColumn("_move", F.col("_at") - F.col("_cursor"))
    move = F.when(F.col("_move") > 0, F.concat(F.lit("<forward>"), _tag("duration", F.col("_move")), F.lit("</forward>"))).when(F.col("_move") < 0, F.concat(F.lit("<backup>"), _tag("duration", -F.col("_move")), F.lit("</backup>"))).otherwise("")
    step, octave = F.regexp_extract, F.regexp_extract
    alter = lambda p: F.when(p.contains("##"), 2).when(p.contains("#"), 1).when(F.substring(p, 2, 2) == "bb", -2).when(F.substring(p, 2, 1) == "b", -1)
    pitch = lambda p: F.concat(F.lit("<pitch>"), _tag("step", step(p, "^([A-G])", 1)), _tag("alter", alter(p)), _tag("octave", octave(p, r"(-?\d+)$", 1)), F.lit("</pitch>"))

    if markers is not None:
        held = markers.groupBy("score_id", "part_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("place", "nth", "pitch", "xml"))).alias("_marks"))
        rows = rows.join(held, ["score_id", "part_id", "event_id"], "left")
    notation = F.col("notation")

    def marked(place: str, pitch: Column | None, first: Column) -> Column:
        """The marks of that place: those of one pitch where it is, the others on the event's first note."""
        if markers is None:
            return F.lit("")
        of_note = lambda m: (m["place"] == place) & F.when(m["pitch"].isNull(), first).otherwise((m["pitch"] == pitch) if pitch is not None else F.lit(False))
        return F.coalesce(F.array_join(F.transform(F.filter("_marks", of_note), lambda m: m["xml"]), ""), F.lit(""))

    def printed(first: Column) -> tuple[Column, Column, Column]:
        """Dots, stem with notehead, and the groups of marks of an event."""
        if markers is None:
            return F.lit(""), F.lit(""), F.lit("")
        attribute = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), c, F.lit('"')), F.lit(""))
        mark = lambda m: F.concat(F.lit("<"), m["type"], attribute("type", m["subtype"]), attribute("placement", m["placement"]), F.lit("/>"))
        groups = F.concat(*(F.when(first & (F.size(notation[g]) > 0), F.concat(F.lit(o), F.array_join(F.transform(notation[g], mark), ""), F.lit(c))).otherwise("") for g, o, c in (("articulations", "<articulations>", "</articulations>"), ("ornaments", "<ornaments>", "</ornaments>"), ("fermatas", "", ""))))
        return F.repeat(F.lit("<dot/>"), F.coalesce(notation["dots"], F.lit(0))), F.concat(_tag("stem", notation["stem"]), _tag("notehead", notation["notehead"])), groups

    def accidental(n: Column) -> Column:
        if markers is None:
            return F.lit("")
        flag = lambda name: F.coalesce(F.when(n["accidental"][name], f' {name}="yes"').when(~n["accidental"][name], f' {name}="no"'), F.lit(""))
        found = F.concat(F.lit("<accidental"), *(flag(f) for f in ("cautionary", "editorial", "parentheses", "bracket")), F.lit(">"), F.coalesce(n["accidental"]["type"], F.lit("")), F.lit("</accidental>"))
        return F.when(n["accidental"].isNotNull(), found).otherwise("")

    def technical(n: Column) -> Column:
        if markers is None:
            return F.lit("")
        placed = lambda m: F.coalesce(F.concat(F.lit(' placement="'), m["placement"], F.lit('"')), F.lit(""))
        mark = lambda m: F.concat(F.lit("<"), m["type"], placed(m), F.lit(">"), F.coalesce(m["value"], F.lit("")), F.lit("</"), m["type"], F.lit(">"))
        return F.when(F.size(n["technical"]) > 0, F.concat(F.lit("<technical>"), F.array_join(F.transform(n["technical"], mark), ""), F.lit("</technical>"))).otherwise("")

    wrap = lambda inner: F.when(inner != "", F.concat(F.lit("<notations>"), inner, F.lit("</notations>"))).otherwise("")

    def note(n: Column, i: Column) -> Column:
        first = i == 0
        dots, look, groups = printed(first)
        head = F.concat(F.lit("<note>"), F.when(F.col("grace"), "<grace/>").otherwise(""), F.when(i > 0, "<chord/>").otherwise(""), pitch(n["pitch"]))
        middle = F.concat(F.when(F.col("grace"), "").otherwise(_tag("duration", F.col("_len"))), _tag("voice", F.col("voice")), _tag("type", notation["note_type"]), dots, accidental(n))
        tail = F.concat(marked("modification", n["pitch"], first), look, _tag("staff", n["staff"]), marked("beam", n["pitch"], first), wrap(F.concat(marked("notations", n["pitch"], first), technical(n), groups)))
        return F.concat(head, middle, tail, F.lit("</note>"))

    always = F.lit(True)
    dots, _, groups = printed(always)
    rest = F.concat(
        F.lit("<note><rest/>"), _tag("duration", F.col("_len")), _tag("voice", F.col("voice")), _tag("type", notation["note_type"]), dots, marked("modification", None, always), _tag("staff", F.col("staff")),
        marked("beam", None, always), wrap(F.concat(marked("notations", None, always), groups)), F.lit("</note>"),
    )
    body = F.when(F.col("type") == "rest", rest).otherwise(F.array_join(F.transform("notes", note), ""))
    last = F.last("_end").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    end = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))) == 1
    back = F.when(end, F.concat(F.lit("<backup>"), _tag("duration", F.col("_last")), F.lit("</backup>"))).otherwise("")
    rows = rows.withColumn("_last", last).withColumn("xml", F.concat(move, body, back))
    seq = F.row_number().over(Window.partitionBy("score_id", "part_idx", "measure_idx").orderBy("voice", *order))
    return rows.select("score_id", "part_id", "part_idx", "measure_idx", "measure_no", seq.alias("seq"), "xml")


def musicxml_documents(events: DataFrame, divisions: int) -> DataFrame:
    """score_id and xml: partwise documents of the rows above."""
    rows = musicxml_rows(events, divisions)
    ordered = lambda order, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda r: r[c]), "")
    measures = rows.groupBy("score_id", "part_id", "part_idx", "measure_idx", "measure_no").agg(ordered("seq", "xml").alias("body"))
    attributes = F.when(F.col("measure_idx") == F.min("measure_idx").over(Window.partitionBy("score_id", "part_idx")), f"<attributes><divisions>{divisions}</divisions></attributes>").otherwise("")
    measures = measures.withColumn("xml", F.concat(F.lit('<measure number="'), "measure_no", F.lit('">'), attributes, "body", F.lit("</measure>")))
    parts = measures.groupBy("score_id", "part_id", "part_idx").agg(ordered("measure_idx", "xml").alias("body")).withColumn("xml", F.concat(F.lit('<part id="'), "part_id", F.lit('">'), "body", F.lit("</part>")))
    return parts.groupBy("score_id").agg(ordered("part_idx", "xml").alias("body")).select("score_id", F.concat(F.lit("<score-partwise>"), "body", F.lit("</score-partwise>")).alias("xml"))


def pad_empty_measures(measures: DataFrame, events: DataFrame) -> DataFrame:
    """Rest events for measures without chords or rests: one of the full measure per staff, by the time and staves in
    force; a whole note before the first time signature."""
    state = sequences.carry_forward(measures, ["score_id", "part_idx"], ["measure_idx"], ["time", "staves"])
    keys = ["score_id", "part_id", "part_idx", "measure_idx", "measure_no"]
    empty = state.join(events.where(F.col("type").isin("chord", "rest")), ["score_id", "part_idx", "measure_idx"], "left_anti")
    length = fractions.frac(F.coalesce("time.beats", F.lit(1)).cast("long"), F.coalesce("time.beat_type", F.lit(1)).cast("long"))
    rows = empty.select(*keys, fractions.frac_str(length).alias("duration"), F.explode(F.sequence(F.lit(1), F.coalesce("staves", F.lit(1)))).alias("staff"))
    return rows.withColumns({"type": F.lit("rest"), "at": F.lit("0"), "voice": (F.col("staff") - 1) * 4 + 1})


def discover_pages(files: DataFrame, base: str | None = None) -> DataFrame:
    """folder, base, page_no, path of page files `<base>-<n>.svg`. files: path. Folders with several bases (unless one
    is chosen) or repeated page numbers raise an error."""
    pattern = r"^(.*/)?([^/]*)-(\d+)\.svg$"
    pages = files.where(F.col("path").rlike(pattern)).select(F.regexp_extract("path", pattern, 1).alias("folder"), F.regexp_extract("path", pattern, 2).alias("base"), F.regexp_extract("path", pattern, 3).cast("int").alias("page_no"), "path")
    pages = pages if base is None else pages.where(F.col("base") == base)
    faults = pages.groupBy("folder").agg(F.count_distinct("base").alias("bases"), (F.count("*") - F.count_distinct("base", "page_no")).alias("repeated"))
    bad = F.when((F.col("bases") > 1) | (F.col("repeated") > 0), F.raise_error(F.concat(F.lit("several bases or repeated pages in "), "folder")))
    return pages.join(faults.withColumn("bad", bad).where("bad IS NULL").select("folder"), "folder")


def discover_cases(files: DataFrame) -> DataFrame:
    """folder and score of folders with exactly one .musicxml file and one page set, not below a folder `out`."""
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    base = F.when(F.col("path").rlike(r"-\d+\.svg$"), F.regexp_extract("path", r"([^/]*)-\d+\.svg$", 1))
    score = F.when(F.lower("path").endswith(".musicxml"), F.col("path"))
    rows = files.where(~F.col("path").rlike("(^|/)out/")).groupBy(folder.alias("folder")).agg(F.count(score).alias("n"), F.count_distinct(base).alias("bases"), F.max(score).alias("score"))
    return rows.where("n = 1 AND bases = 1").select("folder", "score")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:", "").alias("path"))
