"""The score operators on scores that Spark derives from the order tables: an order is a measure, its lines are notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fractions, text
from ..operators import notation
from ..operators.components import materialize
from ..sources import musicxml
from . import score_diff, score_jobs

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and line number: the cheapest part, so that both are unique."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_quantity").cast("long").alias("qty"))


_LINES = "l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, CAST(min(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL)"


def _pitch():
    """C to B with flat, natural or sharp, octaves 2 to 5, of a part key."""
    step = F.element_at(F.array(*map(F.lit, "CDEFGAB")), (F.col("part") % 7 + 1).cast("int"))
    return text.pitch_text(step, (F.col("part") % 3 - 1).cast("int"), (2 + F.col("part") % 4).cast("int"))


_PITCH = "substr('CDEFGAB', CAST(part % 7 + 1 AS INT), 1) || CASE part % 3 WHEN 0 THEN 'b' WHEN 1 THEN '' ELSE '#' END || (2 + part % 4)"


def derived_events(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Canonical events: scores of 50 orders, a measure each; note lengths are quantities of 64ths in one voice. With
    a shift, every 17th part is another pitch and every 23rd line is gone."""
    lines = _lines(spark, sf_dir)
    if shift:
        lines = lines.where("part % 23 <> 5").withColumn("part", F.when(F.col("part") % 17 == 0, F.col("part") + shift).otherwise(F.col("part")))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    rows = lines.withColumn("start", F.coalesce(F.sum("qty").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at, length = fractions.frac(F.col("start"), F.lit(64).cast("long")), fractions.frac(F.col("qty"), F.lit(64).cast("long"))
    none = lambda kind: F.lit(None).cast(kind)
    mark = "array<struct<type:string,subtype:string,placement:string>>"
    measure = (F.col("l_orderkey") % 50).cast("int")
    note = F.struct(_pitch().alias("pitch"), F.lit(1).alias("staff"), none("struct<type:string,cautionary:boolean,editorial:boolean,parentheses:boolean,bracket:boolean>").alias("accidental"), none("array<struct<type:string,value:string,placement:string>>").alias("technical"))
    return rows.select(
        F.concat(F.lit("s"), F.floor(F.col("l_orderkey") / 50).cast("string")).alias("score_id"), F.lit("P1").alias("part_id"), F.lit(0).alias("part_idx"), measure.alias("measure_idx"), (measure + 1).alias("measure_no"),
        F.col("l_linenumber").alias("event_no"), F.concat(F.lit("P1.m"), measure + 1, F.lit(".e"), "l_linenumber").alias("event_id"), F.lit("chord").alias("type"), F.col("l_linenumber").alias("pos"), F.lit(0).alias("part_of"),
        fractions.frac_str(at).alias("at"), at["num"].alias("at_num"), at["den"].alias("at_den"), fractions.frac_str(length).alias("duration"), none("int").alias("staff"), F.lit(1).alias("voice"), none("boolean").alias("grace"),
        F.array(note).alias("notes"), F.struct(*(none(k).alias(n) for n, k in (("note_type", "string"), ("dots", "int"), ("stem", "string"), ("notehead", "string"), ("articulations", mark), ("ornaments", mark), ("fermatas", mark)))).alias("notation"),
        *(none("string").alias(c) for c in ("placement", "text", "value", "target", "beat_unit")), none("decimal(10,3)").alias("bpm"),
    )


def _tables(events: DataFrame) -> dict[str, DataFrame]:
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    measures = events.select("score_id", "part_id", "part_idx", "measure_idx", "measure_no").distinct().select(
        "*", none("time", "struct<beats:int,beat_type:int>"), none("key", "struct<fifths:int,mode:string>"), none("staves", "int"), none("clefs", "array<struct<staff:int,sign:string,line:int,octave_change:int>>"),
        none("left_barline", "string"), none("right_barline", "string"), none("left_repeat", "struct<direction:string,times:int>"), none("right_repeat", "struct<direction:string,times:int>"), none("break_before", "string"),
    )
    scores = events.select("score_id").distinct().select("score_id", F.col("score_id").alias("title"), none("subtitle", "string"), none("composer", "string"))
    slur = F.array(*(F.struct(F.col(c).alias("event_id"), F.lit(None).cast("string").alias("pitch")) for c in ("first", "last")))
    ends = events.groupBy("score_id", "part_id", "part_idx", "measure_idx").agg(F.min_by("event_id", "event_no").alias("first"), F.max_by("event_id", "event_no").alias("last"))
    relations = ends.select("score_id", "part_id", F.lit("slur").alias("kind"), none("level", "int"), none("hook", "string"), none("placement", "string"), none("actual", "int"), none("normal", "int"), none("bracket", "boolean"), none("direction", "string"), slur.alias("members"))
    anchor = lambda c: F.struct(F.col(c).alias("measure"), F.lit("0").alias("at"), F.lit(1).alias("staff"))
    spans = events.groupBy("score_id", "part_id").agg(F.min("measure_no").alias("a"), F.max("measure_no").alias("b"))
    spans = spans.select("score_id", "part_id", F.lit("hairpin").alias("kind"), anchor("a").alias("from"), anchor("b").alias("to"), F.lit("crescendo").alias("type"), none("direction", "string"), none("size", "int"), none("line", "boolean"), none("start_mark", "boolean"), none("placement", "string"))
    parts = events.select("score_id", "part_id").distinct().withColumn("name", F.lit("Orders"))
    return {"scores": scores, "parts": parts, "measures": measures, "events": events, "relations": relations, "spans": spans}


@query(f"""
WITH {_LINES}, c AS (SELECT *, CAST(coalesce(sum(qty) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l),
f AS (SELECT *, start // gcd(start, 64) AS an, 64 // gcd(start, 64) AS ad, qty // gcd(qty, 64) AS dn, 64 // gcd(qty, 64) AS dd FROM c)
SELECT 's' || (l_orderkey // 50) AS score_id, CAST(l_orderkey % 50 + 1 AS INT) AS measure_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS event_no,
  CASE WHEN an = 0 THEN '0' WHEN ad = 1 THEN '' || an ELSE an || '/' || ad END AS at, CASE WHEN dd = 1 THEN '' || dn ELSE dn || '/' || dd END AS duration, {_PITCH} AS pitch FROM f""")
def s_musicxml_roundtrip(spark, sf_dir):
    """Events written as MusicXML documents and read again."""
    docs = score_jobs.musicxml_documents(derived_events(spark, sf_dir), divisions=16)
    timed = musicxml.timed_children(musicxml.measure_children(docs))
    events = musicxml.note_events(musicxml.note_rows(timed))
    return events.select("score_id", "measure_no", "event_no", "at", "duration", F.get("notes", F.lit(0))["pitch"].alias("pitch"))


@query()
def s_score_diff(spark, sf_dir):
    """Scores compared with copies in which pitches and lines are changed."""
    expected, actual = (_tables(materialize(derived_events(spark, sf_dir, shift), "derived")) for shift in (0, 1))
    cases = expected["scores"].select(F.col("score_id").alias("case_id"), F.col("score_id").alias("expected_id"), F.col("score_id").alias("actual_id"))
    return score_diff.diff(expected, actual, cases)


@query(f"""
WITH {_LINES}, e AS (SELECT l_orderkey // 50 AS s, count(*) AS n, count(DISTINCT l_orderkey % 50) AS measures FROM l GROUP BY 1),
m AS (SELECT s // 5 AS v, sum(n) AS n, sum(measures) AS measures FROM e GROUP BY 1)
SELECT 'v' || v AS score_id, CAST(n AS BIGINT) AS n_events, CAST(measures AS BIGINT) AS n_measures FROM m""")
def s_merge_pages(spark, sf_dir):
    """Five scores each as the pages of one."""
    tables = _tables(derived_events(spark, sf_dir))
    number = F.substring("score_id", 2, 20).cast("long")
    pages = tables["scores"].select("score_id", F.concat(F.lit("v"), F.floor(number / 5).cast("string")).alias("merged_id"), (number % 5 + 1).cast("int").alias("page_no"))
    merged = score_jobs.merge_pages(tables, pages)
    events = merged["events"].groupBy("score_id").agg(F.count_distinct("event_id").alias("n_events"))
    return events.join(merged["measures"].groupBy("score_id").agg(F.count("*").alias("n_measures")), "score_id")


@query(f"""
WITH {_LINES} SELECT l_orderkey, l_linenumber, {_PITCH} AS pitch,
  CAST((3 + part % 4) * 12 + CASE part % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 7 WHEN 5 THEN 9 ELSE 11 END + part % 3 - 1 AS INT) AS midi FROM l""")
def s_pitch_text(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", _pitch().alias("pitch"), text.midi(_pitch()).alias("midi"))


@query(f"""
WITH {_LINES}, p AS (SELECT *, CAST(part % 15 AS INT) - 3 AS staff_step, CAST(l_orderkey % 15 AS INT) - 7 AS fifths, l_linenumber % 2 = 0 AS bass FROM l),
i AS (SELECT *, (CASE WHEN bass THEN 24 + 2 ELSE 32 + 6 END) - staff_step AS idx FROM p),
s AS (SELECT *, substr('CDEFGAB', CAST(idx % 7 + 1 AS INT), 1) AS step, idx // 7 AS octave FROM i)
SELECT l_orderkey, l_linenumber, step, CAST(octave AS INT) AS octave,
  CAST(CASE WHEN fifths > 0 AND instr('FCGDAEB', step) <= fifths THEN 1 WHEN fifths < 0 AND instr('BEADGCF', step) <= -fifths THEN -1 ELSE 0 END AS INT) AS alter FROM s""")
def s_diatonic(spark, sf_dir):
    """Staff steps read by G and F clefs and a key signature."""
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("part") % 15 - 3).cast("int").alias("staff_step"), (F.col("l_orderkey") % 15 - 7).cast("int").alias("fifths"), (F.col("l_linenumber") % 2 == 0).alias("bass"))
    d = text.diatonic(F.col("staff_step"), F.when(F.col("bass"), "F").otherwise("G"), F.when(F.col("bass"), 4).otherwise(2))
    rows = rows.withColumn("d", d)
    return rows.select("l_orderkey", "l_linenumber", "d.step", "d.octave", text.key_alter(F.col("d.step"), F.col("fifths")).alias("alter"))


@query(f"""
WITH {_LINES}, d AS (SELECT *, CAST(pow(2, qty % 5) AS BIGINT) AS den, part % 3 AS dots, CASE WHEN part % 5 = 0 THEN 3 ELSE 1 END AS actual, CASE WHEN part % 5 = 0 THEN 2 ELSE 1 END AS normal FROM l),
f AS (SELECT *, (CAST(pow(2, dots + 1) AS BIGINT) - 1) * normal AS n, den * CAST(pow(2, dots) AS BIGINT) * actual AS m FROM d)
SELECT l_orderkey, l_linenumber, CAST(n // gcd(n, m) AS BIGINT) AS num, CAST(m // gcd(n, m) AS BIGINT) AS den FROM f""")
def s_durations(spark, sf_dir):
    """Dotted and tuplet durations, exactly."""
    rows = _lines(spark, sf_dir).withColumns({"dots": (F.col("part") % 3).cast("int"), "three": F.col("part") % 5 == 0})
    plain = fractions.dotted(F.lit(1).cast("long"), F.pow(F.lit(2), F.col("qty") % 5).cast("long"), F.col("dots"))
    rows = rows.withColumn("d", plain)
    f = fractions.tuplet(F.col("d.num"), F.col("d.den"), F.when(F.col("three"), 3).otherwise(1), F.when(F.col("three"), 2).otherwise(1))
    return rows.withColumn("f", f).select("l_orderkey", "l_linenumber", "f.num", "f.den")


@query(f"""
WITH {_LINES}, c AS (SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(420 // (l_linenumber + 0)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t FROM l)
SELECT l_orderkey, l_linenumber, CAST(t // gcd(t, 420) AS BIGINT) AS num, CAST(420 // gcd(t, 420) AS BIGINT) AS den FROM c""")
def s_onsets(spark, sf_dir):
    """Onsets of notes that last one over their line number, in order."""
    rows = _lines(spark, sf_dir).select(F.lit("s").alias("score_id"), F.col("l_orderkey").alias("measure_no"), F.lit(1).alias("staff"), F.lit(1).alias("voice"), F.col("l_linenumber").alias("x"), F.col("l_linenumber").alias("id"),
                                        fractions.frac(F.lit(1).cast("long"), F.col("l_linenumber").cast("long")).alias("duration"))
    return notation.sequential_onsets(rows).select(F.col("measure_no").alias("l_orderkey"), F.col("id").alias("l_linenumber"), "at.num", "at.den")
