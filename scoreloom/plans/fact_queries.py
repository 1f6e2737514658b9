"""Queries of the notation steps on events that Spark makes from the driver's tables: an order is a measure of two staves,
its lines are the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import materialize
from ..operators.ledgers import ledger_ladder, ledger_segments
from ..operators.voices import assign_voices, move_interstaff_rests, polyphonic_staves


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of voice_events, made from lineitem."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_tax").distinct()
    rest = F.col("l_returnflag") == "R"
    x, top = F.col("l_quantity").cast("double"), (F.col("l_partkey") % 60).cast("double")
    stem = ~rest & (F.col("l_tax") < 0.065)
    return rows.select(
        F.floor(F.col("l_orderkey") / 100).alias("score_id"), F.col("l_orderkey").alias("measure_no"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("staff"), F.when(rest, "rest").otherwise("note").alias("kind"),
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")), F.col("l_quantity").cast("int").cast("string"), "l_returnflag", "l_linestatus", F.round(F.col("l_tax") * 100).cast("int").cast("string")).alias("id"),
        x.alias("x"), top.alias("top"), F.when(rest, top).otherwise(top + F.col("l_suppkey") % 3 * 5).alias("bottom"),
        F.when(stem, F.when(F.col("l_linestatus") == "O", "Up").otherwise("Down")).alias("direction"), F.when(stem, x + F.col("l_linenumber") % 3 * 4).alias("stem_x"),
        (0.5 + F.col("l_quantity") / 100).alias("confidence"),
    )


def line_staves(events: DataFrame) -> DataFrame:
    return events.select("score_id", "measure_no", "staff").distinct().select("*", F.lit(10.0).alias("spacing"), F.lit(30.0).alias("centre_y"))


def q_polyphony(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = line_events(spark, sf_dir)
    return polyphonic_staves(events, line_staves(events))


def q_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = materialize(line_events(spark, sf_dir), "line_events")
    return assign_voices(events, line_staves(events)).select("score_id", "measure_no", "staff", "kind", "id", "voice", "polyphonic", F.round("confidence", 6).alias("confidence"), "reason")


def line_rests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rests, totals and pairs of move_interstaff_rests: every event lasts l_quantity ticks of bars of 50, rests between
    the staves are those whose y is 20 to 40."""
    events = line_events(spark, sf_dir).withColumn("ticks", F.col("x").cast("long"))
    totals = events.groupBy("score_id", "measure_no", "staff").agg(F.sum("ticks").alias("ticks"))
    rests = events.where("kind = 'rest'").select("score_id", "measure_no", "staff", "id", F.col("x").cast("int").alias("seq"), F.col("top").alias("y"), "ticks", "confidence")
    pairs = events.select("score_id", "measure_no").distinct().select("*", F.lit(50).cast("long").alias("bar"), F.lit(20.0).alias("upper_bottom"), F.lit(40.0).alias("lower_top"))
    return rests, totals, pairs


def q_interstaff_rests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = move_interstaff_rests(*line_rests(spark, sf_dir))
    return found.select("score_id", "measure_no", "id", "staff", F.round("moved", 6).alias("moved"))


def line_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """staffs, lines, strokes, ellipses, measures: every order is a page of two staffs, its lines are strokes and heads."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    rows = materialize(rows, "lines")  # five tables are made of them
    rows = rows.withColumns({"score_id": F.col("l_orderkey"), "id": F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))})
    whole = lambda c: F.col(c).cast("double")
    staffs = rows.select("score_id").distinct().withColumn("staff_id", F.explode(F.array(F.lit(1), F.lit(2))))
    staffs = staffs.select("*", F.lit(10.0).alias("spacing"), F.lit(0.0).alias("min_x"), F.lit(60.0).alias("max_x"), (200.0 * F.col("staff_id")).alias("min_y"), (200.0 * F.col("staff_id") + 40).alias("max_y"))
    lines = staffs.select("score_id", "staff_id", F.lit("line").alias("stroke_id"), F.col("min_y").alias("y"), F.lit(0.0).alias("x_start"), F.lit(60.0).alias("x_end"))
    near = lambda step: F.when(F.col("l_suppkey") % 2 == 0, 240 + step).otherwise(400 - step)
    x = whole("l_quantity")
    strokes = rows.select("score_id", F.col("id").alias("stroke_id"), near(10 * (F.col("l_linenumber") % 4 + 1) + F.col("l_partkey") % 5 - 2).cast("double").alias("y"), x.alias("x_start"), (x + 6 + F.col("l_partkey") % 41).alias("x_end"))
    ellipses = rows.select("score_id", F.col("id").alias("shape_id"), (x + 2).alias("x"), near(10 * (F.col("l_linenumber") % 3 + 1) + F.col("l_partkey") % 3).cast("double").alias("y"), F.lit(5.0).alias("major"))
    measures = staffs.select("score_id", "staff_id", F.explode(F.array(*(F.struct(F.lit(k).alias("measure_id"), F.lit(25.0 * k).alias("x_start"), F.lit(25.0 * k + 25).alias("x_end")) for k in range(2)))).alias("m")).select("score_id", "staff_id", "m.*")
    return staffs, lines, strokes, ellipses, measures


def q_ledger_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    staffs, lines, strokes, ellipses, measures = line_pages(spark, sf_dir)
    return ledger_ladder(ellipses, staffs, measures, ledger_segments(staffs, lines, strokes))


QUERIES = {"q_ledger_ladder": q_ledger_ladder, "q_polyphony": q_polyphony, "q_voices": q_voices, "q_interstaff_rests": q_interstaff_rests}

_EVENTS = """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_tax FROM lineitem),
e AS (
  SELECT l_orderkey // 100 AS score_id, l_orderkey AS measure_no, (l_suppkey % 2 + 1)::INT AS staff, l_returnflag = 'R' AS rest,
         concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_quantity::INT, l_returnflag, l_linestatus, round(l_tax * 100)::INT) AS id,
         l_quantity::DOUBLE AS x, (l_partkey % 60)::DOUBLE AS top, (l_partkey % 60 + CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_suppkey % 3 * 5 END)::DOUBLE AS bottom,
         CASE WHEN l_returnflag <> 'R' AND l_tax < 0.065 THEN l_linestatus END AS stem, l_quantity + l_linenumber % 3 * 4 AS stem_x
  FROM l)"""
SQL = {
    "q_ledger_ladder": """
WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem),
r AS (SELECT l_orderkey AS score_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS id, l_quantity::DOUBLE AS x, l_suppkey % 2 = 0 AS low,
             10 * (l_linenumber % 4 + 1) + l_partkey % 5 - 2 AS dy, 6 + l_partkey % 41 AS len, 10 * (l_linenumber % 3 + 1) + l_partkey % 3 AS ey FROM l),
-- A stroke below staff 1 is out of reach of staff 2 but for the last steps above it, and the other way round.
c AS (SELECT score_id, s AS staff_id, d AS direction, id, x AS a, x + len AS b, CASE WHEN d = 'above' THEN 200 * s - y ELSE y - 200 * s - 40 END / 10.0 AS steps
      FROM (SELECT *, CASE WHEN low THEN 240 + dy ELSE 400 - dy END AS y FROM r), (VALUES (1), (2)) AS st(s), (VALUES ('above'), ('below')) AS dr(d)
      WHERE len BETWEEN 5.5 AND 45 AND x < 60),
g AS (SELECT score_id, staff_id, direction, id, a, b, round_even(steps, 0)::INT AS step FROM c WHERE abs(steps - round_even(steps, 0)) <= 0.28 AND round_even(steps, 0) BETWEEN 1 AND 12),
chain AS (
  SELECT * FROM g WHERE step = 1
  UNION
  SELECT g.* FROM g JOIN chain p ON g.score_id = p.score_id AND g.staff_id = p.staff_id AND g.direction = p.direction AND g.step = p.step + 1
    AND g.b + 0.2 * least(g.b - g.a, p.b - p.a) >= p.a AND p.b + 0.2 * least(g.b - g.a, p.b - p.a) >= g.a),
e AS (SELECT score_id, id AS shape_id, x + 2 AS x, s AS staff_id, (CASE WHEN low THEN 240 + ey ELSE 400 - ey END - 200 * s) / 5.0 AS raw FROM r, (VALUES (1), (2)) AS st(s)),
f AS (SELECT *, round_even(raw, 0)::INT AS staff_step, CASE WHEN raw < 0 THEN 'above' ELSE 'below' END AS direction FROM e WHERE abs(raw - round_even(raw, 0)) <= 0.30),
h AS (SELECT *, (CASE WHEN staff_step < -1 THEN -staff_step // 2 WHEN staff_step > 9 THEN (staff_step - 8) // 2 ELSE 0 END)::INT AS levels, CASE WHEN x <= 25 THEN 0 ELSE 1 END AS measure_id FROM f WHERE x <= 50),
w AS (SELECT h.score_id, h.shape_id, h.staff_id, h.measure_id, h.direction, h.staff_step, h.levels FROM h JOIN chain k ON k.score_id = h.score_id AND k.staff_id = h.staff_id AND k.direction = h.direction
      WHERE h.levels >= 2 AND k.step <= h.levels AND k.b + 6.5 >= h.x AND k.a - 6.5 <= h.x GROUP BY ALL HAVING count(DISTINCT k.step) = h.levels)
SELECT score_id, shape_id, staff_id, measure_id, direction, staff_step, levels FROM w QUALIFY count(*) OVER (PARTITION BY score_id, shape_id) = 1
""",
    "q_polyphony": f"""{_EVENTS}
SELECT DISTINCT a.score_id, a.measure_no, a.staff FROM e a JOIN e b USING (measure_no, staff)
WHERE (a.stem = 'O' AND b.stem = 'F' AND (abs(a.x - b.x) <= 7.2 OR abs(a.stem_x - b.stem_x) <= 7.2))
   OR (a.rest AND b.rest AND a.id < b.id AND abs(a.x - b.x) <= 6.8 AND abs(a.top - b.top) >= 5.2)
   OR (a.rest AND NOT b.rest AND abs(a.x - b.x) <= 5.8 AND abs(a.top - 30) >= 5.2 AND (a.top < b.top - 1.2 OR a.top > b.bottom + 1.2))
""",
}
