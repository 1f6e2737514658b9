"""The generic operators on event and order tables: QUERIES (functions of spark, sf_dir) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fractions, text
from ..operators import grouped, leaders, matching, ranking, sequences, spatial
from ..operators.components import components

QUERIES = {}
SQL: dict[str, str] = {}

_EVENTS = ["user_id"], ["ts", "event_id"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


@query("""
SELECT page_id, tag, count(*) AS n, min(pos) AS first_pos FROM (
  SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos
  FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<([a-z][a-z0-9]*)', 1) AS tags FROM pages)) GROUP BY page_id, tag""")
def q_ordered_children(spark, sf_dir):
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    rows = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event\":{\"id\":' || event_id || ',\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}}' AS doc FROM events")
def q_json_roundtrip(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    doc = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), "k").alias("event")))
    again = F.from_json("doc", "event struct<id:bigint,k:bigint>")["event"]
    return rows.withColumn("doc", doc).select(again["id"].alias("event_id"), again["k"].alias("k"), "doc")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)""")
def q_running_cursor(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return sequences.running_cursor(rows, ["l_orderkey"], order, F.col("l_quantity").cast("long"), "starts_at")


@query("""
SELECT user_id, start_event_id, event_id AS stop_event_id FROM (
  SELECT *, lag(event_type) OVER w AS before, lag(event_id) OVER w AS start_event_id FROM events
  WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE event_type = 'purchase' AND before = 'signup'""")
def q_pair_spans(spark, sf_dir):
    return sequences.pair_spans(_t(spark, sf_dir, "events"), *_EVENTS, _is("signup"), _is("purchase")).select("user_id", "start_event_id", "stop_event_id")


@query("""
WITH r AS (SELECT *, sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
c AS (SELECT *, coalesce(sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
             max(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id, run) AS whole FROM r WHERE run > 0)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM c WHERE closed = 0 AND whole = 1 GROUP BY user_id, run""")
def q_group_runs(spark, sf_dir):
    runs = sequences.group_runs(_t(spark, sf_dir, "events"), *_EVENTS, _is("signup"), _is("purchase"))
    return runs.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events")
def q_carry_forward(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(_is("error"), F.col("value")).alias("last_error"))
    return sequences.carry_forward(rows, *_EVENTS, ["last_error"]).drop("ts")


@query("""
SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def q_asof_state(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    views = events.where(_is("view")).select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    found = sequences.asof_state(events.where(_is("purchase")).select("event_id", "user_id", "ts"), views, ["user_id"], ["ts"], ["view_id", "view_value"])
    return found.drop("ts")


@query("""
WITH v AS (SELECT user_id, event_id AS view_id, ts AS from_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'view')
SELECT v.user_id, v.view_id, count(*) AS n_clicks FROM v JOIN events c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.ts >= v.from_ts AND (v.until IS NULL OR c.ts < v.until)
GROUP BY v.user_id, v.view_id""")
def q_until_next(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    views = sequences.until_next(events.where(_is("view")).select("user_id", "ts", "event_id"), *_EVENTS)
    views = views.select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("from_ts"), "until")
    clicks = events.where(_is("click")).select("user_id", "ts")
    return sequences.interval_join(clicks, views, ["user_id"], "ts", "from_ts", "until").groupBy("user_id", "view_id").agg(F.count("*").alias("n_clicks"))


@query("""
WITH s AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
o AS (SELECT conv_id, coalesce(sum(n) OVER (PARTITION BY conv_id // 100 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
SELECT c.conv_id // 100 AS volume, conv_id, turn, CAST(off + turn AS BIGINT) AS place FROM conversations c JOIN o USING (conv_id)""")
def q_concat_offsets(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn").withColumn("volume", F.floor(F.col("conv_id") / 100))
    sizes = turns.groupBy("volume", "conv_id").agg((F.max("turn") + 1).alias("n"))
    offsets = sequences.concat_offsets(sizes, ["volume"], ["conv_id"], "n").select("conv_id", "offset")
    return turns.join(offsets, "conv_id").select("volume", "conv_id", "turn", (F.col("offset") + F.col("turn")).alias("place"))


@query("""
WITH l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY user_id, island""")
def q_gap_islands(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    cut = F.col("ts") > sequences.previous("ts", *_EVENTS) + F.expr("INTERVAL 12 HOURS")
    return sequences.gap_islands(rows, *_EVENTS, cut).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
WITH b AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
e AS (SELECT *, d + CAST(30 + o_orderkey % 60 AS INT) AS e FROM b),
r AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY d, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR d > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY d, e, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT o_custkey, CAST(island AS BIGINT) AS island, count(*) AS n, CAST(min(d) AS VARCHAR) AS from_day, CAST(max(e) AS VARCHAR) AS to_day FROM i GROUP BY o_custkey, island""")
def q_overlap_islands(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    rows = rows.withColumn("e", F.date_add("d", (30 + F.col("o_orderkey") % 60).cast("int")))
    islands = sequences.overlap_islands(rows, ["o_custkey"], "d", "e", ["o_orderkey"])
    return islands.groupBy("o_custkey", "island").agg(F.count("*").alias("n"), F.min("d").cast("string").alias("from_day"), F.max("e").cast("string").alias("to_day"))


@query("""
WITH k AS (SELECT user_id, event_id, event_type, max(CAST(event_type <> 'view' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kept,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM k WHERE kept = 1 OR rn = 1 GROUP BY user_id""")
def q_trim_trailing(spark, sf_dir):
    kept = sequences.trim_trailing(_t(spark, sf_dir, "events"), *_EVENTS, _is("view"))
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("""
WITH v AS (SELECT p_type, p_retailprice AS v, count(*) AS n FROM part WHERE p_retailprice > 0 GROUP BY ALL),
w AS (SELECT *, lag(v) OVER o AS b, sum(n) OVER (PARTITION BY p_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below, sum(n) OVER (PARTITION BY p_type) AS total FROM v WINDOW o AS (PARTITION BY p_type ORDER BY v)),
f AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY v / b DESC, v) AS r FROM w WHERE v >= b * 1.0 AND below <= total * 0.45)
SELECT p_type, b AS small_max, v AS large_min, CAST(below AS BIGINT) AS n_small, CAST(total AS BIGINT) AS n, round(sqrt(b * v), 6) AS threshold FROM f WHERE r = 1""")
def q_gap_split(spark, sf_dir):
    found = sequences.largest_gap_split(_t(spark, sf_dir, "part"), ["p_type"], "p_retailprice", 1.0, 0.45)
    return found.withColumn("threshold", F.round("threshold", 6))


def _slices(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    return lines.where("l_partkey % 10 <> 3"), lines.where("l_partkey % 10 <> 7")


_SLICES = "a AS (SELECT * FROM lineitem WHERE l_partkey % 10 <> 3), b AS (SELECT * FROM lineitem WHERE l_partkey % 10 <> 7)"
_TOTALS = "SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, min(CASE WHEN l_returnflag = 'A' THEN 'A' END) AS flag FROM"


@query(f"""
WITH {_SLICES}, ea AS ({_TOTALS} a GROUP BY l_orderkey), ac AS ({_TOTALS} b GROUP BY l_orderkey),
p AS (SELECT coalesce(e.l_orderkey, c.l_orderkey) AS l_orderkey, e.n AS en, c.n AS cn, e.qty AS eq, c.qty AS cq, e.flag AS ef, c.flag AS cf, e.l_orderkey IS NULL AS extra, c.l_orderkey IS NULL AS missing
      FROM ea e FULL JOIN ac c ON e.l_orderkey = c.l_orderkey),
i AS (SELECT l_orderkey, 'order.count' AS code, 'Structure' AS category, CAST(en AS VARCHAR) AS expected, CAST(cn AS VARCHAR) AS actual FROM p WHERE en IS DISTINCT FROM cn
  UNION ALL SELECT l_orderkey, 'order.quantity', 'Rhythm', CAST(eq AS VARCHAR), CAST(cq AS VARCHAR) FROM p WHERE eq IS DISTINCT FROM cq
  UNION ALL SELECT l_orderkey, 'order.flag', 'Text', ef, cf FROM p WHERE ef IS NOT NULL AND ef IS DISTINCT FROM cf)
SELECT *, CASE WHEN category = 'Rhythm' THEN 'Critical' WHEN code = 'order.flag' THEN 'Warning' ELSE 'Error' END AS severity FROM i""")
def q_full_outer_diff(spark, sf_dir):
    totals = lambda df: df.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.min(F.when(F.col("l_returnflag") == "A", "A")).alias("flag")
    )
    a, b = _slices(spark, sf_dir)
    pairs = matching.align(totals(a), totals(b), ["l_orderkey"])
    e, c = F.col("expected"), F.col("actual")
    spec = [("order.count", "Structure", e["n"], c["n"], False), ("order.quantity", "Rhythm", e["qty"], c["qty"], False), ("order.flag", "Text", e["flag"], c["flag"], True)]
    severity = F.when(F.col("category") == "Rhythm", "Critical").when(F.col("code") == "order.flag", "Warning").otherwise("Error")
    return matching.compare_fields(pairs, ["l_orderkey"], spec).withColumn("severity", severity)


@query(f"""
WITH {_SLICES}, x AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM b GROUP BY ALL)
SELECT coalesce(x.l_orderkey, y.l_orderkey) AS l_orderkey, coalesce(x.l_returnflag, y.l_returnflag) AS l_returnflag,
  greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) AS missing, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) AS extra
FROM x FULL JOIN y ON x.l_orderkey = y.l_orderkey AND x.l_returnflag = y.l_returnflag WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def q_bag_diff(spark, sf_dir):
    return matching.bag_diff(*_slices(spark, sf_dir), ["l_orderkey", "l_returnflag"])


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT c_custkey, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
s1 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s_suppkey) AS k FROM s), c1 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c_custkey) AS k FROM c),
m1 AS (SELECT s_suppkey, c_custkey FROM s1 JOIN c1 ON s1.n = c1.n AND s1.k = c1.k),
s2 AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s_suppkey) AS k FROM s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM m1)),
c2 AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c_custkey) AS k FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM m1)),
m2 AS (SELECT s_suppkey, c_custkey FROM s2 JOIN c2 ON s2.r = c2.r AND s2.k = c2.k)
SELECT s_suppkey, c_custkey, 1 AS tier FROM m1 UNION ALL SELECT s_suppkey, c_custkey, 2 FROM m2""")
def q_priority_match(spark, sf_dir):
    """Suppliers and customers of one nation, then of one region."""
    customers = _t(spark, sf_dir, "customer")
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    left = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("n1"), F.col("n_regionkey").alias("r1"))
    right = customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_nationkey").alias("n2"), F.col("n_regionkey").alias("r2"))
    return matching.priority_match(left, right, "s_suppkey", "c_custkey", [("n1", "n2"), ("r1", "r2")])


@query()
def q_tiered_match(spark, sf_dir):
    """Two slices of events, matched inside each user and day."""
    k = F.from_json("props", "k bigint")["k"]
    rows = _t(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.hour("ts").cast("double").alias("at"),
        F.array(F.concat(F.lit("d"), (k % 3).cast("string")), F.concat(F.lit("m"), (k % 2).cast("string"))).alias("content"),
    )
    a, b = rows.where("id % 10 <> 3"), rows.where("id % 10 <> 7")
    return matching.tiered_match(a, b, ["user_id", "day"], "kind", "at", "content")


def _points(spark, sf_dir):
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 6)
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"))


_POINTS = "p AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y FROM embeddings)"


@query(f"""
WITH {_POINTS}, b AS (SELECT label AS box, min(x) / 2 AS min_x, max(x) / 2 AS max_x, min(y) / 2 AS min_y, max(y) / 2 AS max_y FROM p GROUP BY label)
SELECT box, count(*) AS n, min(vec_id) AS first_vec FROM p JOIN b ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY box""")
def q_contain(spark, sf_dir):
    points = _points(spark, sf_dir)
    boxes = points.groupBy(F.col("label").alias("box")).agg(*((f(c) / 2).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))
    found = spatial.contain_join(points.drop("label"), boxes, [], "x", "y", 0.05)
    return found.groupBy("box").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_vec"))


@query(f"""
WITH {_POINTS}, a AS (SELECT vec_id AS anchor_id, label, x AS ax, y AS ay FROM p WHERE vec_id % 20 = 0),
d AS (SELECT p.label, vec_id, anchor_id, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) AS distance FROM p JOIN a ON p.label = a.label AND vec_id % 20 <> 0)
SELECT label, vec_id, arg_min(anchor_id, (distance, anchor_id)) AS anchor_id, round(min(distance), 9) AS distance FROM d WHERE distance <= 0.05 GROUP BY label, vec_id""")
def q_nearest(spark, sf_dir):
    points = _points(spark, sf_dir)
    anchors = points.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("anchor_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    found = spatial.nearest_within(points.where("vec_id % 20 <> 0"), anchors, ["label"], "vec_id", "anchor_id", 0.05)
    return found.withColumn("distance", F.round("distance", 9))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def q_division(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    return spatial.divide(lines, ["l_orderkey"], "l_returnflag", lines.select("l_returnflag").distinct())


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rank
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem)) WHERE rank <= 3""")
def q_topk(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").distinct()
    return ranking.top_k(rows, ["l_orderkey"], [F.desc("l_extendedprice"), "l_partkey", "l_suppkey"], 3)


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q_best(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return ranking.best_by(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""
WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS r FROM c)
SELECT l_orderkey, l_returnflag, n, CAST(total AS BIGINT) AS total FROM r WHERE r = 1 AND n >= total * 0.6""")
def q_majority(spark, sf_dir):
    return ranking.majority(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", 0.6)


_ISSUES = "i AS (SELECT event_id AS seq, user_id, event_type AS category, CASE WHEN event_type = 'error' THEN 'cause-' || (user_id % 7) ELSE 'hour-' || extract(hour FROM ts) END AS cause, 'event ' || event_id AS message, CASE WHEN value > 20 THEN 'Critical' WHEN value > 5 THEN 'Error' ELSE 'Warning' END AS severity FROM events)"


def _issues(spark, sf_dir):
    severity = F.when(F.col("value") > 20, "Critical").when(F.col("value") > 5, "Error").otherwise("Warning")
    return _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("category"), F.concat(F.lit("hour-"), F.hour("ts").cast("string")).alias("hour"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), severity.alias("severity"),
    )


@query(f"WITH {_ISSUES} SELECT category, cause, count(*) AS n, min(seq) AS first_seq, arg_min(message, seq) AS summary FROM i GROUP BY category, cause")
def q_root_causes(spark, sf_dir):
    key = F.when(F.col("category") == "error", F.concat(F.lit("cause-"), (F.col("user_id") % 7).cast("string"))).otherwise(F.col("hour"))
    return ranking.root_causes(_issues(spark, sf_dir), key)


@query(f"""
WITH {_ISSUES} SELECT 'category' AS dimension, category AS value, count(*) AS details, count(DISTINCT user_id) AS cases FROM i GROUP BY category
UNION ALL SELECT 'severity', severity, count(*), count(DISTINCT user_id) FROM i GROUP BY severity""")
def q_breakdown(spark, sf_dir):
    return ranking.breakdown(_issues(spark, sf_dir), ["category", "severity"], "user_id")


@query("""
WITH s AS (SELECT l_orderkey, CAST(sum(420 // l_linenumber) AS BIGINT) AS ticks FROM lineitem GROUP BY l_orderkey),
g AS (SELECT *, gcd(ticks, 420) AS g FROM s)
SELECT l_orderkey, ticks, CAST(ticks // g AS BIGINT) AS num, CAST(420 // g AS BIGINT) AS den, CASE WHEN 420 // g = 1 THEN CAST(ticks // g AS VARCHAR) ELSE (ticks // g) || '/' || (420 // g) END AS total FROM g""")
def q_fraction_sum(spark, sf_dir):
    """1 / l_linenumber per order, exactly: ticks of the least common multiple of all denominators."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("den"))
    base = lines.agg(fractions.lcm_of(F.collect_set("den")).alias("base")).first()["base"] or 1  # of at most a few denominators
    ticks = lines.groupBy("l_orderkey").agg(F.sum((F.lit(base) / F.col("den")).cast("long")).alias("ticks"))
    total = ticks.withColumn("f", fractions.frac(F.col("ticks"), F.lit(base).cast("long")))
    return total.select("l_orderkey", "ticks", "f.num", "f.den", fractions.frac_str(F.col("f")).alias("total"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, list_distinct(list(l_partkey % 12)) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
n AS (SELECT *, lead(o_orderkey) OVER w AS next_order, lead(parts) OVER w AS next_parts FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, next_order, round(len(list_intersect(parts, next_parts)) / len(list_distinct(list_concat(parts, next_parts))), 9) AS similarity FROM n WHERE next_order IS NOT NULL""")
def q_jaccard(spark, sf_dir):
    """How alike each customer's neighbouring orders are, as sets of part classes."""
    orders, lines = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 12).alias("c"))
    sets = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.collect_set("c").alias("parts"))
    after = sequences._window(["o_custkey"], ["o_orderkey"])
    pairs = sets.withColumns({"next_order": F.lead("o_orderkey").over(after), "next_parts": F.lead("parts").over(after)}).where("next_order IS NOT NULL")
    return pairs.select("o_custkey", "o_orderkey", "next_order", F.round(matching.set_similarity(F.col("parts"), F.col("next_parts")), 9).alias("similarity"))


@query(r"SELECT doc_id, length(n) AS n, md5(n) AS digest FROM (SELECT doc_id, nullif(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))), '') AS n FROM documents)")
def q_text_norm(spark, sf_dir):
    plain = _t(spark, sf_dir, "documents").select("doc_id", text.norm_text(F.col("text")).alias("t"))
    return plain.select("doc_id", F.char_length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(r"""
SELECT page_id, CAST(nullif(regexp_extract(url, '=\s*(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS bpm FROM pages WHERE regexp_matches(url, '=\s*\d')""")
def q_metronome(spark, sf_dir):
    found = _t(spark, sf_dir, "pages").select("page_id", text.metronome_bpm(F.col("url")).cast("double").alias("bpm"))
    return found.where("bpm IS NOT NULL")


@query()
def q_leader(spark, sf_dir):
    """Leader clusters of the embeddings of each label, as one scan of each label would find them."""
    found = leaders.vector_leaders(_t(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 1.2)
    return found.withColumn("distance", F.round("distance", 6))


def _candidates(spark, sf_dir):
    """Suppliers and parts that lines bring together, cheaper by quantity."""
    lines = _t(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity").cast("long").alias("cost"))


@query()
def q_assign(spark, sf_dir):
    """Greedy one-to-one assignment of suppliers and parts in order of cost."""
    return matching.greedy_assignment(_candidates(spark, sf_dir), "l_suppkey", "l_partkey", ["cost"])


@query()
def q_max_assign(spark, sf_dir):
    """The largest one-to-one assignment of each order's parts and suppliers."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return matching.max_assignment(lines, ["l_orderkey"], "l_partkey", "l_suppkey", "l_quantity")


@query()
def q_lanes(spark, sf_dir):
    """Lines of each order dealt to lanes that hold a quantity of 100."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("qty")).distinct()
    return grouped.capacity_lanes(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "qty", 100)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, -1 - l_partkey AS b FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(node, component) USING KEY (node) AS (
  SELECT a, min(least(a, b)) FROM u GROUP BY a
  UNION
  SELECT u.b, min(c.component) FROM c JOIN u ON u.a = c.node JOIN recurring.c AS r ON r.node = u.b WHERE c.component < r.component GROUP BY u.b)
SELECT node, component FROM c""")
def q_components(spark, sf_dir):
    """Orders and parts linked by all lines."""
    lines = _t(spark, sf_dir, "lineitem")
    return components(lines.select(F.col("l_orderkey").alias("a"), (-1 - F.col("l_partkey")).alias("b")))


@query("""
WITH s AS (SELECT vec_id, list_sum(list_transform(embedding[1:8], lambda x: CAST(round(CAST(x AS DOUBLE), 4) AS DECIMAL(12,4)))) AS s FROM embeddings)
SELECT vec_id, CASE WHEN s > 0 THEN 'up' ELSE 'down' END AS label, CAST(abs(s) AS DOUBLE) AS confidence FROM s""")
def q_score_prototypes(spark, sf_dir):
    """A linear scorer on distinct vectors, joined back to all rows."""

    def score(vectors):
        sums = [sum(round(round(float(x), 4) * 10_000) for x in v[:8]) / 10_000 for v in vectors]
        return ["up" if s > 0 else "down" for s in sums], [abs(s) for s in sums]

    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("prototype", F.xxhash64("embedding"))
    return grouped.score_prototypes(rows, "prototype", "embedding", score).select("vec_id", "label", "confidence")


@query("""
SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(12,2)) END) AS DOUBLE) AS click, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,2)) END) AS DOUBLE) AS purchase,
  CAST(sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(12,2)) END) AS DOUBLE) AS "view" FROM events GROUP BY user_id""")
def q_pivot_scales(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").cast("decimal(12,2)").alias("v"))
    wide = rows.groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.sum("v"))
    return wide.select("user_id", *(F.col(c).cast("double") for c in ("click", "purchase", "view")))
