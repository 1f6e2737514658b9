from pyspark.sql import functions as F

from scoreloom.operators import spatial


def test_division_holds_one_number_a_key(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, None), (3, "b"), (3, "a"), (3, "z"), (None, "a"), (None, "b")], "k int, item string")
    found = spatial.divide(rows, ["k"], "item", rows.where("item < 'z' OR item IS NULL").select("item"))
    assert {r.k for r in found.collect()} == {1, 3, None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "count(distinct" not in plan  # no row for each key and item in a task
    assert spatial.divide(rows, ["k"], "item", rows.where("k > 9").select("item")).count() == 0


def test_division_by_more_items_than_bits(spark):
    for n in (spatial.BITS, spatial.BITS + 1, 200):
        rows = spark.range(n).select(F.col("id").alias("item"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).where(f"NOT (k = 2 AND item = {n - 1})")
        assert [r.k for r in spatial.divide(rows, ["k"], "item", rows.select("item")).collect()] == [1]
