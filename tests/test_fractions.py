"""Fractions and common denominators are exact over the whole range of longs, batches included."""

from math import gcd, lcm

from pyspark.sql import functions as F

from scoreloom.functions import fractions


def test_long_numbers_stay_exact(spark):
    # Beyond 2**53, where a quotient of doubles is off by one.
    pairs = [(2**53 + 1, 3), (3 * (2**61 - 1) // 3, 9), (-(2**53 + 1), 6), (7, -21), (0, -5), (5, 0), (None, 4), (4, None), (0, 0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, n long, d long")
    found = df.select(fractions.frac(F.col("n"), F.col("d")).alias("f"), fractions.gcd(F.col("n"), F.col("d")).alias("g"), "i").orderBy("i").collect()
    for (n, d), row in zip(pairs, found, strict=True):
        g = max(gcd(n or 0, d or 0), 1)
        sign = -1 if d and d < 0 else 1
        assert row.g == g
        assert (tuple(row.f) if row.f else None) == ((sign * n // g, sign * d // g) if n is not None and d else None)


def test_common_multiples_of_whole_arrays(spark):
    lists = [[4, 6, 10], [], None, [7], [2**62, 3], [2**40 + 1, 2**40 + 1], [3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59], [None, 4]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, x array<long>")
    found = [r.l for r in df.select("i", fractions.lcm_of(F.col("x")).alias("l")).orderBy("i").collect()]
    assert found == [None if x is None or None in x or lcm(*x) >= 2**63 else lcm(*x) for x in lists]


def test_no_fold_over_a_sequence_in_a_row(spark):
    """A reduced fraction takes no interpreted loop of its own in each row."""
    plan = spark.range(3).select(fractions.frac(F.col("id"), F.lit(420).cast("long")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan
