import math
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import leaders
from scoreloom.plans import table_queries


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=False):
        total += 0.0 if x is None or y is None else (x - y) * (x - y)
    return math.sqrt(total)


def scan(rows, threshold):
    found, lead = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        near = [(d, j) for j, u in lead.setdefault(g, []) if (d := distance(u, v)) <= threshold]
        if near:
            found[g, i] = min(near)[::-1]
        else:
            lead[g].append((i, v))
            found[g, i] = (i, 0.0)
    return found


@pytest.mark.parametrize("run", [40, 10_000])
def test_vectors_are_led_as_one_scan_leads_them(spark, monkeypatch, run):
    """Blocks of few rows, equal vectors, distances of just the threshold, missing numbers, NaN, shorter arrays and a null group."""
    monkeypatch.setattr(leaders, "LEADERS", 7)
    monkeypatch.setattr(leaders, "ROWS", 16)
    rng = random.Random(2)
    rows = [(rng.choice([0, 1, None]), i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(400)]
    rows += [(1, 500 + i, [0.5] * 5) for i in range(5)] + [(2, 600 + i, [float(i // 2), 0.0]) for i in range(8)] + [(2, 700, []), (2, 701, [9.0, None, 1.0])]
    df = spark.createDataFrame([*rows, rows[7], (0, None, [0.0] * 5), (0, 999, None)], "g int, i long, v array<double>").withColumn("leader", F.lit("clash"))
    found = {(r.g, r.i): (r.leader, r.distance) for r in leaders.vector_leaders(df, ["g"], "i", "v", 1.0, run).collect()}
    assert found == scan(rows, 1.0)
    assert leaders.vector_leaders(df.limit(0), ["g"], "i", "v", 1.0).count() == 0


def test_a_null_label_is_a_group_and_nan_is_near_nothing(spark, tmp_path):
    rows = [(0, [1.0, 0.0], None), (1, [1.0, 0.5], None), (2, [float("nan"), 0.0], 3), (3, [float("nan"), 0.0], 3), (4, [1e200, 1e200], 3), (5, [1e200, 1e200], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").where("vec_id < 4").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r.vec_id: (r.leader, r.distance) for r in table_queries.QUERIES["q_leader"](spark, str(tmp_path)).collect()}
    assert found == {0: (0, 0.0), 1: (0, 0.5), 2: (2, 0.0), 3: (3, 0.0)}
    large = spark.createDataFrame(rows, "i long, v array<double>, g int").where("i >= 4")
    assert {r.i: (r.leader, r.distance) for r in leaders.vector_leaders(large, ["g"], "i", "v", 1.0).collect()} == {4: (4, 0.0), 5: (4, 0.0)}
