"""Queries over all lines and all customers, on fixtures that a filter would thin out."""

import random

from scoreloom.plans import table_queries


def brute_components(edges):
    """The smallest node connected with each, by merging sets."""
    group = {}
    for a, b in edges:
        merged = group.get(a, {a}) | group.get(b, {b})
        group |= dict.fromkeys(merged, merged)
    return {node: min(nodes) for node, nodes in group.items()}


def test_components_of_all_lines(spark, tmp_path):
    rng = random.Random(3)
    lines = [(rng.randrange(1, 120), rng.randrange(1, 150), float(rng.randrange(1, 51))) for _ in range(110)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.node: r.component for r in table_queries.QUERIES["q_components"](spark, str(tmp_path)).collect()}
    assert found == brute_components([(o, -1 - p) for o, p, _ in lines])
    assert {o for o, _, _ in lines} <= set(found) and 1 < len(set(found.values())) < len({o for o, _, _ in lines})


def test_every_customer_can_be_matched(spark, tmp_path):
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(1, 1), (2, 1), (3, 2)], "n_nationkey long, n_regionkey long", "nation")
    write([(10, 1), (11, 1), (12, 3)], "s_suppkey long, s_nationkey long", "supplier")
    write([(1, 1), (2, 2), (4, 3), (5, 3)], "c_custkey long, c_nationkey long", "customer")
    found = {tuple(r) for r in table_queries.QUERIES["q_priority_match"](spark, str(tmp_path)).select("s_suppkey", "c_custkey", "tier").collect()}
    assert found == {(10, 1, 1), (12, 4, 1), (11, 2, 2)}
