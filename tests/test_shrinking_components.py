import random

from scoreloom.operators import components as module


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_rounds_work_on_fewer_edges(spark, monkeypatch):
    sizes, write = {}, module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: (t := write(df, name), sizes.setdefault(name, []).append(t.count()))[0])
    draw = random.Random(3)
    path = [(i, i + 1) for i in range(60)]  # a long one, and loops, repeated edges and some at random
    edges = [*path, *path[:5], (500, 500), (3, 3), *((draw.randrange(100, 400), draw.randrange(100, 400)) for _ in range(150))]
    df = spark.createDataFrame([*edges, (None, 7), (900, None)], "a long, b long")
    assert {r.node: r.component for r in module.components(df).collect()} == brute(edges)
    assert sizes["live"] == sorted(sizes["live"], reverse=True) and sizes["live"][-1] == 0
    assert [r for r in module.components(df.limit(0)).collect()] == []
