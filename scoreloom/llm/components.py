"""Connected components by hooking and pointer jumping, as joins of tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .screening import spanning

#: So many edges of a partition are contracted together.
HELD = 1 << 18


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs, or of pairs of longs, that connect the same nodes as the given ones: in each part of a
    partition, every node but the smallest of what is connected there has one edge, to that smallest one."""
    pairs = dict(edges.dtypes)["a"].startswith("struct")
    ends = ["a.node", "a.check", "b.node", "b.check"] if pairs else ["a", "b"]
    flat = edges.select(*(F.col(c).alias(c.replace(".", "_")) for c in ends))

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(len(ends))]
        if pairs:
            kind = np.dtype([("node", np.int64), ("check", np.int64)])
            u, v = (np.rec.fromarrays(columns[i : i + 2], dtype=kind) for i in (0, 2))
        else:
            u, v = columns
        ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = spanning(at[: len(u)], at[len(u) :])
        found = [ids[x][name] for x in (a, b) for name in ("node", "check")] if pairs else [ids[a], ids[b]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], held[0].schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= HELD:
                held = [settle(held)]
                size = len(held[0])
                if size >= HELD // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield settle(held)

    found = flat.mapInArrow(run, flat.schema)
    if not pairs:
        return found
    return found.select(*(F.struct(F.col(f"{x}_node").alias("node"), F.col(f"{x}_check").alias("check")).alias(x) for x in "ab"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node it is connected with.

    Edges are contracted inside their partitions first. Each round then hooks every node to its smallest neighbour,
    follows the hooks, and replaces the edges' ends by what they hook to; edges inside one root vanish, so the graph
    shrinks from round to round. Hubs need no care: the smallest neighbour is a partial aggregate, and labels are
    joined, not gathered. Repeated edges are allowed; an edge from a node to itself adds nothing, a null end drops the
    edge.
    """
    edges = materialize(_contracted(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    labels = None
    while True:
        live = materialize(_contracted(edges.distinct()), "live")
        if live.isEmpty():
            if labels is None:
                return materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), "labels")
            return labels
        both = live.union(live.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        hooks = materialize(hooks.select("node", F.least("node", "to").alias("to")), "hooks")
        jump = hooks.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        hooks = materialize(hooks.join(jump, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("root"))
        else:
            further = hooks.select(F.col("node").alias("root"), F.col("to").alias("root_to"))
            labels = materialize(labels.join(further, "root", "left").select("node", F.coalesce("root_to", "root").alias("root")), "labels")
        to = lambda name: hooks.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))  # noqa: B023, E731
        moved = live.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        edges = materialize(moved.where("a <> b"), "edges")
