"""Tables in the shared folder, and connected components on them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master makes one of its own; a
    cluster must name one, as its machines do not share temporary folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scoreloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/scoreloom-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node it is connected with.

    A round hooks every node to its smallest neighbour, follows the hooks once more, and gives the edges' ends the names of
    what they hook to. Edges inside one root and repeated ones vanish, so the graph shrinks from round to round, and rounds
    grow with the logarithm of the diameter. The smallest neighbour is a partial aggregate and labels are joined; a hub's
    edges are never gathered.
    """
    given = materialize(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    live, labels = given.where("a <> b"), None
    while True:
        ends = live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        hooks = materialize(ends.groupBy(F.col("e.a").alias("node")).agg(F.least(F.col("e.a"), F.min("e.b")).alias("to")), "hooks")
        if hooks.isEmpty():
            break
        jump = hooks.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        hooks = materialize(hooks.join(jump, "to").select("node", F.col("beyond").alias("to")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("component"))
        else:
            further = hooks.select(F.col("node").alias("component"), F.col("to").alias("further"))
            labels = materialize(labels.join(further, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "labels")
        to = lambda name: hooks.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))  # noqa: B023, E731
        moved = live.join(to("a"), "a").join(to("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        live = materialize(moved.where("a <> b").distinct(), "live")
    alone = given.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    return alone if labels is None else labels.unionByName(alone.join(labels.select("node"), "node", "left_anti"))
