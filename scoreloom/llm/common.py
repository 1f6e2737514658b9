"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_dir

#: The six characters `[\x20\x09-\x0D]`.
WHITE_SPACE = " \t\n\x0b\f\r"
#: Bytes of an Arrow batch on its way to Python. Spark by itself counts rows only: 10,000 texts of any length.
BATCH_BYTES = 4 << 20


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scoreloom-{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES at most, or one row; a bound that is set already stays.
    The JVM and each worker hold some batches at once, and keep what they took for the largest."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def copy_key(text: Column | str = "text") -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def broadcast_if_small(df: DataFrame, size: Column, limit: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if the sizes of its rows, in bytes, sum to limit at most; else df, for a shuffled join.
    df is read once more, so it should be a written table."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if total <= limit else df


def delete_white_space(text: Column) -> Column:
    return F.translate(text, WHITE_SPACE, "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
