"""A corpus in five stages: toxic documents go, repeated lines go, one of each group of near copies stays, contaminated
documents go, and the rest is mixed to target weights. Part of scoreloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from scoreloom.llm.common import copy_key, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, by a model of the documents' labels that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.remove_toxic(docs.select(*COLUMNS), model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that are similar to earlier ones; documents of which no words are left go. Documents
    without words from the start stay. A repeated doc_id is one document whose rows lose the same line numbers."""
    return line_dedup.remove_lines(docs.select(*COLUMNS), keep_emptied=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard coefficient of 0.8 on five-word shingles the one with the smallest doc_id; each
    row is judged by its own text, and a row of null doc_id goes if it is linked with one that has an id."""
    return jaccard_join.keep_one_of_each(docs.select(*COLUMNS), width=5, per_cent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth of the words. Each row is judged by its own text,
    also with a null doc_id."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, with block, phase, slot and place."""
    order = materialize(mixing.mix(docs), "mixture").select("doc_id", "source", "block", "phase", "slot", "place", "copy")
    copies = docs.select(*COLUMNS).withColumn("copy", copy_key())
    same = copies["doc_id"].eqNullSafe(order["doc_id"]) & (F.coalesce(copies["source"], F.lit("")) == order["source"]) & (copies["copy"] == order["copy"])
    mixed = copies.join(order.dropDuplicates(["doc_id", "source", "copy"]), same).select(*(copies[c] for c in COLUMNS), "block", "phase", "slot", "place")
    return mixed.orderBy("slot", "place", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Training and suffix automata are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
