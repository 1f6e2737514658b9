"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Each input task is a memtable: it turns its documents into (key, doc_id, length, sha256) entries, sorts them by key and
flushes them as one run (level 0, Parquet files with a Bloom filter on the key). Compaction merges `fan` runs of a level
into one of the next until one run is left; of each key it keeps how many documents have it and the identifier that
stays. The keys of several documents in the last run make a filter of stated size. What it does not admit is the only
document with its key; what it admits is a hit, and hits are verified: their texts, and no others, are read again, and the
distinct ones below each key are counted, byte by byte as a hash aggregation compares its keys. Keys with two texts are
keyed anew by SHA-256 as well and merged once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete_white_space, materialize, table

#: Runs of a level that are merged into one of the next.
FAN = 16
_RUN = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": "100000"}


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    key: Callable[[Column], Column] = F.xxhash64,
    filter_words: int = 1 << 18,
    fan: int = FAN,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; of equal ones the longest original stays, then the smallest
    doc_id. A null text counts as empty, and empty texts are equal. Rows that repeat a doc_id with equal text share
    one verdict and each counts in group_size. A null doc_id stays only if no equal text has an id. Other columns are
    not read. filter_words bounds the broadcast filter, of 64 bits a word; a fuller filter only admits more texts to
    verification. fan: how many runs a compaction merges.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = delete_white_space(text)
    runs = flush(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).alias("length"), key(plain).alias("key"), F.unhex(F.sha2(plain, 256)).alias("sha")))
    index = compact(runs, ["key"], fan).where("n > 1")
    admitted = hit_filter(index, filter_words)
    texts = probe(docs.select(key(plain).alias("key"), plain.alias("plain")), admitted, filter_words).where("hit").select("key", "plain").distinct()
    collided = materialize(texts.groupBy("key").count().where("count > 1").select("key"), "collided")
    keys = ["key"]
    if not collided.isEmpty():
        variant = F.when(F.col("collides"), F.col("sha")).otherwise(F.lit(b""))
        runs = materialize(runs.join(collided.withColumn("collides", F.lit(True)), "key", "left").withColumn("variant", variant).drop("collides"), "rekeyed")
        keys = ["key", "variant"]
        index = compact(runs, keys, fan).where("n > 1")
    return _verdicts(probe(runs, admitted, filter_words), index, keys)


def flush(entries: DataFrame) -> DataFrame:
    """Level 0: each task's entries as a run, sorted by key. run numbers the tasks."""
    return materialize(entries.withColumn("run", F.spark_partition_id()).sortWithinPartitions("key"), "level0", **_RUN)


def compact(runs: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """The last run: keys, n (how many entries have them) and keep, the identifier that stays: of entries with one, the
    longest, then the smallest. Entries of a key in one task are combined before they move."""
    best = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "length", F.bitwise_not("doc_id").alias("last"))
    level, depth = runs.select("run", *keys, F.lit(1).cast("long").alias("n"), best.alias("best")), 0
    most = runs.agg(F.max("run")).first()[0] or 0
    while True:
        most //= fan
        depth += 1
        merged = level.groupBy(F.floor(F.col("run") / fan).cast("int").alias("run"), *keys).agg(F.sum("n").alias("n"), F.max("best").alias("best"))
        level = materialize(merged.sortWithinPartitions("run", *keys), f"level{depth}", **_RUN)
        if not most:
            return level.select(*keys, "n", F.bitwise_not("best.last").alias("keep"))


def _place(words: int) -> tuple[Column, Column]:
    """Word and bit of a key in a filter."""
    bit = F.pmod(F.xxhash64("key"), F.lit(64 * words))
    return F.floor(bit / 64).cast("int"), (bit % 64).cast("int")


def hit_filter(index: DataFrame, words: int) -> DataFrame:
    """(word, bits): a bit for each key of index; `words` rows at most."""
    word, bit = _place(words)
    return materialize(index.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")


def probe(rows: DataFrame, admitted: DataFrame, words: int) -> DataFrame:
    """rows with hit: whether the filter may hold their key."""
    word, bit = _place(words)
    found = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(admitted), "word", "left")
    return found.withColumn("hit", F.coalesce(F.getbit("bits", F.col("bit")) == 1, F.lit(False))).drop("word", "bit", "bits")


def _verdicts(runs: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that are no hits are alone; only the others meet the index."""
    row = lambda n, keep: [
        "doc_id", keep.alias("keep_id"), n.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    ]
    alone = runs.where("NOT hit").select(*row(F.lit(1), F.col("doc_id")))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return alone.unionByName(runs.where("hit").join(index, keys, "left").select(*row(F.coalesce("n", F.lit(1)), keep)))


def query(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS len, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS plain FROM d),
g AS (
  SELECT doc_id, plain, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY len DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""
