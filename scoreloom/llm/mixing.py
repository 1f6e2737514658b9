"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a hash order, fill blocks of equal size. With w its weight as a share of all sources left, its
i-th block is released at floor(i / w) and due at ceil((i + 1) / w), and each slot goes to the released block with the
earliest deadline. So after t slots of a phase a source has had floor(w t) or ceil(w t) blocks, however long the phase
is and however small w. A phase lasts until a source runs out; the rest go on from there with their shares. The
schedule is one pass over the blocks (not the documents) in the driver, in whole numbers without rounding; blocks grow
with the corpus beyond a stated number of them, so this pass is bounded. Every document comes out once.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import reduce
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import copy_key, materialize, table

#: A source without a usable weight has this share of the others' sum.
FRAME = 240
#: Rows of the schedule that the driver holds at once, and rows that it makes at most, beside one a source.
PIECE, MOST_BLOCKS = 500_000, 1 << 22


def schedule(sources: Iterable[tuple[str, int, float]]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, phase, slot) of every block, in order of the slots from 0.

    sources: name, number of blocks, weight over 0. Of equal deadlines the first name goes first.
    """
    left = sorted((name, n, Fraction(weight)) for name, n, weight in sources if n > 0)
    whole = lcm(*(w.denominator for *_, w in left))
    names, ends, parts = [x[0] for x in left], [x[1] for x in left], [int(x[2] * whole) for x in left]
    done, alive = [0] * len(left), list(range(len(left)))
    phase = slot = 0
    while alive:
        total = sum(parts[i] for i in alive)
        # Windows count from the phase's first slot: (deadline, source) of released blocks, (release, deadline, source) of others.
        ready, later = [(-(-total // parts[i]), i) for i in alive], []
        heapq.heapify(ready)
        first, before = slot, [*done]
        while True:
            while later and later[0][0] <= slot - first:
                _, due, i = heapq.heappop(later)
                heapq.heappush(ready, (due, i))
            _, i = heapq.heappop(ready)
            yield names[i], done[i], phase, slot
            done[i] += 1
            slot += 1
            if done[i] == ends[i]:
                break
            n = done[i] - before[i]
            heapq.heappush(later, (n * total // parts[i], -(-(n + 1) * total // parts[i]), i))
        alive.remove(i)
        phase += 1


def _written(spark: SparkSession, rows: Iterable[tuple[str, int, int, int]], piece: int) -> DataFrame:
    """The schedule as a table, written piece by piece."""
    names, kinds = ["source", "block", "phase", "slot"], [pa.string(), pa.int64(), pa.int32(), pa.int64()]
    tables = []
    for part in itertools.batched(rows, piece):
        columns = [pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)]
        tables.append(materialize(spark.createDataFrame(pa.table(columns, names)), "slots"))
    return reduce(DataFrame.unionAll, tables)


def mix(
    docs: DataFrame, weights: DataFrame | None = None, block_chars: int = 100_000, frame: int = FRAME, bucket_rows: int = 500, most_blocks: int = MOST_BLOCKS
) -> DataFrame:
    """doc_id, source, block, phase, slot, place, copy (a hash of the text) of every row of docs; (slot, place) is the
    order of the mixture.

    weights: source, weight; sources without a positive, finite weight weigh a frame-th part of the others' sum each.
    None weighs each by the square root of its characters. A null source is ''. A document belongs to the block in which it begins, so one longer than a block
    takes the slots of several. Lengths count a null text as empty and one character more than the text, so that
    empty documents advance too. Order inside a source: a hash of doc_id, then doc_id, then text, so repeated rows sit
    side by side. Repeated rows of equal doc_id, source and text have a place each.
    block_chars: size of a block; where a corpus would have more than most_blocks of them, blocks are longer, so that
    the schedule stays a bounded number of rows. bucket_rows: about how many rows one task ranks at once.
    """
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("doc_id").alias("h"), copy_key().alias("copy"),
        (F.char_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
    )
    rows = materialize(rows, "sizes")
    total = rows.count()
    if not total:
        return rows.select("doc_id", "source", F.lit(0).cast("long").alias("block"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("place"), "copy")
    bits = max(1, min(40, (total // bucket_rows).bit_length()))
    # The leading bits of the hash deal a source into ranges that are ranked side by side.
    rows = rows.withColumn("range", F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("chars"), F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(ranges.select("source", "range", "chars", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")), "ranges")
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id", "copy")
    local = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = ranges.agg(F.sum("chars")).first()[0]
    block_chars = max(block_chars, -(-int(whole) // most_blocks))
    ranked = rows.withColumn("local", local).withColumn("nth", F.row_number().over(inside)).join(ranges.drop("chars"), ["source", "range"])
    ranked = ranked.select(
        "doc_id", "source", "copy", F.floor((F.col("chars_before") + F.col("local")) / block_chars).alias("block"), (F.col("rows_before") + F.col("nth")).alias("place")
    )

    sizes = ranges.groupBy("source").agg(F.ceil(F.sum("chars") / block_chars).alias("n_blocks"), F.sum("chars").alias("chars"))
    if weights is None:
        weights = sizes.select("source", F.pow(F.col("chars").cast("double"), F.lit(0.5)).alias("weight"))
    weights = weights.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("weight").alias("weight"))
    usable = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    share = sizes.join(weights, "source", "left").select("source", "n_blocks", F.when(usable, F.col("weight").cast("double")).alias("weight")).collect()
    least = sum(Fraction(r.weight) for r in share if r.weight) / frame or 1
    slots = _written(docs.sparkSession, schedule((r.source, r.n_blocks, r.weight or least) for r in share), PIECE)
    return ranked.join(slots, ["source", "block"]).select("doc_id", "source", "block", "phase", "slot", "place", "copy")


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("copy")
