"""Line deduplication by an exact set-similarity join.

1. A line is the set of its words. Lines with the same set become one node, kept where it first occurs.
2. A table of hashed word counts over all lines gives every word a rarity; each node's words are ordered by rarity, and
   of similar sets the prefixes (the rarest words) share one at least. Nodes meet by the words of their prefixes.
3. Where nodes meet, the length filter, the positional filter and a bound from hashed signatures of the words, longer
   for longer lines, drop most pairs; the rest are connected to candidate groups. A word of many rows is dealt into
   blocks that are compared two by two.
4. Groups form tiles of bounded size, in which the Jaccard coefficient of the lines is computed exactly. A line goes if
   an earlier line, by doc_id and line number, is similar. Only the lines in groups are fetched from the texts again,
   by a filter of stated size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, materialize, table
from .components import components
from .hashing import digests, folded_words, pieces, texts_in_chunks, word_hashes
from .jaccard_join import tiles
from .membership import Membership, membership, numbers
from .screening import close_pairs, packed, runs, signatures, spanning, spread_out, unpacked, values, whole_groups

PER_CENT = 80
SKETCH, _PIECES = 1 << 20, 64
#: Rows of a word that are compared in one task.
BLOCK = 1 << 17
_LINES = 1 << 22
#: Lines of tiles that are compared together.
_TOGETHER = 1 << 11
_SEEN = 1 << 19
#: Rows of prefix words that a task packs together and that are unpacked together; the fewest ranges of words, and words of a range.
_HELD, _UNPACKED, RANGES, RANGE_WORDS = 1 << 17, 1 << 15, 1 << 10, 1 << 20
_RUNS = "range int, dealt boolean, key binary, node binary, place binary, signature binary"


def _line_words(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its line, first line of each text), lines counted over all the texts."""
    buffer = b"\n".join(held)
    hashes, starts = word_hashes(buffer)
    breaks = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 10)
    lines = np.searchsorted(breaks, starts)
    first = np.cumsum([0] + [b.count(b"\n") + 1 for b in held])
    return hashes, lines, first


def scan_lines(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """In one pass over docs (doc_id, text): a row for each line with words (doc_id, line_no, node, check, n), one for
    each row of docs (doc_id, n: how many lines), and how many words of all texts fall into each of SKETCH buckets."""
    scanned = materialize(docs.mapInArrow(_scan_lines, "doc_id long, line_no int, node long, check long, n int, piece int, counts binary"), "lines")

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH // _PIECES, np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "counts"])

    rows = scanned.where("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    found = np.zeros((_PIECES, SKETCH // _PIECES), np.int64)
    for r in rows:
        found[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    return scanned.where("piece IS NULL").drop("piece", "counts"), found.ravel()


def rarity(counts: np.ndarray) -> np.ndarray:
    """0 for words that occur once at most, else a level that rises with the logarithm of the count."""
    return np.minimum(np.round(8 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def line_sets(held: list[bytes], levels: np.ndarray | None = None):
    """Distinct words of each line that has words, rarest first: (word hashes, level of each, first word of each line,
    number of each line, first line of each text, all words as they come)."""
    hashes, lines, texts = _line_words(held)
    level = levels[(hashes % np.uint64(SKETCH)).astype(np.int64)] if levels is not None else np.zeros(len(hashes), np.uint8)
    # One sort by line, level and leading bits of the hash; if these bits are equal for other words, or there are more
    # lines than 22 bits tell apart, an exact one.
    place = (lines.astype(np.uint64) << np.uint64(42)) | (level.astype(np.uint64) << np.uint64(34)) | (hashes >> np.uint64(30))
    order = np.argsort(place)
    place, h = place[order], hashes[order]
    if texts[-1] > _LINES or ((same := place[1:] == place[:-1]).any() and (h[1:][same] != h[:-1][same]).any()):
        order = np.lexsort((hashes, level, lines))
        h = hashes[order]
    lines, level = lines[order], level[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (lines[1:] != lines[:-1])
    h, lines, level = h[new], lines[new], level[new]
    first = np.flatnonzero(np.diff(lines, prepend=-1))
    return h, level, first, lines[first], texts, hashes


def signature_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words in the signature of a line of so many words: bits for each at least, but for the longest lines."""
    return np.where(sizes <= 64, 2, np.where(sizes <= 128, 4, np.where(sizes <= 256, 8, 16)))


def _scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: the rows of scan_lines, and at the end _PIECES rows with the counts of this task's words."""
    words = np.zeros(SKETCH, np.int64)
    buckets: list[np.ndarray] = []  # of words that are not counted yet
    names = ["doc_id", "line_no", "node", "check", "n", "piece", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in pieces(batches):
        ids = batch.column(0)
        for at, held in texts_in_chunks(batch.column(1).to_pylist()):
            h, _, first, lines, texts, all_words = line_sets(held)
            counted = [ids.slice(at, len(held)), *(pa.nulls(len(held), k) for k in kinds[1:4]), pa.array(np.diff(texts).astype(np.int32)), *(pa.nulls(len(held), k) for k in kinds[5:])]
            yield pa.RecordBatch.from_arrays(counted, names)
            if not len(first):
                continue
            buckets.append((all_words % np.uint64(SKETCH)).astype(np.int32))
            if sum(map(len, buckets)) >= 2 * SKETCH:
                words += np.bincount(np.concatenate(buckets), minlength=SKETCH)
                buckets.clear()
            sizes = np.diff(np.append(first, len(h)))
            text = np.searchsorted(texts, lines, "right") - 1
            node, check = digests(h, first, sizes)
            columns = [
                ids.take(pa.array(at + text)), pa.array((lines - texts[text]).astype(np.int32)), pa.array(node), pa.array(check),
                pa.array(sizes.astype(np.int32)), pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
    if buckets:
        words += np.bincount(np.concatenate(buckets), minlength=SKETCH)
    packs = [zlib.compress(piece.tobytes(), 1) for piece in words.reshape(_PIECES, -1)]
    yield pa.RecordBatch.from_arrays([*(pa.nulls(_PIECES, k) for k in kinds[:5]), pa.array(range(_PIECES), pa.int32()), pa.array(packs, pa.binary())], names)


def _prefixes(levels, spread, per_cent: int, ranges: int):
    """Of texts: a row for each prefix word of each distinct line: the word, the node, its size and the word's place in
    it, and the signature. Words that occur once are left out: no other line has them. Rows travel packed, those of a range
    of words together; those of a word that may have more than BLOCK are dealt out among the ranges by their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.arange(_SEEN) ^ 1  # late nodes, each at its own place; what is overwritten is emitted again, nothing is lost
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        names = ["range", "dealt", "key", "node", "place", "signature"]

        def pack() -> Iterator[pa.RecordBatch]:
            key, node, place = (np.concatenate([x[i] for x in held]) for i in range(3))
            bits = pa.concat_arrays([x[3] for x in held])
            held.clear()
            dealt = spread.value[key & (SKETCH - 1)] > 1
            for which in (False, True):
                at = np.flatnonzero(dealt == which)
                if len(at):
                    part = (node if which else key)[at] & (ranges - 1)
                    own, *columns = runs(part, [key[at], node[at], place[at], bits.take(pa.array(at)) if dealt.any() else bits])
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(own), which)), *columns], names)

        for batch in pieces(batches):
            for _, texts in texts_in_chunks(batch.column(0).to_pylist()):
                h, level, first, _, _, _ = line_sets(texts, levels.value)
                if not len(first):
                    continue
                sizes = np.diff(np.append(first, len(h)))
                nodes = digests(h, first, sizes)[0]
                fresh = np.zeros(len(nodes), bool)
                fresh[np.unique(nodes, return_index=True)[1]] = True
                own = nodes & (_SEEN - 1)
                fresh &= seen[own] != nodes
                seen[own] = nodes
                inside = np.arange(len(h)) - np.repeat(first, sizes)
                prefix = sizes - (per_cent * sizes + 99) // 100 + 1
                line = np.repeat(np.arange(len(first)), sizes)
                signature = signatures(h, line, len(first), 16)
                at = np.flatnonzero((inside < prefix[line]) & (level > 0) & fresh[line])
                line = line[at]
                place = (sizes[line] << 24) + np.minimum(inside[at], (1 << 24) - 1)
                held.append((h[at].view(np.int64), nodes[line], place, packed(signature, signature_words(sizes), line)))
                if sum(len(x[0]) for x in held) >= _HELD:
                    yield from pack()
        if held:
            yield from pack()

    return run


_MET = ["a", "b", "key", "node", "place", "signature"]


def _edges_of(per_cent: int, key: np.ndarray, node: np.ndarray, place: np.ndarray, signature: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by word and size: edges (a, b) that connect the nodes whose pairs pass the filters."""
    size, inside = place >> 24, place & ((1 << 24) - 1)

    def wanted(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        ahead = np.minimum(inside[u], inside[v]) + np.minimum(size[u] - inside[u], size[v] - inside[v])
        # The shorter line's part of the pair's prefixes: as few words as the longer one's size leaves to differ.
        least = -(-per_cent * (size[u] + size[v]) // (100 + per_cent))
        return (least <= ahead) & (inside[u] <= size[u] - least) & (inside[v] <= size[v] - least) & (node[u] != node[v])

    for u, v in close_pairs(key, size, signature, signature_words(size), per_cent, wanted):
        if len(u):
            a, b = spanning(u, v)
            found = np.unique(np.stack((node[a], node[b])), axis=1)
            nulls = [pa.nulls(found.shape[1], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), *nulls], _MET)


def by_word_and_size(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """An order of rows in which those of a word follow each other by size."""
    leading, size = key.view(np.uint64) >> np.uint64(20), place >> 24
    order = np.argsort((leading << np.uint64(20)) | np.minimum(size, (1 << 20) - 1).astype(np.uint64))
    k = key[order]
    # Words that share these bits, or very long lines, take an exact sort.
    if (size >= (1 << 20) - 1).any() or ((k[1:] != k[:-1]) & (leading[order[1:]] == leading[order[:-1]])).any():
        return np.lexsort((place, key))
    return order


def _meet(per_cent: int):
    """Of packed rows sorted by range: edges (a, b) among the rows of each word. Rows that were dealt out are passed on."""

    def unpack(batch: pa.RecordBatch) -> list[np.ndarray]:
        key, count = values(batch.column(2))
        place = values(batch.column(4))[0]
        signature = spread_out(values(batch.column(5))[0].view(np.uint64), signature_words(place >> 24))
        return [np.repeat(batch.column(0).to_numpy(), count), key, values(batch.column(3))[0], place, signature]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ends = np.cumsum(values(batch.column(2))[1])
            at = 0
            while at < len(batch):
                stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _UNPACKED, "right")), at + 1)
                yield batch.slice(at, stop - at)
                at = stop

        def light(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in given:
                dealt = batch.column(1)
                for part in small(batch.filter(dealt)) if dealt.true_count else ():
                    _, key, node, place, signature = unpack(part)
                    bits = packed(signature, signature_words(place >> 24), np.arange(len(key)))
                    passed.append(pa.RecordBatch.from_arrays([*[pa.nulls(len(key), pa.int64())] * 2, pa.array(key), pa.array(node), pa.array(place), bits], _MET))
                yield from small(batch.filter(pc.invert(dealt)) if dealt.true_count else batch)

        for _, *rows in whole_groups(light(batches), unpack):
            yield from passed
            passed.clear()
            order = by_word_and_size(rows[0], rows[2])
            yield from _edges_of(per_cent, *(x[order] for x in rows))
        yield from passed

    return run


def _meet_blocks(per_cent: int):
    """Of rows (key, node, place, signature) sorted by key and place: edges (a, b) among those of a key."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), unpacked(batch.column(3))[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, columns):
            yield from _edges_of(per_cent, *rows)

    return run


def _heavy_edges(met: DataFrame, per_cent: int) -> DataFrame:
    """Edges among the rows that _meet passed on: a word's rows are dealt into as many blocks of BLOCK rows as there
    are, and a task has one pair of blocks."""
    rows = met.where("key IS NOT NULL").select("key", "node", "place", "signature")
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.join(materialize(blocks, "blocks"), "key").withColumn("own", own).withColumn("other", other)
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    rows = rows.select(key, "node", "place", "signature")
    return rows.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_meet_blocks(per_cent), met.schema).select("a", "b")


def _compare(per_cent: int):
    """Of rows sorted by task (task, side, node, check, doc_id, line_no, line): the sets with a similar earlier one of their task,
    of the other side where there are two (1 and 2). Small tasks are settled together."""

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        lines = rows.column(6).to_pylist()
        h, _, first, *_ = line_sets([line.replace("\n", " ").encode("utf-8", "surrogatepass") for line in lines])
        sets, sizes = np.split(h, first[1:]), np.diff(np.append(first, len(h)))
        name, side, number = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 5))
        task = np.cumsum(np.append(True, name[1:] != name[:-1]))
        doc, known = rows.column(4).fill_null(0).to_numpy(), rows.column(4).is_valid().to_numpy(zero_copy_only=False)
        order = np.argsort(np.lexsort((number, doc, known)))
        by = np.lexsort((sizes, task))
        signature = signatures(h, np.repeat(np.arange(len(sizes)), sizes), len(sizes), 8)[by]
        gone = np.zeros(len(sizes), bool)
        own = lru_cache(256)(lambda i: frozenset(folded_words(lines[i])))

        def wanted(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            i, j = by[u], by[v]
            return ~gone[np.where(order[j] > order[i], j, i)] & ((side[i] != side[j]) | (side[i] == 0))

        def similar(i: int, j: int) -> bool:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both < per_cent * (int(sizes[i]) + int(sizes[j]) - both):
                return False
            both = len(own(i) & own(j))
            return 100 * both >= per_cent * (len(own(i)) + len(own(j)) - both)

        for u, v in close_pairs(task[by], sizes[by], signature, np.full(len(by), 8), per_cent, wanted):
            for i, j in zip(by[u].tolist(), by[v].tolist(), strict=True):
                later = j if order[j] > order[i] else i
                if not gone[later]:
                    gone[later] = similar(i, j)
        return rows.select(["node", "check"]).filter(pa.array(gone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in pieces(batches, _TOGETHER):
            task = batch.column(0).to_numpy(zero_copy_only=False)
            # The last task's rows may go on in the next batch.
            cut = int(np.argmax(task == task[-1])) if len(task) else 0
            if len(task) and (cut or (held and held[-1].column(0)[-1].as_py() != task[-1])):
                held.append(batch.slice(0, cut))
                yield settle(pa.concat_batches(held))
                held = []
            if len(task):
                held.append(batch.slice(cut))
        if held:
            yield settle(pa.concat_batches(held))

    return run


def _fetch(wanted: Membership):
    """Of rows (doc_id, text) the lines that `wanted` passes by doc_id and line number, with the 128 bits of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            sizes = np.array([t.count("\n") + 1 for t in texts])
            text = np.repeat(np.arange(len(texts)), sizes)
            number = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            good = wanted.passes(numbers(batch.column(0).take(pa.array(text)), pa.array(number)))
            lines, last, parts = [], -1, []
            for at, i in zip(text[good].tolist(), number[good].tolist(), strict=True):
                if at != last:
                    last, parts = at, texts[at].split("\n")
                lines.append(parts[i])
            encoded = [line.encode("utf-8", "surrogatepass") for line in lines]
            h, _, first, filled, *_ = line_sets(encoded) if encoded else (None, None, (), ())
            if len(first):
                node, check = digests(h, first, np.diff(np.append(first, len(h))))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(check), pa.array([lines[i] for i in filled.tolist()], pa.string())], ["node", "check", "line"])

    return run


def removed_lines(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """One row per doc_id: doc_id, n_lines, removed (sorted line numbers, from 0) for docs (doc_id, text).

    Lines are parted by \\n; a line's words are runs of other characters than `[\\x20\\x09-\\x0D]`, A-Z lower-cased. A
    line is removed if an earlier line, of the same document or one with a smaller doc_id, has a Jaccard coefficient
    of per_cent / 100 or more with it. Lines without words stay. Null texts count as one empty line, null ids as
    smaller than all others. Rows that repeat a doc_id are one document whose line numbers each row has: the same
    number is one line, so a repeated row loses no more than one copy does. Other columns are not read. Equal sets are
    told by 128 bits of keyed hashes of their words, similar ones by the words themselves.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    bound_batches(spark)
    scanned, counts = scan_lines(docs)
    lines = scanned.where("node IS NOT NULL")
    levels = spark.sparkContext.broadcast(rarity(counts))
    spread = spark.sparkContext.broadcast(np.minimum(-(-counts // BLOCK), (1 << 31) - 2).astype(np.int32))
    nodes = lines.groupBy("node", "check").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.min("n").alias("n"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "nodes")

    ranges = min(max(RANGES, 1 << (int(counts.sum()) // RANGE_WORDS).bit_length()), 1 << 16)
    prefixes = docs.select("text").mapInArrow(_prefixes(levels, spread, per_cent, ranges), _RUNS).repartition("range").sortWithinPartitions("range")
    met = materialize(prefixes.mapInArrow(_meet(per_cent), "a long, b long, key long, node long, place long, signature binary"), "met")
    edges = met.where("a IS NOT NULL").select("a", "b").union(_heavy_edges(met, per_cent))
    members = nodes.join(components(edges), "node").select("node", "check", "root", "n", "first.doc_id", "first.line_no")
    members = materialize(members, "members")
    tasks = materialize(tiles(members, per_cent), "tasks")
    found = docs.mapInArrow(_fetch(membership(members.select("doc_id", "line_no"))), "node long, check long, line string").dropDuplicates(["node", "check"])
    rows = tasks.join(found, ["node", "check"]).select("task", "side", "node", "check", "doc_id", "line_no", "line").repartition("task").sortWithinPartitions("task")
    gone = rows.mapInArrow(_compare(per_cent), "node long, check long").withColumn("gone", F.lit(True))
    several = nodes.where("copies > 1").select("node", "check", F.lit(False).alias("gone"), "first")
    status = several.unionByName(gone.withColumn("first", F.lit(None).cast("struct<doc_id:bigint,line_no:int>")))
    status = materialize(status.groupBy("node", "check").agg(F.max("gone").alias("gone"), F.max("first").alias("first")), "status")

    marked = lines.join(status, ["node", "check"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    marked = marked.where(F.col("gone") | ~same).select("doc_id", "line_no", F.lit(None).cast("int").alias("lines"))
    sizes = scanned.where("node IS NULL").select("doc_id", F.lit(None).cast("int").alias("line_no"), F.col("n").alias("lines"))
    removed = F.sort_array(F.collect_set("line_no")).alias("removed")
    return sizes.unionByName(marked).groupBy("doc_id").agg(F.max("lines").cast("long").alias("n_lines"), removed)


def remove_lines(docs: DataFrame, per_cent: int = PER_CENT, keep_emptied: bool = True) -> DataFrame:
    """The rows of docs, all columns; texts lose the lines that repeat earlier ones, and n_chars, if there, follows.
    keep_emptied: whether a row stays whose text loses its last words so; rows without words from the start stay."""
    removed = removed_lines(docs, per_cent).where(F.size("removed") > 0)
    removed = broadcast_if_small(materialize(removed, "removed"), 48 + 4 * F.size("removed"))
    joined = docs.join(removed, docs["doc_id"].cast("long").eqNullSafe(removed["doc_id"]), "left")
    left_out = removed["removed"]
    kept = F.filter(F.split(docs["text"], "\n"), lambda line, i: ~F.array_contains(left_out, i))
    changed = {"text": F.when(left_out.isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(left_out.isNull(), docs["n_chars"]).otherwise(F.char_length(changed["text"]).cast(dict(docs.dtypes)["n_chars"]))
    if not keep_emptied:
        joined = joined.where(left_out.isNull() | changed["text"].rlike("[^ \\t-\\r]"))
    return joined.select(*(changed.get(c, docs[c]).alias(c) for c in docs.columns))


def query(spark, sf_dir):
    found = removed_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line, len(lines) AS n_lines
           FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
w AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word FROM l),
s AS (SELECT doc_id, line_no, list_sort(list(word)) AS words, count(*) AS n FROM w GROUP BY ALL),
u AS (SELECT words, n, min((doc_id, line_no)) AS first, row_number() OVER () AS id FROM s GROUP BY words, n),
t AS (SELECT id, n, first, unnest(words) AS word FROM u),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS n_both FROM t a JOIN t b ON a.word = b.word AND a.first < b.first AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
g AS (SELECT DISTINCT y AS id FROM p JOIN u a ON x = a.id JOIN u b ON y = b.id WHERE 100 * n_both >= 80 * (a.n + b.n - n_both)),
r AS (SELECT doc_id, line_no FROM s JOIN u USING (words, n) WHERE id IN (SELECT id FROM g) OR (doc_id, line_no) <> first)
SELECT l.doc_id, max(n_lines) AS n_lines, count(r.line_no) AS n_removed,
       coalesce(string_agg(CAST(r.line_no AS VARCHAR), ',' ORDER BY r.line_no), '') AS removed_lines
FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.line_no = r.line_no GROUP BY l.doc_id
"""
