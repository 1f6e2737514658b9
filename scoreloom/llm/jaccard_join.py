"""Exact n-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

1. Documents with the same shingle set become one node.
2. Similar sets differ in few shingles, at most d by their size band. So the hash range is cut into m > d parts: sets
   that differ in d shingles agree in m - d parts at least, whatever they share with others. Each set emits a key for
   each part of its own band and of the next larger one; sets with an equal key meet. No similar pair is missed: m
   exceeds d by more than the empty parts a set usually has, and a set with more empty parts emits keys for them too.
3. The nodes that meet at a key form a tile if they are few, otherwise tiles by size band; tiles are compared two by
   two. The bits in which two hashed bitmaps differ bound the overlap from above, so no text is moved for most pairs.
4. What passes is connected, and its texts form such tiles in turn. Sorted hash arrays are intersected and the words
   of what is similar compared. Pairs already connected are not compared again.
5. The verified links' components are the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, copy_key, materialize, table
from .components import components
from .hashing import digests, folded_words, mix, pieces, shingle_sets
from .membership import Membership, membership, numbers
from .screening import close_pairs, signatures, spanning, unpacked, whole_groups

TILE_ROWS, TILE_SHINGLES = 1024, 1_000_000
#: A key with more rows than OFTEN in a run of 100,000 is dealt into SALTS parts. Keys of at most FEW nodes are one
#: group if the nodes are the same. So many rows of one key are held at once.
OFTEN, SALTS, FEW, HELD = 16, 1024, 64, 100_000


def _least_filled(n: int, m: int) -> float:
    """Three standard deviations less than the mean number of parts, of m, that n hashes fall into."""
    empty = math.exp(-n / m)
    return m * (1 - empty) - 3 * math.sqrt(m * empty * max(1 - (1 + n / m) * empty, 0.0))


class Bands:
    """Size bands in which similar sets are at most one apart, with the parts of each. Similar: J >= per_cent / 100."""

    def __init__(self, per_cent: int):
        self.per_cent, self.starts, self._parts = per_cent, [1], {}

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 100 // self.per_cent + 1)
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """(m, slack): the number of parts, and how many identical parts similar sets of this band have at least, less one."""
        if band not in self._parts:
            while len(self.starts) <= band + 1:
                self.starts.append(self.starts[-1] * 100 // self.per_cent + 1)
            top, low = self.starts[band + 1] - 1, self.starts[max(band - 1, 0)]
            d = (100 - self.per_cent) * 2 * top // (100 + self.per_cent)
            m = d + 1
            while m < 16 * top and _least_filled(low, m) < d + 1:
                m += max(1, m // 64)
            self._parts[band] = (m, m - d - 1) if d else (0, 0)
        return self._parts[band]


def _digest(found: np.ndarray) -> tuple[int, int]:
    node, check = digests(found, np.zeros(1, np.int64), np.array([len(found)]))
    return int(node[0]), int(check[0])


def signature_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words in the signature of a set of so many shingles: a bit for each at least, but for the largest."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(sizes, 1) / 64)), 0, 9).astype(np.int64)


_SETS = "doc_id long, copy long, n_shingles long, node long, check long, signature binary"


def _describe(width: int):
    """Of rows (doc_id, copy, text): the size, the 128 bits and the signature of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, nodes, checks, bits = [], [], [], []
            for found in shingle_sets(batch.column(2).to_pylist(), width):
                sizes.append(len(found))
                node, check = _digest(found) if len(found) else (None, None)
                nodes.append(node)
                checks.append(check)
                words = int(signature_words(np.array([len(found)]))[0])
                bits.append(signatures(found, np.zeros(len(found), np.int64), 1, words).tobytes() if len(found) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "copy", "n_shingles", "node", "check", "signature"])

    return run


def _part_keys(found: np.ndarray, bands: Bands) -> Iterator[np.ndarray]:
    mixed, high = mix(found + np.uint64(0x9E3779B97F4A7C15)), found >> np.uint64(32)
    own = bands.of(len(found))
    for band in (own, own + 1):
        m, slack = bands.parts(band)
        if not m:
            continue
        part = (high * np.uint64(m)) >> np.uint64(32)  # not decreasing, as found is sorted
        first = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 63)))
        sums = np.add.reduceat(mixed, first)
        names = part[first]
        if m - len(first) > slack:
            missing = np.setdiff1d(np.arange(m, dtype=np.uint64), names)
            sums, names = np.concatenate((sums, np.zeros(len(missing), np.uint64))), np.concatenate((names, missing))
        yield mix(sums + (names + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


def _keys(width: int, per_cent: int):
    """Of texts: (key, salt, node) for each key of each set. The rows of a key that is frequent in a run of sets are
    dealt out by a salt; a row of salt -1 tells the key's other rows so."""

    def flush(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        key, node = (np.concatenate(x).view(np.int64) for x in (keys, nodes))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[back] > OFTEN
        salt = np.where(often, 1 + (node & (SALTS - 1)), 0).astype(np.int32)
        marked = np.unique(key[often])
        key, node = np.concatenate((key, marked)), np.concatenate((node, np.zeros(len(marked), np.int64)))
        salt = np.concatenate((salt, np.full(len(marked), -1, np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(node)], ["key", "salt", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(per_cent), set()
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0
        for batch in pieces(batches):
            for found in shingle_sets(batch.column(0).to_pylist(), width):
                node = _digest(found)[0] if len(found) else 0
                if not len(found) or node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                for x in _part_keys(found, bands):
                    keys.append(x)
                    nodes.append(np.full(len(x), node, np.int64))
                    held += len(x)
                if held > 100_000:
                    yield flush(keys, nodes)
                    keys, nodes, held = [], [], 0
        if keys:
            yield flush(keys, nodes)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, salt, node) sorted by all: (group, node) where a key has several nodes. Keys with the same few
    nodes are one group; a key of many rows is a group of its own, and is passed on without being held whole."""
    names = ["group", "node"]
    seen = np.zeros(0, np.int64)
    carried: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    large = None  # the key whose rows before this batch were passed on

    def batch_of(group: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(node)], names)

    def settle(key: np.ndarray, salt: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal seen
        if not len(key):
            return
        number = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        own = (salt > 0) | ((key == large) if large is not None else False)
        own |= np.bincount(number, weights=salt < 0)[number] > 0
        own |= np.bincount(number)[number] > FEW
        whole = own & (salt >= 0)
        if whole.any():
            yield batch_of(key[whole], node[whole])
        number, node = number[~own], node[~own]
        fresh = np.ones(len(node), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (number[1:] != number[:-1])
        number, node = number[fresh], node[fresh]
        several = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        number, node = number[several], node[several]
        if not len(node):
            return
        first = np.flatnonzero(np.diff(number, prepend=-1))
        sizes = np.diff(np.append(first, len(node)))
        name = digests(node.view(np.uint64), first, sizes)[0]
        new = np.zeros(len(name), bool)
        new[np.unique(name, return_index=True)[1]] = True
        new &= ~np.isin(name, seen)
        if len(seen) < 500_000:
            seen = np.union1d(seen, name[new])
        row = np.repeat(new, sizes)
        if row.any():
            yield batch_of(np.repeat(name, sizes)[row], node[row])

    for batch in batches:
        if not len(batch):
            continue
        rows = [np.concatenate((c, x.to_numpy(zero_copy_only=False).astype(np.int64))) for c, x in zip(carried, batch.columns, strict=True)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield from settle(*(r[:cut] for r in rows))
            large = None if rows[0][-1] != large else large
        carried = [r[cut:] for r in rows]
        if len(carried[0]) > HELD:
            large = carried[0][-1]
            yield from settle(*carried)
            carried = [r[:0] for r in carried]
    yield from settle(*carried)


def _screen(per_cent: int):
    """Of rows (task, side, node, n, signature) sorted by task and n: pairs that connect all that may be similar."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        side, node, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
        return [batch.column(0).to_numpy(zero_copy_only=False), n, side, node, *unpacked(batch.column(4))[:1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, n, side, node, signature in whole_groups(pieces(batches, 1024), columns):  # long signatures widen their slice only
            wanted = lambda u, v: ((side[u] != side[v]) | (side[u] == 0)) & (node[u] != node[v])  # noqa: B023, E731
            for u, v in close_pairs(task, n, signature, signature_words(n), per_cent, wanted):
                if len(u):
                    a, b = spanning(u, v)
                    edges = np.unique(np.stack((node[a], node[b])), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])

    return run


def similar(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def compare(sets: list[np.ndarray], sides: np.ndarray, per_cent: int, verify: Callable[[int, int], bool] = lambda i, j: True) -> list[tuple[int, int]]:
    """Links that connect all similar pairs of a tile (all sides 0) or of two tiles (sides 1 and 2: only across)."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    side = sides[order]
    bits = 1 << min(max(int(sizes.max()) - 1, 255).bit_length(), 13)
    maps = np.zeros((len(order), bits // 64), np.uint64)
    for row, i in enumerate(order):
        at = sets[i] & np.uint64(bits - 1)
        np.bitwise_or.at(maps[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    root = np.arange(len(order))
    links = []
    for i in range(len(order)):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // per_cent, "right"))
        j = np.arange(i + 1, end)
        j = j[(root[j] != root[i]) & ((side[j] != side[i]) | (side[i] == 0))]
        if not len(j):
            continue
        differ = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
        most = (sizes[j] + sizes[i] - differ) // 2
        for k in j[(100 + per_cent) * most >= per_cent * (sizes[j] + sizes[i])].tolist():
            if root[k] != root[i] and similar(sets[order[i]], sets[order[k]], per_cent) and verify(order[i], order[k]):
                root[root == root[k]] = root[i]
                links.append((order[i], order[k]))
    return links


def word_shingles(text: str, width: int) -> set[tuple[bytes, ...]]:
    seq = folded_words(text)
    return {tuple(seq[i : i + width]) for i in range(max(len(seq) - width + 1, 1))} if seq else set()


def _compare_tiles(width: int, per_cent: int):
    """Of rows (task, side, node, check, text) sorted by task: links between sets whose words are similar."""

    def settle(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        texts = [row[3] for row in rows]
        own = lru_cache(16)(lambda i: word_shingles(texts[i], width))

        def verify(i: int, j: int) -> bool:
            both = len(own(i) & own(j))
            return 100 * both >= per_cent * (len(own(i)) + len(own(j)) - both)

        links = compare(list(shingle_sets(texts, width)), np.array([row[0] for row in rows]), per_cent, verify)
        ends = [pa.array([rows[link[k]][at] for link in links], pa.int64()) for k in (0, 1) for at in (1, 2)]
        return pa.RecordBatch.from_arrays(ends, ["a_node", "a_check", "b_node", "b_check"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != task and rows:
                    yield settle(rows)
                    rows = []
                task = name
                rows.append(tuple(row))
        if rows:
            yield settle(rows)

    return run


def _fetch(width: int, members: Membership):
    """Of rows (doc_id, text) those that `members` passes, with the 128 bits of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            batch = batch.filter(pa.array(members.passes(numbers(batch.column(0)))))
            texts, nodes, checks = batch.column(1).to_pylist(), [], []
            for found in shingle_sets(texts, width):
                node, check = _digest(found) if len(found) else (None, None)
                nodes.append(node)
                checks.append(check)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), batch.column(1)], ["node", "check", "text"])

    return run


def tiles(members: DataFrame, per_cent: int) -> DataFrame:
    """The members (node, root, n and more) once for each tile or pair of tiles in which they are compared, with task
    and side: 0 in a tile of its own, 1 or 2 in a pair."""
    carried = [c for c in members.columns if c not in ("root", "n")]
    bands = Bands(per_cent)
    bands.of(1 << 40)
    band = sum((F.when(F.col("n") >= start, 1).otherwise(0) for start in bands.starts[1:]), F.lit(0))
    members = members.withColumn("band", band)
    many = lambda n, s: F.ceil(F.greatest(n / F.lit(TILE_ROWS), s / F.lit(TILE_SHINGLES)))
    whole = members.groupBy("root").agg(many(F.count("*"), F.sum("n")).alias("whole"))
    dealt = members.groupBy("root", "band").agg(many(F.count("*"), F.sum("n")).alias("dealt"))
    large = dealt.join(whole.where("whole > 1"), "root")
    above = large.select("root", (F.col("band") - 1).alias("band"), F.col("dealt").alias("above"))
    below = large.select("root", (F.col("band") + 1).alias("band"), F.col("dealt").alias("below"))
    large = materialize(large.join(above, ["root", "band"], "left").join(below, ["root", "band"], "left"), "large")
    rows = members.join(large, ["root", "band"], "left").withColumn("t", F.pmod(F.xxhash64("node"), "dealt"))
    name = lambda *parts: F.concat_ws(":", "root", *parts)
    at = lambda band, t: F.concat_ws(".", band, t)
    own = at("band", "t")
    pair = lambda label, side: F.struct(label.alias("task"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<task:string,side:int>>")
    each = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(none)
    same = each(F.col("dealt"), lambda u: F.when(u == F.col("t"), pair(name(own), 0)).when(u > F.col("t"), pair(name(own, at("band", u)), 1)).otherwise(pair(name(at("band", u), own), 2)))
    up = each(F.coalesce("above", F.lit(0)), lambda u: pair(name(own, at(F.col("band") + 1, u)), 1))
    down = each(F.coalesce("below", F.lit(0)), lambda u: pair(name(at(F.col("band") - 1, u), own), 2))
    tasks = F.when(F.col("dealt").isNull(), F.array(pair(F.col("root").cast("string"), 0))).otherwise(F.concat(same, up, down))
    return rows.select(*carried, F.explode(tasks).alias("at")).select("at.task", "at.side", *carried)


def jaccard_classes(docs: DataFrame, width: int = 4, per_cent: int = 85) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Two documents link when their shingle sets have a Jaccard coefficient of per_cent / 100 or more. A text of fewer
    than width words is one shingle; null and empty texts have none and link with nothing, not even each other.
    Repeated rows and equal texts are linked; rows of one doc_id with different texts have a component each. Rows of a
    null doc_id link others, but are no component's name: alone, or among themselves, their component is null. Other
    columns are not read. Equal sets are told by 128 bits of keyed hashes, similar ones by their words.
    """
    return _classes(docs, width, per_cent).drop("copy")


def _classes(docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """jaccard_classes with copy, a hash of the row's text."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(docs.select("doc_id", copy_key().alias("copy"), "text").mapInArrow(_describe(width), _SETS), "sets")
    nodes = base.where("node IS NOT NULL").groupBy("node", "check").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"), F.count("doc_id").alias("named"), F.any_value("signature").alias("signature")
    )
    nodes = materialize(nodes, "nodes")
    keys = docs.select("text").mapInArrow(_keys(width, per_cent), "key long, salt int, node long")
    shared = keys.repartition("key", F.greatest("salt", F.lit(0))).sortWithinPartitions("key", "salt", "node").mapInArrow(_shared, "group long, node long")
    groups = materialize(shared.distinct(), "groups")
    tasks = tiles(groups.join(nodes, "node").select("node", F.col("group").alias("root"), "n", F.col("n").alias("size"), "signature"), per_cent)
    rows = tasks.select(F.xxhash64("task").alias("task"), "side", "node", "size", "signature").repartition("task").sortWithinPartitions("task", "size")
    candidates = components(rows.mapInArrow(_screen(per_cent), "a long, b long"))

    members = materialize(nodes.join(candidates, "node").select("node", "check", "root", "n", "doc_id", "named", "copies"), "members")
    tasks = materialize(tiles(members.select("node", "check", "root", "n"), per_cent), "tasks")
    # Where a set has rows without doc_id only, those are fetched.
    wanted = membership(members.select("doc_id"))
    texts = docs.mapInArrow(_fetch(width, wanted), "node long, check long, text string")
    rows = tasks.join(texts.dropDuplicates(["node", "check"]), ["node", "check"]).select("task", "side", "node", "check", "text")
    links = rows.repartition("task").sortWithinPartitions("task").mapInArrow(_compare_tiles(width, per_cent), "a_node long, a_check long, b_node long, b_check long")
    end = lambda x: F.struct(F.col(f"{x}_node").alias("node"), F.col(f"{x}_check").alias("check")).alias(x)
    linked = components(links.select(end("a"), end("b"))).select("node.node", "node.check", "root")

    named = nodes.join(linked, ["node", "check"], "left").withColumn("root", F.coalesce("root", F.struct("node", "check")))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("rows"))
    found = named.join(names.where("rows > 1"), "root").select("node", "check", "component_id", F.lit(True).alias("grouped"))
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return base.join(materialize(found, "found"), ["node", "check"], "left").select("doc_id", "n_shingles", component, "copy")


def query(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame, width: int = 4, per_cent: int = 85) -> DataFrame:
    """The rows of docs, all columns, whose doc_id names their component: one document of each group stays.

    Each row is judged by its own text, so of two texts under one doc_id one can go. Rows that repeat both stay or go
    together. A row without doc_id goes if it is linked with one that has an id; else it stays.
    """
    classes = _classes(docs, width, per_cent)
    gone = classes.where("component_id IS NOT NULL AND NOT (doc_id <=> component_id)").select("doc_id", "copy").distinct()
    gone = broadcast_if_small(materialize(gone, "gone"), F.lit(64))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (copy_key(docs["text"]) == gone["copy"])
    return docs.join(gone, same, "left_anti")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * n_both >= 85 * (a.n + b.n - n_both)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""
