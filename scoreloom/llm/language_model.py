"""Language-model scores from a log-frequency Bloom filter.

A count c becomes the level 1 + floor(log c) to the base `BASE`, and an n-gram of level q enters the filter q times, as
(n-gram, 1) to (n-gram, q). A reader probes level after level until one is missing; that gives the quantised count, and
chance makes it too high by a level with a probability that falls with each level. Probabilities are smoothed by a
Dirichlet prior: P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m), down to (c(w) + 1) / (N + V + 1).

1. Words of all rows are counted exactly, as strings, pre-aggregated in tasks.
2. Every training row's n-grams of orders 1 to 3 are counted. A task sorts the hashes of a piece of text, counts equal
   ones and sends them as packed runs, one for each range of the hash; more ranges than a task can deal out at once are
   reached in steps. A range holds a bounded number of n-grams and builds its own segment of the filter.
3. Where all n-grams fit a bounded filter it is broadcast. Where they may be too many, nothing is broadcast and nothing stays
   out: a piece of text sends its n-grams, those of rows that are held out too, to their ranges, each range fills a filter
   of its own, probes it with what it was sent, and the levels go back to the piece.
4. The levels of all rows are written, a byte an n-gram. The prior weights are chosen on those of all
   training rows, each without itself; then the levels become scores. Exact base scores take frequent words from a broadcast table of bounded size; the other
   words of a row, which are rare, are joined with their counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, table
from .hashing import mix, word_hashes

ORDER = 3
BASE = 1.5
#: The most bits of a filter that is broadcast (32 MiB), bits for each entry, and probes for each.
MOST, BITS, PROBES = 1 << 28, 8, 3
#: N-grams that a range holds, and ranges that a task deals out at once.
RANGE, FAN = 1 << 21, 1 << 10
#: Bytes of the words, with their counts, that are broadcast for base scores.
HEAD = 32 << 20
#: Prior weights that are tried for each order over 1.
PRIORS = (3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
_CHUNK = 1 << 23
#: Bytes of text that are scored at once, bytes of levels that are, and distinct contexts that a task holds.
_SCORED, _LEVELS, _CONTEXTS = 1 << 21, 1 << 19, 1 << 18
_BEGIN, _END = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Least count of each level; the last is over 2**62.
LEAST = np.array([math.ceil(BASE**q - 1e-9) for q in range(int(62 * math.log(2) / math.log(BASE)) + 1)], np.int64)
#: Mean count of each level; 0 is the level of what is not there.
MEAN = np.concatenate(([0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2))


def held_out(col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, "right")


def chunks(batch: pa.RecordBatch, column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes in that column, _CHUNK if not said."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (size or _CHUNK), "right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """The words of some texts: distinct (words), and for each occurrence its place there (at) and its text (row)."""

    words: pa.Array
    at: np.ndarray
    row: np.ndarray
    rows: int

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Runs of other characters than `[\\x20\\x09-\\x0D]`, A-Z lower-cased."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(full).dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row[full.to_numpy(zero_copy_only=False)], len(texts))

    @cached_property
    def _hashes(self) -> np.ndarray:
        return hashes_of(self.words)

    def hashes(self) -> np.ndarray:
        return self._hashes

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts' tokens in a row, each text between a begin and an end, and each token's text."""
        sizes = np.bincount(self.row, minlength=self.rows) + 2
        row = np.repeat(np.arange(self.rows), sizes)
        found = np.empty(len(row), np.uint64)
        ends = np.cumsum(sizes)
        found[ends - sizes], found[ends - 1] = _BEGIN, _END
        found[np.arange(len(self.at)) + 2 * self.row + 1] = self.hashes()[self.at]
        return found, row


def hashes_of(words: pa.Array) -> np.ndarray:
    return word_hashes(b" ".join(words.cast(pa.binary()).to_pylist()))[0]


def ngrams(tokens: np.ndarray, row: np.ndarray, order: int) -> list[np.ndarray]:
    """Of each order the hashes of the n-grams that end at each token; 0 where the text has none of that length."""
    found = [tokens]
    for n in range(2, order + 1):
        longer = np.zeros_like(tokens)
        inside = row[n - 1 :] == row[: len(row) - n + 1]
        longer[n - 1 :] = np.where(inside, mix(found[-1][n - 2 : -1] * _FIRST + tokens[n - 1 :] * _SECOND + np.uint64(n)), 0)
        found.append(longer)
    return found


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, train) of every word of docs (text, train): how often it occurs, and how often in training rows. A null
    word has the number of rows, which is that of ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                own = Words.of(part.column("text"))
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                size = len(own.words)
                n = np.append(np.bincount(own.at, minlength=size), len(part))
                known = np.append(np.bincount(own.at[train[own.row]], minlength=size), train.sum())
                words = pa.concat_arrays([own.words.cast(pa.string()), pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64))], ["word", "n", "train"])

    counted = docs.select("text", "train").mapInArrow(count, "word string, n long, train long")
    return materialize(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("train").alias("train")), "words")


@dataclass(frozen=True)
class Shape:
    """Where n-grams go: the first `ranges` bits of a hash name its range, the first `segments` of them its segment of the
    filter, and these bits with the next 40 are all that tells n-grams apart. size: bits of a segment."""

    ranges: int
    segments: int
    size: int

    @classmethod
    def of(cls, occurrences: int, most: int = MOST, range_size: int = RANGE) -> Shape:
        """For so many n-grams, repeated ones included."""
        ranges = min(24, max(0, math.ceil(math.log2(max(occurrences, 1) / range_size))))
        bits = min(most, 1 << max(10, math.ceil(math.log2(max(BITS * occurrences, 1)))))
        segments = min(ranges, 10, bits.bit_length() - 4)
        return cls(ranges, segments, bits >> segments)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(24 - self.ranges)

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(40 + self.ranges - self.segments)).astype(np.int64)

    def places(self, keys: np.ndarray, q: int) -> Iterator[np.ndarray]:
        """The bits of (n-gram, q) in its segment."""
        a = mix(keys + np.array([q], np.uint64) * _FIRST)
        step = (a >> np.uint64(32)) | np.uint64(1)
        even = self.size & (self.size - 1) == 0  # the remainder by a power of two is a mask
        for _ in range(PROBES):
            yield (a & np.uint64(self.size - 1) if even else a % np.uint64(self.size)).astype(np.int64)
            a = a + step


class Filter:
    """segments: (segments, bytes of each); lowest: the lowest level of the n-grams in it."""

    def __init__(self, shape: Shape, segments: np.ndarray, lowest: int = 1):
        self.shape, self.segments, self.lowest = shape, segments, lowest

    def levels(self, hashes: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """The level of each n-gram, 0 if there is none; not over `most`, where it is given."""
        return self.levels_of(self.shape.keys(hashes), most)

    def levels_of(self, keys: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        segment, flat = self.shape.segment(keys), self.segments.ravel()
        found = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys)) if most is None else np.flatnonzero(most > 0)
        for q in range(1, len(LEAST)):
            if not len(live):
                break
            base, there = segment[live] * self.segments.shape[1], None
            for place in self.shape.places(keys[live], q):
                hit = ((flat[base + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
                there = hit if there is None else there & hit
            live = live[there]
            found[live] = q
            if most is not None:
                live = live[most[live] > q]
        return np.where(found >= self.lowest, found, 0)


def packed(numbers: np.ndarray, width: int) -> bytes:
    """All lowest bytes, then the next ones."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    found = np.zeros((len(data) // width, 8), np.uint8)
    found[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return found.view("<u8").ravel().astype(np.uint64)


def spaced(keys: np.ndarray, width: int) -> bytes:
    """Keys in order as gaps: how many, the three lowest bytes of all, which are chance, and the others compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(4, "little") + packed(gaps, 3) + pa.Codec("zstd").compress(packed(gaps >> np.uint64(24), width - 3), asbytes=True)


def unspaced(data: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    high = pa.Codec("zstd").decompress(data[4 + 3 * n :], n * (width - 3), asbytes=True)
    return np.cumsum(unpacked(data[4 : 4 + 3 * n], 3) + (unpacked(high, width - 3) << np.uint64(24)))


def ordering(keys: np.ndarray, bits: int) -> np.ndarray:
    """What puts keys of so many bits in order. Keys and places are sorted as one number; where they are too long for
    that, the lowest bits of keys give way, and if the order suffers the keys are sorted by themselves."""
    own = (len(keys) - 1).bit_length() if len(keys) else 0
    less = max(0, bits + own - 64)
    at = (np.sort((keys >> np.uint64(less) << np.uint64(own)) | np.arange(len(keys), dtype=np.uint64)) & np.uint64((1 << own) - 1)).astype(np.int64)
    if less and (keys[at[1:]] < keys[at[:-1]]).any():
        return np.argsort(keys, kind="stable")
    return at


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, in order."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _runs(keys: np.ndarray, counts: np.ndarray, left: int, fan: int, above: int = 0) -> Iterator[tuple[int, bytes, int, bytes]]:
    """Sorted keys of `left` bits as (range, keys of left - fan bits, bytes of each count, counts), by the first fan
    bits; above: the range they come from."""
    part = (keys >> np.uint64(left - fan)).astype(np.int64)
    low = keys & np.uint64((1 << (left - fan)) - 1)
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        width = next(w for w in (1, 2, 4, 8) if int(counts[lo:hi].max()) < 1 << (8 * w))
        counted = pa.Codec("zstd").compress(packed(counts[lo:hi].astype(np.uint64), width), asbytes=True)
        yield (above << fan) + int(part[lo]), spaced(low[lo:hi], -(-(left - fan) // 8)), width, counted


_RUN = "part long, keys binary, width int, counts binary"


def _run_batch(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["part", "keys", "width", "counts"])


def _gathered(batches: Iterator[pa.RecordBatch], left: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, keys, counts) of each run of keys of left bits."""
    width = -(-left // 8)
    for batch in batches:
        for part, keys, size, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = unspaced(keys, width)
            yield part, found, unpacked(pa.Codec("zstd").decompress(counts, len(found) * size, asbytes=True), size).astype(np.int64)


def count_ngrams(docs: DataFrame, order: int, shape: Shape) -> tuple[DataFrame, int]:
    """Runs of counted n-grams of docs (text), one row for each range and task, and the bits of keys in them: 40, the
    range being what part says."""
    first = min(shape.ranges, FAN.bit_length() - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                tokens, row = Words.of(piece.column("text")).sequence()
                found = np.concatenate([x[x != 0] for x in ngrams(tokens, row, order)])
                keys = np.sort(shape.keys(found))
                first_of = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
                rows = list(_runs(keys[first_of[:-1]], np.diff(first_of), 40 + shape.ranges, first))
                for at in range(0, len(rows), 128):
                    yield _run_batch(rows[at : at + 128])

    runs, dealt = docs.select("text").mapInArrow(scan, _RUN), first
    while dealt < shape.ranges:
        fan = min(shape.ranges - dealt, FAN.bit_length() - 1)
        left = 40 + shape.ranges - dealt

        def deal(batches: Iterator[pa.RecordBatch], left: int = left, fan: int = fan) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            size = 0

            def emptied() -> Iterator[pa.RecordBatch]:
                for part, runs in held.items():
                    yield _run_batch(list(_runs(*summed(*(np.concatenate(x) for x in zip(*runs, strict=True))), left, fan, part)))
                held.clear()

            for part, keys, counts in _gathered(batches, left):
                held.setdefault(part, []).append((keys, counts))
                size += len(keys)
                if size >= 2 * RANGE:
                    yield from emptied()
                    size = 0
            yield from emptied()

        runs, dealt = runs.repartition("part").mapInArrow(deal, _RUN), dealt + fan
    return runs, 40


def _enter(bits: np.ndarray, shape: Shape, keys: np.ndarray, q: int) -> None:
    """Sets the bits of n-grams of level q in their segment."""
    for j in range(1, q + 1):
        for place in shape.places(keys, j):
            bits[place] = True


def build_filter(docs: DataFrame, tokens: int, order: int = ORDER, most: int = MOST, range_size: int = RANGE) -> Filter:
    """The filter of all n-grams of docs (text), which have so many tokens. Where they are too many for `most` bits, the
    lowest levels stay out."""
    shape = Shape.of(order * tokens, most, range_size)
    capacity = (shape.size << shape.segments) // BITS
    share = 2 * capacity / (1 << shape.ranges) + 1000
    runs, left = count_ngrams(docs, order, shape)
    schema = "segment int, part long, level int, entries long, keys binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def settle(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        found = list(_gathered(batches, left))
        keys, counts = summed(np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found]))
        q = level(counts)
        entries = np.bincount(q) * np.arange(int(q.max(initial=0)) + 1)
        held = np.cumsum(entries[::-1])[::-1] <= share
        rows = [(part >> (shape.ranges - shape.segments), part, k, int(entries[k]), packed(keys[q == k], 5) if held[k] else None) for k in np.flatnonzero(entries).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ranges = materialize(runs.groupBy("part").applyInArrow(settle, schema), "ngrams")
    sizes = ranges.groupBy("level").agg(F.sum("entries").alias("entries"), F.count("keys").alias("held"), F.count("*").alias("ranges")).collect()
    lowest, total = len(LEAST), 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        total += r["entries"]
        if total > capacity or r["held"] < r["ranges"]:
            break
        lowest = r["level"]

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(shape.size, bool)
        for batch in batches:
            for part, q, keys in zip(*(batch.column(c).to_pylist() for c in ("part", "level", "keys")), strict=True):
                _enter(bits, shape, unpacked(keys, 5) + (np.uint64(part) << np.uint64(40)), q)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    held = ranges.where(F.col("level") >= lowest).groupBy("segment").applyInArrow(fill, "segment int, bits binary")
    segments = np.zeros((1 << shape.segments, shape.size // 8), np.uint8)
    for r in held.toArrow().to_pylist():  # most / 8 bytes at most
        segments[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return Filter(shape, segments, lowest)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The pieces of batches (row, ...; text), each by the row it begins with."""
    for batch in batches:
        for piece in chunks(batch):
            yield piece.column("row")[0].as_py(), piece


def piece_keys(words: Words, order: int, shape: Shape) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams of a piece by order, 0 where there is none, the keys of those that are there, order by order, and the
    text of each token."""
    tokens, row = words.sequence()
    found = ngrams(tokens, row, order)
    return found, shape.keys(np.concatenate([x[x != 0] for x in found])), row


def dealt_levels(rows: DataFrame, order: int, shape: Shape) -> DataFrame:
    """(piece, part, n, levels) of rows (row, train, text): a byte for each of n distinct n-grams of a piece in a range, by
    its key, compressed.
    Each range counts what training rows have, fills a filter and probes it with all that pieces have there."""
    first = min(shape.ranges, FAN.bit_length() - 1)
    names, kinds = ["part", "keys", "width", "counts", "piece"], [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
    schema = f"{_RUN}, piece long"

    def together(runs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        runs = list(runs)
        for at in range(0, len(runs), 128):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*runs[at : at + 128], strict=True), kinds, strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in numbered(batches):
            words = Words.of(piece.column("text"))
            found, keys, row = piece_keys(words, order, shape)
            train = piece.column("train").to_numpy(zero_copy_only=False).astype(np.uint64)[row]
            keys = np.sort((keys << np.uint64(1)) | np.concatenate([train[x != 0] for x in found]))
            own, known = keys >> np.uint64(1), (keys & np.uint64(1)).astype(np.int64)
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            yield from together((*run, number) for run in _runs(own[at], np.add.reduceat(known, at), 40 + shape.ranges, first))

    runs, dealt = rows.mapInArrow(scan, schema), first
    while dealt < shape.ranges:
        fan = min(shape.ranges - dealt, FAN.bit_length() - 1)
        left = 40 + shape.ranges - dealt

        def deal(batches: Iterator[pa.RecordBatch], left: int = left, fan: int = fan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = zip(_gathered(iter([batch.select(names[:4])]), left), batch.column("piece").to_pylist(), strict=True)
                yield from together((*run, number) for (part, keys, counts), number in parts for run in _runs(keys, counts, left, fan, part))

        runs, dealt = runs.repartition("part").mapInArrow(deal, schema), dealt + fan

    def settle(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers, held = key[0].as_py(), [], []
        for batch in batches:
            numbers += batch.column("piece").to_pylist()
            held += _gathered(iter([batch.select(names[:4])]), 40)
        sent = np.concatenate([x[1] for x in held])
        at = ordering(sent, 40)
        new = np.append(True, sent[at[1:]] != sent[at[:-1]])
        keys, counts = sent[at[new]], np.add.reduceat(np.concatenate([x[2] for x in held])[at], np.flatnonzero(new))
        q = level(counts)
        own = Shape(shape.ranges, 0, 1 << max(10, math.ceil(math.log2(max(BITS * int(q.sum()), 1)))))
        whole = keys + (np.uint64(part) << np.uint64(40))
        bits = np.zeros(own.size, bool)
        for k in np.unique(q[q > 0]).tolist():
            _enter(bits, own, whole[q == k], k)
        levels = Filter(own, np.packbits(bits, bitorder="little")[None, :]).levels_of(whole).astype(np.uint8)
        back, codec = np.empty(len(sent), np.uint8), pa.Codec("zstd")
        back[at] = levels[np.cumsum(new) - 1]
        sizes = [len(x[1]) for x in held]
        answers = [codec.compress(x.tobytes(), asbytes=True) for x in np.split(back, np.cumsum(sizes)[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([part] * len(held)), pa.array(sizes), pa.array(answers, pa.binary())], ["piece", "part", "n", "levels"])

    return runs.groupBy("part").applyInArrow(settle, "piece long, part long, n long, levels binary")


def gathered_levels(levels: pa.Table, shape: Shape, distinct: np.ndarray) -> np.ndarray:
    """Those of dealt_levels for one piece, in the order of its keys, which are distinct."""
    levels, codec = levels.sort_by("part"), pa.Codec("zstd")
    parts, n = np.unique((distinct >> np.uint64(40)).astype(np.int64), return_counts=True)
    if levels.column("part").to_pylist() != parts.tolist() or levels.column("n").to_pylist() != n.tolist():
        raise ValueError("a piece of text is not what it was when its n-grams were counted")
    return np.frombuffer(b"".join(codec.decompress(x, k, asbytes=True) for x, k in zip(levels.column("levels").to_pylist(), n.tolist(), strict=True)), np.uint8)


def level_rows(levels: list[np.ndarray], row: np.ndarray, rows: int) -> pa.Array:
    """Of each text the levels of its tokens' n-grams as bytes; levels: those of all tokens, order by order."""
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=rows))) * len(levels)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.stack(levels, axis=1).tobytes())])


def put_back(words: Words, order: int, shape: Shape, levels: pa.Table) -> pa.Array:
    """As Model.levels, from the dealt_levels of a piece."""
    grams, keys, row = piece_keys(words, order, shape)
    ordered = ordering(keys, 40 + shape.ranges)
    first = np.append(True, keys[ordered[1:]] != keys[ordered[:-1]])
    own, begin, found = np.empty(len(keys), np.uint8), 0, []
    own[ordered] = gathered_levels(levels, shape, keys[ordered[first]])[np.cumsum(first) - 1]
    for hashes in grams:
        there = hashes != 0
        now = np.zeros(len(hashes), np.uint8)
        now[there] = own[begin : begin + int(there.sum())]
        begin += int(there.sum())
        if found:
            now = np.minimum(now, np.minimum(found[-1], np.append(np.uint8(0), found[-1][:-1])))
        found.append(now)
    return level_rows(found, row, words.rows)


@dataclass(frozen=True)
class Model:
    """filter: of n-grams up to order, none where it is dealt out by ranges; priors: weights of the Dirichlet priors, of order 2 first; tokens: N, all training
    tokens; types: V, distinct ones."""

    filter: Filter
    order: int
    tokens: int
    types: int
    priors: tuple[float, ...]

    def levels(self, words: Words) -> pa.Array:
        """Of each text the levels of its tokens' n-grams as bytes, the begin's first, those of a token in a row by their
        order. An n-gram's level is bounded by those of its first and of its last words."""
        tokens, row = words.sequence()
        found: list[np.ndarray] = []
        levels = None
        for hashes in ngrams(tokens, row, self.order):
            keys, at = np.unique(hashes, return_inverse=True)
            most = None
            if levels is not None:
                bound = np.minimum(levels, np.append(0, levels[:-1]))
                bound[hashes == 0] = 0
                most = np.zeros(len(keys), np.int64)
                most[at] = bound  # equal n-grams have equal bounds
            levels = self.filter.levels(keys, most)[at]
            found.append(levels.astype(np.uint8))
        return level_rows(found, row, words.rows)

    def contexts(self, levels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of every token but the begins: the levels of its n-grams and of the histories of those over order 1, in 2 order - 1
        columns; and its text."""
        sizes = pc.binary_length(levels).to_numpy(zero_copy_only=False) // self.order
        row = np.repeat(np.arange(len(levels)), sizes)
        own = np.frombuffer(b"".join(levels.to_pylist()), np.uint8).reshape(-1, self.order)
        inner = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
        before = np.flatnonzero(inner) - 1
        return np.concatenate([own[inner], own[before, : self.order - 1]], axis=1), row[inner]

    def log_probabilities(self, contexts: np.ndarray, priors: tuple[float, ...], less: float = 0.0) -> np.ndarray:
        """log10 of each token's probability, after those before it. less: what is taken from every count, 1 for a text that
        the counts hold."""
        counts = np.maximum(MEAN[contexts] - less, 0)
        p = (counts[:, 0] + 1) / (self.tokens + self.types + 1)
        for n in range(1, self.order):
            history = counts[:, self.order + n - 1]
            p = (np.minimum(counts[:, n], history) + priors[n - 1] * p) / (history + priors[n - 1])
        return np.log10(p)

    def score(self, words: Words) -> np.ndarray:
        """log10 of each text's probability, its end included."""
        return self.scores(self.levels(words))

    def scores(self, levels: pa.Array) -> np.ndarray:
        """The same of the levels of texts."""
        contexts, row = self.contexts(levels)
        return np.bincount(row, self.log_probabilities(contexts, self.priors), len(levels))


def fit(docs: DataFrame, counted: DataFrame, order: int = ORDER, most: int = MOST, range_size: int = RANGE) -> Model:
    """The counts of the rows of docs (doc_id, text) that are not held out; its prior weights are still those in the middle.
    counted: their word_counts. Without a filter where their n-grams, repeated ones included, are too many for `most` bits."""
    train = docs.where(~held_out()).select("doc_id", "text")
    sizes = counted.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("tokens"), F.count_if(F.col("train") > 0).alias("types")).first()
    ends = counted.where("word IS NULL").agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n")).first()["n"]
    if order * (sizes["tokens"] + ends) > most // BITS:
        found = None
    else:
        found = build_filter(train, sizes["tokens"] + ends, order, most, range_size) if ends else Filter(Shape.of(1), np.zeros((1, 128), np.uint8))
    return Model(found, order, sizes["tokens"], sizes["types"], (PRIORS[3],) * (order - 1))


def context_counts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(code, n) of the contexts of batches (levels): the numbers of a context as one, and how many tokens have it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def together() -> pa.RecordBatch:
        codes, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    for batch in batches:
        for piece in chunks(batch, "levels", _LEVELS):
            contexts, _ = model.contexts(piece.column("levels"))
            codes = np.zeros(len(contexts), np.int64)
            for i in range(contexts.shape[1]):
                codes = codes * len(MEAN) + contexts[:, i]
            codes, n = np.unique(codes, return_counts=True)
            held.append((codes, n.astype(np.int64)))
            if sum(len(codes) for codes, _ in held) >= _CONTEXTS:
                yield together()
    if held:
        yield together()


def level_scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Batches with their levels, the last column, made scores."""
    for batch in batches:
        for piece in chunks(batch, "levels", _LEVELS):
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(model.scores(piece.column("levels")))], [*piece.schema.names[:-1], "score"])


def choose_priors(levels: DataFrame, model: Model) -> tuple[float, ...]:
    """The prior weights of those in PRIORS that score all rows of levels (levels: of training texts) best, each row without
    itself. Tokens in equal contexts (levels of n-grams and histories) are counted first: contexts are few."""
    tried: list[tuple[float, ...]] = [()]
    for _ in range(model.order - 1):
        tried = [(*t, p) for t in tried for p in PRIORS]
    width, base = 2 * model.order - 1, len(MEAN)
    bare = replace(model, filter=None)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tried))
        for batch in batches:
            codes, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            contexts = np.stack([codes // base**i % base for i in reversed(range(width))], axis=1)
            total -= [(n * bare.log_probabilities(contexts, t, 1.0)).sum() for t in tried]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tried))), pa.array(total)], ["at", "loss"])

    counted = levels.select("levels").mapInArrow(lambda batches: context_counts(batches, bare), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = counted.mapInArrow(losses, "at long, loss double").groupBy("at").agg(F.sum("loss").alias("loss")).collect()
    best = min(rows, key=lambda r: (float(f"{r['loss']:.12g}"), r["at"]), default=None)
    return tried[best["at"]] if best else model.priors


class Head:
    """Frequent words with their training counts, by the hash of a word; the words themselves are compared."""

    def __init__(self, words: pa.Array, train: np.ndarray):
        hashes = hashes_of(words)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        alone = np.ones(len(hashes), bool)
        alone[1:] &= hashes[1:] != hashes[:-1]
        alone[:-1] &= hashes[1:] != hashes[:-1]
        self.left_out = words.take(pa.array(order[~alone])).to_pylist()
        self.hashes, self.words, self.train = hashes[alone], words.take(pa.array(order[alone])), train[order[alone]]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word, whether it is here and its training count."""
        if not len(self.hashes) or not len(words.words):
            return np.zeros(len(words.words), bool), np.zeros(len(words.words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes()), len(self.hashes) - 1)
        here = pc.equal(self.words.take(pa.array(at)), words.words.cast(self.words.type)).to_numpy(zero_copy_only=False)
        return here, np.where(here, self.train[at], 0)


def _head(counted: DataFrame, head: int) -> tuple[int, Head]:
    """The least power of two such that the words that occur so often take head bytes at most, and those words."""
    held = counted.where("word IS NOT NULL").withColumn("level", F.floor(F.log2("n")).cast("int"))
    sizes = {r["level"]: r["size"] for r in held.groupBy("level").agg(F.sum(F.octet_length("word") + 16).alias("size")).collect()}
    at, total = max(sizes, default=-1) + 1, 0
    while at > 0 and total + sizes.get(at - 1, 0) <= head:
        at -= 1
        total += sizes.get(at, 0)
    words = held.where(F.col("n") >= 1 << at).select("word", "train").toArrow()
    return at, Head(words.column("word").combine_chunks(), words.column("train").to_numpy())


def score_texts(docs: DataFrame, model: Model, counted: DataFrame, head: int = HEAD, range_size: int = RANGE, same: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): row (a number of its own), doc_id, n_tokens, n_known, base_score, score, the prior weights
    chosen on all training rows. head: bytes of the words that are broadcast with their counts; with fewer, more words go
    through the join. The filter is probed once: the levels that are found are written, for the choice and for the scores.
    Where the filter is dealt out docs are cut into pieces twice, and written before unless they are the same (files that are
    read as they are); a piece that changed raises an error."""
    at, frequent = _head(counted, head)
    ends = counted.where("word IS NULL").agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n")).first()["n"]
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast((model, frequent))
    whole, order = model.tokens + model.types + 1, model.order
    names = ["row", "doc_id", "train", "n_tokens", "n_known", "base_score", "levels"]

    def filled(piece: pa.RecordBatch, words: Words, levels: pa.Array) -> pa.RecordBatch:
        frequent = shared.value[1]
        here, train = frequent.find(words)
        logs = np.where(here, np.log10((train + 1) / whole), 0.0)
        n = np.bincount(words.row, minlength=words.rows) + 1
        known = np.bincount(words.row, (train > 0)[words.at], words.rows).astype(np.int64) + (ends > 0)
        base = np.bincount(words.row, logs[words.at], words.rows) + math.log10((ends + 1) / whole)
        away = ~here[words.at]
        rare, times = np.unique(words.row[away] * max(len(words.words), 1) + words.at[away], return_counts=True)
        row, word = rare // max(len(words.words), 1), rare % max(len(words.words), 1)
        cuts = pa.array(np.searchsorted(row, np.arange(words.rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, words.words.take(pa.array(word)).cast(pa.string())), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64)))]
        return pa.RecordBatch.from_arrays([piece.column("row"), piece.column("doc_id"), piece.column("train"), pa.array(n), pa.array(known), pa.array(base), levels, *lists], [*names, "rare", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, size=_SCORED):
                words = Words.of(piece.column("text"))
                yield filled(piece, words, shared.value[0].levels(words))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in numbered(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["piece", "texts"])

    def meet(texts: pa.Table, levels: pa.Table) -> pa.Table:
        (piece,) = pa.ipc.open_stream(texts.column("texts")[0].as_buffer())
        words = Words.of(piece.column("text"))
        return pa.Table.from_batches([filled(piece, words, put_back(words, order, shape, levels))])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (~held_out()).alias("train"), "text")
    schema = f"row long, doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, levels binary, rare array<string>, times array<long>"
    if model.filter:
        probed = rows.mapInArrow(run, schema)
    else:
        if not same:
            rows = materialize(rows, "rows")
        shape = Shape(min(23, Shape.of(order * (model.tokens + ends), range_size=range_size).ranges), 0, 0)
        levels = dealt_levels(rows, order, shape)
        probed = rows.mapInArrow(pack, "piece long, texts binary").groupBy("piece").cogroup(levels.groupBy("piece")).applyInArrow(meet, schema)
    probed = materialize(probed, "probed")
    final = replace(model, filter=None, priors=choose_priors(probed.where("train"), model) if ends else model.priors)

    columns = ["row", "doc_id", "n_tokens", "n_known", "base_score"]
    scored = probed.select(*columns, "levels").mapInArrow(lambda batches: level_scores(batches, final), f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    if not at and not frequent.left_out:  # every word was in the table
        return scored
    rare = probed.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    others = counted.where((F.col("n") < 1 << at) | F.col("word").isin(frequent.left_out)).select("word", "train")
    more = rare.join(others, "word").groupBy("row").agg(
        F.sum(F.when(F.col("train") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((F.col("train") + 1) / F.lit(whole))).alias("more_base")
    )
    plus = lambda name, other: (F.col(name) + F.coalesce(other, F.lit(0))).alias(name)
    return scored.join(more, "row", "left").select("row", "doc_id", "n_tokens", plus("n_known", "more_known"), plus("base_score", "more_base"), "score")


def score_documents(docs: DataFrame, order: int = ORDER, most: int = MOST, head: int = HEAD, range_size: int = RANGE, same: bool = False) -> DataFrame:
    """Per row of docs: row, doc_id, n_tokens, n_known, train_tokens, base_score, score, from a model of the rows of docs that
    are not held out.

    Tokens are words and one end. A null text is an empty one: only an end. Rows are documents of their own, also where
    ids are null or repeated; a null id counts as the empty text where the remainder is taken. Without training rows N
    and V are 0 and every token has probability 1. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    bound_batches(docs.sparkSession)
    counted = word_counts(docs.select("text", (~held_out()).cast("int").alias("train")))
    model = fit(docs, counted, order, most, range_size)
    return score_texts(docs, model, counted, head, range_size, same).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def query(spark, sf_dir):
    found = score_documents(table(spark, sf_dir, "documents"), same=True)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
