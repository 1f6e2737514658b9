"""Alignment of two tokenizers' tokens by pointer jumping, and how often their tokens meet over the corpus.

Tokens of both sides are ranges of the same bytes. Every token points to the token that overlaps it and ends farthest to
the right, itself if none ends farther; successors are doubled, for all tokens of many texts at once, until nothing
moves. Then each points to the last token of its component, and components are the groups between the offsets where
tokens of both sides end. The work is linear in the tokens but for a logarithm of the longest group.

1. One pass over the texts writes, per row, the counts, the digest of its groups and its distinct linked id pairs.
2. The pairs of all rows are counted, pre-aggregated in tasks.
3. A second pass over the written pairs looks the frequent ones up in a broadcast table of bounded size. The others are
   rare, so no key of theirs has many rows; they meet their counts in a join.

Texts are encoded in units, cut at a space between a visible ASCII character and an ASCII letter. Neither side has a token over such a place, and each
side sees the unit with a space before it, so the units' tokens are the text's tokens; equal units are encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Where the public tokenizers' files are, on the driver.
FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The most id pairs that are broadcast with their counts (12 bytes each).
HEAD = 1 << 21
_CUT = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
_INNER = re.compile(r"[A-Za-z](?:.*[!-~])?", re.DOTALL)
_JOINED = 64  # units that are encoded as one text
_CHUNK = 1 << 20  # characters that are aligned at once
_CACHED = 1 << 23  # characters of the units that a task keeps encoded
_HELD = 1 << 22  # pairs that a task counts at once
_LINKS = 1 << 22  # links that are written out at once


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from
    U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, made from their files' bytes, with the bytes of every id."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(byte_file.decode())
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        of = byte_level()
        described = json.loads(byte_file)
        vocab = {**described["model"]["vocab"], **{x["content"]: x["id"] for x in described["added_tokens"]}}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: Whether no piece goes on over a space, so that texts may be cut at spaces.
        self.cut = all(re.fullmatch("▁*[^▁]*", p) for p in pieces)

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of both sides the ids of all units, and how many each has; and whether both sides' bytes are those of a space and
        the unit. Short units that can stand inside a text are encoded as one text, cut where units end."""
        plain = np.array([self.cut and len(u) < 1000 and _INNER.fullmatch(u) is not None for u in units], bool)
        order, parts = [], []
        joined = np.flatnonzero(plain)
        if len(joined):
            ids, sizes, same = self._joined([units[i] for i in joined])
            plain[joined[~same]] = False
            order.append(joined[same])
            parts.append((ids, sizes, np.ones(int(same.sum()), bool)))
        rest = np.flatnonzero(~plain)
        if len(rest):
            order.append(rest)
            parts.append(self._single([units[i] for i in rest]))
        at = np.concatenate(order)
        back = np.argsort(at)
        ids, sizes = [], []
        for side in (0, 1):
            flat, n = (np.concatenate([p[k][side] for p in parts]) for k in (0, 1))
            first = np.cumsum(n) - n
            n, first = n[back], first[back]
            ids.append(flat[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)])
            sizes.append(n)
        return ids, sizes, np.concatenate([p[2] for p in parts])[back]

    def _sides(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        a = self._a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        return zip((x.ids for x in a), self._b.encode(texts, num_threads=1), strict=True)

    def _joined(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """As encode, without the units, which are marked, of texts that a side changes or has a token over a unit's end in."""
        texts = [units[i : i + _JOINED] for i in range(0, len(units), _JOINED)]
        ids, sizes, same = ([], []), ([], []), []
        for own, found in zip(texts, self._sides([" ".join(t) for t in texts]), strict=True):
            raw = [b" " + found_bytes(u) for u in own]
            ends, whole = np.cumsum([len(x) for x in raw]), b"".join(raw)
            flat = [np.array(x, np.int32) for x in found]
            after = [np.cumsum(lengths[x]) for x, lengths in zip(flat, (self.a_sizes, self.b_sizes), strict=True)]
            at = [np.searchsorted(x, ends) for x in after]
            good = all(b"".join(map(of.__getitem__, x)) == whole for x, of in zip(found, (self.a_bytes, self.b_bytes), strict=True))
            good = good and all((x[k] == ends).all() for x, k in zip(after, at, strict=True))
            same += [good] * len(own)
            for side in (0, 1) if good else ():
                ids[side].append(flat[side])
                sizes[side].append(np.diff(at[side], prepend=-1))
        gathered = [[np.concatenate([np.zeros(0, kind), *x]) for x in sides] for sides, kind in ((ids, np.int32), (sizes, np.int64))]
        return gathered[0], gathered[1], np.array(same, bool)

    def _single(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        found, same = list(self._sides(units)), []
        for unit, (a, b) in zip(units, found, strict=True):
            raw = b" " + found_bytes(unit)
            same.append(b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw)
        flat = [np.array([i for x in found for i in x[side]], np.int32) for side in (0, 1)]
        return flat, [np.array([len(x[side]) for x in found], np.int64) for side in (0, 1)], np.array(same, bool)


def found_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class _Encoded:
    """Ids of the units seen so far, in two flat arrays; forgotten when their characters are more than _CACHED."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.same = np.zeros(0, bool)

    def look_up(self, units: list[str]) -> np.ndarray:
        """The place of each unit in sizes and same."""
        if self.chars > _CACHED:
            self._forget()
        new = [u for u in dict.fromkeys(units) if u not in self.at]
        if new:
            ids, sizes, same = self.tokenizers.encode(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            self.ids = [np.concatenate(x) for x in zip(self.ids, ids, strict=True)]
            self.sizes = [np.concatenate(x) for x in zip(self.sizes, sizes, strict=True)]
            self.same = np.concatenate((self.same, same))
        return np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))

    def gather(self, side: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units at these places, one after the other, and how many each has."""
        sizes = self.sizes[side][at]
        first = np.cumsum(self.sizes[side]) - self.sizes[side]
        shift = first[at] - (np.cumsum(sizes) - sizes)
        return self.ids[side][np.arange(int(sizes.sum())) + np.repeat(shift, sizes)], sizes


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A token and of each B token, numbered from 0 in order, and how many there are. Both sides cover
    the same bytes without gaps; the ends are rising."""
    a_starts, b_starts = np.concatenate(([0], a_ends[:-1])), np.concatenate(([0], b_ends[:-1]))
    n = len(a_ends)
    farthest_b = np.searchsorted(b_starts, a_ends, "left") - 1  # its end is no less than the A token's
    farthest_a = np.searchsorted(a_starts, b_ends, "left") - 1
    own = np.arange(n, n + len(b_ends))
    to = np.concatenate((n + farthest_b, np.where(a_ends[farthest_a] > b_ends, farthest_a, own)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    last = to[n:] == own
    number = np.cumsum(last) - 1
    return number[to[:n] - n], number[to[n:] - n], int(last.sum())


def _distinct_pairs(doc_of_group: np.ndarray, na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, links) of the distinct pairs of each document: code is a * width + b. Links are written out a
    bounded number at a time; in a large group, equal ids are counted first."""
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    links = na * nb
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def distinct(doc: np.ndarray, code: np.ndarray, weight: np.ndarray | None) -> None:
        key = (doc.astype(np.uint64) << np.uint64(40)) | code.astype(np.uint64)
        if weight is None:
            found, times = np.unique(key, return_counts=True)
        else:
            found, at = np.unique(key, return_inverse=True)
            times = np.zeros(len(found), np.int64)
            np.add.at(times, at, weight)
        parts.append((found >> np.uint64(40), found & np.uint64((1 << 40) - 1), times))

    small = np.flatnonzero(links <= 4096)
    cuts = np.searchsorted(np.cumsum(links[small]), np.arange(_LINKS, int(links[small].sum()) + _LINKS, _LINKS), "right")
    for part in np.split(small, cuts[:-1]) if len(small) else []:
        n = links[part]
        if not n.sum():
            continue
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        per = np.repeat(nb[part], n)
        code = a[np.repeat(first_a[part], n) + within // per].astype(np.int64) * width + b[np.repeat(first_b[part], n) + within % per]
        distinct(np.repeat(doc_of_group[part], n), code, None)
    for g in np.flatnonzero(links > 4096):
        x, times_x = np.unique(a[first_a[g] : first_a[g] + na[g]], return_counts=True)
        y, times_y = np.unique(b[first_b[g] : first_b[g] + nb[g]], return_counts=True)
        step = max(1, _LINKS // len(y))
        for k in range(0, len(x), step):
            code = (x[k : k + step, None].astype(np.int64) * width + y[None, :]).ravel()
            distinct(np.full(len(code), doc_of_group[g]), code, (times_x[k : k + step, None] * times_y[None, :]).ravel())
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    doc, code, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    distinct(doc, code, times)
    return parts[0]


_ALIGNED = "row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, links binary"


class Aligner:
    """Aligns texts by the bounded chunk; codes of pairs are A id * width + B id."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.units = tokenizers, _Encoded(tokenizers)
        self.width = len(tokenizers.b_bytes)
        most = max(len(tokenizers.a_bytes), self.width)
        self._written = [np.array([f"{i}{sep}" for i in range(most)], object) for sep in ",|;"]

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, bytes, bytes]]:
        """n_a, n_b, n_groups, n_links, groups as text, codes and links of each text."""
        held: list[str | None] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= _CHUNK:
                yield from self._chunk(held)
                held, size = [], 0
        if held:
            yield from self._chunk(held)

    def _chunk(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, bytes, bytes]]:
        units = [(_CUT.split(t) if self.tokenizers.cut else [t]) if t else [] for t in texts]
        counts = np.array([len(u) for u in units], np.int64)
        flat = [u for own in units for u in own]
        at = self.units.look_up(flat)
        doc = np.repeat(np.arange(len(texts)), counts)
        wrong = np.zeros(len(texts), bool)
        wrong[doc[~self.units.same[at]]] = True
        for d in np.flatnonzero(wrong):
            wrong[d] = not self._same(texts[d], at[doc == d])
        at, doc = at[~wrong[doc]], doc[~wrong[doc]]
        a, a_sizes = self.units.gather(0, at)
        b, b_sizes = self.units.gather(1, at)
        a_doc, b_doc = np.repeat(doc, a_sizes), np.repeat(doc, b_sizes)
        a_group, b_group, n = groups(np.cumsum(self.tokenizers.a_sizes[a]), np.cumsum(self.tokenizers.b_sizes[b]))
        na, nb = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        doc_of_group = np.zeros(n, np.int64)
        doc_of_group[a_group] = a_doc
        pair_doc, code, links = _distinct_pairs(doc_of_group, na, nb, a, b, self.width)

        text = np.empty(len(a) + len(b), object)
        ends_a = np.append(a_group[1:] != a_group[:-1], True) if len(a) else np.zeros(0, bool)
        ends_b = np.append(b_group[1:] != b_group[:-1], True) if len(b) else np.zeros(0, bool)
        before = np.cumsum(nb) - nb
        through = np.cumsum(na)
        comma, bar, semicolon = self._written
        text[np.arange(len(a)) + before[a_group]] = np.where(ends_a, bar[a], comma[a])
        text[np.arange(len(b)) + through[b_group]] = np.where(ends_b, semicolon[b], comma[b])

        rows = len(texts)
        n_a, n_b = np.bincount(a_doc, minlength=rows), np.bincount(b_doc, minlength=rows)
        n_groups = np.bincount(doc_of_group, minlength=rows)
        n_links = np.zeros(rows, np.int64)
        np.add.at(n_links, doc_of_group, na * nb)
        tokens = np.concatenate(([0], np.cumsum(n_a + n_b)))
        pairs = np.searchsorted(pair_doc, np.arange(rows + 1).astype(np.uint64))
        for i in range(rows):
            own = slice(int(pairs[i]), int(pairs[i + 1]))
            steps = np.diff(code[own].astype(np.int64), prepend=0).astype(np.uint64)
            yield int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(n_links[i]), "".join(text[tokens[i] : tokens[i + 1]])[:-1], packed(steps), packed(links[own].astype(np.uint64))

    def _same(self, text: str, at: np.ndarray) -> bool:
        raw = b" " + found_bytes(text)
        sides = ((0, self.tokenizers.a_bytes), (1, self.tokenizers.b_bytes))
        return all(b"".join(map(of.__getitem__, self.units.gather(side, at)[0].tolist())) == raw for side, of in sides)


def packed(numbers: np.ndarray) -> bytes:
    """The numbers in the least of 1, 2, 4 or 8 bytes that holds them all; the width comes first."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << (8 * w))
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a column of packed steps, and how many each row has."""
    found = [np.cumsum(unpacked(x)) for x in column.to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.array([len(x) for x in found], np.int64)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed codes to (code, n), summed over as many rows as fit."""
    kept, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def merge() -> None:
        nonlocal kept, times, size
        code, n = np.unique(np.concatenate(held), return_counts=True) if held else (kept[:0], times[:0])
        held.clear()
        size = 0
        both = np.concatenate((kept, code))
        kept, at = np.unique(both, return_inverse=True)
        times = np.bincount(at, np.concatenate((times, n)), len(kept)).astype(np.int64)

    for batch in batches:
        for start in range(0, len(batch), 256):
            code, _ = _codes(batch.column(0).slice(start, 256))
            held.append(code)
            size += len(code)
            if size >= _HELD:
                merge()
                if len(kept) >= _HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(times)], ["code", "n"])
                    kept, times = kept[:0], times[:0]
    merge()
    if len(kept):
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(times)], ["code", "n"])


def align(docs: DataFrame, folder: str = FOLDER, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """Every row of docs (doc_id, text) aligned and written: row (a number of its own), doc_id, n_a, n_b, n_groups,
    n_links, groups_sha256, and its distinct pairs as packed steps of codes and packed links."""
    files = [(Path(folder) / name).read_bytes() for name in (byte_file, piece_file)]
    shared = docs.sparkSession.sparkContext.broadcast(files)  # the two files, some MB
    kind = _ALIGNED.format(dict(docs.dtypes)["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Tokenizers(*shared.value))
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                rows = list(zip(*aligner.align(part.column(2).to_pylist()), strict=True))
                digests = [hashlib.sha256(x.encode()).hexdigest() if n else "" for x, n in zip(rows[4], rows[0], strict=True)]
                columns = [*(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(digests, pa.string()), pa.array(rows[5], pa.binary()), pa.array(rows[6], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "links"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return materialize(rows.mapInArrow(run, kind), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n): how many rows hold each pair linked."""
    return materialize(aligned.select("codes").mapInArrow(_count_pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pairs")


def _level(pairs: DataFrame, head: int) -> int:
    """The least power of two such that at most head pairs have counts from it on."""
    sizes = {r["level"]: r["pairs"] for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("pairs")).collect()}
    level, total = max(sizes, default=-1) + 1, 0
    while level > 0 and total + sizes.get(level - 1, 0) <= head:
        level -= 1
        total += sizes.get(level, 0)
    return level


def best_links(aligned: DataFrame, pairs: DataFrame, width: int, head: int = HEAD) -> DataFrame:
    """The rows of aligned with n_best (links whose count is the highest of their A id's) and count_sum (over links)."""
    level = _level(pairs, head)
    frequent = pairs.where(F.col("n") >= 1 << level).toArrow()  # head rows at most
    order = np.argsort(frequent.column("code").to_numpy())
    best = pairs.groupBy(F.floor(F.col("code") / width).alias("a")).agg(F.max("n").alias("best"))
    highest = best.toArrow()  # a row for an A id, so the vocabulary's size at most
    top = np.zeros(int(highest.column("a").to_numpy().max(initial=-1)) + 1, np.int64)
    top[highest.column("a").to_numpy()] = highest.column("best").to_numpy()
    shared = aligned.sparkSession.sparkContext.broadcast((frequent.column("code").to_numpy()[order], frequent.column("n").to_numpy()[order], top))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, top = shared.value
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                code, sizes = _codes(batch.column("codes"))
                links = np.concatenate([unpacked(x) for x in batch.column("links").to_pylist()])
                row = np.repeat(np.arange(len(batch)), sizes)
                at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
                found = known[at] == code if len(known) else np.zeros(len(code), bool)
                n = np.where(found, counts[at], 0) if len(known) else np.zeros(len(code), np.int64)
                total, at_best = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
                np.add.at(total, row, links * n)
                np.add.at(at_best, row, np.where(found & (n == top[code // width]), links, 0))
                rare = np.concatenate(([0], np.cumsum(np.bincount(row[~found], minlength=len(batch))))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(rare), pa.array(x[~found])) for x in (code, links)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(at_best), pa.array(total), *lists], [*names, "n_best", "count_sum", "rare", "rare_links"])

    kind = ", ".join(f"{c} {k}" for c, k in aligned.dtypes if c in names)
    scored = aligned.mapInArrow(run, f"{kind}, n_best long, count_sum long, rare array<long>, rare_links array<long>")
    if not level:  # every pair was in the table
        return scored.drop("rare", "rare_links")
    scored = materialize(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_links")).alias("x")).select("row", F.col("x.rare").alias("code"), F.col("x.rare_links").alias("links"))
    counted = rare.join(pairs.where(F.col("n") < 1 << level), "code").withColumn("a", F.floor(F.col("code") / width))
    counted = counted.join(F.broadcast(best), "a")
    more = counted.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum"))
    plus = lambda name, other: (F.col(name) + F.coalesce(other, F.lit(0))).alias(name)
    return scored.drop("rare", "rare_links").join(more, "row", "left").select(*names, plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def align_tokenizers(docs: DataFrame, folder: str = FOLDER, head: int = HEAD) -> DataFrame:
    """Per row of docs: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A encodes a space and the text by the byte-level tokenizer, B the text by the pieces, which add the space; special
    tokens' strings are plain text. A text that is null or empty, or that one side does not give back byte for byte, has
    no tokens: zeros and ''. Each row is a document of its own, also where ids are null or repeated. Other columns are
    not read. head: the most pairs that are broadcast; a smaller one sends more pairs through the join.
    """
    aligned = align(docs, folder)
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder) / PIECE_FILE)).get_piece_size()
    return best_links(aligned, pair_counts(aligned), width, head)


def query(spark, sf_dir):
    found = align_tokenizers(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
