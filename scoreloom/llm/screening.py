"""Pairs of a group that may be similar sets, by their sizes and by bounds from hashed signatures of their members."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PAIRS, PAIR_WORDS = 1 << 18, 1 << 19  # pairs, and 64-bit words of signatures, that are looked at together


def signatures(h: np.ndarray, row: np.ndarray, n: int, words: int) -> np.ndarray:
    """(n, words): the bits that the hashes of each row's members choose. words: a power of two."""
    found = np.zeros(n * words, np.uint64)
    np.bitwise_or.at(found, row * words + ((h >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return found.reshape(n, words)


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """The same for `words` 64-bit words: bit i stands for all bits that are i modulo the shorter length."""
    while signature.shape[1] > words:
        half = signature.shape[1] // 2
        signature = signature[:, :half] | signature[:, half:]
    return signature


def packed(signature: np.ndarray, words: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A binary column of the signatures of these rows, each folded to its words."""
    kinds = np.unique(words)
    flat = np.concatenate([folded(signature, int(w)) for w in kinds], axis=1) if len(kinds) else signature
    begins = np.concatenate(([0], np.cumsum(kinds)[:-1]))
    start = begins[np.searchsorted(kinds, words[rows])]
    count = words[rows]
    ends = np.cumsum(count)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
    data = flat[np.repeat(rows, count), np.repeat(start, count) + inside]
    offsets = np.concatenate(([0], ends * 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of such a column, (n, words of the longest), zeros where one is shorter; and the words of each."""
    if not len(column):
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    data = np.frombuffer(column.buffers()[2], np.uint8, int(bounds[-1]) * 8).view(np.uint64)[bounds[0] :]
    count = np.diff(bounds)
    return spread_out(data, count), count


def spread_out(data: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(n, words of the longest) of signatures of so many words each that follow each other; zeros where one is shorter."""
    found = np.zeros((len(count), int(count.max(initial=1))), np.uint64)
    found[np.repeat(np.arange(len(count)), count), np.arange(len(data)) - np.repeat(np.cumsum(count) - count, count)] = data
    return found


def runs(part: np.ndarray, columns: list[np.ndarray | pa.Array]) -> list[pa.Array]:
    """Rows of numbers of 64 bits, or of binaries, as one row for each part: the part, and the values of its rows in one binary."""
    order = np.argsort(part.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(part[order], prepend=-1))
    ends = np.append(first, len(order))
    found = [pa.array(part[order][first].astype(np.int32))]
    for c in columns:
        if isinstance(c, pa.Array):
            c = c.take(pa.array(order))
            data, offsets = c.buffers()[2], np.frombuffer(c.buffers()[1], np.int32, len(c) + 1)[ends]
        else:
            data, offsets = pa.py_buffer(c[order].tobytes()), (8 * ends).astype(np.int32)
        found.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), data]))
    return found


def values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of 64 bits in such a column of binaries, one after the other, and how many each row has."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    return np.frombuffer(column.buffers()[2], np.int64, int(bounds[-1] - bounds[0]), int(bounds[0]) * 8), np.diff(bounds)


def close_pairs(group: np.ndarray, size: np.ndarray, signature: np.ndarray, words: np.ndarray, per_cent: int, wanted: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by group and size: (u, v), u before v, of pairs of a group whose Jaccard coefficient may be
    per_cent / 100, by their sizes, by wanted(u, v) and by the bits in which their signatures differ."""
    number = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
    combined = number * (1 << 40) + size
    start = np.searchsorted(combined, number * (1 << 40) + (per_cent * size + 99) // 100)
    ends = np.cumsum(np.arange(len(group)) - start)
    by_words = {int(w): folded(signature, int(w)) for w in np.unique(words)}
    at = 0
    while at < len(group):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        count = np.arange(at, stop) - start[at:stop]
        v = np.repeat(np.arange(at, stop), count)
        u = np.arange(len(v)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[at:stop], count)
        at = stop
        good = wanted(u, v)
        u, v = u[good], v[good]
        differ = np.zeros(len(u), np.int64)
        for w, bits in by_words.items():
            own = np.flatnonzero(words[u] == w)  # u is the shorter
            for part in np.array_split(own, max(1, len(own) * w // PAIR_WORDS)):
                differ[part] = np.bitwise_count(bits[u[part]] ^ bits[v[part]]).sum(axis=1)
        both = size[u] + size[v]
        good = (100 + per_cent) * ((both - differ) // 2) >= per_cent * both
        yield u[good], v[good]


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the pairs (u, v) connect, one for each row but the first of what is connected."""
    ids, ends_at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends_at[: len(u)], ends_at[len(u) :]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    kept = root != np.arange(len(ids))
    return ids[root[kept]], ids[kept]


def whole_groups(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column, as lists of arrays, cut anew so that each holds whole groups of it."""
    held: list[list[np.ndarray]] = []

    def together():
        return [np.concatenate(x) if x[0].ndim == 1 else _stacked(x) for x in zip(*held, strict=True)]

    for batch in batches:
        if not len(batch):
            continue
        rows = columns(batch)
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group's rows may go on in the next batch
        if cut or (held and held[-1][0][-1] != rows[0][0]):
            held.append([r[:cut] for r in rows])
            whole = together()
            if len(whole[0]):
                yield whole
            held = []
        held.append([r[cut:] for r in rows])
    if held:
        yield together()


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    found = np.zeros((sum(map(len, parts)), width), np.uint64)
    at = 0
    for p in parts:
        found[at : at + len(p), : p.shape[1]] = p
        at += len(p)
    return found
