"""Vectorised 64-bit hashes of the words of many texts, and sets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LONG = 1024  # bytes of a word that is hashed by itself
_CHUNK = 1 << 19  # bytes that are hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_factors = np.zeros(0, np.uint64)


def _factor_table(longest: int) -> np.ndarray:
    """An odd number for each place in a word, without a relation from one to the next."""
    global _factors
    if len(_factors) < longest:
        n = 1 << max(longest - 1, 63).bit_length()
        _factors = mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return _factors


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each word (run of other characters than white space, A-Z lower-cased) of a text: its hash and first byte.

    The hash takes eight bytes of the word at a time into what it has and mixes them, so words of one size up to eight
    bytes never share one. Of longer words than _LONG the products of the eights with a number of their place are summed.
    """
    folded = buffer.translate(_FOLD)
    data = np.frombuffer(folded, np.uint8)
    solid = ~_WHITE[data]
    if not solid.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    edges = np.concatenate((np.zeros(int(solid[0]), np.int64), edges, np.full(int(solid[-1]), len(data))))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray((len(data) + 1,), "<u8", folded + bytes(8), 0, (1,))  # the eight bytes from each place on
    found = mix(sizes.astype(np.uint64) * _STEP)
    found = mix(found + (eights[starts] & _FIRST[np.minimum(sizes, 8)]))
    at, live = 8, np.flatnonzero((sizes > 8) & (sizes <= _LONG))
    while len(live):
        found[live] = mix(found[live] * _STEP + (eights[starts[live] + at] & _FIRST[np.minimum(sizes[live] - at, 8)]))
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        places = np.arange(0, int(sizes[i]), 8)
        values = eights[starts[i] + places] & _FIRST[np.minimum(sizes[i] - places, 8)]
        found[i] = mix(found[i : i + 1] + (values * _factor_table(len(values))[: len(values)]).sum(dtype=np.uint64))[0]
    return found, starts


def digests(hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each of many sets of hashes, as two 64-bit numbers; the order in a set does not matter."""
    mixed = mix(hashes)
    other = mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))
    n = sizes.astype(np.uint64)
    node = mix(np.add.reduceat(other, first) ^ (np.add.reduceat(mixed, first) + n))
    check = mix(np.add.reduceat(mix(mixed + np.uint64(0xA0761D6478BD642F)), first) ^ (np.add.reduceat(mix(other + _STEP), first) + n))
    return node.view(np.int64), check.view(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, of which Python objects are made one slice at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def texts_in_chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 in runs of about _CHUNK bytes, with the position of each run's first text."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= _CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of `width` words; a shorter text is one run, if not empty."""
    for _, held in texts_in_chunks(texts):
        ends = np.cumsum([len(b) + 1 for b in held])
        hashes, starts = word_hashes(b" ".join(held))
        bounds = np.searchsorted(starts, np.concatenate(([0], ends)))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = hashes[lo:hi]
            n = min(width, len(own))
            if not n:
                yield own
                continue
            total = np.full(len(own) - n + 1, n, np.uint64)
            for k in range(n):
                total += own[k : k + len(total)] * _factor_table(n)[k]
            yield np.unique(mix(total))
