import random

import numpy as np
import pyarrow as pa

from scoreloom.llm import line_dedup as m
from scoreloom.llm import screening


def test_small_tiles_are_compared_together(monkeypatch):
    """The words of a hundred tiles are hashed in a few calls, and tasks are told apart over batches."""
    calls, plain = [], m.line_sets
    monkeypatch.setattr(m, "line_sets", lambda *x: calls.append(1) or plain(*x))
    rng = random.Random(8)
    rows = []
    for t in range(100):
        side = t % 3 == 0
        for k in range(rng.randrange(2, 6)):
            words = [f"t{t}w{i}" for i in range(10)]
            words[rng.randrange(10)] = f"x{rng.randrange(3)}"
            rows.append((f"{t:03}", 1 + k % 2 if side else 0, len(rows), -len(rows), rng.choice([None, 1, 2, 3]), len(rows), " ".join(words)))
    names = ["task", "side", "node", "check", "doc_id", "line_no", "line"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    expected = set()
    for t, side, node, _, doc, no, line in rows:
        for u, other, _, _, d, n, text in rows:
            if u == t and (side != other or not side) and ((d is not None, d or 0), n) < ((doc is not None, doc or 0), no):
                a, b = set(line.split()), set(text.split())
                if 100 * len(a & b) >= 80 * len(a | b):
                    expected.add(node)
    for size in (7, 1000):
        found = pa.Table.from_batches(m._compare(80)(iter([batch.slice(at, size) for at in range(0, len(batch), size)])))
        assert set(found["node"].to_pylist()) == expected and found["check"].to_pylist() == [-x for x in found["node"].to_pylist()]
    assert expected and len(calls) < 100


def test_rows_of_words_are_packed_by_range_and_come_back():
    rng = np.random.default_rng(3)
    key, words = rng.integers(-(1 << 62), 1 << 62, 500), rng.choice([2, 4, 8, 16], 500)
    signature = rng.integers(0, 1 << 62, (500, 16)).astype(np.uint64)
    bits = screening.packed(signature, words, np.arange(500))
    part, keys, flat = screening.runs(key & 63, [key, bits])
    assert len(part) == len(set((key & 63).tolist())) and screening.values(keys.slice(3, 2))[1].tolist() == [int((key & 63 == p).sum()) for p in part.to_pylist()[3:5]]
    order = np.argsort(key & 63, kind="stable")
    assert (screening.values(keys)[0] == key[order]).all() and (screening.values(keys)[1].sum()) == 500
    back = screening.spread_out(screening.values(flat)[0].view(np.uint64), words[order])
    assert (back == screening.unpacked(bits)[0][order]).all()


def test_words_that_share_leading_bits_and_very_long_lines_stay_together():
    key = np.array([5, 6, 5, 6, 5, 1 << 40, 7])
    for size in ([3, 2, 2, 3, 1, 9, 9], [3, 2, 1 << 21, 1 << 22, 1, 9, 9]):
        place = np.array(size) << 24
        order = m.by_word_and_size(key, place)
        assert sorted(order.tolist()) == list(range(7))
        runs = [(k, s) for k, s in zip(key[order].tolist(), np.array(size)[order].tolist(), strict=True)]
        assert runs == sorted(runs)
