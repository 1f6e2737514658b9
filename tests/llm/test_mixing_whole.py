"""mix() against plain Python: order inside a source, blocks, phases, slots and places."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from scoreloom.llm import mixing


def test_blocks_places_and_slots_of_many_sources(spark):
    rng = random.Random(4)
    docs = [(i, "x" * rng.choice([0, 3, 40, 300]), f"s{rng.randrange(12)}" if i % 9 else None) for i in range(400)]
    docs += [(5, "again", "s1"), (5, "again", "s1"), (None, None, "s2"), (None, "y", "s2")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, block string")
    weights = {f"s{i}": float(i + 1) for i in range(11)} | {"": 0.25}  # s11 has none
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    found = sorted(tuple(r) for r in mixing.mix(frame, table, block_chars=200, bucket_rows=20).select("source", "block", "phase", "slot", "place", F.coalesce("doc_id", F.lit(-1)), "copy").collect())
    hashed = frame.select(F.coalesce("source", F.lit("")), F.xxhash64("doc_id"), F.coalesce("doc_id", F.lit(-1)), F.xxhash64(F.coalesce("text", F.lit(""))), F.char_length(F.coalesce("text", F.lit(""))) + 1).collect()
    expected, blocks = [], {}
    for source in sorted({r[0] for r in hashed}):
        before = 0
        rows = sorted((tuple(r)[1:] for r in hashed if r[0] == source), key=lambda r: (r[0], r[1], r[2]))
        for place, (_, doc_id, copy, size) in enumerate(rows, 1):
            expected.append((source, before // 200, place, doc_id, copy))
            before += size
        blocks[source] = math.ceil(before / 200)
    assert sorted((s, b, p, d, c) for s, b, _, _, p, d, c in found) == sorted(expected)
    weights["s11"] = float(sum(map(Fraction, weights.values())) / 240)
    slots = {(s, b): (phase, slot) for s, b, phase, slot in mixing.schedule((s, n, weights[s]) for s, n in blocks.items())}
    assert all((phase, slot) == slots[s, b] for s, b, phase, slot, *_ in found)
    order = sorted((slot, phase, s) for (s, _), (phase, slot) in slots.items())
    assert [slot for slot, *_ in order] == list(range(sum(blocks.values())))
    left = dict(blocks)
    for phase in sorted({p for _, p, _ in order}):
        inside, alive = [s for _, p, s in order if p == phase], {s for s, n in left.items() if n}
        for t in range(1, len(inside) + 1):
            assert all(abs(inside[:t].count(s) - weights[s] / sum(weights[x] for x in alive) * t) < 1 for s in alive)
        for s in inside:
            left[s] -= 1
    assert not any(left.values())
