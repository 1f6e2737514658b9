import tracemalloc

import numpy as np
import pyarrow as pa

from scoreloom.llm import language_model as lm


def test_levels_of_a_large_batch_are_worked_on_in_pieces():
    draw = np.random.default_rng(3)
    sizes = draw.integers(2, 500, 6000)
    levels = pa.array([draw.integers(0, 4, 3 * n).astype(np.uint8).tobytes() for n in sizes], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(levels))), levels], ["row", "levels"])
    model = lm.Model(None, 3, 1_000_000, 1000, (30.0, 100.0))
    contexts, row = model.contexts(levels)
    expected = np.bincount(row, model.log_probabilities(contexts, model.priors), len(levels))
    whole, times = np.unique(contexts, axis=0, return_counts=True)
    tracemalloc.start()
    scores = pa.Table.from_batches(lm.level_scores(iter([batch]), model))
    counts = pa.Table.from_batches(lm.context_counts(iter([batch.select(["levels"])]), model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # of 1.5 million tokens at once it is some 300 MB
    assert scores["row"].to_pylist() == list(range(len(levels))) and np.allclose(scores["score"].to_numpy(), expected, rtol=1e-12)
    found = dict(zip(counts["code"].to_pylist(), counts["n"].to_pylist(), strict=True))
    codes = np.zeros(len(whole), np.int64)
    for i in range(whole.shape[1]):
        codes = codes * len(lm.MEAN) + whole[:, i]
    assert found == dict(zip(codes.tolist(), times.tolist(), strict=True))
