import math
import random
import statistics

import pytest

from scoreloom.operators import facts, sequences


def plain(sizes, r):
    v = sorted(x for x in sizes if x is not None and x > 0)
    best = None
    for k in range(1, len(v)) if len(v) >= 3 else ():
        low, high = v[:k], v[k:]
        gap, spread = high[0] / max(low[-1], 0.001), low[-1] / max(low[0], 0.001)
        a, b = statistics.median(low), statistics.median(high)
        if gap < r.gap or k / len(v) > r.share or len(high) < r.least_large or spread > r.spread or not r.small[0] <= a <= r.small[1] or not r.large[0] <= b <= r.large[1] or a > b * r.medians:
            continue
        score = math.log(gap) - r.spread_weight * math.log(max(spread, 1.0))
        if best is None or score > best[0]:
            best = (score, round(math.sqrt(low[-1] * high[0]), 9), k, len(high), round(a, 9), round(b, 9))
    return best and best[1:]


@pytest.mark.parametrize("rules", [sequences.DOT_RULES, sequences.GRACE_RULES])
def test_splits_against_plain_python(spark, rules):
    rng = random.Random(5)
    groups = {}
    for g in range(80):
        large = [rng.uniform(0.9, 1.3) for _ in range(rng.randint(0, 12))]
        groups[g] = large + [rng.uniform(0.3, 0.85) * rng.choice([1, 1, 0.98]) for _ in range(rng.randint(0, 4))] + rng.choice([[], [0.0], [None]])
    df = spark.createDataFrame([(g, f"i{k}", v) for g, own in groups.items() for k, v in enumerate(own)], "g int, id string, v double")
    found = {r["g"]: (round(r["threshold"], 9), r["n_small"], r["n_large"], round(r["small_median"], 9), round(r["large_median"], 9)) for r in sequences.size_split(df, ["g"], "id", "v", rules).collect()}
    expected = {g: p for g, own in groups.items() if (p := plain(own, rules))}
    assert found == expected and len(expected) > 3


def test_clefs_count_where_systems_begin(spark):
    clefs = spark.createDataFrame(
        [("s", 1, 1, 5.0, 0.9, "G", 2, 0), ("s", 1, 1, 80.0, 0.9, "F", 4, 0), ("s", 1, 2, 5.0, 0.9, "F", 4, 0), ("s", 1, 3, 5.0, 0.5, "C", 3, 0), ("s", 1, 3, 5.0, 0.9, "F", 4, 0), ("s", 1, 4, 5.0, 0.9, "F", 4, 0), ("s", 2, 1, 5.0, 0.9, "F", 4, 0)],
        "score_id string, staff int, measure_no int, x double, confidence double, sign string, line int, octave_change int",
    )
    measures = spark.createDataFrame([("s", i, b, 0.0, 100.0) for i, b in ((1, None), (2, None), (3, "system"), (4, "page"))], "score_id string, measure_no int, break_before string, x_start double, x_end double")
    assert sorted((r["staff"], r["measure_no"], r["sign"]) for r in facts.clef_changes(clefs, measures).collect()) == [(1, 1, "G"), (1, 3, "F"), (2, 1, "F")]
