"""Joins and matchings between two sides: field comparison, bags, priorities, tiers and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import materialize
from .groupwise import Columns, each_group


def align(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join: keys, expected and actual (structs of the other columns), side ('both', 'missing', 'extra'). Null
    keys are equal."""
    pack = lambda df, name: df.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.struct(*(c for c in df.columns if c not in keys), F.lit(True).alias("present")).alias(name))
    same = reduce(lambda x, y: x & y, (F.col(f"expected_{k}").eqNullSafe(F.col(f"actual_{k}")) for k in keys))
    joined = pack(expected, "expected").join(pack(actual, "actual"), same, "full_outer")
    joined = joined.select(*(F.coalesce(f"expected_{k}", f"actual_{k}").alias(k) for k in keys), "expected", "actual")
    side = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("both")
    return joined.withColumn("side", side)


def compare_fields(pairs: DataFrame, keys: Sequence[str], spec: Sequence[tuple[str, str, Column, Column, bool]]) -> DataFrame:
    """Issue rows of aligned pairs: keys, code, category, expected, actual.

    spec: (code, category, expected, actual, wildcard); a null expected value of a wildcard field equals anything,
    a null actual value only a null.
    """
    cells = [
        F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), e.cast("string").alias("expected"), a.cast("string").alias("actual"), F.lit(wild).alias("wild"))
        for code, category, e, a, wild in spec
    ]
    rows = pairs.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    differs = ~F.col("expected").eqNullSafe(F.col("actual")) & ~(F.col("wild") & F.col("expected").isNull())
    return rows.where(differs).drop("wild")


def bag_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_left, n_right of every value of either side; null keys are equal."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def bag_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, missing (in left only), extra (in right only), as counts; equal values have no row."""
    counts = bag_counts(left, right, keys).where("n_left <> n_right")
    return counts.select(*keys, F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0)).alias("missing"), F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0)).alias("extra"))


def match_occurrences(expected: DataFrame, actual: DataFrame, keys: Sequence[str], order_expected: Sequence[str], order_actual: Sequence[str]) -> DataFrame:
    """One-to-one by key and position: the n-th row of a key on one side meets the n-th on the other. Columns as of align
    with keys and occurrence; null keys are equal. Both sides go through one shuffle by the keys."""
    pack = lambda df, name: df.select(*keys, F.struct(*(c for c in df.columns if c not in keys), F.lit(True).alias("present")).alias(name))
    rows = pack(expected, "expected").unionByName(pack(actual, "actual"), allowMissingColumns=True).repartition(*keys)
    own = [*(F.col("expected")[c] for c in order_expected), *(F.col("actual")[c] for c in order_actual)]
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, F.col("expected").isNull()).orderBy(*own)))
    met = rows.groupBy(*keys, "occurrence").agg(*(F.first(name, ignorenulls=True).alias(name) for name in ("expected", "actual")))
    side = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("both")
    return met.withColumn("side", side)


def priority_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: Sequence[tuple[str, str]]) -> DataFrame:
    """left_id, right_id, tier: one-to-one matches tier by tier, each on a pair of columns; tiers count from 1.

    In a tier, the n-th unmatched left row of a value meets the n-th unmatched right one, both by id. Rows without a
    partner have none in the result.
    """
    open_left, open_right, found = left, right, None
    for tier, (a, b) in enumerate(tiers, 1):
        nth = lambda df, key, name: df.where(F.col(key).isNotNull()).select(
            F.col(key).alias("_key"), F.col(name), F.row_number().over(Window.partitionBy(key).orderBy(name)).alias("_nth")
        )
        hits = nth(open_left, a, left_id).join(nth(open_right, b, right_id), ["_key", "_nth"]).select(left_id, right_id, F.lit(tier).alias("tier"))
        hits = materialize(hits, "matches")
        found = hits if found is None else found.unionByName(hits)
        open_left, open_right = open_left.join(hits, left_id, "left_anti"), open_right.join(hits, right_id, "left_anti")
    return found


def greedy_assignment(candidates: DataFrame, left: str, right: str, cost: Sequence[str]) -> DataFrame:
    """Candidates in order of cost, each side used once: rounds of mutually cheapest pairs give the same pairs as a
    sorted scan, as cost with both ids is a strict order. Candidates of one hub are aggregated, never gathered."""
    order = F.struct(*cost, left, right)
    open_rows = materialize(candidates.select(left, right, *(c for c in candidates.columns if c not in (left, right))).withColumn("_o", order), "candidates")
    found = None
    while not open_rows.isEmpty():
        best_left = open_rows.groupBy(left).agg(F.min("_o").alias("_bl"))
        best_right = open_rows.groupBy(right).agg(F.min("_o").alias("_br"))
        wins = materialize(open_rows.join(best_left, left).join(best_right, right).where("_o = _bl AND _o = _br").drop("_bl", "_br"), "wins")
        found = wins if found is None else found.unionByName(wins)
        open_rows = open_rows.join(wins.select(left), left, "left_anti").join(wins.select(right), right, "left_anti")
        open_rows = materialize(open_rows, "candidates")
    return (found if found is not None else open_rows).drop("_o")


def max_assignment(candidates: DataFrame, group: Sequence[str], left: str, right: str, cost: str) -> DataFrame:
    """A one-to-one matching of most pairs in each group: group, left, right. Left rows with the fewest candidates go
    first, each tries its cheapest candidates, and augmenting paths free what is taken. Groups are small (a score)."""

    def solve(rows: Columns) -> list[tuple]:
        options: dict = {}
        for item, choice in zip(rows[left], rows[right], strict=True):
            options.setdefault(item, {})[choice] = None
        owner: dict = {}

        for item in sorted(options, key=lambda x: (len(options[x]), x)):
            # Depth first over who could make room; a frame is a left item, what it may still try and what it wants now.
            seen: set = set()
            stack = [[item, iter(options[item]), None]]
            while stack:
                frame = stack[-1]
                choice = next((c for c in frame[1] if c not in seen), None)
                if choice is None:
                    stack.pop()
                    continue
                seen.add(choice)
                frame[2] = choice
                if choice in owner:
                    stack.append([owner[choice], iter(options[owner[choice]]), None])
                    continue
                for taker, _, wanted in stack:
                    owner[wanted] = taker
                break
        head = [rows[g][0] for g in group]
        return [(*head, item, choice) for choice, item in owner.items()]

    kinds = dict(candidates.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*group, left, right])
    return each_group(candidates.select(*group, left, right, cost).where(F.col(left).isNotNull() & F.col(right).isNotNull()), group, [cost, right], solve, schema)


def tiered_match(
    expected: DataFrame, actual: DataFrame, by: Sequence[str], kind: str, at: str, content: str, place: str | None = None,
    agree: dict[str, float] | None = None, base: float = 0.0, least: float = 0.72,
) -> DataFrame:
    """by, expected_id, actual_id, tier: each expected row in order of (at, id) takes an unused actual row.

    Both sides: by, id, kind, at (number), content (array of strings) and the columns of place and agree. Similarity:
    base, the weight of each column of agree that is equal, and the Jaccard coefficient of content for the rest up
    to 1. Tier 1: same kind, at and place, the most similar; 2: same kind and at, equal content; 3: same kind and a
    similarity of least or more, the closest, then most similar. What is left is tier 0 with one id null. Groups of
    `by` are small (a measure).
    """
    agree = agree or {}
    names = list(dict.fromkeys([*by, "id", kind, at, content, *([place] if place else []), *agree]))
    rest_weight = 1.0 - base - sum(agree.values())
    own = [c for c in names if c not in by]

    def solve(rows: Columns) -> list[tuple]:
        head = tuple(rows[b][0] for b in by)
        sides: tuple[list[dict], list[dict]] = ([], [])
        for side, *values in zip(rows["_side"], *(rows[c] for c in own), strict=True):
            sides[side].append(dict(zip(own, values, strict=True)) | {"_set": frozenset(values[own.index(content)] or ())})
        free = {y["id"]: y for y in sides[1]}

        def alike(x: dict, y: dict) -> float:
            p, q = x["_set"], y["_set"]
            shared = len(p & q) / len(p | q) if p or q else 1.0
            return base + sum(w for c, w in agree.items() if x[c] == y[c]) + rest_weight * shared

        out = []
        for x in sides[0]:
            peers = [y for y in free.values() if y[kind] == x[kind]]
            now = [y for y in peers if y[at] == x[at]]
            tiers = (
                lambda: (1, [(-alike(x, y), y["id"]) for y in now if place is None or x[place] == y[place]]),  # noqa: B023
                lambda: (2, [(0.0, y["id"]) for y in now if sorted(y[content] or ()) == sorted(x[content] or ())]),  # noqa: B023
                lambda: (3, [(abs(y[at] - x[at]), -alike(x, y), y["id"]) for y in peers if alike(x, y) >= least]),  # noqa: B023
            )
            tier, options = next(((t, o) for t, o in (make() for make in tiers) if o), (0, []))
            pick = min(options)[-1] if options else None
            free.pop(pick, None)
            out.append((*head, x["id"], pick, tier))
        return out + [(*head, None, y, 0) for y in free]

    kinds = dict(expected.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"expected_id {kinds['id']}", f"actual_id {kinds['id']}", "tier int"])
    both = expected.select(*names, F.lit(0).alias("_side")).unionByName(actual.select(*names, F.lit(1).alias("_side")))
    return each_group(both, by, [at, "id"], solve, schema)


def align_labels(evidence: DataFrame, left: str, right: str, n: str, min_n: int = 2, min_share: float = 0.75) -> DataFrame:
    """left, right, n: label pairs with enough common evidence, one-to-one, strongest first.

    evidence: a count for each pair of labels. A pair needs min_n and min_share of all evidence of either label.
    """
    totals = evidence.groupBy(left).agg(F.sum(n).alias("_l")), evidence.groupBy(right).agg(F.sum(n).alias("_r"))
    strong = evidence.join(totals[0], left).join(totals[1], right)
    strong = strong.where((F.col(n) >= min_n) & (F.col(n) >= F.col("_l") * min_share) & (F.col(n) >= F.col("_r") * min_share))
    return greedy_assignment(strong.select(left, right, n, (-F.col(n)).alias("_minus")), left, right, ["_minus"]).drop("_minus")


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays as sets; 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)
