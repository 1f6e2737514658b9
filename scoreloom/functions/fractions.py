"""Exact fractions as struct<num, den> columns, and whole ticks for sums of them. They are reduced in Arrow batches: Euclid's
steps as a fold over each row's own sequence took most of the time of all queries on times."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "struct<num:bigint,den:bigint>"


def _longs(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.maximum(np.gcd(_longs(a), _longs(b)), 1))


def _frac(num: pa.Array, den: pa.Array) -> pa.Array:
    n, d = _longs(num), _longs(den)
    g = np.maximum(np.gcd(n, d), 1) * np.where(d < 0, -1, 1)
    bad = pc.or_(pc.or_(pc.is_null(num), pc.is_null(den)), pa.array(d == 0))
    return pa.StructArray.from_arrays([pa.array(n // g), pa.array(d // g)], ["num", "den"], mask=bad)


def _lcm(dens: pa.Array) -> pa.Array:
    flat, rows = pc.list_flatten(dens), pc.list_parent_indices(dens).to_numpy(zero_copy_only=False)
    found, fits, values = np.ones(len(dens), np.int64), np.ones(len(dens), bool), _longs(flat)
    if flat.null_count:
        fits[rows[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = False
    starts = np.searchsorted(rows, np.arange(len(dens)))
    sizes = np.diff(np.append(starts, len(rows)))
    # The n-th number of all rows at once; where the product does not fit, the row is null.
    for nth in range(int(sizes.max(initial=0))):
        row = np.flatnonzero((sizes > nth) & fits)
        more = values[starts[row] + nth]
        more = more // np.maximum(np.gcd(found[row], more), 1)
        fits[row] = found[row] <= np.iinfo(np.int64).max // np.maximum(more, 1)
        found[row] = np.where(fits[row], found[row] * more, found[row])
    return pa.array(found, mask=~fits | pc.is_null(dens).to_numpy(zero_copy_only=False))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of longs, a null counting as 0. gcd(0, 0) is 1."""
    return F.arrow_udf(_gcd, "bigint")(a.cast("long"), b.cast("long"))


def frac(num: Column, den: Column) -> Column:
    """Reduced, with a positive denominator; null if the denominator is 0 or either is null."""
    return F.arrow_udf(_frac, KIND)(num.cast("long"), den.cast("long"))


def frac_parse(text: Column) -> Column:
    """'3/8', '1' or blank (0)."""
    parts = F.split(F.trim(text), r"\s*/\s*")
    num = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0)).otherwise(parts[0].cast("long"))
    return frac(num.cast("long"), F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).cast("long")).otherwise(F.lit(1).cast("long")))


def frac_add(a: Column, b: Column, sign: int = 1) -> Column:
    """Null where a product does not fit a long."""
    num = F.try_add(F.try_multiply(a["num"], b["den"]), sign * F.try_multiply(b["num"], a["den"]))
    return frac(num, F.try_multiply(a["den"], b["den"]))


def frac_sub(a: Column, b: Column) -> Column:
    return frac_add(a, b, -1)


def frac_str(f: Column) -> Column:
    return F.when(f["num"] == 0, "0").when(f["den"] == 1, f["num"].cast("string")).otherwise(F.concat(f["num"].cast("string"), F.lit("/"), f["den"].cast("string")))


def lcm_of(dens: Column) -> Column:
    """Least common multiple of an array of positive longs; null where it does not fit."""
    return F.arrow_udf(_lcm, "bigint")(dens.cast("array<bigint>"))


def dotted(num: Column, den: Column, dots: Column) -> Column:
    """d (2^(n+1) - 1) / 2^n for 0 to 12 dots."""
    return frac(num * (F.pow(F.lit(2), dots + 1).cast("long") - 1), den * F.pow(F.lit(2), dots).cast("long"))


def tuplet(num: Column, den: Column, actual: Column, normal: Column) -> Column:
    return frac(num * normal, den * actual)
