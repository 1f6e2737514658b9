"""Order-dependent work inside small groups (a measure, an order): many groups a call instead of a call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Columns = dict[str, list]


def each_group(df: DataFrame, by: Sequence[str], order: Sequence[str], solve: Callable[[Columns], list[tuple]], schema: str) -> DataFrame:
    """What solve makes of each group of df: it gets a group's columns as lists, in order, and returns rows of schema.

    One shuffle by the keys and a sort inside partitions; a task walks over its sorted batches and holds one group at a
    time, so a group is small by what it is (the notes of a measure), never a share of the table. Nulls are keys too.
    """
    names, kind = df.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[list] = [[] for _ in names]
        out: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys = list(zip(*(columns[names.index(b)] for b in by), strict=True))
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != now:
                    if held[0]:
                        out += solve(dict(zip(names, held, strict=True)))
                    now, held = keys[start], [c[start:end] for c in columns]
                else:
                    held = [h + c[start:end] for h, c in zip(held, columns, strict=True)]
                start = end
            if len(out) >= 4096:
                yield _batch(out, kind)
                out = []
        if held[0]:
            out += solve(dict(zip(names, held, strict=True)))
        if out:
            yield _batch(out, kind)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
