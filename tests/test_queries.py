"""Every query with SQL against DuckDB on the smallest tables; the rest must run."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = Path(__spark_entry__.SMALLEST)
NAMES = sorted(n for n in __spark_entry__.queries() if n.startswith(("q_", "s_")))


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    found = __spark_entry__.queries()[name](spark, str(SF))
    cols = sorted(found.columns)
    rows = sorted((tuple(map(plain, r)) for r in found.select(*cols).collect()), key=str)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in SF.glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        expected = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
        assert rows == sorted((tuple(map(plain, r)) for r in expected), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
