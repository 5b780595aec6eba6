import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(float(r[i]), 6) if isinstance(r[i], float | Decimal) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    got = df.collect()
    if name in ORACLES:
        found = oracle.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, found.fetchall())
    else:
        assert got


def test_entry_and_oracles(spark):
    assert entry.entry(spark).columns == ["player_id", "name", "nationality", "rating", "shown_rating", "match_count", "rank"]
    assert set(ORACLES) <= set(QUERIES)


def test_queries_stand_without_the_language_package():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)
