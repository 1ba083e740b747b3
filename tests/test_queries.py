"""Every query against its SQL on the smallest tables, and the library without the optional parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got, want = df.collect(), con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    pick = lambda rows, cols: sorted(tuple(repr(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert pick(got, df.columns) == pick(want.fetchall(), want.columns)


def test_the_rest_needs_no_optional_part():
    code = "import sys; sys.modules['quern.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])
