"""Every named query against DuckDB on the same tables, and the entry point without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quarry.queries import SQL, TABLES, run

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, duck, name):
    got = run(name)(spark, DATA)
    want = duck.sql(SQL[name][1])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda cols, data: sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["order_multi_nulls", "order_nulls_first", "order_by_ordinal", "order_by_alias", "order_by_hidden"])
def test_whole_tables_are_sorted(spark, duck, name):
    name += "_whole"
    assert "LIMIT" not in SQL[name][0]
    got, want = run(name)(spark, DATA), duck.sql(SQL[name][1])
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == want.columns and rows == want.fetchall() and len(rows) == (1500 if "nulls" in name else 150)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "Sort [" in plan and "rangepartitioning" in plan
    if "nulls" in name:
        empty = [k is None for _, k in rows]
        assert any(empty) and empty == sorted(empty, reverse="first" in name)


def test_entry_without_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    for f in (root / "quarry").rglob("*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and 'flagship' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
