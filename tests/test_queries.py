from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from oracle import database, difference
from spreadloom.plans import catalog

REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, data, db, name):
    assert not difference(spark, db, catalog.QUERIES[name], catalog.ORACLE[name], data)


@pytest.mark.parametrize("name", ["backtest_results_given", "backtest_trades_given"])
def test_same_rows_as_sql_where_windows_fit(spark, data, name):
    """The smallest tables are shorter than a window of 900 rows."""
    data = data.replace("0.001", "0.01")
    assert not difference(spark, database(data), catalog.QUERIES[name], catalog.ORACLE[name], data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_gives_rows(spark, data, name):
    df = catalog.QUERIES[name](spark, data.replace("0.001", "0.01") if name in ("walk_forward", "walk_forward_windows", "trade_log") else data)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_package(tmp_path):
    (tmp_path / "spreadloom").mkdir()
    for p in (REPO / "spreadloom").iterdir():
        if p.name != "llm":
            (tmp_path / "spreadloom" / p.name).symlink_to(p)
    (tmp_path / "spreadloom" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)}, check=True)
