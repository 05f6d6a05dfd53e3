"""Every query of the catalogue against its SQL in DuckDB."""

import os
from pathlib import Path

import pytest

from quirefold.plans import catalog

DATA = os.environ.get("QUIREFOLD_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, DATA).toPandas()) == plain(duck.execute(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE.keys()))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_library_stands_alone():
    """Nothing outside the folder of training-data operators imports it."""
    root = Path(__file__).resolve().parent.parent
    for path in (root / "quirefold").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quirefold.llm" not in path.read_text(), path
