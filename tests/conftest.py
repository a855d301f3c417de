import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(DATA).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return v


@pytest.fixture(scope="session")
def same_rows(spark, duck, data_dir):
    """Compares a query with its SQL on the small tables."""

    def compare(query, sql):
        df = query(spark, data_dir)
        cols = sorted(df.columns)
        mine = sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        assert mine == theirs

    return compare
