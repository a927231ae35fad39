"""Every query with SQL gives what DuckDB gives on whole small tables, and gives rows."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rows(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, str(DATA)).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0  # nothing would agree with nothing
    assert rows(got) == rows(want)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_registered_indexes(spark, size):
    found = {r.method: r.recall for r in entry.queries()["ann_recall"](spark, str(DATA.parent / size)).collect()}
    print(found)
    assert sorted(found) == ["ivf", "lsh"] and min(found.values()) >= 0.9


def test_chains_of_more_than_four_events(spark, tmp_path):
    at = lambda n: __import__("datetime").datetime(2024, 1, 1, 0, n)
    kinds = [("view", "signup"), ("purchase", "click"), ("error", "error")]
    rows = [(100 * k + 10 * n + m, 1, at(10 * k + n), float(n), kind) for k, pair in enumerate(kinds) for m, kind in enumerate(dict.fromkeys(pair)) for n in range(6)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    for n in (2, 3):
        assert entry.queries()[f"temporal_chain_{n}"](spark, str(tmp_path)).count() == 6**n


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label_id", "id", "score", "sources", "rank"] and df.count() > 0


def test_imports_without_llm():
    root = Path(entry.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts and f.name != "__spark_entry__.py" and os.sep + "tests" not in str(f):
            assert "framesift.llm" not in f.read_text(), f
