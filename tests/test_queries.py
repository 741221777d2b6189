"""Every query with SQL against DuckDB on the same tables, and every other one for rows."""

import duckdb
import pandas as pd
import pytest

from fellside.plans import catalogue

SF = "/root/testdata/sf0.001"
#: The smallest maps have no room for a triangle.
LARGER = dict.fromkeys(("start_triangles", "best_start"), "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame):
    value = lambda v: "null" if pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)
    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, LARGER.get(name, SF)).toPandas()
    if name in catalogue.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(catalogue.ORACLE_SQL[name]).df())
    else:
        assert len(got)
