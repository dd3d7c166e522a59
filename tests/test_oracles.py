"""Every query that has SQL gives the same rows as the SQL does, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CORPUS = set(entry.corpus.QUERIES) | {"pipeline"} if entry.corpus else set()


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return str(x) if x is not None else None


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - CORPUS))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in got.description)
    order = [[d[0] for d in got.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=str)
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == columns
    have = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    assert have == want
    assert have


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - CORPUS))
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0
