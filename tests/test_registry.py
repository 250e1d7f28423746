"""Every registered query without the corpus subpackage runs and has the columns its SQL has."""

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)

    def texts(df):
        return sorted(map(tuple, df[columns].astype(str).replace({"None": "-", "nan": "-", "<NA>": "-", "NaN": "-"}).to_numpy()))

    assert texts(got) == texts(want)
