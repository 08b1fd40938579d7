"""Every query of the catalogue against the same relation in SQL."""

import duckdb
import pytest

from cubiform.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def plain(value):
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    asked = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]}) AS q")
    assert got == sorted((tuple(map(plain, r)) for r in asked.fetchall()), key=repr)
