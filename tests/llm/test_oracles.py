"""Queries of the training-data operators against their SQL, on the small tables and on hard rows."""

import duckdb
import pytest

from cubiform.llm import oracles, queries
from tests.llm import cases

SF = cases.SF


def rows(columns, found):
    return sorted((tuple(int(v) if isinstance(v, float) and v.is_integer() else round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]}) AS q").fetchall()
    assert rows(columns, got) == rows(columns, want)


@pytest.mark.parametrize("name", ["op3_source_mix", "op5_decontaminate", "op7_quality_rules", "op10_pii"])
def test_matches_sql_on_hard_rows(spark, name, tmp_path):
    cases.hard(spark).filter("doc_id is null or doc_id <> 14").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "the lazy dog while the band plays a slow tune about rivers"), (None, "a"), (3, "short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]}) AS q").fetchall()
    assert rows(columns, got) == rows(columns, want)
