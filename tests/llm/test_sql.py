"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest
from weir.llm import queries

SQL = queries.oracle_sql()


def against(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in found.fetchall())
    return got


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    assert against(spark, sf, name)


@pytest.mark.parametrize("name", sorted(SQL))
def test_odd_rows(spark, tmp_path, name):
    passage = " ".join(f"Wört{i}" for i in range(20))
    spark.createDataFrame([(1, None), (1, ""), (None, passage), (3, passage * 2), (4, "tiny one, TINY"), (4, "x " * 4000 + passage)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, passage), (9, passage), (8, None), (7, " ,"), (6, "Tiny")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    urls = [None, "", "no scheme", "http://a.org/x", "http://b.com/de/1", "http://c.com/fr/1", "http://c.com/fr/1", "http://d.net/de/7?q", "HTTP://ÉX.Example.ORG/en/1#a"]
    spark.createDataFrame([(i // 2 if u else None, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert against(spark, str(tmp_path), name)
    for t in ("documents", "benchmark", "pages"):
        kept = spark.read.parquet(f"{tmp_path}/{t}.parquet")
        spark.createDataFrame([], kept.schema).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert against(spark, f"{tmp_path}/none", name) == []
