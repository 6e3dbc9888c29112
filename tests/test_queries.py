"""Every registered query against its SQL on DuckDB, at the smallest size."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from weir import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())
    assert got == want
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {d[0]: str(d[1]) for d in found.description} == {c: kinds[k] for c, k in df.dtypes}


@pytest.mark.parametrize(("name", "table", "columns"), [("fn_regex_partial", "documents", "doc_id bigint, text string, lang string, source string"), ("fn_truncate", "part", "p_partkey bigint, p_name string, p_size int")])
def test_beginnings_of_texts_count_characters(spark, tmp_path, name, table, columns):
    """The match ends at the 200th character, which is the 202nd byte, or at the 201st; the fifth character is not the fifth byte."""
    odd = ["é" * 2 + "x" * 192 + "of the", "é" * 2 + "x" * 193 + "of the", "日本" + "of and", "", "y" * 300, "éàüöç"]
    spark.createDataFrame([(i, t, "fr", "s") if table == "documents" else (i, t, 1) for i, t in enumerate(odd)], columns).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert got == sorted(c.execute(SQL[name]).fetchall()) and len(got) == len(odd)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["tb", "event_type", "cnt", "users"] and df.count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    """Both llm folders deleted, with and without the pipeline's module: the other queries are all there."""
    root = Path(__file__).resolve().parent.parent
    for name in ["weir", "__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (root / "corpus_pipeline.py").exists()):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) + sorted(e.oracle_sql()))"
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=own, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == str(sorted(QUERIES) + sorted(SQL))
