"""Stateful queries over streams of several micro-batches, against the same queries over tables."""

import os
import random
from pathlib import Path

import pytest

from weir import types as T
from weir.session import Engine
from weir.streaming.app import to_folder

SCHEMA = "t long, k string, v long"


@pytest.fixture(scope="module")
def feeds(spark, tmp_path_factory):
    """The same rows as a table, and as files that a stream takes one by one."""
    rng, path = random.Random(8), tmp_path_factory.mktemp("feed")
    data = [(10 + i // 7, rng.choice("aabcd"), rng.randrange(1, 9)) for i in range(140)]
    for n in range(5):
        part = path / f"part{n}"
        spark.createDataFrame(data[n * 28 : n * 28 + 28], SCHEMA).coalesce(1).write.parquet(str(part))
        (file,) = part.glob("*.parquet")
        file.rename(path / f"{n}.parquet")
        os.utime(path / f"{n}.parquet", (1000 + n, 1000 + n))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(str(path))
    engines = {}
    for name, df in (("table", spark.createDataFrame(data, SCHEMA)), ("stream", stream)):
        engines[name] = Engine(spark)
        engines[name].register_table("s", df, {"t": "uint", "v": "uint"}, ["t"])
    return engines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def streamed(spark, df, path):
    to_folder(df, f"{path}/out", f"{path}/at")
    return rows(spark.read.schema(df.schema).parquet(f"{path}/out"))


@pytest.mark.parametrize(
    "text",
    [
        "SELECT tb, k, count(*) AS n, sum(v) AS s, min(v) AS lo, max(v) AS hi, avg(v) AS m, Or_Aggr(v) AS o, And_Aggr(v) AS a FROM s GROUP BY t/2 AS tb, k CLOSING_WHEN count(*) = 0",
        "SELECT tb, k, moving_sum(v, 3) AS m, moving_sum_exp(v, 2, 0.5) AS e FROM s GROUP BY t/2 AS tb, k HAVING count(*) < 5 CLOSING_WHEN sum(v) >= 12 or k = 'd' and count(*) > 1",
        "SELECT tb, sum3(v) AS m, count(*) AS n FROM s WHERE k <> 'a' GROUP BY t AS tb CLOSING_WHEN count(*) > 4",
    ],
)
def test_running_aggregation(spark, feeds, tmp_path, text):
    want = rows(feeds["table"].sql(text))
    got = streamed(spark, feeds["stream"].sql(text), tmp_path)
    last = max(r[0] for r in want)
    assert got and got == [r for r in want if r[0] < last]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT tb, k, sum(v) AS s, ssthreshold() AS z FROM s WHERE ssample(v, 2) = 1 GROUP BY t/4 AS tb, k SUPERGROUP tb, tb HAVING ssfinal_clean(sum(v)) = 1 CLEANING_WHEN ssdo_clean() = 1 CLEANING_BY ssclean_with(sum(v)) = 1",
        "SELECT tb, k, v, count(*) AS n, count_distinct() AS d FROM s WHERE ssample(v, 3) < 2 GROUP BY t/4 AS tb, k, v SUPERGROUP tb, k",
        "SELECT tb, v, count(*) AS n FROM s GROUP BY t/4 AS tb, v SUPERGROUP tb, tb CLEANING_WHEN local_count(9) = 1 CLEANING_BY count(*) >= current_bucket()",
    ],
)
def test_sampling(spark, feeds, tmp_path, text):
    want = rows(feeds["table"].sql(text))
    got = streamed(spark, feeds["stream"].sql(text), tmp_path)
    # each supergroup's last window is still open
    where = (lambda r: r[1]) if "SUPERGROUP tb, k" in text else (lambda r: None)
    last = {where(r): max(x[0] for x in want if where(x) == where(r)) for r in want}
    assert got == [r for r in want if r[0] < last[where(r)]] and (got or "ssthreshold" in text)


def test_what_a_stream_cannot_run(feeds):
    for text in ("SELECT k, count(*) AS n FROM s GROUP BY k", "SELECT tb, POSAVG(FLOAT(v)) AS p FROM s GROUP BY t AS tb CLOSING_WHEN count(*) = 0", "SELECT A.t INNER_JOIN FROM s A, s B WHERE A.k = B.k"):
        with pytest.raises(T.TypeError_):
            feeds["stream"].sql(text)


def test_pairs_of_an_epoch_take_little_room(spark, tmp_path):
    """All pairs of an hour repeat two lists: what is written doesn't grow with their number. The session's settings stay."""
    from weir import queries

    rows = [(k * 7919 % 1_000_003, 1_700_000_000 - 1_700_000_000 % 3600 + k % 3600, 1, "purchase" if k % 2 == 0 else "view") for k in range(2_800)]
    spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = queries.queries()["stream_join"](spark, str(tmp_path))
    n = [sum(r[3] == kind for r in rows) for kind in ("purchase", "view")]
    assert df.count() == n[0] * n[1] == 1_960_000
    size = sum(f.stat().st_size for f in map(Path, {x.removeprefix("file://") for x in df.inputFiles()}))
    assert size < 100_000
    assert spark.conf.get("parquet.page.size", None) is None
