"""Running aggregation, sampling, streaming, sinks and flows: hand-made cases."""

from collections import Counter, defaultdict

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weir import queries
from weir import types as T
from weir.operators.sinks import bucketed, by_batch, outputs, parse_specs, to_function, write
from weir.session import Engine
from weir.streaming.app import INCREASING, StreamApp, StreamSchema
from weir.streaming.flow import IGNORE, Flow, Flowlet, output, process_input, projected, start_ticks, tick

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import test modules


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    rows = [(t, k, v) for t, k, v in [(0, "a", 5), (1, "a", 1), (1, "b", 2), (2, "b", 4), (5, "a", 3), (6, "c", 9), (9, "c", 1)]]
    e.register_table("s", spark.createDataFrame(rows, "t long, k string, v long"), {"t": "uint", "v": "uint"}, ["t"])
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def simulate(data, closing, idle_min=0):
    """Row by row: every live group reports at each change of the epoch and at the end."""
    live, out, now = {}, [], None

    def flush():
        for k in list(live):
            n, s = live[k]
            out.append((now, k, n, s))
            if closing(n, s):
                del live[k]
            else:
                live[k] = (0, 0)

    for t, k, v in sorted(data):
        if now is not None and t != now:
            flush()
        now = t
        n, s = live.get(k, (0, 0))
        live[k] = (n + 1, s + v)
    flush()
    return sorted(out)


DATA = [(0, "a", 5), (1, "a", 1), (1, "b", 2), (2, "b", 4), (5, "a", 3), (6, "c", 9), (9, "c", 1)]


@pytest.mark.parametrize(
    ("text", "closing"),
    [("count(*) = 0", lambda n, s: n == 0), ("sum(v) >= 4", lambda n, s: s >= 4), ("count(*) > 99", lambda n, s: False), ("count(*) >= 1", lambda n, s: n >= 1), ("sum(v) < 3 or count(*) = 0", lambda n, s: s < 3 or n == 0)],
)
def test_running_aggregation(engine, text, closing):
    got = rows(engine.sql(f"SELECT t, k, count(*) AS n, sum(v) AS s FROM s GROUP BY t, k CLOSING_WHEN {text}"))
    assert got == simulate(DATA, closing)


def test_moving_sum_starts_anew_when_a_group_closed(engine):
    got = rows(engine.sql("SELECT t, k, moving_sum(v, 2) AS m FROM s GROUP BY t, k CLOSING_WHEN count(*) = 0"))
    assert [r for r in got if r[1] == "a"] == [(0, "a", 5), (1, "a", 6), (2, "a", 1), (5, "a", 3), (6, "a", 3)]


def test_running_needs_an_epoch(engine):
    with pytest.raises(T.TypeError_):
        engine.sql("SELECT k, count(*) AS n FROM s GROUP BY k CLOSING_WHEN count(*) = 0")


def test_lossy_counting_bounds(spark, sf):
    exact = defaultdict(int)
    total = Counter()
    for r in queries.engine(spark, sf).sql("SELECT tb, user_id, count(*) AS n FROM events GROUP BY ts_sec/864000 AS tb, user_id").collect():
        exact[r.tb, r.user_id] = r.n
        total[r.tb] += r.n
    got = {(r.tb, r.user_id): r.n for r in queries.lossy_counting(spark, sf).collect()}
    for key, n in exact.items():
        missing = total[key[0]] / 100 + 1
        assert got.get(key, 0) <= n and (key in got or n <= missing)


def test_smart_sampling_size(spark, sf):
    by_window = Counter(r.tb for r in queries.smart_sampling(spark, sf).collect())
    assert by_window and max(by_window.values()) <= 2 * 50 + 1


def test_strictness_and_joins(engine):
    engine.settings.strict = True
    with pytest.raises(T.TypeError_):
        engine.sql("SELECT A.t INNER_JOIN FROM s A, s B WHERE A.k = B.k")
    assert engine.sql("SELECT A.t AS x, B.t AS y INNER_JOIN FROM s A, s B WHERE A.t / 2 = B.t + 1 and A.k = B.k").count() == 1
    with pytest.raises(T.TypeError_):
        engine.sql("SELECT A.t INNER_JOIN FROM s A, s B, s C WHERE A.t = B.t")


@pytest.mark.parametrize("span", [1, 2, 3, 10])
def test_filter_join_against_brute_force(spark, span):
    import random

    rng = random.Random(span)
    left = [(rng.randrange(40), rng.randrange(4), i) for i in range(120)]
    right = [(rng.randrange(40), rng.randrange(5), i) for i in range(25)]
    e = Engine(spark)
    for name, data in (("r", left), ("s", right)):
        e.register_table(name, spark.createDataFrame(data, "t long, k long, i long"), dict.fromkeys(["t", "k", "i"], "uint"), ["t"])
    got = sorted(r.i for r in e.sql(f"SELECT R.i FILTER_JOIN(t, {span}) FROM r R, s S WHERE R.k = S.k").collect())
    assert got == sorted(i for t, k, i in left if any(k == k2 and t - span < t2 <= t for t2, k2, _ in right))


def test_wrapping(spark):
    e = Engine(spark, wrap=True)
    e.register_table("n", spark.createDataFrame([((1 << 32) - 1, (1 << 31) - 1)], "u long, i int"), {"u": "uint"})
    r = e.sql("SELECT u + 2 AS a, u * u AS b, i + i AS c, 0 - u AS d FROM n").first()
    assert (r.a, r.b, r.c, r.d) == (1, 1, -2, 1)


def test_query_sets(spark):
    e = Engine(spark)
    e.register_table("n", spark.createDataFrame([(1,), (2,)], "x long"), {"x": "uint"})
    out = e.run_set(["DEFINE { query_name 'c'; } SELECT x + 1 AS x FROM b", "DEFINE { query_name 'b'; visibility 'none'; } SELECT x + 10 AS x FROM n"])
    assert list(out) == ["c"] and rows(out["c"]) == [(12,), (13,)]
    with pytest.raises(T.TypeError_):
        e.run_set(["DEFINE { query_name 'p'; } SELECT x FROM q", "DEFINE { query_name 'q'; } SELECT x FROM p"])


def test_json_application(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text("".join(f'{{"data":["{i}","{j}"]}}\n' for i in range(1, 11) for j in range(1, i + 1)))
    schema = StreamSchema("counts").add("at", "llong", INCREASING).add("n", "int")
    for streaming, last in ((True, 9), (False, 10)):
        app = StreamApp(spark, str(tmp_path / f"at{streaming}"), streaming)
        app.add_json_input("meter", schema, str(landing))
        app.add_query("sums", "SELECT at, SUM(n) AS total FROM meter.counts GROUP BY at")
        seen = {}
        app.on("sums")(lambda r, seen=seen: seen.update({r["at"]: r["total"]}))
        assert app.run() == {"sums": last}
        assert seen == {t: t * (t + 1) // 2 for t in range(1, last + 1)}


def test_join_application(spark, tmp_path):
    for name, make in (("people", lambda i: f"P{i}"), ("years", lambda i: i * 10)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text("".join(f'{{"data":["{i}","{make(i)}"]}}\n' for i in range(1, 9)))
    app = StreamApp(spark, str(tmp_path / "at"))
    app.add_json_input("crm", StreamSchema("people").add("id", "int", INCREASING).add("called", "string"), str(tmp_path / "people"))
    app.add_json_input("hr", StreamSchema("years").add("id", "int", INCREASING).add("years", "int"), str(tmp_path / "years"))
    app.add_query("old", "SELECT p.id, p.called, y.years INNER_JOIN FROM crm.people p, hr.years y WHERE y.id = p.id AND y.years > 40")
    seen = []
    app.on("old")(seen.append)
    app.run()
    assert sorted((r["id"], r["called"], r["years"]) for r in seen) == [(i, f"P{i}", i * 10) for i in range(5, 9)]


def test_sinks(engine, tmp_path, spark):
    s = engine.stream("SELECT t, k, v FROM s")
    spec, = parse_specs("# comment\nq,file,,out,5,k,2\n")
    write(s, spec, str(tmp_path / "f"), form="text")
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if p.is_dir()) == ["bucket=0", "bucket=5"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "f")).collect()) == sorted("|".join(map(str, d)) for d in DATA)
    assert {r.bucket for r in bucketed(s, parse_specs("q,file,,o,,,")[0]).collect()} == {0}
    with pytest.raises(ValueError):
        parse_specs("q,file,x")
    seen = []
    to_function(s.df, seen.append)
    assert len(seen) == len(DATA)
    engine.sql("DEFINE { query_name 'a'; } SELECT t, k FROM s; DEFINE { query_name 'b'; } SELECT t, v FROM s WHERE v > 3")
    shown = outputs(engine, f"a,zfile,bz2,{tmp_path},10,,\nb,stream,,,,,", form="text")
    assert list(shown) == ["b"] and shown["b"].count() == 3
    assert sum(1 for _ in (tmp_path / "a" / "bucket=0").glob("*.bz2")) == 1 and spark.read.text(str(tmp_path / "a")).count() == len(DATA)
    with pytest.raises(T.TypeError_):
        outputs(engine, "nobody,stream,,,,,")


def test_batches_count_once(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # the second run has forgotten the first, as after a lost commit
        by_batch(source(), str(tmp_path / "out"), str(tmp_path / checkpoint))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))


@output("even", "n int")
@output("odd", "n int, text string")
class Split(Flowlet):
    limit: int
    failure_policy = IGNORE

    def initialize(self, context):
        self.add = context.get("add", 0)

    @process_input("numbers")
    def one(self, record, context):
        n = record["n"] + self.add
        self.count("seen")
        if n > self.limit:
            raise ValueError("too large")
        self.emit({"n": n}, "even") if n % 2 == 0 else self.emit({"n": n, "text": context.origin}, "odd")


@output("queue", "total int, many int")
class Total(Flowlet):
    @process_input(batch=3, partition="hash", key="n")
    def some(self, records):
        values = [r["n"] for r in records]
        self.emit({"total": sum(values), "many": len(values)})


def test_flow(spark):
    numbers = spark.range(10).select(F.col("id").cast("int").alias("n"))
    flow = Flow("f", "splits").source("numbers", numbers).add("split", Split(limit="9")).add("sum", Total(), 2).connect("numbers", "split").connect("split", "sum")
    out = flow.build({"add": 2})
    assert rows(out["split"]["even"]) == [(2,), (4,), (6,), (8,)]
    assert rows(out["split"]["odd"]) == [(n, "numbers") for n in (3, 5, 7, 9)]
    sums = out["sum"]["queue"].collect()
    assert sum(r.total for r in sums) == 44 and sum(r.many for r in sums) == 8 and max(r.many for r in sums) <= 3
    assert flow.metrics()["split.seen"] >= 8 and flow.metrics()["split.seen"] % 8 == 0  # 2 of 10 failed
    assert flow.specification()["connections"] == [("numbers", "split", None), ("split", "sum", None)]
    with pytest.raises(ValueError):
        flow.connect("nobody", "sum")
    with pytest.raises(ValueError):
        Flow("g").add("a", Total()).add("b", Total()).connect("a", "b").connect("b", "a").build()


class Clock(Flowlet):
    count = 0

    @tick(0.1)
    def beat(self):
        self.count += 1
        self.emit({"n": self.count})


def test_ticks(spark):
    seen = []
    started = start_ticks(spark, Clock(), seen.append, ticks=2)
    import time

    for _ in range(100):
        if len(seen) >= 2:
            break
        time.sleep(0.2)
    for q in started:
        q.stop()
    assert [r["n"] for r in seen] == [1, 2]


def test_projection(spark):
    df = spark.createDataFrame([(1, 2.5, True, [1], {"a": 1}, (1, "x"))], "i int, f float, b boolean, l array<int>, m map<string,int>, r struct<p:int,q:string>")
    out = projected(df, "I bigint, f string, b string, l array<double>, m map<string,bigint>, r struct<p:string,z:int>, none int").first()
    assert (out.I, out.f, out.b, out.l, out.m, out.r.p, out.r.z, out.none) == (1, "2.5", "true", [1.0], {"a": 1}, "1", None, None)
    with pytest.raises(TypeError):
        projected(df, "f int")


def test_declared_functions(spark):
    from weir.functions.declare import declare, parse
    from weir.operators.sampling import LossyCounting

    text = """
    # comments are left out
    uint FUN [LFTA_LEGAL, COST LOW] twice (uint);
    string FUN [PARTIAL] after_dash (string, string HANDLE);
    PRED [LFTA_LEGAL] even [uint];
    float UDAF spread udaf16 (float);
    uint UDAF [RUNNING] rolling fstring8 (uint, uint CONST);
    fstring8 STATE bucket;
    int SFUN every bucket (uint);
    """
    assert [d.kind for d in parse(text)] == ["FUN", "FUN", "PRED", "UDAF", "UDAF", "STATE", "SFUN"]
    e = Engine(spark)

    class Every(LossyCounting):
        def every(self, groups, n):
            return self.local_count(groups, n)

    declare(
        e.registry,
        text,
        {"twice": lambda v: v * 2, "after_dash": lambda s, d: F.nullif(F.substring_index(s, d, -1), s), "even": lambda v: v % 2 == 0, "spread": lambda v: F.max(v) - F.min(v), "rolling": lambda v, *_: F.sum(v)},
        {"bucket": Every},
        {"rolling": lambda panes, n: F.aggregate(panes, F.lit(0).cast("bigint"), lambda a, v: a + v)},
    )
    e.register_table("x", spark.createDataFrame([(1, "a-b"), (2, "c"), (4, "d-e")], "t long, s string"), {"t": "uint"}, ["t"])
    assert rows(e.sql("SELECT twice(t) AS d, after_dash(s, '-') AS s FROM x")) == [(2, "b"), (8, "e")]
    assert rows(e.sql("SELECT t FROM x WHERE even[t]")) == [(2,), (4,)]
    assert rows(e.sql("SELECT spread(FLOAT(t)) AS r FROM x")) == [(3.0,)]
    assert rows(e.sql("SELECT t, rolling(t, 2) AS r FROM x GROUP BY t CLOSING_WHEN count(*) > 9")) == [(1, 1), (2, 3), (4, 6)]
    assert rows(e.sql("SELECT t, count(*) AS n FROM x WHERE every(2) = 1 GROUP BY t SUPERGROUP t, t")) == []
    with pytest.raises(ValueError):
        declare(e.registry, "uint FUN missing (uint);", {})
    with pytest.raises(ValueError):
        parse("uint nothing x")


def test_ingest_over_http(spark, tmp_path):
    import urllib.error
    import urllib.request

    from weir.sources.ingest import IngestServer

    with IngestServer({"in": str(tmp_path / "land")}) as server:
        post = lambda name, body: urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.port}/v1/streams/{name}", body.encode(), method="POST"), timeout=5).status
        assert post("in", '{"data":["1","2"]}\n{"data":["1","5"]}') == 200
        for name, body in (("in", "nothing"), ("other", '{"data":[]}')):
            with pytest.raises(urllib.error.HTTPError):
                post(name, body)
    app = StreamApp(spark, str(tmp_path / "at"), streaming=False)
    app.add_json_input("feed", StreamSchema("pairs").add("t", "llong", INCREASING).add("v", "int"), str(tmp_path / "land"))
    app.add_query("q", "SELECT t, sum(v) AS s FROM feed.pairs GROUP BY t")
    assert rows(app.queries["q"]) == [(1, 7)]


def test_texts_count_bytes(spark):
    from weir.session import Engine

    e = Engine(spark)
    e.register_table("t", spark.createDataFrame([(1, "héé"), (2, "ab"), (3, ""), (4, "日本")], "k long, s string"), {"k": "uint", "s": "string"})
    assert {r.k: r.h for r in e.sql("SELECT k, str_truncate(s, 4) AS h FROM t").collect()} == {1: "hé", 2: "ab", 3: "", 4: "日"}
    assert [r.k for r in e.sql("SELECT k FROM t WHERE str_match_offset[3, 'é', s]").collect()] == [1]
    assert [r.k for r in e.sql("SELECT k FROM t WHERE byte_match_offset[1, 195, s]").collect()] == [1]
    assert {r.k: r.h for r in e.sql("SELECT k, str_partial_regex_match(s, 'é$', 3) AS h FROM t").collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_packed_binary_interfaces_are_refused(spark):
    from weir import types as T
    from weir.sources.catalog import Interface, read_interface

    with pytest.raises(T.TypeError_, match="Parquet"):
        read_interface(spark, Interface("g", "GDAT", {"Path": "/nowhere"}), [])


FLOWS = "SELECT tb, k, count(*) AS n, max(t) AS last FROM s WHERE flow_ssample(5) = 1 GROUP BY t/600 AS tb, k SUPERGROUP tb, tb HAVING flow_ssfinal_clean(0, 40, max(t), count(*)) = 1 CLEANING_WHEN flow_ssdo_clean(max(t)) = 1 CLEANING_BY flow_ssclean_with(0, 40, max(t), count(*)) = 1"



def _flows(monkeypatch, rows, plain):
    """What FLOWS reports of rows (t, k) of one window, and how often a flow was judged; plain: every cleaning asks all groups."""
    from weir.functions.library import default_registry
    from weir.operators import sampling
    from weir.plans import syntax as S
    from weir.plans.lower import conjuncts

    (q,), registry, judged, flow = S.parse(FLOWS), default_registry(), [], sampling.FlowSampling._flow
    for s in sampling.STATES:
        registry.register_state(s)
    aggregates = [S.Call(e.name, e.args, e.star) for e, _ in q.select[2:]]
    with monkeypatch.context() as m:
        m.setattr(sampling.FlowSampling, "_flow", lambda self, *a: judged.append(1) or flow(self, *a))
        if plain:
            m.setattr(sampling.Program, "_waits", lambda self: None)
        program = sampling.Program(q, registry, {}, aggregates, conjuncts(q.where), ["tb", "k"], [None, "v_2"], ["k_tb", "k_k", "v_2"])
        machine = sampling.Machine(program)
        for at in range(0, len(rows), 700):
            program.takes(machine, [[0] * len(rows[at : at + 700]), [k for _, k in rows[at : at + 700]], [t for t, _ in rows[at : at + 700]]])
            machine = sampling.Machine(program).restore(machine.saved())
        return list(machine.report()), len(judged)


def test_flows_that_are_open_are_not_judged_again_by_every_row(monkeypatch):
    import random

    pick = random.Random(5)
    rows = [(k // 20, pick.randrange(1, 1 + 300 * (1 + k // 2000))) for k in range(8_000)]
    got, judged = _flows(monkeypatch, rows, False)
    want, asked = _flows(monkeypatch, rows, True)
    assert got == want and len(got) > 10
    assert judged < 4 * len(rows) < 100 * len(rows) < asked


def test_one_stream_is_sorted_in_parallel_and_its_task_gets_batches(spark):
    """Only packed batches go to the one task that follows the threshold, not the sorted table with all its columns."""
    import random

    from weir.session import Engine

    pick = random.Random(3)
    rows = [(k, pick.randrange(1, 900), pick.randrange(40), "x" * 20) for k in range(3_000)]
    e = Engine(spark)
    e.register_table("s", spark.createDataFrame(rows, "t long, v long, k long, pad string").repartition(7), {"t": "uint", "v": "uint", "k": "uint"}, ["t"])
    df = e.sql("SELECT tb, k, sum(v) AS w, ssthreshold() AS z FROM s WHERE ssample(v, 7) = 1 GROUP BY t/500 AS tb, k SUPERGROUP tb, tb HAVING ssfinal_clean(sum(v)) = 1 CLEANING_WHEN ssdo_clean() = 1 CLEANING_BY ssclean_with(sum(v)) = 1")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    single = plan.split("Repartition 1, true")[1]
    assert "pad" in single and "MapInArrow" in single.split("\n")[1] and "RepartitionByExpression" in single
    assert [tuple(r) for r in df.collect()] == _plain_smart(rows, 500, 7)


def _plain_smart(rows, width, size):
    """The same sampling, row by row."""
    from weir.operators.sampling import SmartSampling

    out, state, groups, at = [], None, {}, None

    def report():
        state.begin_final(len(groups))
        out.extend((at, k, w, float(state.z)) for k, w in list(groups.items()) if state.ssfinal_clean(len(groups), w) == 1)

    for t, v, k, _ in sorted(rows):
        if t // width != at:
            if state:
                report()
            state, groups, at = SmartSampling(state), {}, t // width
        if state.ssample(len(groups), v, size) == 1:
            groups[k] = groups.get(k, 0) + v
            if state.ssdo_clean(len(groups)) == 1:
                for g in list(groups):
                    if state.ssclean_with(len(groups), groups[g]) != 1:
                        del groups[g]
    report()
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_a_micro_batch_is_sorted_in_runs(monkeypatch, ties):
    """No more rows are held than a few runs' chunks, however the rows come; equal times stay together."""
    import numpy as np
    import pandas as pd
    from weir.operators import sampling

    for name, n in (("_HELD", 100), ("_CHUNK", 5), ("_MERGED", 50)):
        monkeypatch.setattr(sampling, name, n)
    r = np.random.default_rng(2)
    t = r.integers(0, 50 if ties else 100_000, 3_000)
    rows = pd.DataFrame({"k_tb": t // 1000, "o_0": t, "o_1": [None if x % 7 == 0 else f"p{x}" for x in r.integers(0, 999, 3_000)], "v": range(3_000)})
    for order in (rows, rows.sort_values("o_0"), rows.sort_values("o_0", ascending=False)):
        by = ["k_tb", "o_0", "o_1"]
        got = list(sampling._sorted((order.iloc[k : k + 37] for k in range(0, 3_000, 37)), by, [True] * 3, by[:2]))
        want = order.sort_values(by)
        assert pd.concat(got)[by].reset_index(drop=True).equals(want[by].reset_index(drop=True))
        assert sorted(x for g in got for x in g["v"]) == list(range(3_000))
        assert max(map(len, got)) < 600
