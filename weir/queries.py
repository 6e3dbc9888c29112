"""The registered queries of the stream language, each with its SQL for comparison."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir import types as T
from weir.functions.library import default_registry
from weir.plans.lower import Stream
from weir.session import Engine
from weir.streaming.flow import Flow, Flowlet, output, process_input, projected
from weir.tables import folder

TABLES = "region nation customer supplier part orders lineitem".split()
KINDS = {
    "lineitem": {"l_orderkey": "uint", "l_partkey": "uint", "l_suppkey": "uint", "l_linenumber": "uint"},
    "orders": {"o_orderkey": "uint", "o_custkey": "uint"},
    "customer": {"c_custkey": "uint", "c_nationkey": "uint"},
    "part": {"p_partkey": "uint", "p_size": "int"},
    "supplier": {"s_suppkey": "uint", "s_nationkey": "uint"},
    "nation": {"n_nationkey": "uint", "n_regionkey": "uint"},
    "region": {"r_regionkey": "uint"},
}


def _seconds(events: DataFrame):
    return T.seconds(F.col("ts"), dict(events.dtypes)["ts"])


def engine(spark: SparkSession, sf_dir: str, **settings) -> Engine:
    """All tables as streams, read when a query names them; events with ts_sec, whole seconds, increasing. Beginnings of texts count characters, as in the queries' SQL."""
    e = Engine(spark, default_registry(characters=True), **settings)

    def add(name: str, columns: list[str] | None = None, kinds: dict[str, str] | None = None, increasing=()) -> None:
        def load() -> Stream:
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            df = df.withColumn("ts_sec", _seconds(df)) if name == "events" else df.select(*columns) if columns else df
            return Stream.of(df, kinds, increasing)

        e.catalog.register(name, load)

    for t in TABLES:
        add(t, None, KINDS.get(t, {}), {"orders": ["o_orderkey"], "lineitem": ["l_orderkey"]}.get(t, ()))
    add("events", None, {"ts_sec": "uint", "user_id": "uint", "event_id": "uint"}, ["ts_sec"])
    add("documents", ["doc_id", "text", "lang", "source"], {"doc_id": "uint"})
    add("pages", ["page_id", "url"], {"page_id": "uint"})
    add("conversations", None, {"conv_id": "uint", "turn": "uint"}, ["turn"])
    return e


#: name -> (query text, parameters, SQL). Each SQL is what DuckDB runs on the same tables.
TEXTS: dict[str, tuple[str, dict, str]] = {}


def _add(name: str, text: str, sql: str, **params) -> None:
    TEXTS[name] = text, params, sql


SEC = "epoch_us(ts) // 1000000"

_add("select_project", "SELECT l_orderkey, l_partkey AS pk, l_returnflag FROM lineitem WHERE l_quantity > 45.0", "SELECT l_orderkey, l_partkey AS pk, l_returnflag FROM lineitem WHERE l_quantity > 45")
_add("select_arith", "SELECT l_orderkey, l_orderkey + l_partkey * 2 AS a, l_partkey / 7 AS d, l_partkey % 7 AS m, l_extendedprice * (1.0 - l_discount) AS net, -l_linenumber AS neg FROM lineitem", "SELECT l_orderkey, l_orderkey + l_partkey * 2 AS a, l_partkey // 7 AS d, l_partkey % 7 AS m, l_extendedprice * (1.0::DOUBLE - l_discount) AS net, (-l_linenumber)::INTEGER AS neg FROM lineitem")
_add("bitwise_shift", "SELECT o_orderkey, o_orderkey & 255 AS low, o_orderkey | 1 AS odd, o_custkey << 3 AS up, o_custkey >> 2 AS down, o_orderkey & 6 + 1 AS loose, ~o_custkey AS inv FROM orders", "SELECT o_orderkey, o_orderkey & 255 AS low, o_orderkey | 1 AS odd, o_custkey << 3 AS up, o_custkey >> 2 AS down, o_orderkey & 7 AS loose, 4294967295 - o_custkey AS inv FROM orders")
_add("pred_cmp", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000.0 and o_orderkey <> 7 and o_custkey < 900 and o_orderstatus <= 'O' and o_orderpriority > '2'", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderkey <> 7 AND o_custkey < 900 AND o_orderstatus <= 'O' AND o_orderpriority > '2'")
_add("pred_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ['BUILDING','MACHINERY'] and c_nationkey IN [1, 2, 3, 5, 8]", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_nationkey IN (1, 2, 3, 5, 8)")
_add("pred_bool_logic", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000.0) AND (o_custkey % 2 = 0 OR o_custkey % 3 = 0)", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000) AND (o_custkey % 2 = 0 OR o_custkey % 3 = 0)")
_add("pred_user", "SELECT c_custkey FROM customer WHERE str_exists_substr[c_mktsegment, 'UIL'] or str_match_offset[0, 'MACH', c_mktsegment] and byte_match_offset[1, 65, c_mktsegment] and str_compare[c_name, 'x']", "SELECT c_custkey FROM customer WHERE contains(c_mktsegment, 'UIL') OR (substr(c_mktsegment, 1, 4) = 'MACH' AND substr(c_mktsegment, 2, 1) = 'A' AND c_name <> 'x')")
_add("lit_hex_ip", "SELECT c_custkey, c_custkey + HEX 'ff' AS h, UINT(strtoip_c('10.0.0.1')) + c_custkey AS ip FROM customer WHERE UINT(strtoip_c('0.0.2.0')) < c_custkey", "SELECT c_custkey, c_custkey + 255 AS h, 167772161 + c_custkey AS ip FROM customer WHERE 512 < c_custkey")
_add("ip_ops", "SELECT c_custkey, UINT(strtoip('10.1.2.3') & IP_VAL '255.255.0.0') AS net, UMIN(c_custkey, c_nationkey) AS lo FROM customer WHERE strtoip('1.2.3.4') = IP_VAL '1.2.3.4'", "SELECT c_custkey, 167837696::BIGINT AS net, least(c_custkey, c_nationkey)::BIGINT AS lo FROM customer")
_add("fn_regex_match", "SELECT doc_id, str_regex_match(text, 'th(e|at) [a-z]+ing') AS hit FROM documents", "SELECT doc_id, (text <> '' AND regexp_matches(text, 'th(e|at) [a-z]+ing'))::BIGINT AS hit FROM documents")
_add("fn_regex_partial", "SELECT doc_id, str_partial_regex_match(text, 'of (the|of|and)', 200) AS hit FROM documents", "SELECT doc_id, regexp_matches(left(text, 200), 'of (the|of|and)')::BIGINT AS hit FROM documents")
_add("fn_extract_regex", "SELECT doc_id, str_extract_regex(text, '[a-z]{9,}') AS word FROM documents", "SELECT doc_id, regexp_extract(text, '[a-z]{9,}') AS word FROM documents WHERE regexp_matches(text, '[a-z]{9,}')")
_add("fn_truncate", "SELECT p_partkey, str_truncate(p_name, 5) AS head FROM part", "SELECT p_partkey, left(p_name, 5) AS head FROM part")
_add("fn_match_offset", "SELECT p_partkey FROM part WHERE str_match_offset[6, '#1', p_brand] or str_match_offset[5, '#2', p_brand]", "SELECT p_partkey FROM part WHERE substr(p_brand, 7, 2) = '#1' OR substr(p_brand, 6, 2) = '#2'")
_add("fn_bytes_of_texts", "SELECT doc_id, lang FROM documents WHERE byte_match_offset[9, 195, text] or str_match_offset[30, 'é', text] or str_match_offset[17, 'en ', text]", "SELECT doc_id, lang FROM (SELECT *, hex(encode(text)) AS b FROM documents) WHERE substr(b, 19, 2) = 'C3' OR substr(b, 61, 4) = 'C3A9' OR substr(b, 35, 6) = '656E20'")
_add("fn_byte_offset", "SELECT p_partkey FROM part WHERE byte_match_offset[0, 66, p_brand] and byte_match_offset[6, 50, p_brand]", "SELECT p_partkey FROM part WHERE substr(p_brand, 1, 1) = 'B' AND substr(p_brand, 7, 1) = '2'")
_add("fn_strtoi", "SELECT page_id, strtoi(url) AS n FROM pages", "SELECT page_id, regexp_extract(url, '[0-9]+')::BIGINT AS n FROM pages WHERE regexp_matches(url, '[0-9]+')")
_add("fn_minmax2", "SELECT l_orderkey, l_linenumber, UMIN(l_partkey, l_suppkey) AS lo, UMAX(l_partkey, l_suppkey) AS hi FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem")
_add("fn_casts", "SELECT o_orderkey, INT(o_orderkey) AS i, FLOAT(o_custkey) AS f, UINT(INT(o_custkey)) AS u, non_temporal(o_orderkey) AS n FROM orders", "SELECT o_orderkey, o_orderkey::INTEGER AS i, o_custkey::DOUBLE AS f, o_custkey::BIGINT AS u, o_orderkey AS n FROM orders")
_add("agg_builtin", "SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum(l_orderkey) AS s, min(l_partkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum(l_orderkey)::BIGINT AS s, min(l_partkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY ALL")
_add("agg_bits", "SELECT l_suppkey, And_Aggr(l_partkey) AS a, Or_Aggr(l_partkey) AS o, Xor_Aggr(l_partkey) AS x FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, bit_and(l_partkey) AS a, bit_or(l_partkey) AS o, bit_xor(l_partkey) AS x FROM lineitem GROUP BY ALL")
_add("agg_avg", "SELECT o_orderstatus, avg(o_custkey) AS m, count(o_custkey) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, avg(o_custkey) AS m, count(*) AS n FROM orders GROUP BY ALL")
_add("agg_no_groups", "SELECT count(*) AS n, sum(o_custkey) AS s, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F'", "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS s, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F'")
_add("agg_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 55 and max(c_custkey) > 100", "SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 55 AND max(c_custkey) > 100")
_add("epoch_tumble", "DEFINE { query_name 'per_hour'; } SELECT tb, event_type, count(*) AS cnt, sum(user_id) AS users FROM events GROUP BY ts_sec/3600 AS tb, event_type", f"SELECT ({SEC}) // 3600 AS tb, event_type, count(*) AS cnt, sum(user_id)::BIGINT AS users FROM events GROUP BY ALL")
_add("gb_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", "SELECT CASE WHEN grouping(l_returnflag)=1 THEN '' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus)=1 THEN '' ELSE l_linestatus END AS l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
_add("gb_cube", "SELECT o_orderstatus, h, sum(o_custkey) AS s FROM orders GROUP BY CUBE(o_orderstatus, o_custkey/500 AS h)", "WITH t AS (SELECT o_orderstatus, o_custkey // 500 AS h, o_custkey FROM orders) SELECT CASE WHEN grouping(o_orderstatus)=1 THEN '' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(h)=1 THEN 0 ELSE h END AS h, sum(o_custkey)::BIGINT AS s FROM t GROUP BY CUBE(o_orderstatus, h)")
_add("gb_gsets", "SELECT l_linestatus, l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linestatus, GROUPING_SETS((l_returnflag),(l_returnflag,l_linenumber))", "SELECT l_linestatus, l_returnflag, CASE WHEN grouping(l_linenumber)=1 THEN 0 ELSE l_linenumber END::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_linestatus, l_returnflag, l_linenumber))")
_VIEWS = "DEFINE {{ query_name 'buys'; }} SELECT ts_sec/3600 AS h, user_id, event_id FROM events WHERE event_type = '{a}'; DEFINE {{ query_name 'looks'; }} SELECT ts_sec/3600 AS h, user_id, event_id FROM events WHERE event_type = '{b}'; "
_PAIR = _VIEWS.format(a="purchase", b="view")
_WITH = f"WITH a AS (SELECT ({SEC}) // 3600 AS h, user_id, event_id FROM events WHERE event_type = 'purchase'), b AS (SELECT ({SEC}) // 3600 AS h, user_id, event_id FROM events WHERE event_type = 'view') "
for _n, _k, _j in (("join_inner", "INNER_JOIN", "JOIN"), ("join_left", "LEFT_OUTER_JOIN", "LEFT JOIN"), ("join_right", "RIGHT_OUTER_JOIN", "RIGHT JOIN"), ("join_full", "OUTER_JOIN", "FULL JOIN")):
    _add(_n, f"{_PAIR} SELECT A.h, A.user_id AS ua, B.user_id AS ub, A.event_id AS ea, B.event_id AS eb {_k} FROM buys A, looks B WHERE A.h = B.h and A.user_id % 50 = B.user_id % 50", f"{_WITH} SELECT coalesce(a.h, b.h) AS h, coalesce(a.user_id, 0) AS ua, coalesce(b.user_id, 0) AS ub, coalesce(a.event_id, 0) AS ea, coalesce(b.event_id, 0) AS eb FROM a {_j} b ON a.h = b.h AND a.user_id % 50 = b.user_id % 50")
_add("join_fill_key", f"{_PAIR} SELECT A.h, A.user_id AS ua, B.user_id AS ub, B.event_id AS eb LEFT_OUTER_JOIN FROM buys A, looks B WHERE A.h = B.h and A.user_id = B.user_id", f"{_WITH} SELECT a.h, a.user_id AS ua, coalesce(b.user_id, a.user_id) AS ub, coalesce(b.event_id, 0) AS eb FROM a LEFT JOIN b ON a.h = b.h AND a.user_id = b.user_id")
_add("join_time_only", f"{_PAIR} SELECT A.h, A.event_id AS ea, B.event_id AS eb INNER_JOIN FROM buys A, looks B WHERE A.h = B.h and A.user_id < B.user_id", f"{_WITH} SELECT a.h, a.event_id AS ea, b.event_id AS eb FROM a JOIN b ON a.h = b.h AND a.user_id < b.user_id")
_add("join_orders_lineitem", "SELECT O.o_orderkey, O.o_orderstatus, L.l_partkey, L.l_linenumber INNER_JOIN FROM orders O, lineitem L WHERE O.o_orderkey = L.l_orderkey and L.l_returnflag = 'R' and O.o_totalprice > 200000.0", "SELECT o_orderkey, o_orderstatus, l_partkey, l_linenumber::BIGINT AS l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_totalprice > 200000")
_add("filter_join", "DEFINE { query_name 'p'; } SELECT ts_sec, user_id, event_id FROM events WHERE event_type = 'purchase'; DEFINE { query_name 'v'; } SELECT ts_sec, user_id FROM events WHERE event_type = 'view'; SELECT R.event_id, R.user_id, R.ts_sec FILTER_JOIN(ts_sec, 86400) FROM p R, v S WHERE R.user_id = S.user_id", f"WITH e AS (SELECT {SEC} AS t, user_id, event_id, event_type FROM events) SELECT event_id, user_id, t AS ts_sec FROM e r WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM e s WHERE s.event_type = 'view' AND s.user_id = r.user_id AND s.t <= r.t AND s.t > r.t - 86400)")
_THREE = "DEFINE { query_name 'm1'; } SELECT ts_sec, event_id FROM events WHERE event_type = 'view'; DEFINE { query_name 'm2'; } SELECT ts_sec, event_id FROM events WHERE event_type = 'purchase'; DEFINE { query_name 'm3'; } SELECT ts_sec, event_id FROM events WHERE event_type = 'click'; "
_add("merge2", f"{_THREE} MERGE R.ts_sec : S.ts_sec FROM m1 R, m2 S", f"SELECT {SEC} AS ts_sec, event_id FROM events WHERE event_type IN ('view', 'purchase')")
_add("merge3_slack", f"{_THREE} MERGE R.ts_sec : S.ts_sec : Q.ts_sec SLACK 5 FROM m1 R, m2 S, m3 Q", f"SELECT {SEC} AS ts_sec, event_id FROM events WHERE event_type IN ('view', 'purchase', 'click')")
_add("udaf_posavg", "SELECT c_mktsegment, POSAVG(FLOAT(INT(c_nationkey)) - 12.0) AS p FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, coalesce(avg(c_nationkey::DOUBLE - 12.0) FILTER (c_nationkey >= 12), -1.0) AS p FROM customer GROUP BY ALL")
_add("udaf_extr_avg", "SELECT o_orderpriority, extr_avg(o_custkey) AS m FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, avg(o_custkey) AS m FROM orders GROUP BY ALL")
_RUN = f"""WITH RECURSIVE p AS (SELECT ({SEC}) // 86400 AS tb, user_id AS g, count(*) AS n, sum(event_id)::BIGINT AS s FROM events GROUP BY ALL),
e AS (SELECT tb, row_number() OVER (ORDER BY tb) AS i FROM (SELECT DISTINCT tb FROM p)),
d AS (SELECT p.g, e.i, p.n, p.s FROM p JOIN e USING (tb)),
f AS (SELECT g, min(i) AS i0 FROM d GROUP BY g),
w AS (SELECT f.g, e.tb, e.i, coalesce(d.n, 0) AS n, coalesce(d.s, 0) AS s FROM f JOIN e ON e.i >= f.i0 LEFT JOIN d ON d.g = f.g AND d.i = e.i),
x AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY g ORDER BY i), 1) AS before FROM w),
"""
_add("running_closing", "SELECT tb, user_id, count(*) AS n, sum(event_id) AS s FROM events GROUP BY ts_sec/86400 AS tb, user_id CLOSING_WHEN count(*) = 0", _RUN + "z AS (SELECT 1) SELECT tb, g AS user_id, n, s FROM x WHERE n > 0 OR before > 0")
_add("running_forever", "SELECT tb, user_id, count(*) AS n FROM events GROUP BY ts_sec/86400 AS tb, user_id HAVING count(*) < 3 CLOSING_WHEN count(*) > 100000", _RUN + "z AS (SELECT 1) SELECT tb, g AS user_id, n FROM x WHERE n < 3")
_add("moving_sum", "SELECT tb, user_id, moving_sum(event_id, 3) AS m FROM events GROUP BY ts_sec/86400 AS tb, user_id CLOSING_WHEN count(*) > 100000", _RUN + "z AS (SELECT 1) SELECT tb, g AS user_id, (sum(s) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS m FROM x")
_add("moving_sum_exp", "SELECT tb, user_id, moving_sum_exp(event_id, 3, 0.5) AS m FROM events GROUP BY ts_sec/86400 AS tb, user_id CLOSING_WHEN count(*) > 100000", _RUN + "z AS (SELECT 1) SELECT tb, g AS user_id, s + 0.5::DOUBLE * coalesce(lag(s) OVER u, 0) + 0.25::DOUBLE * coalesce(lag(s, 2) OVER u, 0) AS m FROM x WINDOW u AS (PARTITION BY g ORDER BY i)")
_add("sum3", "SELECT tb, user_id, sum3(event_id) AS m FROM events GROUP BY ts_sec/86400 AS tb, user_id CLOSING_WHEN count(*) > 100000", _RUN + "z AS (SELECT 1) SELECT tb, g AS user_id, (sum(s) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS m FROM x")
_add("superagg", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, count$(*) AS all_n, sum$(l_partkey) AS all_s FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber SUPERGROUP l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber, count(*) AS n, (sum(count(*)) OVER (PARTITION BY l_returnflag, l_linestatus))::BIGINT AS all_n, (sum(sum(l_partkey)) OVER (PARTITION BY l_returnflag, l_linestatus))::BIGINT AS all_s FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
_add("heavy_hitters", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 20", "SELECT user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 20")
_add("query_chain", "DEFINE { query_name 'big'; } SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000.0; DEFINE { query_name 'per_cust'; } SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey; SELECT n, count(*) AS customers FROM per_cust GROUP BY n", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY ALL) GROUP BY ALL")
_add("param_query", "PARAM { floor float; status string; } SELECT o_orderkey FROM orders WHERE o_totalprice > $floor and o_orderstatus = $status", "SELECT o_orderkey FROM orders WHERE o_totalprice > 120000 AND o_orderstatus = 'O'", floor=120000.0, status="O")
_add("define_macro", "DEFINE { query_name 'm'; seg 'AUTOMOBILE'; } SELECT c_custkey FROM customer WHERE c_mktsegment = #seg", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
_add("timeval_shift", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate + 1500 > TIMEVAL '800000000.0' and TIMEVAL '820000000.5' > l_shipdate", "SELECT l_orderkey, l_partkey FROM lineitem WHERE epoch_ms(l_shipdate) + 1500 > 800000000000 AND epoch_ms(l_shipdate) < 820000000500")


def _text_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, params, _ = TEXTS[name]
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(text, **params)


# ---- queries that need more than a text


def agg_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", (F.col("o_orderstatus") == "F").alias("done"))
    e.register_table("flags", orders, {"o_custkey": "uint"})
    return e.sql("SELECT o_custkey, sum(done) AS s, min(done) AS lo, max(done) AS hi, And_Aggr(done) AS a, Or_Aggr(done) AS o, Xor_Aggr(done) AS x FROM flags GROUP BY o_custkey")


def query_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.catalog.add_library("LIB/urgent", "DEFINE { query_name 'urgent'; } SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
    return e.sql("SELECT o_custkey, count(*) AS n FROM LIB/urgent GROUP BY o_custkey")


def operator_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register_operator("dense", lambda dfs, params: dfs[0].groupBy("l_orderkey").count().where("count > 4"), {"l_orderkey": "uint", "count": "uint"}, ["lineitem"], ["l_orderkey"])
    return e.sql("SELECT b, count(*) AS n FROM dense GROUP BY l_orderkey/1000 AS b")


def interface_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.catalog.system_time = 1
    e.register_schemas("PROTOCOL arrivals { uint arrived get_system_time (increasing); } PROTOCOL ev (arrivals) { uint event_id x; uint user_id y; string event_type z; }")
    for kind in ("view", "click", "purchase"):
        e.register_interface(kind, "FRAME", frame=lambda s, kind=kind: s.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind), Feed="web" if kind != "purchase" else "shop", InterfaceType="FRAME")
    e.catalog.add_sets("web : Equals[Feed,web] and not Equals[InterfaceType,CSV]")
    return e.sql("DEFINE { query_name 'w'; } SELECT event_type, event_id, @Feed AS feed FROM [web].ev; SELECT event_type, feed, count(*) AS n FROM w GROUP BY event_type, feed")


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation written as a delimited text and read by position."""
    from weir.operators.sinks import text_lines

    e = engine(spark, sf_dir)
    path = folder(spark, "csv")
    text_lines(e.stream("SELECT n_nationkey, n_name, n_regionkey FROM nation")).write.text(path)
    e.register_schemas("PROTOCOL n { uint n_nationkey get_csv_uint_pos1; string n_name get_csv_string_pos2; uint n_regionkey get_csv_uint_pos3; }")
    e.register_interface("feed", "CSV", Path=path, CSVSeparator="|")
    return e.sql("SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM feed.n GROUP BY n_regionkey")


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    path = folder(spark, "json")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.to_json(F.struct(F.array(F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string")).alias("data"))).alias("value")).write.text(path)
    e.register_schemas("PROTOCOL s { uint s_suppkey a; string s_name b; uint s_nationkey c; }")
    e.register_interface("jin", "JSON", Path=path)
    return e.sql("SELECT s_nationkey, count(*) AS n, max(s_name) AS last FROM jin.s GROUP BY s_nationkey")


def file_sink_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.operators.sinks import parse_specs, write

    e = engine(spark, sf_dir)
    s = e.stream("SELECT ts_sec, user_id, event_type FROM events WHERE event_type = 'purchase'")
    path = folder(spark, "sink")
    write(s, parse_specs("p,file,gz,out,86400,user_id,4")[0], path)
    return spark.read.parquet(path).groupBy(F.col("bucket").cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("ts_sec").alias("last"))


SMART = "SELECT tb, l_suppkey, sum(l_partkey) AS s, ssthreshold() AS z FROM lineitem WHERE ssample(l_partkey, 50) = 1 GROUP BY l_orderkey/20000 AS tb, l_suppkey SUPERGROUP tb, tb HAVING ssfinal_clean(sum(l_partkey)) = 1 CLEANING_WHEN ssdo_clean() = 1 CLEANING_BY ssclean_with(sum(l_partkey)) = 1"


def smart_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(SMART)


def flow_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(
        "SELECT tb, user_id, count(*) AS n FROM events WHERE flow_ssample(50) = 1 GROUP BY ts_sec/864000 AS tb, user_id SUPERGROUP tb, tb HAVING flow_ssfinal_clean(0, 3600, max(ts_sec), count(*)) = 1 "
        "CLEANING_WHEN flow_ssdo_clean(max(ts_sec)) = 1 CLEANING_BY flow_ssclean_with(0, 3600, max(ts_sec), count(*)) = 1"
    )


LOSSY = "SELECT tb, user_id, count(*) AS n FROM events GROUP BY ts_sec/864000 AS tb, user_id SUPERGROUP tb, tb CLEANING_WHEN local_count(100) = 1 CLEANING_BY count(*) >= current_bucket()"


def lossy_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(LOSSY)


def _event_stream(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    source = spark.readStream.schema(table.schema)
    if [f.rstrip("/").endswith("/events.parquet") for f in table.inputFiles()] == [True]:  # a file by itself: streams watch folders
        df = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        df = source.parquet(path)
    df = df.withColumn("ts_sec", _seconds(df))
    e.register_table("events", df, {"ts_sec": "uint", "user_id": "uint", "event_id": "uint"}, ["ts_sec"], disorder=1)
    return e


def _streamed(spark: SparkSession, df: DataFrame) -> DataFrame:
    from weir.streaming.app import to_folder

    path = folder(spark, "stream")
    to_folder(df, path, path + "-at")
    return spark.read.schema(df.schema).parquet(path)


def stream_epoch_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream that ran until now: all epochs but the last, which is still open."""
    return _streamed(spark, _event_stream(spark, sf_dir).sql("SELECT tb, event_type, count(*) AS cnt FROM events GROUP BY ts_sec/3600 AS tb, event_type"))


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, _event_stream(spark, sf_dir).sql(_PAIR + "SELECT A.h, A.event_id AS ea, B.event_id AS eb INNER_JOIN FROM buys A, looks B WHERE A.h = B.h"))


def stream_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases without a view in their hour are reported when both streams have passed it."""
    return _streamed(spark, _event_stream(spark, sf_dir).sql(_PAIR + "SELECT A.h, A.user_id AS ua, B.user_id AS ub, A.event_id AS ea, B.event_id AS eb LEFT_OUTER_JOIN FROM buys A, looks B WHERE A.h = B.h and A.user_id = B.user_id"))


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts over a merge of two streams."""
    text = _THREE + "DEFINE { query_name 'm'; } MERGE R.ts_sec : S.ts_sec SLACK 2 FROM m1 R, m2 S; SELECT tb, count(*) AS cnt FROM m GROUP BY ts_sec/86400 AS tb"
    return _streamed(spark, _event_stream(spark, sf_dir).sql(text))


def stream_filter_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, _event_stream(spark, sf_dir).sql("SELECT ts_sec, event_id, user_id FROM events WHERE event_type = 'purchase'"))


RUNNING = "SELECT tb, event_type, count(*) AS n, sum(user_id) AS s, moving_sum(user_id, 3) AS m FROM events WHERE event_type <> 'error' GROUP BY ts_sec/86400 AS tb, event_type CLOSING_WHEN sum(user_id) % 2 = 1"


def stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts that run on until a day's sum is odd; moving sums begin anew then. The last day is still open."""
    return _streamed(spark, _event_stream(spark, sf_dir).sql(RUNNING))


def stream_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, _event_stream(spark, sf_dir).sql(LOSSY))


@output("queue", "word string")
class Words(Flowlet):
    @process_input()
    def process(self, record):
        for w in re.findall(r"[^\x20\x09-\x0D]+", record["text"] or ""):
            self.emit({"word": w})


def flow_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text")
    words = Flow("wordcount").source("lines", docs).add("split", Words(), 4).connect("lines", "split").build()["split"]["queue"]
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def flow_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey bigint, n_name string, n_regionkey string, missing int")


def topk_per_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weir.streaming.app import top_k_per_epoch

    s = engine(spark, sf_dir).stream("SELECT ts_sec/86400 AS tb, user_id FROM events")
    return top_k_per_epoch(s, "tb", ["user_id"], 3)


MORE: dict[str, tuple[Callable, str | None]] = {
    "agg_bool": (agg_bool, "WITH t AS (SELECT o_custkey, o_orderstatus = 'F' AS d FROM orders) SELECT o_custkey, sum(d::INT)::BIGINT AS s, bool_and(d) AS lo, bool_or(d) AS hi, bool_and(d) AS a, bool_or(d) AS o, bit_xor(d::INT) = 1 AS x FROM t GROUP BY ALL"),
    "query_library": (query_library, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL"),
    "operator_view": (operator_view, "SELECT l_orderkey // 1000 AS b, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) > 4) GROUP BY ALL"),
    "interface_set": (interface_set, "SELECT event_type, 'web' AS feed, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL"),
    "csv_source": (csv_source, "SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n, min(n_name) AS first FROM nation GROUP BY ALL"),
    "json_source": (json_source, "SELECT s_nationkey::BIGINT AS s_nationkey, count(*) AS n, max(s_name) AS last FROM supplier GROUP BY ALL"),
    "file_sink_buckets": (file_sink_buckets, f"SELECT ({SEC}) // 86400 * 86400 AS bucket, count(*) AS n, max({SEC}) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "smart_sampling": (smart_sampling, None),
    "flow_sampling": (flow_sampling, None),
    "lossy_counting": (lossy_counting, None),
    "stream_epoch_agg": (stream_epoch_agg, f"WITH t AS (SELECT ({SEC}) // 3600 AS tb, event_type FROM events) SELECT tb, event_type, count(*) AS cnt FROM t WHERE tb < (SELECT max(tb) FROM t) GROUP BY ALL"),
    "stream_join": (stream_join, f"{_WITH} SELECT a.h, a.event_id AS ea, b.event_id AS eb FROM a JOIN b ON a.h = b.h"),
    "stream_running": (
        stream_running,
        f"""WITH p AS (SELECT ({SEC}) // 86400 AS tb, event_type, count(*) AS n, sum(user_id)::BIGINT AS s FROM events WHERE event_type <> 'error' GROUP BY ALL),
d AS (SELECT unnest(range((SELECT min(tb) FROM p), (SELECT max(tb) FROM p))) AS tb),
w AS (SELECT d.tb, t.event_type, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(n, 0) > 0 AS own FROM d CROSS JOIN (SELECT DISTINCT event_type FROM p) t LEFT JOIN p USING (tb, event_type)),
l AS (SELECT *, coalesce(sum((s % 2 = 1)::INT) OVER (PARTITION BY event_type ORDER BY tb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM w),
b AS (SELECT *, bool_or(own) OVER (PARTITION BY event_type, life ORDER BY tb) AS begun FROM l)
SELECT tb, event_type, n, s, (sum(s) OVER (PARTITION BY event_type, life ORDER BY tb ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS m FROM b WHERE begun""",
    ),
    "stream_sampling": (stream_sampling, None),
    "stream_left_join": (
        stream_left_join,
        f"{_WITH}, w AS (SELECT least((SELECT max(h) FROM a), (SELECT max(h) FROM b)) AS h) SELECT a.h, a.user_id AS ua, coalesce(b.user_id, a.user_id) AS ub, a.event_id AS ea, coalesce(b.event_id, 0) AS eb FROM a LEFT JOIN b ON a.h = b.h AND a.user_id = b.user_id WHERE b.h IS NOT NULL OR a.h < (SELECT h FROM w)",
    ),
    "stream_merge": (stream_merge, f"WITH t AS (SELECT ({SEC}) // 86400 AS tb FROM events WHERE event_type IN ('view', 'purchase')) SELECT tb, count(*) AS cnt FROM t WHERE tb < (SELECT max(tb) FROM t) - 1 GROUP BY ALL"),
    "stream_filter_sink": (stream_filter_sink, f"SELECT {SEC} AS ts_sec, event_id, user_id FROM events WHERE event_type = 'purchase'"),
    "flow_wordcount": (flow_wordcount, r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM conversations) GROUP BY ALL"),
    "flow_projection": (flow_projection, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, NULL::INTEGER AS missing FROM nation"),
    "topk_per_epoch": (topk_per_epoch, f"SELECT tb, user_id, cnt, rank FROM (SELECT *, (row_number() OVER (PARTITION BY tb ORDER BY cnt DESC, user_id))::INTEGER AS rank FROM (SELECT ({SEC}) // 86400 AS tb, user_id, count(*) AS cnt FROM events GROUP BY ALL)) WHERE rank <= 3"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _text_query(n) for n in TEXTS} | {n: f for n, (f, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, _, sql) in TEXTS.items()} | {n: sql for n, (_, sql) in MORE.items() if sql}
