"""The language: syntax, types, temporality, results on small feeds."""

import operator
from functools import reduce

import pytest

from weir import types as T
from weir.plans import syntax as S
from weir.plans.lower import grouping_patterns
from weir.session import Engine

SCHEMAS = """
PROTOCOL arrivals { uint seen get_system_time (required, increasing); }
PROTOCOL WORDS (arrivals) { string first get_csv_string_pos1; string second get_csv_string_pos2; uint n get_csv_uint_pos3; }
PROTOCOL MIXED (arrivals) { int n get_csv_int_pos1; bool flag get_csv_bool_pos2; string left get_csv_string_pos3; string right get_csv_string_pos4; }
""" + "".join(f"PROTOCOL KV_{t} (arrivals) {{ {t} Key get_csv_{t.lower()}_pos1; {t} Value get_csv_{t.lower()}_pos2; }}\n" for t in "bool float int IP IPV6 llong string uint ullong ushort".split())


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register_schemas(SCHEMAS)
    e.catalog.system_time = 1
    return e


def feed(engine, tmp_path, lines, separator="|"):
    path = tmp_path / "in.txt"
    path.write_text("\n".join(lines) + "\n")
    engine.register_interface("csv0", "CSV", Path=str(path), CSVSeparator=separator, InterfaceType="CSV")
    engine.catalog.add_sets("csv : Equals[Host,'localhost'] and Contains[InterfaceType,CSV]")


def lines_of(stream):
    from weir.operators.sinks import text_lines

    return sorted(r.value for r in text_lines(stream).collect())


RED = ["red|apple|7", "red|rose|12", "red|brick|8"]
LEAF = ["lime|leaf|12", "oak|leaf|3", "elm|leaf|9"]
OTHER = ["elm|bark|5", "apple|red|6", "blue|sky|20"]
SIDES = "DEFINE { query_name 'reds'; } SELECT seen, first, second, n FROM [csv].WORDS WHERE first = 'red'; DEFINE { query_name 'leaves'; } SELECT seen, first, second, n FROM [csv].WORDS WHERE second = 'leaf'"
JOIN = "SELECT r.seen, r.first, r.second, r.n, l.first, l.second, l.n {} FROM reds r, leaves l WHERE {} r.seen = l.seen"
BOTH, REST_RED, REST_LEAF = ["1|red|rose|12|lime|leaf|12"], ["1|red|apple|7|||7", "1|red|brick|8|||8"], ["1|||3|oak|leaf|3", "1|||9|elm|leaf|9"]


@pytest.mark.parametrize(
    ("kind", "lines", "condition", "want"),
    [
        ("INNER_JOIN", ["red|oak|4", "oak|leaf|5", "red|pine|6", *OTHER], "r.second = l.first and", ["1|red|oak|4|oak|leaf|5"]),
        ("INNER_JOIN", RED + LEAF + OTHER, "r.n = l.n and", BOTH),
        ("LEFT_OUTER_JOIN", RED + LEAF + OTHER, "r.n = l.n and", BOTH + REST_RED),
        ("RIGHT_OUTER_JOIN", OTHER + RED + LEAF, "r.n = l.n and", BOTH + REST_LEAF),
        ("OUTER_JOIN", LEAF + OTHER + RED, "r.n = l.n and", BOTH + REST_RED + REST_LEAF),
        ("INNER_JOIN", ["red|leaf|1", "red|fox|2", "oak|leaf|3", *OTHER], "", [f"1|{a}|{b}" for a in ("red|leaf|1", "red|fox|2") for b in ("red|leaf|1", "oak|leaf|3")]),
    ],
)
def test_joins_fill_what_is_missing(engine, tmp_path, kind, lines, condition, want):
    feed(engine, tmp_path, lines)
    engine.settings.strict = True
    engine.sql(SIDES)
    assert lines_of(engine.stream(JOIN.format(kind, condition))) == sorted(want)


ROWS = {"s": "40|TRUE|Left1|Left2", "a": "95|FALSE|same|same", "x": "3|TRUE|zoo|ant", "o": "62|TRUE|lOWER|Other"}


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("left = right", "a"), ("n = 3", "x"), ("flag = TRUE", "sxo"), ("left <> right", "sxo"), ("n <> 3", "aos"), ("left <> 'same'", "sxo"),
        ("right > left", "s"), ("n > 40", "ao"), ("flag > FALSE", "sxo"), ("right >= left", "sa"), ("n >= 40", "sao"), ("flag >= TRUE", "sxo"),
        ("left in [ 'Left1', 'zoo']", "sx"), ("n in [ 40, 62 ]", "so"), ("flag in [ TRUE ]", "sxo"),
        ("n < 40 or not (flag = TRUE)", "ax"), ("(n + 1) * 2 <= 82", "sx"), ("((n)) < 4", "x"), ("str_exists_substr[left, 'me']", "a"), ("str_compare[left, 'zoo'] and n >= 62", "ao"),
    ],
)
def test_predicates(engine, tmp_path, where, want):
    feed(engine, tmp_path, ROWS.values())
    got = lines_of(engine.stream(f"SELECT seen, n, flag, left, right FROM csv0.MIXED WHERE {where}"))
    assert got == sorted("1|" + ROWS[k] for k in want)


def grouped(rows, read, show, folds):
    """Groups of `key|value` lines, folded one by one."""
    groups = {}
    for line in rows:
        key, value = line.split("|")
        groups.setdefault(key, []).append(read(value))
    return sorted("|".join(["1", k, str(len(v)), *(s(f(v)) for f, s in zip(folds, show, strict=True))]) for k, v in groups.items())


BITS = [sum, min, max, lambda v: reduce(operator.and_, v), lambda v: reduce(operator.or_, v), lambda v: reduce(operator.xor, v)]
INTEGERS = [f"{k}|{v}" for k, v in [(4, 12), (9, 77), (4, 12), (31, 90210), (31, 655), (31, 655), (8, 1), (8, 255), (8, 4095), (9, 512)]]


@pytest.mark.parametrize("kind", ["int", "uint", "llong", "ullong"])
def test_integer_aggregates(engine, tmp_path, kind):
    feed(engine, tmp_path, INTEGERS)
    q = f"SELECT seen, Key, count(*), sum(Value), min(Value), max(Value), AND_AGGR(Value), OR_AGGR(Value), XOR_AGGR(Value) FROM [csv].KV_{kind} GROUP BY seen, Key"
    assert lines_of(engine.stream(q)) == grouped(INTEGERS, int, [str] * 6, BITS)


TRUTH = {True: "TRUE", False: "FALSE"}.get
OF_KIND = {
    "float": (["7.250000|0.500000", "7.250000|2.125000", "19.000000|3.000000", "7.250000|0.500000"], float, [lambda v: f"{v:.6f}"] * 3, [sum, min, max], "sum(Value), min(Value), max(Value)"),
    "bool": (["TRUE|FALSE", "FALSE|FALSE", "TRUE|TRUE", "FALSE|FALSE", "TRUE|TRUE", "TRUE|TRUE"], lambda v: v == "TRUE", [str, *[TRUTH] * 5], BITS, "sum(Value), min(Value), max(Value), AND_AGGR(Value), OR_AGGR(Value), XOR_AGGR(Value)"),
    "string": (["pear|green", "Pear|Zinc", "pear|Green", "pear|greener"], str, [str] * 2, [min, max], "min(Value), max(Value)"),
    "IP": (["10.0.0.7|9.255.0.1", "10.0.0.7|100.0.0.1", "192.168.3.4|1.2.3.4"], lambda v: tuple(map(int, v.split("."))), [lambda v: ".".join(map(str, v))] * 2, [min, max], "min(Value), max(Value)"),
    "IPV6": (["2001:0db8:0000:0000:0000:0000:0000:0001|fd00:0000:0000:0000:0000:0000:0000:0009", "2001:0db8:0000:0000:0000:0000:0000:0001|2001:0db8:00ff:0000:0000:0000:0000:0000"], str, [str] * 2, [min, max], "min(Value), max(Value)"),
}


@pytest.mark.parametrize("kind", OF_KIND)
def test_other_aggregates(engine, tmp_path, kind):
    rows, read, show, folds, aggregates = OF_KIND[kind]
    feed(engine, tmp_path, rows)
    assert lines_of(engine.stream(f"SELECT seen, Key, count(*), {aggregates} FROM [csv].KV_{kind} GROUP BY seen, Key")) == grouped(rows, read, show, folds)


@pytest.mark.parametrize(
    ("kind", "rows"),
    [("IP", "10.20.30.40|1.2.3.4"), ("bool", "TRUE|FALSE FALSE|TRUE"), ("float", "2.500000|-0.125000"), ("int", "15|-20"), ("llong", "-77|4000000000"), ("string", "a|b"), ("uint", "1|4294967295"), ("ullong", "5|18446744073709551615"), ("ushort", "1|65535"), ("IPV6", "fd00:0000:0000:0000:0000:0000:00aa:0001|0000:0000:0000:0000:0000:0000:0000:0001")],
)
def test_types_pass_through(engine, tmp_path, kind, rows):
    feed(engine, tmp_path, rows.split())
    assert lines_of(engine.stream(f"SELECT seen, Key, Value FROM [csv].KV_{kind}")) == sorted("1|" + r for r in rows.split())


def test_malformed_fields_drop_rows_that_use_them(engine, tmp_path):
    feed(engine, tmp_path, ["1|2", "x|3", "4", "5|99999999999"])
    assert lines_of(engine.stream("select Key from [csv].KV_int")) == ["1", "4", "5"]
    assert lines_of(engine.stream("select Value from [csv].KV_int")) == ["2", "3"]


def test_syntax():
    q, = S.parse("SELECT a|b+1<<2 AS v, -x FROM lib/q t WHERE a & 1 = 2 AND (x IN [1,2] OR NOT p[]) // end")
    assert q.tables == [S.Table("lib/q", "t")]
    assert q.select[0][0] == S.Bin("|", S.Col(None, "a"), S.Bin("<<", S.Bin("+", S.Col(None, "b"), S.Lit("INT", "1")), S.Lit("INT", "2")))
    assert q.where.b.b == S.Un("NOT", S.Pred("p", ()))
    q, = S.parse("DEFINE { query_name 'm'; } PARAM { n int; } MERGE A.t : B.t : C.t SLACK 5 FROM i.x A, 'h'.i.y B, h.i.z C")
    assert [t.machine for t in q.tables] == [None, "h", "h"] and len(q.merge) == 3 and q.params == {"n": "int"}
    for bad in ("SELECT FROM t", "SELECT a FROM t GROUP BY a+1", "SELECT a b FROM t", "MERGE A.t FROM A", "SELECT a FROM t WHERE a", "SELECT a FROM [s].i.t"):
        with pytest.raises(S.SyntaxError_):
            S.parse(bad)
    assert [g.name for s in S.parse("SELECT a FROM t GROUP BY GROUPING_SETS((a),(a,b/2 AS h))")[0].group[0].sets for g in s] == ["a", "a", "h"]


def test_grouping_patterns():
    q, = S.parse("SELECT t FROM x GROUP BY t, ROLLUP(a,b), CUBE(c)")
    assert grouping_patterns(q.group) == [["t", "a", "b", "c"], ["t", "a", "b"], ["t", "a", "c"], ["t", "a"], ["t", "c"], ["t"]]


@pytest.mark.parametrize(
    ("op", "a", "b", "want"),
    [("+", "INT", "INT", "INT"), ("+", "INT", "UINT", "UINT"), ("*", "USHORT", "LLONG", "LLONG"), ("-", "LLONG", "ULLONG", "ULLONG"), ("/", "FLOAT", "UINT", "FLOAT"), ("+", "TIMEVAL", "INT", "TIMEVAL"), ("-", "TIMEVAL", "TIMEVAL", "INT"), ("<<", "UINT", "INT", "UINT"), ("%", "FLOAT", "INT", None), ("+", "STRING", "INT", None), ("<<", "UINT", "LLONG", None)],
)
def test_result_types(op, a, b, want):
    if want:
        assert T.arithmetic(op, a, b) == want
    else:
        with pytest.raises(T.TypeError_):
            T.arithmetic(op, a, b)


@pytest.mark.parametrize(
    ("op", "a", "b", "ka", "kb", "want"),
    [
        ("/", "increasing", "constant", "UINT", "UINT", "increasing"), ("/", "increasing", "constant", "INT", "INT", "varying"), ("+", "increasing", "increasing", "INT", "INT", "increasing"), ("+", "constant", "decreasing", "INT", "INT", "decreasing"),
        ("-", "constant", "increasing", "UINT", "UINT", "decreasing"), ("-", "increasing", "constant", "UINT", "UINT", "varying"), ("-", "constant", "increasing", "UINT", "INT", "varying"), ("*", "increasing", "constant", "UINT", "UINT", "increasing"),
        ("%", "increasing", "constant", "UINT", "UINT", "varying"), ("/", "constant", "increasing", "UINT", "UINT", "decreasing"),
    ],
)
def test_temporality(op, a, b, ka, kb, want):
    assert T.moves(op, a, b, ka, kb) == want


def test_schemas_and_operators(spark):
    e = Engine(spark)
    e.register_schemas("UNPACK_FCNS { f x 1; } PROTOCOL a { uint t get_t (increasing); } PROTOCOL b (a) { string s get_csv_string_pos1; } OPERATOR_VIEW twice { OPERATOR (file 'x') FIELDS { uint t (increasing); uint n; } SUBQUERIES { src (uint t, uint n); } SELECTION_PUSHDOWN }")
    assert [f.name for f in e.catalog.fields("b")] == ["t", "s"]
    e.register_table("src", spark.createDataFrame([(1, 2), (3, 4)], "t long, n long"), {"t": "uint", "n": "uint"}, ["t"])
    e.register_operator("twice", lambda dfs, params: dfs[0].union(dfs[0]))
    assert sorted(tuple(r) for r in e.sql("SELECT tb, sum(n) AS s FROM twice GROUP BY t/2 AS tb").collect()) == [(0, 4), (1, 8)]
    e.register_table("src", spark.createDataFrame([(1, "2")], "t long, n string"), {"t": "uint"}, ["t"])
    with pytest.raises(T.TypeError_):
        e.sql("SELECT t FROM twice")


def test_operators_on_values(spark):
    from datetime import datetime, timezone
    from decimal import Decimal

    e = Engine(spark)
    df = spark.createDataFrame([(7, -7, 3, bytes(range(240, 256)), True, datetime.fromtimestamp(100, timezone.utc), Decimal((1 << 64) - 2))], "u long, i int, h int, six binary, b boolean, t timestamp, w decimal(20,0)")
    e.register_table("v", df, {"u": "uint", "h": "ushort", "six": "IPV6"})
    one = lambda x: e.sql(f"SELECT {x} AS r FROM v").first().r
    assert [one(x) for x in ("i / 2", "i % 4", "u / 2", "-u", "!u", "!b", "~i", "~u", "u << 2", "u >> 1", "u & 3 | 8", "+u")] == [-3, -3, 3, -7, 0, False, 6, 4294967288, 28, 3, 11, 7]
    assert one("six & IPV6_VAL 'ffff:0:ffff:0:ffff:0:ffff:0'") == bytes(b if k // 2 % 2 == 0 else 0 for k, b in enumerate(range(240, 256)))
    assert one("six | IPV6_VAL '::ffff'") == bytes([*range(240, 254), 255, 255])
    assert one("t + 1500").replace(tzinfo=timezone.utc).timestamp() == 101.5 and one("t - TIMEVAL '99.250'") == 750 and one("t / 4").replace(tzinfo=timezone.utc).timestamp() == 25
    assert one("w / 2") == (1 << 63) - 1 and one("w / (w + 1)") == 0 and one("(w + 1) / w") == 1 and one("w + 1") == (1 << 64) - 1 and one("LHEX 'ffffffffff' & 255") == 255
    assert one("1.5e1 * h") == 45.0 and one("'it''s'") == "it's" and one("INT(u) - 9") == -2 and one("ULLONG(i)") == (1 << 64) - 7
    option = lambda text, n: e.sql(f"SELECT has_ipv4_option('{text}', {n}) AS r FROM v").first().r
    assert [option("", 1), option("\x01\x01\x07\x04ab\x08", 8), option("\x01\x07\x04ab\x03", 3), option("\x07\x04ab\x03", 9), option("\x87\x03ab", 7), option("\x02\x08", 8), option("\x03\x00\x08", 8)] == [0, 1, 1, 0, 1, 0, 0]
    for bad in ("six + 1", "b + 1", "t * 2", "'a' & 1", "u << w", "nothing(u)", "strtoi(u)", "sum(sum(u))", "$p", "@x"):
        with pytest.raises((T.TypeError_, S.SyntaxError_)):
            one(bad)
