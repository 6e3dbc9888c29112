"""Lowering: a query's syntax tree to one DataFrame plan. Catalyst does pruning, pushdown, partial aggregation and join choice."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir import types as T
from weir.functions.library import Registry
from weir.plans import syntax as S
from weir.plans.expressions import Scope, Typed


@dataclass
class Stream:
    """A stream: rows, and the language's type and temporality of each column.

    checked: fields come from text, where a malformed value is null; a row lacking a field that a query uses is dropped.
    disorder: time units by which rows may be late (watermark delay when streaming).
    """

    df: DataFrame
    kinds: dict[str, str]
    moves: dict[str, str] = field(default_factory=dict)
    checked: bool = False
    disorder: int = 0
    interface: dict[str, object] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, kinds: dict[str, str] | None = None, increasing=(), decreasing=(), **more) -> Stream:
        kinds = kinds or {}
        known = {c: T.named(kinds[c]) if c in kinds else T.from_spark(t) for c, t in df.dtypes}
        known = {c: k for c, k in known.items() if k}
        have = dict(df.dtypes)
        as_typed = lambda c, k: F.col(f"`{c}`") if have[c] == T.SPARK[k] else F.timestamp_micros(T.micros(F.col(f"`{c}`"))) if have[c] == "timestamp_ntz" else F.col(f"`{c}`").cast(T.SPARK[k])
        df = df.select(*(as_typed(c, k).alias(c) for c, k in known.items()))
        return Stream(df, known, {**dict.fromkeys(increasing, T.INCREASING), **dict.fromkeys(decreasing, T.DECREASING)}, **more)


@dataclass
class Settings:
    """strict: refuse joins, merges and running queries without the ordered fields they need; wrap: C's integer overflow; null_mode sql: outer joins and subtotals keep nulls."""

    strict: bool = False
    wrap: bool = False
    null_mode: str = "empty"


def conjuncts(e) -> list:
    if e is None:
        return []
    if isinstance(e, S.Bin) and e.op == "AND":
        return [*conjuncts(e.a), *conjuncts(e.b)]
    return [e]


def tables_of(e, scopes: dict[str, Scope]) -> set[str]:
    """Aliases of the tables whose columns an expression uses."""
    found = set()
    for c in S.walk(e):
        if isinstance(c, S.Col):
            owners = [a for a, s in scopes.items() if (c.table in (None, a)) and _has(s, c)]
            if not owners:
                raise T.TypeError_(f"no column {c.table + '.' if c.table else ''}{c.name}")
            if len(owners) > 1:
                raise T.TypeError_(f"{c.name} is in several tables")
            found.add(owners[0])
        elif isinstance(c, S.IfParam) and c.table:
            found.add(c.table)
    return found


def _has(scope: Scope, c: S.Col) -> bool:
    try:
        scope.column(c)
        return True
    except T.TypeError_:
        return False


def is_aggregate(e, registry: Registry) -> bool:
    return isinstance(e, S.Call) and (e.name.lower() in S.AGGREGATES or e.name.lower() in registry.aggregates)


class Lowering:
    def __init__(self, registry: Registry, settings: Settings, params: dict) -> None:
        self.registry, self.settings, self.params = registry, settings, params

    # -- scopes

    def scope(self, q: S.Query, streams: dict[str, Stream], rename: bool = False) -> Scope:
        columns = {}
        for alias, s in streams.items():
            for name, kind in s.kinds.items():
                columns[alias, name] = Typed(F.col(f"{alias}__{name}" if rename else f"`{name}`"), kind, s.moves.get(name, T.VARYING))
        values = {**{k: v for k, v in q.define.items() if k == "__none__"}, **self.params}
        types = {k: v for k, v in q.params.items()}
        own = {k: self._parameter(v, types.get(k)) for k, v in values.items()}
        return Scope(columns, self.registry, own, {k: t for k, t in types.items() if k in own}, q.define, {a: s.interface for a, s in streams.items()}, self.settings.wrap)

    @staticmethod
    def _parameter(value, kind: str | None):
        kind = T.named(kind) if kind else None
        if kind == T.IP and isinstance(value, str):
            return T.parse_ip(value)
        if kind == T.IPV6 and isinstance(value, str):
            return T.parse_ipv6(value)
        if kind in T.INTEGERS and isinstance(value, str):
            return int(value)
        return value

    @staticmethod
    def used(q: S.Query, scope: Scope, alias: str) -> list[str]:
        """Columns of a table that a query uses."""
        trees = [e for e, _ in q.select] + [q.where, q.having, q.cleaning_when, q.cleaning_by, q.closing_when] + [g.expr for g in flat(q.group)]
        names = []
        for t in trees:
            for c in S.walk(t):
                if isinstance(c, S.Col) and c.table in (None, alias):
                    found = [n for (a, n) in scope.columns if a == alias and n.lower() == c.name.lower()]
                    names += [n for n in found if n == c.name] or found
        return list(dict.fromkeys(names))

    def checked(self, s: Stream, names: list[str]) -> DataFrame:
        df = s.df
        if s.checked:
            for n in names:
                df = df.where(F.col(f"`{n}`").isNotNull())
        return df

    def names(self, q: S.Query) -> list[str]:
        """Output names: as given; else the column's, the aggregate's (cnt, sum_x, ...) or f and its position; made distinct."""
        out: list[str] = []
        for i, (e, name) in enumerate(q.select):
            if name is None:
                if isinstance(e, S.Col):
                    name = e.name
                elif isinstance(e, S.Call) and e.name.lower() == "count":
                    name = "cnt"
                elif isinstance(e, S.Call) and len(e.args) >= 1 and isinstance(e.args[0], S.Col):
                    name = f"{e.name.lower()}_{e.args[0].name}"
                else:
                    name = f"f{i}"
            base, k = name, 2
            while name.lower() in (n.lower() for n in out):
                name, k = f"{base}_{k}", k + 1
            out.append(name)
        return out

    def project(self, q: S.Query, scope: Scope, df: DataFrame, disorder: int, lost: set[str] = frozenset()) -> Stream:
        """The select list over a scope."""
        typed = [scope.scalar(e) for e, _ in q.select]
        for c in scope.partial:
            df = df.where(c.isNotNull())
        names = self.names(q)
        out = df.select(*(t.col.alias(n) for t, n in zip(typed, names, strict=True)))
        moves = {n: t.moves for n, t in zip(names, typed, strict=True) if t.moves in (T.INCREASING, T.DECREASING) and n not in lost}
        return Stream(out, {n: t.kind for n, t in zip(names, typed, strict=True)}, moves, disorder=disorder)

    # -- the kinds of queries

    def query(self, q: S.Query, streams: dict[str, Stream]) -> Stream:
        stateful = any(isinstance(e, S.Call) and e.name.lower() in self.registry.states for t in self.trees(q) for e in S.walk(t))
        if q.merge:
            return self.merge(q, streams)
        if len(streams) > 1 or q.join:
            if q.group or any(is_aggregate(e, self.registry) for t in self.trees(q) for e in S.walk(t)):
                raise T.TypeError_("a join has no aggregates: name it and aggregate over its stream")
            return self.filter_join(q, streams) if q.join == "FILTER" else self.join(q, streams)
        if stateful or q.cleaning_by is not None or q.cleaning_when is not None:
            from weir.operators.sampling import sampling

            return sampling(self, q, streams)
        if q.closing_when is not None:
            from weir.operators.running import running

            return running(self, q, streams)
        if q.group or any(is_aggregate(e, self.registry) for t in self.trees(q) for e in S.walk(t)):
            return self.group(q, streams)
        return self.select(q, streams)

    @staticmethod
    def trees(q: S.Query) -> list:
        return [e for e, _ in q.select] + [x for x in (q.where, q.having, q.cleaning_when, q.cleaning_by, q.closing_when) if x is not None]

    def filtered(self, q: S.Query, scope: Scope, df: DataFrame) -> DataFrame:
        for e in conjuncts(q.where):
            before = len(scope.partial)
            c = scope.condition(e)
            for p in scope.partial[before:]:
                df = df.where(p.isNotNull())
            df = df.where(c)
        scope.partial.clear()
        return df

    def select(self, q: S.Query, streams: dict[str, Stream]) -> Stream:
        (alias, s), = streams.items()
        scope = self.scope(q, streams)
        df = self.filtered(q, scope, self.checked(s, self.used(q, scope, alias)))
        return self.project(q, scope, df, s.disorder)

    # -- grouping

    def aggregate(self, call: S.Call, scope: Scope) -> tuple[Column, str]:
        """An aggregate call as an aggregate Column, and its type."""
        name = call.name.lower()
        if name == "count":
            return F.count(F.lit(1)), T.UINT  # without nulls, count(e) counts every row
        if name not in S.AGGREGATES:
            args = [scope.scalar(a) for a in call.args]
            f = self.registry.find(self.registry.aggregates, name, [a.kind for a in args])
            return f.build(*scope._arguments(f, call.args, args)), f.result
        (arg,) = call.args
        a = scope.scalar(arg)
        if name == "sum":
            kind = T.summed(a.kind)
            value = a.col.cast("bigint") if a.kind in T.INTEGERS - {T.ULLONG} or a.kind == T.BOOL else a.col
            total = F.sum(value)
            return (T.wrapped(total, kind) if self.settings.wrap and kind != T.FLOAT else total.cast(T.SPARK[kind])), kind
        if name == "avg":
            return F.avg(a.col.cast("double")), T.FLOAT
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(a.col), a.kind
        bits = {"and_aggr": F.bit_and, "or_aggr": F.bit_or, "xor_aggr": F.bit_xor}[name]
        if a.kind == T.BOOL:
            return bits(a.col.cast("int")) != 0, T.BOOL
        if a.kind not in T.INTEGERS | {T.IP}:
            raise T.TypeError_(f"{call.name} of {a.kind}")
        return bits(a.col.cast("bigint")).cast(T.SPARK[a.kind]), a.kind

    def calls(self, q: S.Query, over: bool = False) -> list[S.Call]:
        found = [e for t in [*(e for e, _ in q.select), q.having, q.closing_when] for e in S.walk(t) if is_aggregate(e, self.registry) and e.super == over]
        return list(dict.fromkeys(found))

    def group(self, q: S.Query, streams: dict[str, Stream]) -> Stream:
        (alias, s), = streams.items()
        scope = self.scope(q, streams)
        df = self.filtered(q, scope, self.checked(s, self.used(q, scope, alias)))
        items = flat(q.group)
        keys = {g.name: scope.scalar(g.expr) for g in items}
        calls = self.calls(q)
        whole = [replace(c, super=False) for c in self.calls(q, True)]
        built = {c: self.aggregate(c, scope) for c in dict.fromkeys([*calls, *_needed(whole)])}
        for c in scope.partial:
            df = df.where(c.isNotNull())
        df = df.withColumns({f"_k_{n}": t.col for n, t in keys.items()}) if keys else df
        names, event = list(keys), None
        if df.isStreaming:
            df, event = self._event_time(df, keys, s.disorder)
        cols = [event[1] if event and n == event[0] else F.col(f"_k_{n}") for n in names]
        aggs = [a.alias(f"_a{i}") for i, (a, _) in enumerate(built.values())] or [F.count(F.lit(1)).alias("_n")]
        patterns = grouping_patterns(q.group or [])
        if not names:
            out = df.agg(*aggs)
            if s.df is not None and self.settings.null_mode == "empty":  # no row in, no row out
                out = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).where("_rows > 0")
        elif len(patterns) == 1:
            out = df.groupBy(*cols).agg(*aggs)
        else:
            marks = [F.grouping(f"_k_{n}").alias(f"_r_{n}") for n in names]
            out = df.groupingSets([[F.col(f"_k_{n}") for n in p] for p in patterns], *cols).agg(*aggs, *marks)
            if self.settings.null_mode == "empty":
                out = out.withColumns({f"_k_{n}": F.when(F.col(f"_r_{n}") == 1, T.empty(keys[n].kind)).otherwise(F.col(f"_k_{n}")) for n in names})
        if event:
            out = out.withColumn(f"_k_{event[0]}", F.unix_seconds(F.col(f"_e_{event[0]}")).cast(T.SPARK[keys[event[0]].kind]))
        after = self.after(scope, items, keys, {c: Typed(F.col(f"_a{i}"), kind) for i, (c, (_, kind)) in enumerate(built.items())})
        if whole:
            own = [n for n in names if n in q.supergroup or keys[n].moves in (T.INCREASING, T.DECREASING)]
            for i, c in enumerate(whole):
                out = out.withColumn(f"_s{i}", _over(c, after.calls, Window.partitionBy(*(f"_k_{n}" for n in own))))
                after.calls[replace(c, super=True)] = Typed(F.col(f"_s{i}"), built[c][1] if c in built else T.FLOAT)
        if q.having is not None:
            out = out.where(after.condition(q.having))
        return self.project(q, after, out, s.disorder)

    def after(self, scope: Scope, items: list[S.GroupBy], keys: dict[str, Typed], calls: dict) -> Scope:
        """What names mean behind a GROUP BY: its variables and the aggregates."""
        columns = {}
        for g in items:
            t = Typed(F.col(f"_k_{g.name}"), keys[g.name].kind, keys[g.name].moves)
            columns[None, g.name] = t
            if isinstance(g.expr, S.Col):
                for (alias, name), old in scope.columns.items():
                    if old.col is scope.column(g.expr).col:
                        columns[alias, name] = t
        return replace(scope, columns=columns, calls=calls, partial=[])

    def _event_time(self, df: DataFrame, keys: dict[str, Typed], disorder: int):
        """The first ordered grouping value as an event time of one second a unit, with a watermark of one epoch or more."""
        for n, t in keys.items():
            if t.moves == T.INCREASING and t.kind in T.INTEGERS:
                at = f"_e_{n}"
                df = df.withColumn(at, F.timestamp_seconds(F.col(f"_k_{n}").cast("bigint"))).withWatermark(at, f"{max(1, disorder)} seconds")
                return df, (n, F.col(at))
        raise T.TypeError_("a streaming aggregation needs an increasing value in GROUP BY")

    # -- joins

    def join(self, q: S.Query, streams: dict[str, Stream]) -> Stream:
        if len(streams) != 2:
            raise T.TypeError_("a join has two inputs: name a join of two and join its stream with the next")
        (la, ls), (ra, rs) = streams.items()
        scope = self.scope(q, streams, rename=True)
        single = {a: Scope({k: t for k, t in scope.columns.items() if k[0] == a}, self.registry, scope.params, scope.param_types, scope.macros, scope.interface, scope.wrap) for a in streams}
        sides = {a: self.checked(s, self.used(q, scope, a)).select(*(F.col(f"`{c}`").alias(f"{a}__{c}") for c in s.kinds)) for a, s in streams.items()}
        equal, rest = [], []
        for e in conjuncts(q.where):
            owners = tables_of(e, single)
            if len(owners) <= 1:
                a = next(iter(owners), la)
                before = len(scope.partial)
                c = scope.condition(e)
                for p in scope.partial[before:]:
                    sides[a] = sides[a].where(p.isNotNull())
                del scope.partial[before:]
                sides[a] = sides[a].where(c)
            elif isinstance(e, S.Bin) and e.op == "=" and [len(tables_of(x, single)) for x in (e.a, e.b)] == [1, 1]:
                left, right = (e.a, e.b) if tables_of(e.a, single) == {la} else (e.b, e.a)
                equal.append((left, right))
            else:
                rest.append(e)
        pairs = [(scope.scalar(x), scope.scalar(y)) for x, y in equal]
        for x, y in pairs:
            if not T.comparable(x.kind, y.kind):
                raise T.TypeError_(f"{x.kind} = {y.kind}")
        ordered = [i for i, (x, y) in enumerate(pairs) if x.moves == y.moves and x.moves in (T.INCREASING, T.DECREASING)]
        if not ordered and (self.settings.strict or sides[la].isStreaming or sides[ra].isStreaming):
            raise T.TypeError_("a join needs an equality of two values that increase, or decrease, together")
        if not pairs:
            raise T.TypeError_("a join needs an equality between its inputs")
        for a, k in ((la, 0), (ra, 1)):
            for i, p in enumerate(pairs):
                value = p[k].col if pairs[i][0].kind == pairs[i][1].kind else p[k].col.cast(T.SPARK[_common(pairs[i][0].kind, pairs[i][1].kind)])
                sides[a] = sides[a].withColumn(f"_j{k}_{i}", value)
            sides[a] = sides[a].withColumn(f"_in{k}", F.lit(True))
            if sides[a].isStreaming:
                i = ordered[0]
                sides[a] = sides[a].withColumn(f"_j{k}_{i}", F.timestamp_seconds(F.col(f"_j{k}_{i}").cast("bigint"))).withWatermark(f"_j{k}_{i}", f"{max(1, streams[a].disorder)} seconds")
        on = [F.col(f"_j0_{i}") == F.col(f"_j1_{i}") for i in range(len(pairs))]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        kind = q.join or "INNER"
        df = sides[la].join(sides[ra], condition, {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}[kind])
        if kind != "INNER" and self.settings.null_mode == "empty":
            df = self._fill(df, scope, streams, equal, pairs, kind)
        for e in rest:
            df = df.where(scope.condition(e))
        # behind an outer join, an ordered value of a side that may be missing is one only if the equality fills it
        filled = {c for x, y in equal for c in (x, y) if isinstance(c, S.Col)}
        missing = {"INNER": set(), "LEFT": {ra}, "RIGHT": {la}, "FULL": {la, ra}}[kind]
        lost = {n for (e, _), n in zip(q.select, self.names(q), strict=True) if isinstance(e, S.Col) and tables_of(e, single) & missing and e not in filled}
        tied = {id(t.col) for i in ordered for t in pairs[i]}
        for k, t in list(scope.columns.items()):
            if id(t.col) not in tied and t.moves != T.VARYING:
                scope.columns[k] = replace(t, moves=T.VARYING)
        return self.project(q, scope, df, max(ls.disorder, rs.disorder), lost)

    def _fill(self, df: DataFrame, scope: Scope, streams: dict[str, Stream], equal, pairs, kind: str) -> DataFrame:
        """What stands for a missing side: the other side's value of an equality, else the type's empty value."""
        (la, ls), (ra, rs) = streams.items()
        fills = {}
        for a, s, k, other in ((la, ls, 0, 1), (ra, rs, 1, 0)):
            if kind not in ("FULL", "RIGHT" if k == 0 else "LEFT"):
                continue
            for c, t in s.kinds.items():
                value = T.empty(t)
                for sides, typed in zip(equal, pairs, strict=True):
                    own = sides[k]
                    if isinstance(own, S.Col) and scope.column(own).col is scope.columns[a, c].col:
                        value = typed[other].col.cast(T.SPARK[t])
                        break
                fills[f"{a}__{c}"] = F.when(F.col(f"_in{k}").isNull(), value).otherwise(F.col(f"{a}__{c}"))
        return df.withColumns(fills)

    def filter_join(self, q: S.Query, streams: dict[str, Stream]) -> Stream:
        """Rows of the first input with an equal key in the second within the last `range` time units.

        The second input is reduced to its least and greatest time a key and span of `range` units: a row finds a partner
        in its own span (if the least is not later) or in the one before (if the greatest is recent enough). So
        the join is on equality alone, its right side is small, and a frequent key is spread over its spans.
        """
        if len(streams) != 2:
            raise T.TypeError_("FILTER_JOIN has two inputs")
        (la, ls), (ra, rs) = streams.items()
        scope = self.scope(q, streams, rename=True)
        single = {a: Scope({k: t for k, t in scope.columns.items() if k[0] == a}, self.registry, scope.params, scope.param_types, scope.macros, scope.interface, scope.wrap) for a in streams}
        sides = {a: self.checked(s, self.used(q, scope, a)).select(*(F.col(f"`{c}`").alias(f"{a}__{c}") for c in s.kinds)) for a, s in streams.items()}
        for e, _ in q.select:
            if ra in tables_of(e, single):
                raise T.TypeError_("FILTER_JOIN selects from its first input only")
        equal = []
        for e in conjuncts(q.where):
            owners = tables_of(e, single)
            if len(owners) <= 1:
                a = next(iter(owners), la)
                sides[a] = sides[a].where(scope.condition(e))
            elif isinstance(e, S.Bin) and e.op == "=" and [len(tables_of(x, single)) for x in (e.a, e.b)] == [1, 1]:
                equal.append((e.a, e.b) if tables_of(e.a, single) == {la} else (e.b, e.a))
            else:
                raise T.TypeError_("FILTER_JOIN relates its inputs by equalities only")
        if not equal:
            raise T.TypeError_("FILTER_JOIN needs an equality between its inputs")
        column, span = q.window
        if span <= 0:
            raise T.TypeError_("FILTER_JOIN's range is at least 1")
        at = {a: scope.column(S.Col(a, column.name)) for a in streams}
        if self.settings.strict and any(t.moves != T.INCREASING for t in at.values()):
            raise T.TypeError_("FILTER_JOIN's time increases in both inputs")
        keys = [(scope.scalar(x).col, scope.scalar(y).col) for x, y in equal]
        time = {a: (F.unix_seconds(t.col) if t.kind == T.TIMEVAL else t.col.cast("bigint")) for a, t in at.items()}
        names = [f"_q{i}" for i in range(len(keys))]
        right = sides[ra].select(*(y.alias(n) for (_, y), n in zip(keys, names, strict=True)), time[ra].alias("_t")).withColumn("_b", T.floored(F.col("_t"), span))
        seen = right.groupBy(*names, "_b").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        none = F.lit(None).cast("bigint")
        spans = F.explode(F.array(F.struct(F.col("_b").alias("b"), F.col("_lo").alias("lo"), none.alias("hi")), F.struct((F.col("_b") + 1).alias("b"), none.alias("lo"), F.col("_hi").alias("hi"))))
        seen = seen.select(*names, spans.alias("_s")).select(*names, F.col("_s.b").alias("_b"), "_s.lo", "_s.hi").groupBy(*names, "_b").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
        left = sides[la].withColumns({f"_p{i}": x for i, (x, _) in enumerate(keys)}).withColumn("_lt", time[la]).withColumn("_lb", T.floored(F.col("_lt"), span))
        condition = (F.col("_lb") == F.col("_b")) & ((F.col("_lo") <= F.col("_lt")) | (F.col("_hi") > F.col("_lt") - span))
        for i, n in enumerate(names):
            condition = condition & (F.col(f"_p{i}") == F.col(n))
        return self.project(q, scope, left.join(seen, condition, "left_semi"), ls.disorder)

    # -- merging

    def merge(self, q: S.Query, streams: dict[str, Stream]) -> Stream:
        if len(q.merge) != len(streams):
            raise T.TypeError_("MERGE names one column for each input")
        inputs = list(streams.items())
        first = inputs[0][1]
        for _, s in inputs[1:]:
            if list(s.kinds.values()) != list(first.kinds.values()):
                raise T.TypeError_("MERGE takes inputs of the same types")
        on = []
        for c, (alias, s) in zip(q.merge, inputs, strict=True):
            names = [n for n in s.kinds if n.lower() == c.name.lower()]
            if c.table not in (None, alias) or not names:
                raise T.TypeError_(f"{c.table}.{c.name} is no column of {alias}")
            if self.settings.strict and s.moves.get(names[0]) not in (T.INCREASING, T.DECREASING):
                raise T.TypeError_(f"MERGE needs an ordered column; {alias}.{c.name} is not")
            on.append(list(s.kinds).index(names[0]))
        if len(set(on)) > 1:
            raise T.TypeError_("MERGE's columns stand in the same place of each input")
        name = list(first.kinds)[on[0]]
        df = first.df
        for _, s in inputs[1:]:
            df = df.union(s.df.toDF(*first.kinds))
        slack = int(self.scope(q, streams).constant(q.slack)) if q.slack is not None else 0
        return Stream(df, dict(first.kinds), {name: first.moves.get(name, T.INCREASING)}, any(s.checked for _, s in inputs), max([slack, *(s.disorder for _, s in inputs)]))


def _common(a: str, b: str) -> str:
    return T.FLOAT if T.FLOAT in (a, b) else T.ULLONG if T.ULLONG in (a, b) else T.LLONG


def flat(group) -> list[S.GroupBy]:
    """All grouping variables, each once."""
    out: dict[str, S.GroupBy] = {}
    for g in group or []:
        for item in [g] if isinstance(g, S.GroupBy) else [i for s in g.sets for i in s]:
            out.setdefault(item.name, item)
    return list(out.values())


def grouping_patterns(group) -> list[list[str]]:
    """The lists of variables that are grouped by: plain ones in all, and every choice of ROLLUP, CUBE and GROUPING_SETS."""
    choices = []
    for g in group:
        if isinstance(g, S.GroupBy):
            choices.append([[g.name]])
            continue
        names = [i.name for i in g.sets[0]]
        if g.kind == "ROLLUP":
            choices.append([names[:k] for k in range(len(names), -1, -1)])
        elif g.kind == "CUBE":
            choices.append([list(c) for k in range(len(names), -1, -1) for c in combinations(names, k)])
        else:
            choices.append([[i.name for i in s] for s in g.sets])
    return [list(dict.fromkeys(n for part in parts for n in part)) for parts in product(*choices)]


def _needed(whole: list[S.Call]) -> list[S.Call]:
    """Group-level aggregates from which those over the supergroup are made."""
    out = []
    for c in whole:
        out += [S.Call("sum", c.args), S.Call("count", (), True)] if c.name.lower() == "avg" else [c]
    return out


def _over(c: S.Call, calls: dict[S.Call, Typed], w) -> Column:
    name = c.name.lower()
    if name == "avg":
        return F.sum(calls[S.Call("sum", c.args)].col).over(w) / F.sum(calls[S.Call("count", (), True)].col).over(w)
    own = calls[c]
    if name in ("count", "sum"):
        return F.sum(own.col).over(w).cast(T.SPARK[own.kind])
    fold = {"min": F.min, "max": F.max, "and_aggr": F.bit_and, "or_aggr": F.bit_or, "xor_aggr": F.bit_xor}.get(name)
    if fold is None:
        raise T.TypeError_(f"{c.name}$ is not an aggregate over supergroups")
    return fold(own.col).over(w)
