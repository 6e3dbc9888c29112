"""Binding: syntax trees to typed Spark columns, with temporality."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir import types as T
from weir.functions.library import Registry
from weir.plans import syntax as S


@dataclass
class Typed:
    col: Column
    kind: str
    moves: str = T.VARYING


@dataclass
class Scope:
    """What names mean: columns by (table alias, name), parameters, DEFINE texts, source parameters."""

    columns: dict[tuple[str | None, str], Typed]
    registry: Registry
    params: dict[str, object] = field(default_factory=dict)
    param_types: dict[str, str] = field(default_factory=dict)
    macros: dict[str, str] = field(default_factory=dict)
    interface: dict[str, dict[str, object]] = field(default_factory=dict)
    wrap: bool = False
    calls: dict[S.Call, Typed] = field(default_factory=dict)  # aggregates that have been computed
    partial: list[Column] = field(default_factory=list)  # results whose absence drops the row

    def column(self, c: S.Col) -> Typed:
        if (c.table, c.name) in self.columns:
            return self.columns[c.table, c.name]
        found = {id(t.col): t for (table, name), t in self.columns.items() if name == c.name and (c.table is None or table == c.table)}
        if len(found) > 1:
            raise T.TypeError_(f"{c.name} is in several tables")
        if not found:
            folded = {id(t.col): t for (table, name), t in self.columns.items() if name.lower() == c.name.lower() and (c.table is None or (table or "").lower() == c.table.lower())}
            if len(folded) == 1:
                return next(iter(folded.values()))
            raise T.TypeError_(f"no column {c.table + '.' if c.table else ''}{c.name}")
        return next(iter(found.values()))

    # -- literals

    def literal(self, e) -> tuple[object, str]:
        """Python value and type."""
        if isinstance(e, S.Macro):
            if e.name not in self.macros:
                raise T.TypeError_(f"#{e.name} is not defined")
            return self.macros[e.name], T.STRING
        if isinstance(e, S.Un) and e.op == "-":
            value, kind = self.literal(e.a)
            return -value, T.negated(kind)
        if not isinstance(e, S.Lit):
            raise T.TypeError_("a literal is due")
        k, t = e.kind, e.text
        if k == "STRING":
            return t, T.STRING
        if k == "BOOL":
            return t.upper() == "TRUE", T.BOOL
        if k in ("INT", "LONG"):
            value = int(t.rstrip("uUlL"))
            return value, T.UINT if k == "INT" and value < T.WORD else T.ULLONG
        if k == "FLOAT":
            return float(t), T.FLOAT
        if k in ("HEX", "LHEX"):
            return int(t, 16), T.UINT if k == "HEX" else T.ULLONG
        if k == "IP_VAL":
            return T.parse_ip(t), T.IP
        if k == "IPV6_VAL":
            return T.parse_ipv6(t), T.IPV6
        return T.parse_timeval(t), T.TIMEVAL

    @staticmethod
    def lit(value, kind: str) -> Column:
        if kind == T.ULLONG:
            value = Decimal(value)
        return F.lit(value).cast(T.SPARK[kind]) if kind != T.IPV6 else F.lit(value)

    def constant(self, e):
        if isinstance(e, S.Param):
            return self.params[e.name]
        return self.literal(e)[0]

    # -- scalars

    def scalar(self, e) -> Typed:
        if isinstance(e, (S.Lit, S.Macro)):
            value, kind = self.literal(e)
            return Typed(self.lit(value, kind), kind, T.CONSTANT)
        if isinstance(e, S.Param):
            if e.name not in self.params:
                raise T.TypeError_(f"parameter ${e.name} has no value")
            kind = T.named(self.param_types[e.name]) if e.name in self.param_types else _python_type(self.params[e.name])
            return Typed(self.lit(self.params[e.name], kind), kind, T.CONSTANT)
        if isinstance(e, S.IfParam):
            values = self.interface.get(e.table or next(iter(self.interface), ""), {})
            if e.name not in values:
                raise T.TypeError_(f"the source has no parameter @{e.name}")
            value = values[e.name]
            if isinstance(value, Column):
                return Typed(value, T.STRING)
            return Typed(F.lit(value), _python_type(value), T.CONSTANT)
        if isinstance(e, S.Col):
            return self.column(e)
        if isinstance(e, S.Un):
            return self._unary(e)
        if isinstance(e, S.Bin):
            return self._binary(e)
        if isinstance(e, S.Call):
            return self._call(e)
        raise T.TypeError_(f"{e} is no scalar")

    def _unary(self, e: S.Un) -> Typed:
        if e.op == "-" and isinstance(e.a, S.Lit):
            value, kind = self.literal(e)
            return Typed(self.lit(value, kind), kind, T.CONSTANT)
        a = self.scalar(e.a)
        move = T.CONSTANT if a.moves == T.CONSTANT else T.VARYING
        if e.op == "+":
            return a
        if e.op == "-":
            kind = T.negated(a.kind)
            return Typed(-a.col.cast(T.SPARK[kind]), kind, T.flipped(a.moves))
        if e.op == "!":
            if a.kind == T.BOOL:
                return Typed(~a.col, T.BOOL, move)
            if a.kind in T.INTEGERS | {T.IP}:
                return Typed((a.col == 0).cast(T.SPARK[a.kind]), a.kind, move)
        if e.op == "~" and a.kind in T.INTEGERS | {T.IP}:
            if a.kind in (T.INT, T.LLONG):
                return Typed(F.bitwise_not(a.col), a.kind, move)
            top = (1 << 64) - 1 if a.kind == T.ULLONG else T.WORD - 1
            return Typed((self.lit(top, T.ULLONG) - a.col).cast(T.SPARK[a.kind]), a.kind, move)
        raise T.TypeError_(f"{e.op}{a.kind}")

    def _binary(self, e: S.Bin) -> Typed:
        if e.op in ("AND", "OR", "=", "<>", "<", ">", "<=", ">="):
            return Typed(self.condition(e), T.BOOL)
        a, b = self.scalar(e.a), self.scalar(e.b)
        move = T.moves(e.op, a.moves, b.moves, a.kind, b.kind)
        if e.op in "&|":
            kind = T.bitwise(e.op, a.kind, b.kind)
            return Typed(_bits(e.op, a, b, kind), kind, T.CONSTANT if a.moves == b.moves == T.CONSTANT else T.VARYING)
        kind = T.arithmetic(e.op, a.kind, b.kind)
        if T.TIMEVAL in (a.kind, b.kind):
            return Typed(_time(e.op, a, b), kind, move)
        spark = T.SPARK[kind]
        x, y = a.col.cast(spark), b.col.cast(spark)
        if self.wrap and kind in (T.UINT, T.INT, T.ULLONG) and e.op in "+-*":
            x, y = (c.cast("decimal(20,0)") for c in (a.col, b.col))
        if e.op in ("<<", ">>"):
            n = b.col.cast("int")
            base = a.col.cast("bigint") if kind != T.INT else a.col.cast("int")
            out = F.call_function("shiftleft" if e.op == "<<" else "shiftright", base, n)
            return Typed((T.wrapped(out, kind) if kind in (T.UINT,) else out).cast(spark), kind, T.VARYING)
        if e.op == "/":
            out = x / y if kind == T.FLOAT else _int_div(x, y, kind)
        else:
            out = {"+": x.__add__, "-": x.__sub__, "*": x.__mul__, "%": x.__mod__}[e.op](y)
        return Typed(T.wrapped(out, kind) if self.wrap and kind in (T.UINT, T.INT, T.ULLONG) and e.op in "+-*" else out.cast(spark), kind, move)

    def _call(self, e: S.Call) -> Typed:
        if e in self.calls:
            return self.calls[e]
        if e.name.lower() in S.AGGREGATES or e.name.lower() in self.registry.aggregates:
            raise T.TypeError_(f"{e.name} is an aggregate: it has no place here")
        if e.name.lower() in self.registry.states:
            raise T.TypeError_(f"{e.name} is stateful: it needs a SUPERGROUP query")
        args = [self.scalar(a) for a in e.args]
        f = self.registry.find(self.registry.scalars, e.name, [a.kind for a in args])
        col = f.build(*self._arguments(f, e.args, args))
        if f.partial:
            self.partial.append(col)
        move = T.CONSTANT if args and all(a.moves == T.CONSTANT for a in args) else args[0].moves if f.temporal and args else T.VARYING
        return Typed(col, f.result, move)

    def _arguments(self, f, trees, args: list[Typed]) -> list:
        out = []
        for i, (tree, a, want) in enumerate(zip(trees, args, f.args, strict=True)):
            if i in f.constant:
                out.append(self.constant(tree))
            else:
                out.append(a.col if want in (a.kind, "ANY") else a.col.cast(T.SPARK[want]))
        return out

    # -- conditions

    def condition(self, e) -> Column:
        if isinstance(e, S.Un) and e.op == "NOT":
            return ~self.condition(e.a)
        if isinstance(e, S.Bin) and e.op == "AND":
            return self.condition(e.a) & self.condition(e.b)
        if isinstance(e, S.Bin) and e.op == "OR":
            return self.condition(e.a) | self.condition(e.b)
        if isinstance(e, S.Bin) and e.op in ("=", "<>", "<", ">", "<=", ">="):
            a, b = self.scalar(e.a), self.scalar(e.b)
            if not T.comparable(a.kind, b.kind):
                raise T.TypeError_(f"{a.kind} {e.op} {b.kind}")
            x, y = a.col, b.col
            return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e.op]
        if isinstance(e, S.In):
            a = self.scalar(e.a)
            values = []
            for v in e.values:
                value, kind = self.literal(v)
                if not T.comparable(a.kind, kind):
                    raise T.TypeError_(f"{a.kind} IN {kind}")
                values.append(self.lit(value, kind) if a.kind in (T.IPV6, T.TIMEVAL) else value)
            return a.col.isin(*values)
        if isinstance(e, S.Pred):
            args = [self.scalar(a) for a in e.args]
            f = self.registry.find(self.registry.predicates, e.name, [a.kind for a in args])
            return f.build(*self._arguments(f, e.args, args))
        a = self.scalar(e)
        if a.kind != T.BOOL:
            raise T.TypeError_(f"{a.kind} is no condition")
        return a.col


def _python_type(value) -> str:
    return T.BOOL if isinstance(value, bool) else T.FLOAT if isinstance(value, float) else T.STRING if isinstance(value, str) else T.UINT if 0 <= value < T.WORD else T.LLONG


def _int_div(x: Column, y: Column, kind: str = T.LLONG) -> Column:
    """Division towards zero, as in C; by zero it is an error."""
    return (x - x % y) / y if kind == T.ULLONG else F.call_function("div", x, y)


def _bits(op: str, a: Typed, b: Typed, kind: str) -> Column:
    if kind == T.BOOL:
        x, y = ((t.col if t.kind == T.BOOL else t.col != 0) for t in (a, b))
        return x & y if op == "&" else x | y
    if kind == T.IPV6:
        halves = []
        for k in (0, 1):
            x, y = (F.conv(F.hex(F.substring(t.col, 1 + 8 * k, 8)), 16, -10).cast("bigint") for t in (a, b))
            halves.append(F.lpad(F.hex(x.bitwiseAND(y) if op == "&" else x.bitwiseOR(y)), 16, "0"))
        return F.unhex(F.concat(*halves))
    x, y = a.col.cast("bigint"), b.col.cast("bigint")
    return (x.bitwiseAND(y) if op == "&" else x.bitwiseOR(y)).cast(T.SPARK[kind])


def _time(op: str, a: Typed, b: Typed) -> Column:
    """Times move in milliseconds."""
    ms = lambda t: F.unix_millis(t.col) if t.kind == T.TIMEVAL else t.col.cast("bigint")
    if op == "-" and a.kind == b.kind == T.TIMEVAL:
        return (ms(a) - ms(b)).cast("int")
    if op == "/":
        return F.timestamp_millis(_int_div(ms(a), ms(b)))
    return F.timestamp_millis(ms(a) + ms(b) if op == "+" else ms(a) - ms(b))


def move_of(e, scope: Scope) -> str:
    return scope.scalar(e).moves
