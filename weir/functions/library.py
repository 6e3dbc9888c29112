"""Scalar functions, predicates and aggregate functions: name and argument types to Column builders.

All builders are built-in Spark expressions. `partial` functions give null where they have no result; the row is
then dropped, as by a filter. Users add their own with `Registry.register_*`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir import types as T


@dataclass
class Fn:
    name: str
    args: tuple[str, ...]
    result: str
    build: Callable[..., Column]
    partial: bool = False
    constant: tuple[int, ...] = ()  # arguments that must be literals (handed over as Python values)
    temporal: bool = False  # keeps the temporality of its argument


@dataclass
class Aggregate:
    """A user-defined aggregate: `build` gives an aggregate Column of its arguments.

    running: the state lives on between epochs; `over` then gives, for the kept values of an epoch
    (panes, one per epoch), a Column over the window from the group's first epoch to this one. summed: a pane is the
    sum of the first argument, so that a stream can keep panes by itself.
    """

    name: str
    args: tuple[str, ...]
    result: str
    build: Callable[..., Column]
    running: bool = False
    over: Callable | None = None
    constant: tuple[int, ...] = ()
    summed: bool = False


@dataclass
class State:
    """A family of stateful functions over one state: `make()` gives an object whose methods are the functions.

    new_window(old) gives the state for a supergroup's next window; `final` is called at the end of a window.
    """

    name: str
    make: Callable
    functions: dict[str, str]  # function -> result type


@dataclass
class Registry:
    scalars: dict[str, list[Fn]] = field(default_factory=dict)
    predicates: dict[str, list[Fn]] = field(default_factory=dict)
    aggregates: dict[str, list[Aggregate]] = field(default_factory=dict)
    states: dict[str, State] = field(default_factory=dict)

    def register_scalar(self, name, args, result, build, **more) -> None:
        self.scalars.setdefault(name.lower(), []).insert(0, Fn(name, tuple(args), result, build, **more))

    def register_predicate(self, name, args, build, **more) -> None:
        self.predicates.setdefault(name.lower(), []).insert(0, Fn(name, tuple(args), T.BOOL, build, **more))

    def register_aggregate(self, name, args, result, build, **more) -> None:
        self.aggregates.setdefault(name.lower(), []).insert(0, Aggregate(name, tuple(args), result, build, **more))

    def register_state(self, state: State) -> None:
        for f in state.functions:
            self.states[f.lower()] = state

    @staticmethod
    def _fits(want: tuple[str, ...], have: list[str]) -> int | None:
        """How far arguments must be widened; None if they don't fit. ANY takes every type."""
        if len(want) != len(have):
            return None
        cost = 0
        for w, h in zip(want, have, strict=True):
            if w == h:
                continue
            if w == "ANY":
                cost += 5
            elif w in T.NUMERIC and h in T.NUMERIC and not (h == T.FLOAT and w != T.FLOAT):
                cost += 1 + abs(_WIDTH.index(w) - _WIDTH.index(h))
            else:
                return None
        return cost

    def find(self, table: dict[str, list], name: str, have: list[str]):
        """The overload that fits best (the first of equals)."""
        best = None
        for f in table.get(name.lower(), []):
            cost = self._fits(f.args, have)
            if cost is not None and (best is None or cost < best[0]):
                best = cost, f
        if best is None:
            known = [f"{f.name}({', '.join(f.args)})" for f in table.get(name.lower(), [])]
            raise T.TypeError_(f"no {name}({', '.join(have)})" + (f"; there are {', '.join(known)}" if known else ""))
        return best[1]


_WIDTH = [T.USHORT, T.INT, T.UINT, T.LLONG, T.ULLONG, T.FLOAT]


def _java(pattern: str) -> str:
    """An extended POSIX pattern as Java writes it: ^ and $ also match at line ends."""
    return "(?m)" + pattern


def _bytes(s: Column) -> Column:
    """Positions and lengths in texts count bytes of UTF-8."""
    return F.encode(s, "UTF-8")


def _head(s: Column, n: Column) -> Column:
    """The first n bytes; a last character that doesn't fit whole is left out, as no text can hold its half."""
    cut = lambda k: F.try_validate_utf8(F.substring(_bytes(s), F.lit(1), F.greatest(n.cast("int") - k, F.lit(0))).cast("string"))
    return F.coalesce(*(cut(k) for k in range(4)))


def _strtoip(s: Column) -> Column:
    runs = F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(runs) >= 4, sum((F.get(runs, F.lit(k)).try_cast("bigint") * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0).cast("bigint")))


def _strtoi(s: Column) -> Column:
    return F.regexp_substr(s, F.lit("[0-9]+")).try_cast("bigint")


def _has_option(options: Column, wanted: Column) -> Column:
    """Whether a list of IPv4 options (characters are bytes, 40 at most) has one of that number (the low 5 bits of its kind).

    Fixed lengths: end of list 0, padding 1, security 2 (11 bytes), stream 8 (4 bytes); 3, 4, 7 and 9 say their own; others end the search.
    """
    byte = lambda at: F.ascii(F.substring(options, at + 1, F.lit(1))).bitwiseAND(F.lit(255))

    def step(state: Column, _) -> Column:
        kind, at = byte(state.at).bitwiseAND(F.lit(31)), state.at
        size = F.when(kind == 1, 1).when(kind == 2, 11).when(kind == 8, 4).when(kind.isin(3, 4, 7, 9) & (at + 1 < F.length(options)), byte(at + 1)).otherwise(0)
        hit = kind == wanted
        over = hit | (size == 0) | (at + size >= F.length(options))
        return F.when(state.ended, state).otherwise(F.struct((at + size).cast("int").alias("at"), over.alias("ended"), hit.alias("hit")))

    start = F.struct(F.lit(0).alias("at"), (options == "").alias("ended"), F.lit(False).alias("hit"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step).hit.cast("bigint")


def moving(values: Column, n: int, alpha: float = 1.0) -> Column:
    """Sum of the last n of an array of epoch values, newest last, weighted by alpha to the power of their age."""
    last = F.slice(F.reverse(values), 1, n)
    weighted = F.transform(last, lambda v, i: v * F.pow(F.lit(float(alpha)), i))
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)


def default_registry(characters: bool = False) -> Registry:
    """The language's functions. characters: lengths of beginnings of texts count characters, as SQL's, instead of bytes."""
    r = Registry()
    head = (lambda s, n: F.substring(s, F.lit(1), F.greatest(n.cast("int"), F.lit(0)))) if characters else _head
    s, p = r.register_scalar, r.register_predicate
    p("str_exists_substr", [T.STRING, T.STRING], lambda a, b: F.contains(a, b))
    p("str_compare", [T.STRING, T.STRING], lambda a, b: a != b)
    p("str_match_offset", [T.UINT, T.STRING, T.STRING], lambda off, pat, text: F.substring(_bytes(text), off.cast("int") + 1, F.length(_bytes(pat))) == _bytes(pat))
    p("byte_match_offset", [T.UINT, T.UINT, T.STRING], lambda off, byte, text: F.hex(F.substring(_bytes(text), off.cast("int") + 1, F.lit(1))) == F.lpad(F.hex(byte.bitwiseAND(F.lit(255))), 2, "0"))
    for name, kinds, pick in (("LLMIN", [T.LLONG], F.least), ("LLMAX", [T.LLONG], F.greatest), ("UMIN", [T.IP, T.UINT], F.least), ("UMAX", [T.IP, T.UINT], F.greatest)):
        for kind in kinds:
            s(name, [kind, kind], kind, pick)
    s("str_regex_match", [T.STRING, T.STRING], T.UINT, lambda a, re: F.when((a != "") & a.rlike(_java(re)), 1).otherwise(0).cast("bigint"), constant=(1,))
    s("str_partial_regex_match", [T.STRING, T.STRING, T.UINT], T.UINT, lambda a, re, n: F.when((a != "") & head(a, n).rlike(_java(re)), 1).otherwise(0).cast("bigint"), constant=(1,))
    s("str_extract_regex", [T.STRING, T.STRING], T.STRING, lambda a, re: F.regexp_substr(a, F.lit(_java(re))), partial=True, constant=(1,))
    s("str_truncate", [T.STRING, T.UINT], T.STRING, head, partial=True)
    for kind in (T.INT, T.UINT, T.LLONG, T.ULLONG):
        s("non_temporal", [kind], kind, lambda a: a)
    for kind in (T.UINT, T.ULLONG, T.LLONG, T.INT, T.IP):
        if kind != T.INT and kind != T.IP:
            s("INT", [kind], T.INT, lambda a: T.wrapped(a.cast("decimal(20,0)"), T.INT))
        if kind != T.UINT:
            s("UINT", [kind], T.UINT, lambda a: T.wrapped(a.cast("decimal(20,0)"), T.UINT))
    for kind in (T.INT, T.UINT, T.LLONG, T.ULLONG, T.USHORT):
        s("FLOAT", [kind], T.FLOAT, lambda a: a.cast("double"))
    for kind in (T.UINT, T.INT):
        s("ULLONG", [kind], T.ULLONG, lambda a: T.wrapped(a.cast("decimal(21,0)"), T.ULLONG))
    s("strtoi", [T.STRING], T.UINT, _strtoi, partial=True)
    s("strtoip", [T.STRING], T.IP, _strtoip, partial=True)
    s("strtoi_c", [T.STRING], T.UINT, lambda a: F.coalesce(_strtoi(F.lit(a)), F.lit(0).cast("bigint")), constant=(0,))
    s("strtoip_c", [T.STRING], T.IP, lambda a: F.coalesce(_strtoip(F.lit(a)), F.lit(0).cast("bigint")), constant=(0,))
    s("partn_hash", [T.IP, T.IP], T.UINT, lambda a, b: a.bitwiseXOR(b))
    for name in ("rand_hash", "lc_rand"):
        s(name, [], T.UINT, lambda: F.floor(F.rand() * T.WORD).cast("bigint"))
    s("has_ipv4_option", [T.STRING, T.UINT], T.UINT, _has_option)

    a = r.register_aggregate
    for name in ("avg_udaf", "extr_avg"):
        a(name, [T.UINT], T.FLOAT, lambda v: F.avg(v.cast("double")))
    s("extr_avg_fcn", [T.FLOAT], T.FLOAT, lambda v: v)
    a("POSAVG", [T.FLOAT], T.FLOAT, lambda v: F.coalesce(F.avg(F.when(v >= 0, v)), F.lit(-1.0)))
    pane = lambda v, *_: F.sum(v)
    a("sum3", [T.UINT], T.UINT, pane, running=True, summed=True, over=lambda panes: moving(panes, 3).cast("bigint"))
    for name in ("moving_sum", "moving_sum_udaf", "super_moving_sum_udaf", "moving_sum_extract"):
        a(name, [T.UINT, T.UINT], T.UINT, pane, running=True, summed=True, over=lambda panes, n: moving(panes, n).cast("bigint"), constant=(1,))
    for name in ("moving_sum_exp", "moving_sum_extract_exp"):
        a(name, [T.UINT, T.UINT, T.FLOAT], T.FLOAT, pane, running=True, summed=True, over=moving, constant=(1, 2))
    return r
