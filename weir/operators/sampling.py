"""Supergroup sampling: stateful functions decide row by row what is sampled, cleaned and reported.

The decisions of a supergroup follow its rows in order, so its rows are sorted within one partition and read
as a stream of Arrow batches: what is held is the sample, never the supergroup. Where no state outlives its window,
windows are apart as well. Everything that isn't stateful (source filters, expressions over a row) is
computed before, in built-in expressions.

Over a stream, a supergroup's sample is kept in the state store, and a window is reported when its supergroup's
next one begins; rows of windows before it come too late and are dropped. A micro-batch's rows of one supergroup are
sorted in memory: maxFilesPerTrigger bounds them.
"""

from __future__ import annotations

import heapq
import operator
import pickle
import re
import tempfile
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

from weir import types as T
from weir.functions.library import State
from weir.plans import syntax as S


class SmartSampling:
    """Threshold sampling of sizes: a size over z is taken, smaller ones each time their sum passes z; z adapts to the sample's size."""

    START, GAMMA = 200.0, 2.0

    def __init__(self, old: SmartSampling | None = None) -> None:
        self.z = max(old.z / 10, 1.0) if old else self.START
        self.z_prev, self.size = self.z, old.size if old else 0
        self.sum = self.kept = self.final = 0.0
        self.cleaning = False
        self.packets = self.cleans = 0

    def ssample(self, groups, length, size):
        self.packets += 1
        self.size = size
        if self.cleaning:
            self.kept, self.cleaning = 0.0, False
        if length > self.z:
            return 1
        self.sum += length
        if self.sum >= self.z:
            self.sum -= self.z
            return 1
        return 0

    def skip_ssample(self, lengths, at, size):
        """The place from `at` on of the first row that ssample takes, or their number: the rows before it have gone through it."""
        if at < len(lengths):
            self.size = size
            if self.cleaning:
                self.kept, self.cleaning = 0.0, False
        z, total, begun, taken = self.z, self.sum, at, len(lengths)
        for k in range(at, len(lengths)):
            length = lengths[k]
            if length <= z:
                total += length
                if total < z:
                    continue
                total -= z
            taken = k
            break
        self.sum, self.packets = total, self.packets + min(taken + 1, len(lengths)) - begun
        return taken

    def ssdo_clean(self, groups):
        if groups > self.GAMMA * self.size:
            self.z_prev, self.z = self.z, self.GAMMA * self.z
            self.cleaning = True
            self.kept = 0.0
            self.cleans += 1
            return 1
        return 0

    def _test(self, glen, name):
        glen = max(glen, self.z_prev)
        if glen > self.z:
            return 1
        total = getattr(self, name) + glen
        if total >= self.z:
            setattr(self, name, total - self.z)
            return 1
        setattr(self, name, total)
        return 0

    def ssclean_with(self, groups, glen):
        return self._test(glen, "kept")

    def begin_final(self, groups):
        if self.size and groups > self.size:
            self.z_prev, self.z, self.final = self.z, self.z * groups / self.size, 0.0

    def ssfinal_clean(self, groups, glen):
        return 1 if groups <= self.size or not self.size else self._test(glen, "final")

    def ssthreshold(self, groups):
        return float(self.z)

    def count_distinct(self, groups):
        return groups

    def packet_count(self, groups):
        return self.packets

    def gamma(self, groups):
        return float(self.GAMMA)

    def do_clean_count(self, groups):
        return self.cleans

    def init_threshold(self, groups):
        return self.START


class FlowSampling(SmartSampling):
    """The same over flows: every packet counts, and groups that closed or rest longer than `delay` are judged when cleaning."""

    def __init__(self, old=None) -> None:
        super().__init__(old)
        self.time, self._delay, self.closed = 0, 0, 0

    def flow_ssample(self, groups, size):
        self.packets += 1
        self.size = size
        if self.cleaning:
            self.kept, self.cleaning = 0.0, False
        return 1

    def flow_ssdo_clean(self, groups, now):
        self.time = now
        return self.ssdo_clean(groups)

    def _flow(self, closed, delay, last, glen, name):
        self._delay = delay
        if closed == 1 or self.time - last >= delay:
            self.closed += self.time - last <= (1 if closed == 1 else delay + 1)
            return self._test(glen, name)
        return 1  # an open flow stays

    def flow_ssclean_with(self, groups, closed, delay, last, glen):
        return self._flow(closed, delay, last, glen, "kept")

    def waits_flow_ssclean_with(self, delay):
        """Open flows were asked for: they stay whatever else holds."""
        self._delay = delay

    def flow_ssfinal_clean(self, groups, closed, delay, last, glen):
        return 1 if groups <= self.size or not self.size else self._flow(closed, delay, last, glen, "final")

    def delay(self, groups):
        return self._delay

    def newly_closed(self, groups):
        return self.closed


class LossyCounting:
    """Manku and Motwani's buckets: a bucket ends after `size` rows, and then groups seen too seldom are cleaned."""

    CARRIES = False  # every window begins anew

    def __init__(self, old=None) -> None:
        self.count, self.bucket, self.due = 0, 1, False

    def local_count(self, groups, size):
        self.count += 1
        if self.count >= size:
            self.bucket, self.count, self.due = self.bucket + 1, 0, True
            return 1
        return 0

    def current_bucket(self, groups):
        if self.due:
            self.due = False
            return self.bucket - 1
        return self.bucket


_SMART = {"ssample": T.INT, "ssdo_clean": T.INT, "ssclean_with": T.INT, "ssfinal_clean": T.INT, "ssthreshold": T.FLOAT, "count_distinct": T.INT, "packet_count": T.INT, "gamma": T.FLOAT, "do_clean_count": T.INT, "init_threshold": T.FLOAT}
STATES = [
    State("smart_sampling", SmartSampling, _SMART),
    State("flow_sampling", FlowSampling, {"flow_ssample": T.INT, "flow_ssdo_clean": T.INT, "flow_ssclean_with": T.INT, "flow_ssfinal_clean": T.INT, "delay": T.INT, "newly_closed": T.INT}),
    State("lossy_counting", LossyCounting, {"local_count": T.INT, "current_bucket": T.UINT}),
]
_OPS = {"+": "+", "-": "-", "*": "*", "%": "%", "=": "==", "<>": "!=", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "&": "&", "|": "|", "<<": "<<", ">>": ">>", "AND": "and", "OR": "or"}


def _start(name: str):
    return {"count": 0, "sum": 0, "avg": (0, 0), "min": None, "max": None, "and_aggr": -1, "or_aggr": 0, "xor_aggr": 0}[name]


def _add(name: str, old, v):
    if name == "count":
        return old + 1
    if name == "avg":
        return old[0] + v, old[1] + 1
    if name in ("min", "max"):
        return v if old is None else (min if name == "min" else max)(old, v)
    return {"sum": operator.add, "and_aggr": operator.and_, "or_aggr": operator.or_, "xor_aggr": operator.xor}[name](old, v)


def _value(name: str, held):
    return held[0] / held[1] if name == "avg" else held


def _over(a, b):
    """a / b: of whole numbers the whole part."""
    return a / b if isinstance(a, float) or isinstance(b, float) else int(a / b) if abs(a) < 1 << 52 else abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


_ADDED = {"count": "h[{i}] += 1", "sum": "h[{i}] += {v}", "avg": "h[{i}] = h[{i}][0] + {v}, h[{i}][1] + 1", "min": "h[{i}] = {v} if h[{i}] is None else min(h[{i}], {v})", "max": "h[{i}] = {v} if h[{i}] is None else max(h[{i}], {v})", "and_aggr": "h[{i}] &= {v}", "or_aggr": "h[{i}] |= {v}", "xor_aggr": "h[{i}] ^= {v}"}


class Program:
    """A query's decisions as Python functions, made once a task. Inputs of aggregates and functions come computed, by tree.

    In their text m is the Machine, R a row (a tuple of columns), K a group's key, h what is held of its aggregates.
    """

    def __init__(self, query, registry, leaves: dict, aggregates: list, where: list, names: list[str], inputs: list[str | None], columns: list[str]) -> None:
        self.q, self.registry, self.leaves, self.aggregates = query, registry, leaves, aggregates
        self.where, self.names, self.columns = where, names, columns
        self.inputs = [None if c is None else columns.index(c) for c in inputs]
        self.make = {n: s.make for n, s in {s.name: s for s in registry.states.values()}.items()}
        self.fresh = [_start(a.name.lower()) for a in aggregates]
        self.stays, self.told = self.asks(query.cleaning_by), self.asks(query.having)
        self.gives = [self.asks(e) for e, _ in query.select]
        self.skips, self.waits = self._skips(), self._waits()
        self.takes = self._takes()

    @classmethod
    def bare(cls, registry, aggregates: list, names: list[str]) -> Program:
        """One without a query, for asks()."""
        p = cls.__new__(cls)
        p.registry, p.leaves, p.aggregates, p.names, p.make, p.waits = registry, {}, aggregates, names, {}, None
        return p

    def asks(self, e):
        """An expression over a group as a function of the machine, its key and what is held."""
        return eval(f"lambda m, K, h: {self.text(e, False, True)}", {"over": _over}) if e is not None else None  # noqa: S307

    def text(self, e, row: bool, group: bool) -> str:
        """The Python text of an expression over a row, a group or both."""
        if row and e in self.leaves:
            return f"R[{self.columns.index(self.leaves[e])}]"
        if isinstance(e, S.Lit):
            return repr(_literal(e)) if e.kind != "FLOAT" else f"float({e.text!r})"
        if isinstance(e, S.Col) and group and e.name in self.names:
            return f"K[{self.names.index(e.name)}]"
        if isinstance(e, S.Call):
            name = e.name.lower()
            if name in S.AGGREGATES:
                at = self.aggregates.index(S.Call(e.name, e.args, e.star))
                return f"m.total({at})" if e.super else f"(h[{at}][0] / h[{at}][1])" if name == "avg" else f"h[{at}]"
            if name in self.registry.states:
                return f"m.states[{self.registry.states[name].name!r}].{name}(len(m.groups){''.join(', ' + self.text(a, row, group) for a in e.args)})"
        if isinstance(e, S.Un):
            return f"({'not ' if e.op in ('NOT', '!') else e.op if e.op in '-~' else ''}{self.text(e.a, row, group)})"
        if isinstance(e, S.In):
            return f"({self.text(e.a, row, group)} in [{', '.join(self.text(v, False, False) for v in e.values)}])"
        if isinstance(e, S.Bin):
            a, b = self.text(e.a, row, group), self.text(e.b, row, group)
            return f"over({a}, {b})" if e.op == "/" else f"({a} {_OPS[e.op]} {b})"
        raise T.TypeError_(f"{e} has no place in a sampling query")

    def _asked(self, e, shortcut: str):
        """(state's name, call) where e is one of its functions = 1 and the state has a shortcut of that function's own class."""
        if isinstance(e, S.Bin) and e.op == "=" and isinstance(e.a, S.Call) and isinstance(e.b, S.Lit) and _literal(e.b) == 1 and (name := e.a.name.lower()) in self.registry.states:
            state = self.registry.states[name]
            owner = lambda n: next((k for k in type(self.make[state.name]()).__mro__ if n in vars(k)), None)
            if owner(name) is not None and owner(name) is owner(f"{shortcut}_{name}"):
                return state.name, e.a
        return None

    def _skips(self) -> str | None:
        """Where the only condition is a function of one column: the text that finds the next row taken."""
        found = self._asked(self.where[0], "skip") if len(self.where) == 1 else None
        if not found or found[1].args[0] not in self.leaves or not all(isinstance(a, S.Lit) for a in found[1].args[1:]):
            return None
        state, call = found
        return f"m.states[{state!r}].skip_{call.name.lower()}(C[{self.columns.index(self.leaves[call.args[0]])}], i{''.join(', ' + self.text(a, False, False) for a in call.args[1:])})"

    def _waits(self):
        """(state, function, delay, place of the last time) where cleaning asks for flows that have rested for a fixed delay."""
        found = self._asked(self.q.cleaning_by, "waits")
        if not found or len(found[1].args) < 3 or not all(isinstance(a, S.Lit) for a in found[1].args[:2]) or _literal(found[1].args[0]) == 1:
            return None
        last = found[1].args[2]
        if not isinstance(last, S.Call) or last.name.lower() != "max" or last.super:
            return None
        return found[0], found[1].name.lower(), _literal(found[1].args[1]), self.aggregates.index(S.Call(last.name, last.args, last.star))

    def _takes(self):
        """takes(m, C): the rows of one window, as a list of each column, go through m."""
        key = "".join(f"R[{self.columns.index(f'k_{n}')}], " for n in self.names)
        body = [f"K = ({key})", "h = G.get(K)", "if h is None:", "    h = m.begin(K)"]
        body += [_ADDED[a.name.lower()].format(i=i, v=f"R[{c}]") for i, (a, c) in enumerate(zip(self.aggregates, self.inputs, strict=True))]
        if self.waits:
            body += ["if h is m.new:", "    m.wait(K, h)"]
        if self.q.cleaning_when is not None:
            body += [f"if {self.text(self.q.cleaning_when, True, True)}:", "    m.clean()"]
        if self.skips:
            lines = ["i, n = 0, len(C[0])", "while True:", f"    i = {self.skips}", "    if i >= n:", "        break", f"    R = ({''.join(f'C[{j}][i], ' for j in range(len(self.columns)))})", "    i += 1"]
        else:
            lines = ["for R in zip(*C):"] + [f"    if not {self.text(e, True, False)}:\n        continue" for e in self.where]
        space: dict = {"over": _over}
        exec("\n".join(["def takes(m, C):", "    G = m.groups", *("    " + x.replace("\n", "\n    ") for x in [*lines, *("    " + x for x in body)])]), space)  # noqa: S102
        return space["takes"]


def _literal(e: S.Lit):
    return e.text.upper() == "TRUE" if e.kind == "BOOL" else e.text if e.kind == "STRING" else float(e.text) if e.kind == "FLOAT" else int(e.text.rstrip("uUlL"), 16 if "HEX" in e.kind else 10)


class Machine:
    """One supergroup's window: its groups and states.

    Where cleaning asks for rested flows only (Program.waits), groups wait in a heap by the last time they were seen to have until that
    is `delay` ago, and only the rested are judged, in the order in which the groups began: all others would stay.
    """

    def __init__(self, program: Program, old: Machine | None = None) -> None:
        self.p = program
        self.groups: dict[tuple, list] = {}
        self.states = {n: make(old.states.get(n)) if old else make() for n, make in program.make.items()}
        self.new, self.begun, self.waiting, self.rested = None, 0, [], []

    def begin(self, key: tuple) -> list:
        self.new = self.groups[key] = list(self.p.fresh)
        return self.new

    def wait(self, key: tuple, held: list) -> None:
        self.new = None
        self.begun += 1
        heapq.heappush(self.waiting, (held[self.p.waits[3]], self.begun, key))

    def total(self, at: int):
        """An aggregate over all groups."""
        name = self.p.aggregates[at].name.lower()
        total = _start(name)
        for h in self.groups.values():
            v = _value(name, h[at])
            total = total + v if name in ("count", "sum") else _add(name, total, v)
        return _value(name, total)

    def clean(self) -> None:
        groups, stays = self.groups, self.p.stays
        if stays is None:
            return
        if not self.p.waits:
            for k in list(groups):
                if not stays(self, k, groups[k]):
                    del groups[k]
            return
        name, function, delay, last = self.p.waits
        state, waiting = self.states[name], self.waiting
        if groups:
            getattr(state, f"waits_{function}")(delay)
        found = len(self.rested)
        while waiting and state.time - waiting[0][0] >= delay:
            seen, n, k = heapq.heappop(waiting)
            if groups[k][last] > seen:
                heapq.heappush(waiting, (groups[k][last], n, k))
            else:
                self.rested.append((n, k))
        if found < len(self.rested):
            self.rested.sort()
        rested, self.rested = self.rested, []
        for n, k in rested:
            if not stays(self, k, groups[k]):
                del groups[k]
            elif state.time - groups[k][last] < delay:
                heapq.heappush(waiting, (groups[k][last], n, k))
            else:
                self.rested.append((n, k))

    def saved(self) -> bytes:
        return cloudpickle.dumps((self.groups, self.states))

    def restore(self, saved: bytes) -> Machine:
        self.groups, self.states = cloudpickle.loads(saved)
        if self.p.waits:
            for k, h in self.groups.items():
                self.wait(k, h)
        return self

    def report(self) -> Iterator[list]:
        for s in self.states.values():
            if hasattr(s, "begin_final"):
                s.begin_final(len(self.groups))
        for key, held in list(self.groups.items()):
            if self.p.told is None or self.p.told(self, key, held):
                yield [f(self, key, held) for f in self.p.gives]


def sampling(lowering, q: S.Query, streams: dict):
    from weir.plans.lower import Stream, conjuncts, flat

    (alias, s), = streams.items()
    registry = lowering.registry
    scope = lowering.scope(q, streams)
    stateful = lambda e: any(isinstance(x, S.Call) and x.name.lower() in registry.states for x in S.walk(e))
    df = lowering.checked(s, lowering.used(q, scope, alias))
    where = []
    for e in conjuncts(q.where):
        if stateful(e):
            where.append(e)
        else:
            df = df.where(scope.condition(e))
    items = flat(q.group)
    keys = {g.name: scope.scalar(g.expr) for g in items}
    window = [n for n, t in keys.items() if t.moves in (T.INCREASING, T.DECREASING)]
    supers = [n for n in q.supergroup if n not in window]
    unknown = [n for n in q.supergroup if n not in keys]
    if unknown:
        raise T.TypeError_(f"SUPERGROUP {', '.join(unknown)}: not in GROUP BY")
    names, falling = list(keys), [keys[n].moves == T.DECREASING for n in window]
    aggregates = list(dict.fromkeys(S.Call(e.name, e.args, e.star) for t in lowering.trees(q) for e in S.walk(t) if isinstance(e, S.Call) and e.name.lower() in S.AGGREGATES))
    leaves, columns, inputs = {}, {f"k_{n}": t.col for n, t in keys.items()}, []
    for a in aggregates:
        inputs.append(None)
        if a.args and a.name.lower() != "count":
            columns[f"v_{len(columns)}"] = scope.scalar(a.args[0]).col
            inputs[-1] = list(columns)[-1]
    for e in [*where, q.cleaning_when]:
        for x in S.walk(e):  # what a function is called with, by row
            if isinstance(x, S.Call) and x.name.lower() in registry.states:
                for arg in x.args:
                    aggregated = any(isinstance(y, S.Call) and y.name.lower() in S.AGGREGATES for y in S.walk(arg))
                    grouped = isinstance(arg, S.Col) and arg.name in keys and e is q.cleaning_when
                    if not isinstance(arg, S.Lit) and not aggregated and not grouped and arg not in leaves:
                        columns[f"v_{len(columns)}"] = scope.scalar(arg).col
                        leaves[arg] = list(columns)[-1]
    for c in scope.partial:
        df = df.where(c.isNotNull())
    order = [c for c in s.kinds if s.moves.get(c) == T.INCREASING] + [c for c in s.kinds if s.moves.get(c) != T.INCREASING]
    rows = df.select(*(c.alias(n) for n, c in columns.items()), *(F.col(f"`{c}`").alias(f"o_{i}") for i, c in enumerate(order)))
    numeric = {n: F.col(n).cast("double") for n, t in rows.dtypes if t.startswith("decimal") and not n.startswith("o_")}
    rows = rows.withColumns(numeric) if numeric else rows
    out_names = lowering.names(q)
    kinds = [_kind(e, keys, scope, lowering) for e, _ in q.select]
    ddl = ", ".join(f"`{n}` {T.SPARK[k]}" for n, k in zip(out_names, kinds, strict=True))
    schema = {T.FLOAT: pa.float64(), T.STRING: pa.string(), T.BOOL: pa.bool_(), T.INT: pa.int32(), T.USHORT: pa.int32(), T.IPV6: pa.binary(), T.TIMEVAL: pa.timestamp("us", "UTC"), T.ULLONG: pa.decimal128(20, 0)}

    def packed(done: list[list]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [()] * len(out_names)
        return pa.RecordBatch.from_arrays([pa.array([None if v is None else float(v) if k == T.FLOAT else v for v in c], schema.get(k, pa.int64())) for c, k in zip(cols, kinds, strict=True)], out_names)

    held = list(columns)
    edge = [held.index(f"k_{n}") for n in [*supers, *window]]

    def program() -> Program:
        return Program(q, registry, leaves, aggregates, where, names, inputs, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, machine, at, done = program(), None, None, []
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for a, b in pairwise(_edges([lists[j] for j in edge], batch.num_rows)):
                here = tuple(lists[j][a] for j in edge)
                if here != at:
                    if machine is not None:
                        done.extend(machine.report())
                    machine, at = Machine(made, machine if at is not None and at[: len(supers)] == here[: len(supers)] else None), here
                made.takes(machine, lists if b - a == batch.num_rows else [x[a:b] for x in lists])
                if len(done) > 5000:
                    yield packed(done)
                    done = []
        if machine is not None:
            done.extend(machine.report())
        yield packed(done)

    sorting = [*(f"k_{n}" for n in window), *(f"o_{i}" for i in range(len(order)))]
    known = [] if any(falling) else [*(f"k_{n}" for n in window), *(f"o_{i}" for i, c in enumerate(order) if s.moves.get(c) == T.INCREASING)]

    def live(_key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        made, machine, at = program(), None, None
        if state.exists:
            saved, at = state.get
            machine, at = Machine(made).restore(bytes(saved)), cloudpickle.loads(bytes(at))
        for rows in _sorted(frames, sorting, [*(not f for f in falling), *(True for _ in order)], known):
            lists, done = [rows[c].tolist() for c in held], []
            here_in = [lists[held.index(f"k_{n}")] for n in window]
            for a, b in pairwise(_edges(here_in, len(rows))):
                here = tuple(x[a] for x in here_in)
                if at is not None and _before(here, at, falling):
                    continue
                if here != at:
                    if machine is not None:
                        done.extend(machine.report())
                    machine, at = Machine(made, machine), here
                made.takes(machine, [x[a:b] for x in lists])
            yield packed(done).to_pandas()
        state.update((machine.saved(), cloudpickle.dumps(at)))

    by = [f"k_{n}" for n in supers]
    if rows.isStreaming:
        df = rows.withColumn("_all", F.lit(0)).groupBy(*(by or ["_all"])).applyInPandasWithState(live, ddl, "machine binary, at binary", "append", "NoTimeout")
    else:
        called = {registry.states[x.name.lower()].make for t in lowering.trees(q) for x in S.walk(t) if isinstance(x, S.Call) and x.name.lower() in registry.states}
        if not any(getattr(m, "CARRIES", True) for m in called):
            by += [f"k_{n}" for n in window if n not in supers]
        within = [*(f"k_{n}" for n in supers), *(F.col(f"k_{n}").desc() if f else F.col(f"k_{n}") for n, f in zip(window, falling, strict=True)), *(c for c in rows.columns if c.startswith("o_"))]
        if by or not within:
            df = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*within or held).select(*held).mapInArrow(run, ddl)
        else:  # one stream, as the state demands: sorted in parallel, and only batches in their order go to its task
            batches = rows.repartitionByRange(*within).sortWithinPartitions(*within).select(*held).mapInArrow(_numbered, "task int, n long, rows binary")
            _bounded(rows.sparkSession)
            df = batches.repartition(1).sortWithinPartitions("task", "n").select("rows").mapInArrow(lambda found: run(_read(found)), ddl)
    return Stream(df, dict(zip(out_names, kinds, strict=True)), {n: keys[e.name].moves for n, (e, _) in zip(out_names, q.select, strict=True) if isinstance(e, S.Col) and e.name in window}, disorder=s.disorder)


#: Bytes of an Arrow batch whose rows are batches.
_BYTES = 32 << 20
#: Rows that a micro-batch's sort holds before it writes them, rows of what it writes at once, and rows it reads again at a time.
_HELD, _CHUNK, _MERGED = 100_000, 1_000, 64_000


def _bounded(spark) -> None:
    """The session sends Python workers batches of _BYTES at most."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    m = re.fullmatch(r"(\d+)\s*([kmg]?)i?b?", str(spark.conf.get(key)).strip().lower())
    if not m or not 0 < int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2]] <= _BYTES:
        spark.conf.set(key, str(_BYTES))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row: its task, its number there and its bytes."""
    task = TaskContext.get().partitionId()
    for n, batch in enumerate(batches):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["task", "n", "rows"])


def _read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        for x in batch.column(0):
            yield from pa.ipc.open_stream(x.as_buffer())


def _edges(keys: list[list], n: int) -> list[int]:
    """0, the places at which a key changes, and n."""
    cut = {0, n}
    for x in keys:
        if n and x.count(x[0]) < n:
            cut.update(i for i in range(1, n) if x[i] != x[i - 1])
    return sorted(cut)


def _sorted(frames: Iterator[pd.DataFrame], by: list[str], rising: list[bool], known: list[str]) -> Iterator[pd.DataFrame]:
    """All rows of the frames, sorted, as frames one after the other. known: the first columns of `by`, all rising and without nulls.

    Sorted runs go to a temporary file in chunks; chunks are read again by the first row's known columns, and what lies before the
    first row of all that are unread is sorted and given.
    """

    def all_of(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True).sort_values(by, ascending=rising)

    parts, size, unread = [], 0, []
    with tempfile.TemporaryFile() as file:
        for frame in frames:
            parts.append(frame)
            size += len(frame)
            if known and size >= _HELD:
                run = all_of(parts)
                for at in range(0, size, _CHUNK):
                    chunk = run.iloc[at : at + _CHUNK]
                    unread.append((tuple(chunk[c].iat[0] for c in known), file.tell(), len(chunk)))
                    pickle.dump(chunk, file, pickle.HIGHEST_PROTOCOL)
                parts, size = [], 0
        if not unread:
            if parts:
                yield all_of(parts)
            return
        unread.sort(key=lambda x: x[0], reverse=True)
        while unread:
            size = 0
            while unread and size < _MERGED:
                _, at, n = unread.pop()
                file.seek(at)
                parts.append(pickle.load(file))  # noqa: S301
                size += n
            rows = pd.concat(parts, ignore_index=True)
            if not unread:
                yield rows.sort_values(by, ascending=rising)
                return
            before, same = np.zeros(len(rows), bool), np.ones(len(rows), bool)
            for c, v in zip(known, unread[-1][0], strict=True):
                x = rows[c]
                before |= same & (x < v).to_numpy(bool)
                same &= (x == v).to_numpy(bool)
            if before.any():
                yield rows[before].sort_values(by, ascending=rising)
            parts = [rows[~before]]


def _before(a: tuple, b: tuple, falling: list[bool]) -> bool:
    """Whether window a comes before window b."""
    for x, y, f in zip(a, b, falling, strict=True):
        if x != y:
            return (x > y) == f
    return False


def _kind(e, keys, scope, lowering) -> str:
    if isinstance(e, S.Col):
        return keys[e.name].kind if e.name in keys else scope.column(e).kind
    if isinstance(e, S.Call) and e.name.lower() in lowering.registry.states:
        return lowering.registry.states[e.name.lower()].functions[e.name.lower()]
    if isinstance(e, S.Call) and e.name.lower() in S.AGGREGATES:
        return lowering.aggregate(S.Call(e.name, e.args, e.star), scope)[1]
    if isinstance(e, S.Bin):
        return T.arithmetic(e.op, _kind(e.a, keys, scope, lowering), _kind(e.b, keys, scope, lowering))
    return scope.scalar(e).kind
