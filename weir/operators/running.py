"""Running aggregation (CLOSING_WHEN): a group lives on from epoch to epoch and reports in each until it closes.

Rows are first reduced to one pane per group and epoch. Between two panes of a group the idle epochs follow
from the panes alone: none if the group closed, one if an idle group closes, else all of them. So only
rows that are reported are ever made, all in built-in expressions. The panes are worked out once and written to
the shared folder, since the list of epochs (one row an epoch, numbered in one task) comes from them as well.

Over a stream each group is a row of the state store: its open epochs, and the last panes of what runs over several.
The watermark ends epochs, for idle groups as well, by timeouts. What no row tells can't be known there, so
every whole number is an epoch, also one in which nothing arrived at all; rows of ended epochs are dropped, and the
last epoch stays open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from weir import types as T
from weir.plans import syntax as S
from weir.plans.expressions import Typed
from weir.tables import written

_IDLE = {"count": lambda k: F.lit(0), "sum": T.empty, "avg": T.empty, "min": T.greatest, "max": T.least, "or_aggr": T.empty, "xor_aggr": T.empty}


def _idle(name: str, kind: str):
    """A built-in aggregate of an epoch without rows."""
    if name == "and_aggr":
        return T.greatest(kind) if kind not in (T.INT, T.LLONG) else F.lit(-1).cast(T.SPARK[kind])
    return _IDLE.get(name, T.empty)(kind)


def running(lowering, q: S.Query, streams: dict):
    from weir.plans.lower import flat

    (alias, s), = streams.items()
    scope = lowering.scope(q, streams)
    df = lowering.filtered(q, scope, lowering.checked(s, lowering.used(q, scope, alias)))
    items = flat(q.group)
    keys = {g.name: scope.scalar(g.expr) for g in items}
    epoch = [n for n, t in keys.items() if t.moves in (T.INCREASING, T.DECREASING)]
    if not epoch:
        raise T.TypeError_("CLOSING_WHEN needs an increasing or decreasing value in GROUP BY: its changes end the epochs")
    own = [n for n in keys if n not in epoch]
    calls = lowering.calls(q)
    for t in S.walk(q.closing_when):
        if isinstance(t, S.Col) and t.name in epoch:
            raise T.TypeError_("CLOSING_WHEN looks at aggregates and groups, not at the epoch")
    built, rolling = {}, {}
    for c in calls:
        found = None if c.name.lower() in S.AGGREGATES else lowering.registry.find(lowering.registry.aggregates, c.name, [scope.scalar(a).kind for a in c.args])
        if found is not None and found.running:
            rolling[c] = found
            if any(x == c for x in S.walk(q.closing_when)):
                raise T.TypeError_(f"CLOSING_WHEN looks at aggregates of the epoch; {c.name} runs over several")
        built[c] = lowering.aggregate(c, scope)
    for c in scope.partial:
        df = df.where(c.isNotNull())
    if s.df.isStreaming:
        return _live(lowering, q, s, scope, df, items, keys, epoch, own, built, rolling)
    names = [f"_k_{n}" for n in keys]
    at = [f"_k_{n}" for n in epoch]
    group = [f"_k_{n}" for n in own] or [F.lit(0)]
    panes = df.select("*", *(t.col.alias(f"_k_{n}") for n, t in keys.items())).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), *(a.alias(f"_a{i}") for i, (a, _) in enumerate(built.values())))
    panes = written(panes, "panes")
    whole = Window.partitionBy()  # one row an epoch
    sort = [F.col(f"_k_{n}").asc() if keys[n].moves == T.INCREASING else F.col(f"_k_{n}").desc() for n in epoch]
    epochs = panes.select(*at).distinct().withColumn("_i", F.row_number().over(Window.orderBy(*sort)).cast("bigint")).withColumn("_last", F.count(F.lit(1)).over(whole))
    values = {c: Typed(F.col(f"_a{i}"), kind) for i, (c, (_, kind)) in enumerate(built.items())}
    idle = {f"_a{i}": (F.lit(0).cast(T.SPARK[kind]) if c in rolling else _idle(c.name.lower(), kind).cast(T.SPARK[kind])) for i, (c, (_, kind)) in enumerate(built.items())}
    after = lowering.after(scope, items, keys, values)
    resting = replace(after, calls={c: Typed(idle[f"_a{i}"], kind) for i, (c, (_, kind)) in enumerate(built.items())}, partial=[])
    by = Window.partitionBy(*group)
    panes = panes.join(epochs, at).withColumn("_next", F.coalesce(F.lead("_i").over(by.orderBy("_i")), F.col("_last") + 1))
    panes = panes.withColumns({"_closed": after.condition(q.closing_when), "_resting": resting.condition(q.closing_when)})
    upto = F.when(F.col("_closed"), F.col("_i")).when(F.col("_resting"), F.least(F.col("_i") + 1, F.col("_next") - 1)).otherwise(F.col("_next") - 1)
    kept = [f"_k_{n}" for n in own]
    rows = panes.withColumn("_j", F.explode(F.sequence(F.col("_i").cast("bigint"), upto.cast("bigint")))).withColumn("_own", F.col("_j") == F.col("_i"))
    values_at = {c: F.when(F.col("_own"), F.col(c)).otherwise(v).alias(c) for c, v in idle.items()}
    rows = rows.select(*kept, F.col("_j").alias("_i"), F.when(F.col("_own"), F.col("_closed")).otherwise(F.col("_resting")).alias("_closed"), *values_at.values())
    out = rows.join(epochs.drop("_last"), "_i")
    if rolling:
        order = by.orderBy("_i")
        fresh = F.coalesce(F.lag("_i").over(order) != F.col("_i") - 1, F.lit(True)) | F.coalesce(F.lag("_closed").over(order), F.lit(False))
        out = out.withColumn("_new", fresh.cast("int")).withColumn("_life", F.sum("_new").over(order))
        for i, c in enumerate(built):
            if c in rolling:
                f = rolling[c]
                constants = [scope.constant(c.args[k]) for k in f.constant]
                life = Window.partitionBy(*group, "_life").orderBy("_i").rowsBetween(-(int(constants[0]) if constants else 3) + 1, 0)
                out = out.withColumn(f"_r{i}", f.over(F.collect_list(f"_a{i}").over(life), *constants).cast(T.SPARK[f.result]))
                after.calls[c] = Typed(F.col(f"_r{i}"), f.result)
    if q.having is not None:
        out = out.where(after.condition(q.having))
    return lowering.project(q, after, out, s.disorder)


def _fold(name: str, held, values: list):
    if name == "avg":
        return held[0] + sum(values), held[1] + len(values)
    if name == "count":
        return held + len(values)
    if name == "sum":
        return held + sum(values)
    if name in ("min", "max"):
        found = (min if name == "min" else max)(values)
        return found if held is None else (min if name == "min" else max)(held, found)
    return reduce({"and_aggr": lambda a, b: a & b, "or_aggr": lambda a, b: a | b, "xor_aggr": lambda a, b: a ^ b}[name], values, held)


def _resting(name: str, kind: str):
    """What _idle says, as Python has it."""
    if name == "avg":
        return 0.0, 1
    if name == "and_aggr":
        return -1 if kind in (T.INT, T.LLONG) else T.greatest_value(kind)
    if name in ("min", "max"):
        return (T.greatest_value if name == "min" else T.least_value)(kind)
    return 0


def _live(lowering, q: S.Query, s, scope, df, items, keys, epoch, own, built, rolling):
    from weir.operators.sampling import Machine, Program, _start

    if len(epoch) != 1 or keys[epoch[0]].moves != T.INCREASING or keys[epoch[0]].kind not in T.INTEGERS:
        raise T.TypeError_("over a stream, CLOSING_WHEN needs one increasing integer in GROUP BY")
    folds, columns, outs, spans = [], {}, [], {}
    for i, (c, (_, kind)) in enumerate(built.items()):
        name = c.name.lower()
        if c in rolling and rolling[c].summed:
            value = scope.scalar(c.args[0])
            spark = "double" if value.kind == T.FLOAT else "bigint"
            constants = [scope.constant(c.args[k]) for k in rolling[c].constant]
            spans[i] = int(constants[0]) if constants else 3
            folds.append(("sum", 0))
            columns[f"_v{i}"] = value.col.cast(spark)
            outs.append(f"_a{i} array<{spark}>")
        elif name in S.AGGREGATES:
            folds.append((name, _resting(name, kind)))
            if c.args and name != "count":
                value = scope.scalar(c.args[0])
                whole = name not in ("min", "max") and value.kind in T.INTEGERS - {T.ULLONG} | {T.BOOL}
                columns[f"_v{i}"] = value.col.cast("bigint") if whole else value.col.cast("double") if name == "avg" else value.col
            outs.append(f"_a{i} {T.SPARK[kind]}")
        else:
            raise T.TypeError_(f"{c.name} doesn't run over a stream: use aggregates of the language, or sums of panes")
    kinds = [kind for _, kind in built.values()]
    at = F.timestamp_seconds(F.col("_e"))
    rows = df.select(keys[epoch[0]].col.cast("bigint").alias("_e"), *(keys[n].col.alias(f"_k_{n}") for n in own), *(v.alias(n) for n, v in columns.items()))
    rows = rows.withColumn("_at", at).withWatermark("_at", f"{max(1, s.disorder)} seconds")
    types = dict(rows.dtypes)
    ddl = ", ".join(["_e bigint", *(f"`_k_{n}` {types[f'_k_{n}']}" for n in own), *outs])
    names = [f"_k_{n}" for n in own]
    calls, registry, closing, inputs = list(built), lowering.registry, q.closing_when, list(columns)

    def live(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        program = Program.bare(registry, calls, own)
        machine, closes = Machine(program), program.asks(closing)
        # open epochs' panes, the last epoch that ended, whether the group lives, kept panes of what runs
        opened, last, alive, kept = cloudpickle.loads(bytes(state.get[0])) if state.exists else ({}, None, False, {i: [] for i in spans})
        if not state.hasTimedOut:
            for frame in frames:
                for e, part in frame.groupby("_e"):
                    held = opened.setdefault(int(e), [_start(n) for n, _ in folds])
                    for i, (n, _) in enumerate(folds):
                        held[i] = _fold(n, held[i], part[f"_v{i}"].tolist() if f"_v{i}" in inputs else part["_e"].tolist())
        limit, done = state.getCurrentWatermarkMs() // 1000, []
        while alive or opened:
            e = last + 1 if alive else min(opened)
            if e > limit:
                break
            held = opened.pop(e, None) or [idle for _, idle in folds]
            values = []
            for i, (n, _) in enumerate(folds):
                if i in spans:
                    kept[i] = [*kept[i], held[i]][-spans[i] :]
                    values.append(kept[i])
                else:
                    v = held[i][0] / held[i][1] if n == "avg" else held[i]
                    values.append(bool(v) if kinds[i] == T.BOOL else Decimal(v) if kinds[i] == T.ULLONG else v)
            done.append((e, *(key if names else ()), *values))
            last, alive = e, not closes(machine, key, held)
            if not alive:
                kept = {i: [] for i in spans}
        if alive or opened:
            state.update((cloudpickle.dumps((opened, last, alive, kept)),))
            state.setTimeoutTimestamp(max((last + 1 if alive else min(opened)) * 1000 - 500, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(done, columns=["_e", *names, *(f"_a{i}" for i in range(len(folds)))])

    out = rows.withColumn("_all", F.lit(0)).groupBy(*(names or ["_all"])).applyInPandasWithState(live, ddl, "held binary", "append", "EventTimeTimeout")
    out = out.withColumn(f"_k_{epoch[0]}", F.col("_e").cast(T.SPARK[keys[epoch[0]].kind]))
    values = {}
    for i, (c, (_, kind)) in enumerate(built.items()):
        if i in spans:
            values[c] = Typed(rolling[c].over(F.col(f"_a{i}"), *(scope.constant(c.args[k]) for k in rolling[c].constant)).cast(T.SPARK[kind]), kind)
        else:
            values[c] = Typed(F.col(f"_a{i}"), kind)
    after = lowering.after(scope, items, keys, values)
    if q.having is not None:
        out = out.where(after.condition(q.having))
    return lowering.project(q, after, out, s.disorder)
