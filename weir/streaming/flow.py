"""Flows: user code as a graph of flowlets over DataFrames.

A flowlet's process methods get one record, or an iterator of a batch of them, and emit any number to named
outputs. A flow lowers to one DataFrame plan per output; each flowlet is one Arrow-batched pass over its input.
"""

from __future__ import annotations

import inspect
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType, _parse_datatype_string

RETRY, IGNORE = "retry", "ignore"
_NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


# ---- what flowlets are made of


def process_input(*names: str, batch: int | None = None, partition: str = "fifo", key: str | None = None):
    """Marks a process method: of which inputs (all, if none is named); a batch size for iterators; fifo, round_robin or hash by key."""
    def mark(fn):
        fn._process = (names, batch, partition, key)
        return fn

    return mark


def output(name: str, schema: str):
    """Declares an output of a flowlet class, by DDL."""
    def mark(cls):
        cls._outputs = {**getattr(cls, "_outputs", {}), name: schema}
        return cls

    return mark


def tick(seconds: float, initial_delay: float = 0.0, max_retries: int = 5):
    """Marks a method that runs every so many seconds of processing time (see Flow.start_ticks)."""
    def mark(fn):
        fn._tick = (seconds, initial_delay, max_retries)
        return fn

    return mark


class _Counts(AccumulatorParam):
    def zero(self, _value) -> Counter:
        return Counter()

    def addInPlace(self, a: Counter, b: Counter) -> Counter:  # noqa: N802
        a.update(b)
        return a


@dataclass
class InputContext:
    origin: str
    retries: int = 0


class Flowlet:
    """Base of user code. properties: keyword arguments, checked against class annotations. Emit with self.emit(record, output).

    self.count(name, delta) adds to the flow's metrics; what a failed attempt counted doesn't count.
    """

    _outputs: dict[str, str] = {}
    failure_policy = RETRY
    max_retries = 5

    def __init__(self, **properties) -> None:
        for name, value in properties.items():
            kind = inspect.get_annotations(type(self), eval_str=True).get(name)
            if kind in (int, float, str, bool) and not isinstance(value, kind):
                value = value.lower() == "true" if kind is bool and isinstance(value, str) else kind(value)
            setattr(self, name, value)

    def initialize(self, context: dict) -> None:
        """Once in each task, with the runtime arguments."""

    def destroy(self) -> None:
        """At the end of each task."""

    def on_success(self, record, context: InputContext) -> None:
        """After a record."""

    def on_failure(self, record, context: InputContext, error: Exception) -> str:
        """After the last attempt: RETRY lets the task fail (Spark runs it again), IGNORE drops the record."""
        return self.failure_policy

    def emit(self, record, output: str | None = None) -> None:
        self._sink(record, output)

    def count(self, name: str, delta: int = 1) -> None:
        self.__dict__.setdefault("_counts", Counter())[name] += delta


@dataclass
class _Node:
    name: str
    flowlet: Flowlet
    instances: int
    inputs: list[tuple[str, str | None]] = field(default_factory=list)


class Flow:
    """Flow(name).add(name, flowlet, instances).source(name, df).connect(a, b, output).build(args) -> {flowlet: {output: DataFrame}}."""

    def __init__(self, name: str, description: str = "") -> None:
        self.name, self.description = name, description
        self.nodes: dict[str, _Node] = {}
        self.sources: dict[str, DataFrame] = {}
        self._counts = None

    def add(self, name: str, flowlet: Flowlet, instances: int = 1) -> Flow:
        if name in self.nodes or name in self.sources:
            raise ValueError(f"two flowlets are named {name}")
        self.nodes[name] = _Node(name, flowlet, instances)
        return self

    def source(self, name: str, df: DataFrame) -> Flow:
        if name in self.nodes or name in self.sources:
            raise ValueError(f"two flowlets are named {name}")
        self.sources[name] = df
        return self

    def connect(self, a: str, b: str, output: str | None = None) -> Flow:
        if b not in self.nodes or a not in self.nodes and a not in self.sources:
            raise ValueError(f"{a} -> {b}: no such flowlet")
        self.nodes[b].inputs.append((a, output))
        return self

    def set_instances(self, name: str, instances: int) -> Flow:
        self.nodes[name].instances = instances
        return self

    def specification(self) -> dict:
        return {"name": self.name, "description": self.description, "flowlets": {n: {"class": type(x.flowlet).__name__, "instances": x.instances} for n, x in self.nodes.items()}, "connections": [(a, n, o) for n, x in self.nodes.items() for a, o in x.inputs]}

    def metrics(self) -> dict[str, int]:
        """What flowlets counted, by flowlet.name, over all runs of the plans that were built; a task that is run again counts again."""
        return dict(self._counts.value) if self._counts is not None else {}

    def build(self, arguments: dict | None = None) -> dict[str, dict[str, DataFrame]]:
        if self._counts is None and self.sources:
            self._counts = next(iter(self.sources.values())).sparkSession.sparkContext.accumulator(Counter(), _Counts())
        done: dict[str, dict[str, DataFrame]] = {}
        busy: set[str] = set()

        def visit(name: str) -> dict[str, DataFrame]:
            if name in self.sources:
                return {"queue": self.sources[name]}
            if name in done:
                return done[name]
            if name in busy:
                raise ValueError(f"flowlet {name} feeds itself")
            busy.add(name)
            node = self.nodes[name]
            if not node.inputs:
                raise ValueError(f"flowlet {name} has no input")
            feeds = []
            for origin, out in node.inputs:
                found = visit(origin)
                for o, df in found.items():
                    if out in (None, o):
                        feeds.append((origin, o, df))
            done[name] = _lower(node, feeds, dict(arguments or {}), self._counts)
            return done[name]

        for n in self.nodes:
            visit(n)
        return done


def _methods(flowlet: Flowlet) -> list[tuple[Callable, tuple]]:
    found = [(m, m._process) for _, m in inspect.getmembers(flowlet, callable) if hasattr(m, "_process")]
    if not found:
        raise ValueError(f"{type(flowlet).__name__} has no process method")
    return found


def _lower(node: _Node, feeds: list[tuple[str, str, DataFrame]], arguments: dict, metrics=None) -> dict[str, DataFrame]:
    """One pass for all inputs: rows carry their origin; emitted rows carry their output."""
    flowlet = node.flowlet
    outputs = {o: _parse_datatype_string(ddl) for o, ddl in (type(flowlet)._outputs or {"queue": "value string"}).items()}
    union, pieces = None, []
    for origin, out, df in feeds:
        wanted = [(m, p) for m, p in _methods(flowlet) if not p[0] or origin in p[0] or out in p[0]]
        if not wanted:
            raise ValueError(f"{type(flowlet).__name__} takes no input {origin}")
        _, (_, _, partition, key) = wanted[0]
        if partition == "hash":
            df = df.repartition(node.instances, key)
        elif partition == "round_robin" or node.instances > 1:
            df = df.repartition(node.instances)
        pieces.append((origin, out, df.select(F.lit(origin).alias("_origin"), F.lit(out).alias("_output"), F.struct(*df.columns).alias(f"_in_{len(pieces)}"))))
    for _, _, p in pieces:
        union = p if union is None else union.unionByName(p, allowMissingColumns=True)
    out_type = StructType([StructField("_to", _parse_datatype_string("string")), *(StructField(o, t) for o, t in outputs.items())])
    arrow = to_arrow_schema(out_type)
    names, flowlet_name = list(outputs), node.name
    routes = {(origin, out): [(m.__name__, p) for m, p in _methods(flowlet) if not p[0] or origin in p[0] or out in p[0]] for origin, out, _ in feeds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        own = copy.copy(flowlet)
        own._counts = Counter()
        emitted: list[dict] = []

        def sink(record, output=None):
            to = output or names[0]
            if to not in outputs:
                raise ValueError(f"no output {to}")
            fields = outputs[to].names
            if not isinstance(record, dict):
                record = record._asdict() if hasattr(record, "_asdict") else vars(record) if hasattr(record, "__dict__") else dict(zip(fields, record if isinstance(record, (tuple, list)) else (record,), strict=True))
            emitted.append({"_to": to, to: {f: record.get(f) for f in fields}})

        own._sink = sink
        own.initialize(arguments)

        def attempt(method, record, context) -> None:
            while True:
                mark, counted = len(emitted), Counter(own._counts)
                try:
                    method(record, context) if len(inspect.signature(method).parameters) > 1 else method(record)
                    own.on_success(record, context)
                    return
                except Exception as e:
                    del emitted[mark:]  # what a failed attempt emitted doesn't count
                    own._counts = counted
                    if context.retries >= own.max_retries or own.failure_policy == IGNORE:
                        if own.on_failure(record, context, e) == IGNORE:
                            return
                        raise
                    context.retries += 1

        try:
            for batch in batches:
                rows = batch.to_pylist()
                held: dict[str, tuple] = {}
                for row in rows:
                    record = next((row[c] for c in row if c.startswith("_in_") and row[c] is not None), None)
                    for name, (_, size, _, _) in routes[row["_origin"], row["_output"]]:
                        context = InputContext(row["_origin"])
                        if size is None:
                            attempt(getattr(own, name), record, context)
                        else:
                            held.setdefault(name, (size, context, []))[2].append(record)
                            if len(held[name][2]) >= size:
                                attempt(getattr(own, name), iter(held.pop(name)[2]), context)
                for name, (_, context, some) in held.items():
                    attempt(getattr(own, name), iter(some), context)
                if emitted:
                    yield pa.RecordBatch.from_pylist(emitted, arrow)
                    emitted.clear()
        finally:
            own.destroy()
            if metrics is not None and own._counts:
                metrics.add(Counter({f"{flowlet_name}.{name}": n for name, n in own._counts.items()}))

    done = union.mapInArrow(run, out_type)
    return {o: done.where(F.col("_to") == o).select(f"`{o}`.*") for o in names}


# ---- type projection


def projected(df: DataFrame, target: str) -> DataFrame:
    """df as another record type: fields by name, numbers widened, simple values to text; a field that df lacks is null."""
    wanted = _parse_datatype_string(target)
    columns = []
    for f in wanted.fields:
        have = next((h for h in df.schema.fields if h.name.lower() == f.name.lower()), None)
        if have is None:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            columns.append(_project(F.col(f"`{have.name}`"), have.dataType, f.dataType, f.name).alias(f.name))
    return df.select(*columns)


def _project(value, have: DataType, want: DataType, name: str):
    a, b = have.simpleString(), want.simpleString()
    if a == b:
        return value
    if isinstance(have, StructType) and isinstance(want, StructType):
        known = {h.name.lower(): h for h in have.fields}
        return F.when(value.isNotNull(), F.struct(*((_project(value.getField(known[f.name.lower()].name), known[f.name.lower()].dataType, f.dataType, f.name) if f.name.lower() in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields)))
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):
        return F.transform(value, lambda v: _project(v, have.elementType, want.elementType, name))
    if isinstance(have, MapType) and isinstance(want, MapType) and have.keyType == want.keyType:
        return F.transform_values(value, lambda k, v: _project(v, have.valueType, want.valueType, name))
    if a in _NUMBERS and b in _NUMBERS and _NUMBERS.index(a) < _NUMBERS.index(b) or b == "string" and a in [*_NUMBERS, "boolean"]:
        return value.cast(want)
    raise TypeError(f"{name}: {a} is not read as {b}")


def start_ticks(spark, flowlet: Flowlet, sink: Callable[[dict], None], ticks: int | None = None):
    """Run a flowlet's tick methods on a processing-time trigger; emitted records go to `sink`. Gives the StreamingQueries.

    ticks: stop after so many (for sources that end). What is emitted is made on the driver: ticks are timers, not data paths.
    """
    started = []
    for _, method in inspect.getmembers(flowlet, callable):
        if not hasattr(method, "_tick"):
            continue
        seconds, _, retries = method._tick
        count = [0]

        def batch(_df, _id, method=method, retries=retries, count=count):
            if ticks is not None and count[0] >= ticks:
                return
            count[0] += 1
            flowlet._sink = lambda record, output=None: sink(record)
            for n in range(retries + 1):
                try:
                    method()
                    return
                except Exception:
                    if n == retries:
                        raise

        source = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        started.append(source.writeStream.foreachBatch(batch).trigger(processingTime=f"{seconds} seconds").start())
    return started


class FlowRunner:
    """Start, stop and list the streaming queries of flows by name."""

    def __init__(self, spark) -> None:
        self.spark, self.running = spark, {}

    def start(self, flow: Flow, sink: Callable[[str, str, DataFrame], object], arguments: dict | None = None) -> None:
        if flow.name in self.running:
            raise ValueError(f"flow {flow.name} runs already")
        self.running[flow.name] = [q for f, outs in flow.build(arguments).items() for o, df in outs.items() if (q := sink(f, o, df)) is not None]

    def stop(self, name: str) -> None:
        for q in self.running.pop(name):
            q.stop()

    def list(self) -> list[str]:
        return sorted(self.running)

    def status(self, name: str) -> str:
        if name not in self.running:
            return "STOPPED"
        return "RUNNING" if any(q.isActive for q in self.running[name]) else "COMPLETED"
