"""Where streams come from: protocols, the interfaces that feed them, interface sets, views, libraries, operators."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir import types as T
from weir.plans import syntax as S
from weir.plans.lower import Stream

_POSITION = re.compile(r"_pos(\d+)$", re.I)


@dataclass
class Interface:
    """A feed: its kind (CSV, JSON, PARQUET, FRAME), properties, and the machine it is on.

    Properties: Filename or Path, CSVSeparator, Streaming, Unlink (delete files that a stream has read), TcpPort,
    Slack_<protocol>; all may be read in queries as @Name.
    """

    name: str
    kind: str
    properties: dict[str, str] = field(default_factory=dict)
    host: str = "localhost"
    frame: Callable[[SparkSession], DataFrame] | None = None


class Catalog:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.schemas: dict[str, S.Schema] = {}
        self.interfaces: dict[str, Interface] = {}
        self.sets: dict[str, Callable[[Interface], bool]] = {}
        self.streams: dict[str, Stream | Callable[[], Stream]] = {}
        self.library: dict[str, str] = {}
        self.operators: dict[str, Callable] = {}
        #: What `get_system_time` fields hold: an integer for repeatable runs, or None for the clock.
        self.system_time: int | None = None

    # -- declarations

    def add_schemas(self, text: str) -> None:
        for s in S.parse_schemas(text):
            self.schemas[s.name] = s

    def fields(self, name: str, seen: tuple[str, ...] = ()) -> list[S.Field]:
        """A protocol's fields, those of its bases first."""
        if name in seen:
            raise T.TypeError_(f"protocol {name} inherits from itself")
        s = self.schemas[name]
        own = [f for b in s.bases for f in self.fields(b, (*seen, name))]
        return own + s.fields

    def add_interface(self, i: Interface) -> None:
        self.interfaces[i.name] = i

    def add_interfaces_xml(self, text: str) -> None:
        """<Host Name=..><Interface Name=..><InterfaceType value='CSV'/>...; every other child is a property."""
        for host in ET.fromstring(text).iter("Host"):
            for node in host.iter("Interface"):
                properties = {c.tag: c.get("value", "") for c in node}
                kind = properties.get("InterfaceType", "CSV").upper()
                self.add_interface(Interface(node.get("Name"), "CSV" if kind.startswith("CSV") else kind, properties, host.get("Name", "localhost")))

    def add_sets(self, text: str) -> None:
        """name : Contains[Property,Value] and Equals[Property,'value'] or not Exists[Property] ; ..."""
        for line in filter(None, (x.strip() for x in re.split(r"[;\n]", text))):
            name, _, rule = line.partition(":")
            tokens = re.findall(r"\w+\s*\[[^\]]*\]|\(|\)|\b(?:and|or|not)\b", rule, re.I)
            self.sets[name.strip()] = _set_rule(tokens)

    def add_library(self, path: str, text: str) -> None:
        """A query that FROM finds as path, e.g. LIB/query."""
        self.library[path] = text

    def add_library_folder(self, folder: str, name: str, suffix: str) -> None:
        for p in Path(folder).glob(f"*{suffix}"):
            self.library[f"{name}/{p.stem}"] = p.read_text()

    def register(self, name: str, stream: Stream | Callable[[], Stream]) -> None:
        """A stream by name, or what makes it when a query first reads it."""
        self.streams[name] = stream

    def named(self, name: str) -> Stream | None:
        found = self.streams.get(name)
        if callable(found):
            found = self.streams[name] = found()
        return found

    # -- resolution

    def stream(self, table: S.Table) -> Stream | None:
        """The stream that a FROM item names, or None if it must be built from a query."""
        if table.set_ is None and table.interface is None:
            if table.name in self.streams:
                return self.named(table.name)
            if table.name in self.schemas and self.schemas[table.name].kind == "OPERATOR_VIEW":
                return None
            folded = {k.lower(): k for k in self.streams}
            if table.name.lower() in folded:
                return self.named(folded[table.name.lower()])
            if table.name in self.schemas and len(self.interfaces) == 1:
                return self.read(next(iter(self.interfaces.values())), table.name)
            return None
        if table.set_ is not None:
            rule = self.sets.get(table.set_)
            members = [i for i in self.interfaces.values() if (rule(i) if rule else i.name == table.set_ or i.properties.get("InterfaceType", i.kind).lower() == table.set_.lower())]
            if not members:
                raise T.TypeError_(f"interface set [{table.set_}] has no members")
        else:
            if table.interface not in self.interfaces:
                if table.interface in self.streams or f"{table.interface}.{table.name}" in self.streams:
                    return self.named(f"{table.interface}.{table.name}") or self.named(table.interface)
                raise T.TypeError_(f"no interface {table.interface}")
            members = [self.interfaces[table.interface]]
            if table.machine and members[0].host != table.machine:
                raise T.TypeError_(f"interface {table.interface} is on {members[0].host}, not {table.machine}")
        read = [self.read(i, table.name) for i in members]
        first = read[0]
        if len(read) == 1:
            return first
        names = sorted(set().union(*(s.interface for s in read)))
        df = None
        for s in read:  # @names differ by member: they become columns
            part = s.df.withColumns({f"_if_{n}": F.lit(s.interface.get(n)).cast("string") for n in names})
            df = part if df is None else df.unionByName(part)
        return Stream(df, first.kinds, first.moves, True, max(s.disorder for s in read), {n: F.col(f"_if_{n}") for n in names})

    def read(self, i: Interface, protocol: str) -> Stream:
        if protocol not in self.schemas:
            raise T.TypeError_(f"no protocol {protocol}")
        fields = self.fields(protocol)
        return read_interface(self.spark, i, fields, self.system_time, int(i.properties.get(f"Slack_{protocol}", 0)))


def _set_rule(tokens: list[str]) -> Callable[[Interface], bool]:
    at = 0

    def atom():
        nonlocal at
        t = tokens[at]
        at += 1
        if t.lower() == "not":
            inner = atom()
            return lambda i: not inner(i)
        if t == "(":
            inner = either()
            at += 1
            return inner
        name, _, rest = t.partition("[")
        args = [a.strip().strip("'\"") for a in rest.rstrip("]").split(",")]
        value = lambda i, k: i.host if k.lower() == "host" else i.properties.get(k, i.kind if k == "InterfaceType" else None)
        kind = name.strip().lower()
        if kind == "exists":
            return lambda i: value(i, args[0]) is not None
        if kind == "equals":
            return lambda i: value(i, args[0]) == args[1]
        return lambda i: args[1] in (value(i, args[0]) or "").split(",")

    def both():
        nonlocal at
        out = atom()
        while at < len(tokens) and tokens[at].lower() == "and":
            at += 1
            a, b = out, atom()
            out = lambda i, a=a, b=b: a(i) and b(i)
        return out

    def either():
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at].lower() == "or":
            at += 1
            a, b = out, both()
            out = lambda i, a=a, b=b: a(i) or b(i)
        return out

    return either()


def read_interface(spark: SparkSession, i: Interface, fields: list[S.Field], system_time: int | None = None, slack: int = 0) -> Stream:
    """A protocol's fields out of a feed. Text fields go by position; malformed ones are null, and drop the rows of queries that use them."""
    path = i.properties.get("Path") or i.properties.get("Filename")
    streaming = i.properties.get("Streaming", "").lower() == "true"
    reader = spark.readStream if streaming else spark.read
    positions = {f.name: int(m[1]) for f in fields if (m := _POSITION.search(f.access))}
    if i.frame is not None:
        df = i.frame(spark)
        columns = {f.name: F.col(f.name) for f in fields if f.access.lower() != "get_system_time"}
        typed = {n: c if dict(df.dtypes)[n] != "string" or T.named(f.kind) == T.STRING else T.parsed(c, T.named(f.kind)) for f in fields if (n := f.name) in columns for c in (columns[n],)}
    elif i.kind == "CSV":
        separator = i.properties.get("CSVSeparator", ",")
        if "TcpPort" in i.properties:  # for development: a socket can't be read again after a failure
            text = spark.readStream.format("socket").option("host", i.host).option("port", i.properties["TcpPort"]).load()
        else:
            text = (reader.option("cleanSource", "delete") if streaming and i.properties.get("Unlink", "").lower() == "true" else reader).text(path)
        parts = F.split(F.col("value"), "\\Q" + separator + "\\E")
        df = text.where("value <> ''")
        typed = {n: T.parsed(F.get(parts, F.lit(p - 1)), T.named(next(f.kind for f in fields if f.name == n))) for n, p in positions.items()}
    elif i.kind == "JSON":
        text = reader.text(path)
        df = text.where("value <> ''").withColumn("_data", F.from_json("value", "data array<string>")["data"])
        data = [f for f in fields if f.access.lower() != "get_system_time"]
        typed = {f.name: T.parsed(F.get("_data", F.lit(positions.get(f.name, k + 1) - 1)), T.named(f.kind)) for k, f in enumerate(data)}
    elif i.kind == "PARQUET":
        plain = spark.read.parquet(path)
        df = reader.schema(plain.schema).parquet(path) if streaming else plain
        names = df.columns
        typed = {f.name: F.col(f"`{f.name if f.name in names else names[positions[f.name] - 1]}`").cast(T.SPARK[T.named(f.kind)]) for f in fields if f.access.lower() != "get_system_time"}
    elif i.kind == "GDAT":
        raise T.TypeError_(f"interface {i.name}: packed binary streams are not read; write them as Parquet and declare PARQUET")
    else:
        raise T.TypeError_(f"interface kind {i.kind}")
    now = F.lit(system_time).cast("bigint") if system_time is not None else F.unix_timestamp(F.current_timestamp())
    for f in fields:
        if f.access.lower() == "get_system_time":
            typed[f.name] = now
    kinds = {f.name: T.named(f.kind) for f in fields}
    moves = {f.name: m for f in fields for m in (T.INCREASING, T.DECREASING) if m in f.modifiers}
    return Stream(df.select(*(typed[f.name].alias(f.name) for f in fields)), kinds, moves, True, slack, dict(i.properties))


def json_stream(spark: SparkSession, path: str, fields: list[S.Field], streaming: bool = True) -> Stream:
    """{"data": [...]} lines from a landing folder; {"a": 1} records by name are not part of the format."""
    return read_interface(spark, Interface("json", "JSON", {"Path": path, "Streaming": str(streaming).lower()}), fields)


def ticks(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of (timestamp, value), one row each period: the source of generators."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as a stream, one file a micro-batch, in the order of their times."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
