"""The engine: registers streams, runs query texts, names their results."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weir import types as T
from weir.functions.library import Registry, default_registry
from weir.operators.sampling import STATES
from weir.plans import syntax as S
from weir.plans.lower import Lowering, Settings, Stream
from weir.sources.catalog import Catalog, Interface


class Engine:
    """engine.sql(text, param=value) gives the DataFrame of the text's last query; every named query becomes a stream.

    strict, wrap, null_mode: see weir.plans.lower.Settings.
    """

    def __init__(self, spark: SparkSession, registry: Registry | None = None, **settings) -> None:
        self.spark, self.registry, self.settings = spark, registry or default_registry(), Settings(**settings)
        for s in STATES:
            self.registry.register_state(s)
        self.catalog = Catalog(spark)
        self.queries: dict[str, S.Query] = {}
        self._busy: list[str] = []

    # -- what queries can read

    def register_table(self, name: str, df: DataFrame, kinds: dict[str, str] | None = None, increasing=(), decreasing=(), **more) -> None:
        """A DataFrame as a stream; columns of types that the language lacks are left out."""
        self.catalog.register(name, Stream.of(df, kinds, increasing, decreasing, **more))

    def register_schemas(self, text: str) -> None:
        self.catalog.add_schemas(text)

    def register_interface(self, name: str, kind: str, host: str = "localhost", frame=None, **properties) -> None:
        self.catalog.add_interface(Interface(name, kind, properties, host, frame))

    def register_operator(self, name: str, fn: Callable, fields: dict[str, str] | None = None, inputs: list[str] = (), increasing=()) -> None:
        """A user's operator over streams: fn(list of DataFrames, params) -> DataFrame, read in FROM by its name."""
        self.catalog.operators[name] = (fn, fields, list(inputs), tuple(increasing))

    # -- running

    def stream(self, text: str, **params) -> Stream:
        """The stream of the last query of a text."""
        found = None
        for q in S.parse(text):
            found = self._lower(q, params)
            if q.name:
                self.catalog.register(q.name, found)
                self.queries[q.name] = q
        if found is None:
            raise S.SyntaxError_("no query")
        return found

    def sql(self, text: str, **params) -> DataFrame:
        return self.stream(text, **params).df

    def run_file(self, path: str, **params) -> DataFrame:
        return self.sql(Path(path).read_text(), **params)

    def run_set(self, texts: list[str], **params) -> dict[str, DataFrame]:
        """Queries in any order that read each other by name; gives the visible ones. Rings are refused."""
        todo = [q for t in texts for q in S.parse(t)]
        by_name = {q.name: q for q in todo if q.name}
        order: list[S.Query] = []
        state: dict[int, int] = {}

        def visit(q: S.Query) -> None:
            if state.get(id(q)) == 1:
                raise T.TypeError_(f"query {q.name} reads itself")
            if state.get(id(q)) == 2:
                return
            state[id(q)] = 1
            for t in q.tables:
                if t.interface is None and t.set_ is None and t.name in by_name:
                    visit(by_name[t.name])
            state[id(q)] = 2
            order.append(q)

        for q in todo:
            visit(q)
        out = {}
        for i, q in enumerate(order):
            s = self._lower(q, params)
            if q.name:
                self.catalog.register(q.name, s)
                self.queries[q.name] = q
            if q.define.get("visibility", "external") != "none":
                out[q.name or f"query{i}"] = s.df
        return out

    def _lower(self, q: S.Query, params: dict) -> Stream:
        missing = [p for p in q.params if p not in params]
        if missing:
            raise T.TypeError_(f"parameters without a value: {', '.join(missing)}")
        streams: dict[str, Stream] = {}
        for t in q.tables:
            if t.alias in streams:
                raise T.TypeError_(f"two tables are named {t.alias}")
            streams[t.alias] = self._resolve(t, params)
        own = {k: v for k, v in params.items() if k in q.params or not q.params}
        out = Lowering(self.registry, self.settings, own).query(q, streams)
        for key in ("max_lfta_disorder", "max_hfta_disorder"):
            out.disorder = max(out.disorder, int(q.define.get(key, 0)))
        return out

    def _resolve(self, t: S.Table, params: dict) -> Stream:
        found = self.catalog.stream(t)
        if found is not None:
            return found
        if t.name in self.catalog.operators:
            return self._operator(t.name, params)
        if t.name in self.catalog.library:
            if t.name in self._busy:
                raise T.TypeError_(f"library query {t.name} reads itself")
            self._busy.append(t.name)
            try:
                found = self.stream(self.catalog.library[t.name], **params)
            finally:
                self._busy.pop()
            self.catalog.register(t.name, found)
            return found
        raise T.TypeError_(f"no stream {t.name}")

    def _operator(self, name: str, params: dict) -> Stream:
        fn, fields, inputs, increasing = self.catalog.operators[name]
        view = self.catalog.schemas.get(name)
        if view is not None and view.kind == "OPERATOR_VIEW":
            fields = {f.name: f.kind for f in view.fields}
            increasing = tuple(f.name for f in view.fields if "increasing" in f.modifiers)
            inputs = [q for q, _ in view.operator.get("inputs", [])] or inputs
            for q, wanted in view.operator.get("inputs", []):
                have = self._resolve(S.Table(q, q), params).kinds
                for kind, column in wanted:
                    column, kind = (column, kind) if column else (kind, None)
                    if column not in have or kind and T.named(kind) != have[column]:
                        raise T.TypeError_(f"operator {name} wants {kind or ''} {column} of {q}")
        df = fn([self._resolve(S.Table(i, i), params).df for i in inputs], params)
        out = Stream.of(df, fields, increasing)
        missing = [f for f in fields or () if f not in out.kinds]
        if missing:
            raise T.TypeError_(f"operator {name} gave no {', '.join(missing)}")
        return out
