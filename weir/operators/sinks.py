"""Where results go: bucketed files, text, Parquet, functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir import types as T
from weir.plans.lower import Stream


@dataclass
class OutputSpec:
    """One line of an output file: query, operator, parameter, directory, bucket width, partition fields, partitions."""

    query: str
    operator: str
    param: str = ""
    directory: str = ""
    bucket: int = 60
    fields: tuple[str, ...] = ()
    partitions: int = 1


def parse_specs(text: str) -> list[OutputSpec]:
    """Lines of seven comma-separated fields; # begins a comment; a bucket width of nothing is 60."""
    out = []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        f = [x.strip() for x in line.split(",")]
        if len(f) != 7:
            raise ValueError(f"an output line has 7 fields: {line!r}")
        if f[1] not in ("file", "zfile", "stream"):
            raise ValueError(f"no output operator {f[1]}")
        out.append(OutputSpec(f[0], f[1], f[2], f[3], int(f[4] or 60), tuple(x for x in f[5].split(":") if x), int(f[6] or 1)))
    return out


def bucketed(stream: Stream, spec: OutputSpec) -> DataFrame:
    """The stream with the time bucket of each row: its first ordered field, down to the bucket's width."""
    ordered = [n for n, m in stream.moves.items() if m == T.INCREASING]
    if not ordered:
        raise T.TypeError_("a file output needs an increasing field")
    t = F.col(f"`{ordered[0]}`")
    t = F.unix_seconds(t) if stream.kinds[ordered[0]] == T.TIMEVAL else t.cast("bigint")
    return stream.df.withColumn("bucket", T.floored(t, spec.bucket) * spec.bucket)


def text_lines(stream: Stream, separator: str = "|") -> DataFrame:
    """Rows as the text outputs print them, in one column `value`."""
    return stream.df.select(F.concat_ws(separator, *(F.coalesce(T.text_of(F.col(f"`{n}`"), k), F.lit("")) for n, k in stream.kinds.items())).alias("value"))


def write(stream: Stream, spec: OutputSpec, path: str | None = None, form: str = "parquet", checkpoint: str | None = None):
    """Write a file output: a folder for each time bucket, hash partitions by the spec's fields.

    Spark commits a folder's files together, which takes the place of temporary names. A stream that is still
    running gives its StreamingQuery (checkpoint: the folder where it keeps its place).
    """
    df = bucketed(stream, spec)
    if form == "text":
        df = df.select("bucket", *(F.col(f"`{f}`") for f in spec.fields if f != "bucket"), F.concat_ws("|", *(F.coalesce(T.text_of(F.col(f"`{n}`"), k), F.lit("")) for n, k in stream.kinds.items())).alias("value"))
    if spec.fields and spec.partitions > 1:
        df = df.repartition(spec.partitions, *(F.col(f"`{f}`") for f in spec.fields))
    else:
        df = df.repartition("bucket") if not df.isStreaming else df
    if form == "text":
        df = df.select("bucket", "value")
    path = path or f"{spec.directory}/{spec.query}"
    zipped = {"compression": "bzip2"} if "bz2" in spec.param and form == "text" else {"compression": "gzip"} if spec.operator == "zfile" or "gz" in spec.param else {}
    if df.isStreaming:
        return df.writeStream.format(form).options(path=path, checkpointLocation=checkpoint, **zipped).partitionBy("bucket").trigger(availableNow=True).start()
    df.write.mode("append").format(form).options(**zipped).partitionBy("bucket").save(path)
    return None


def outputs(engine, text: str, form: str = "parquet", checkpoint: str | None = None) -> dict[str, DataFrame]:
    """Carry out the lines of an output file over an engine's named queries: `file` and `zfile` lines are written, `stream` lines given back."""
    visible = {}
    for spec in parse_specs(text):
        stream = engine.catalog.named(spec.query)
        if stream is None:
            raise T.TypeError_(f"no query {spec.query}")
        if spec.operator == "stream":
            visible[spec.query] = stream.df
            continue
        started = write(stream, spec, form=form, checkpoint=f"{checkpoint}/{spec.query}" if checkpoint else None)
        if started is not None:
            started.awaitTermination()
    return visible


def by_batch(df: DataFrame, path: str, checkpoint: str) -> None:
    """A stream's micro-batches, each in a folder batch=N that a repeated batch replaces: each result counts once, whatever fails."""
    save = lambda part, n: part.write.mode("overwrite").parquet(f"{path}/batch={n}")
    df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def console(stream: Stream, rows: int = 20) -> None:
    text_lines(stream).show(rows, truncate=False)


def to_function(df: DataFrame, fn: Callable[[dict], None], checkpoint: str | None = None):
    """Each result to a function, by field name. Over a stream: in each micro-batch, once per batch id.

    The rows of a batch come to the driver one partition at a time: for results, not for data.
    """
    def batch(part: DataFrame, _id: int = 0) -> None:
        for r in part.toLocalIterator():
            fn(r.asDict())

    if not df.isStreaming:
        batch(df)
        return None
    writer = df.writeStream.foreachBatch(batch).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
