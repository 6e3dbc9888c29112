"""Helpers of the training-data operators: the shared folder, written tables, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a Python worker, and rows and bytes of an Arrow batch sent to one.
SLICE_ROWS, BATCH_ROWS, BATCH_BYTES = 512, 1024, 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the session has no such setting (as in local tests) a local folder takes its place.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weir-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/weir-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there, and losing an executor loses no part of it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def never_broadcast(df: DataFrame) -> DataFrame:
    """df, whose join is by sorting on both sides: Spark takes rows that an explode makes for as few as those they are made of.

    So lists of millions of keys pass for a few MB, and the driver would collect them to broadcast them.
    """
    return df.hint("merge")


def open_fs(uri: str):
    """(filesystem, path) of a URI for work inside executors: a mounted folder, or a store that pyarrow reaches."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends Python workers Arrow batches of BATCH_ROWS and BATCH_BYTES at most (a session's smaller limits stay).

    Texts are long: batches of Spark's usual 10,000 rows would hold tens of MB in the JVM and again in each worker.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _count(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df


def _count(text: str) -> int:
    """A setting that may have a unit of bytes, as a number."""
    m = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", text.strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 0


def settle() -> None:
    """Give back memory that a task has freed: workers live on, and the next stage's need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], pa.RecordBatch], size: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow with batches cut to `size` rows, so that a worker holds little at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield rows(batch.slice(at, size))
        settle()

    return small_batches(df).mapInArrow(run, schema)


def fold(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int) -> DataFrame:
    """At most `per_class` labelled documents of each class, for fitting: (doc_id, text, label), a row each.

    train: a predicate over doc_id. Ids are taken in the order of their hash, so the sample is the same on
    every run; only that many ids are broadcast (8 bytes each). Rows with a null label or a label other
    than 0 and 1 are left out; an id labelled twice counts once, with its larger label. Of an id's documents the one
    whose text has the least hash counts, however many there are.
    """
    known = labels.where(F.col("doc_id").isNotNull() & train & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = None
    for c in (0, 1):
        one = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")
