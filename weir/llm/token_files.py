"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, read back by memory map.

A data set is a folder of shards. Shard k has
  k.ids   token ids, uint16 or uint32 little-endian by vocabulary size, documents one after another
  k.off   int64 little-endian, one more than documents: where each document begins within the shard
  k.doc   int64 little-endian document ids; k.nul (one byte a document) only if some id is null
and manifest.json lists shards in order with documents, tokens and base (tokens in all shards before).

Documents are in ascending doc_id order over all shards (null ids first, equal ids by text). Every
document ends with the end id. A null text counts as empty. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import tokens
from weir.llm.shared import open_fs, settle, small_batches

SHARD = "shard long, docs long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> list[dict]:
    """Write the data set under `folder` (a folder that all executors share); returns the manifest's shards.

    Rows are dealt by ranges of (doc_id, hash of text), so even one doc_id repeated many times spreads out.
    A shard is written under a name of its own attempt and then renamed: a task that is run again or twice
    leaves the same files. Only one row a shard comes to the driver.
    """
    spec = tokens.read_spec(tokenizer)
    dtype = "<u2" if tokens.vocabulary_size(spec) <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = open_fs(folder)
        name = f"{base}/{task.partitionId():08d}"
        part = f"{name}.try-{task.taskAttemptId()}"
        encode = tokens.encoder(spec).encode
        ends, ids, nulls, total = [0], [], [], 0
        with fs.open_output_stream(f"{part}.ids") as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    for got in encode(some.column(1).to_pylist()):
                        data = np.frombuffer(got + end, "<u4")
                        total += data.size
                        ends.append(total)
                        out.write(data.astype(dtype).tobytes())
                    for d in some.column(0).to_pylist():
                        ids.append(d or 0)
                        nulls.append(d is None)
        settle()
        if not ids:
            fs.delete_file(f"{part}.ids")
            return
        for kind, data in (("off", np.array(ends, "<i8")), ("doc", np.array(ids, "<i8")), *([("nul", np.array(nulls, "u1"))] if any(nulls) else [])):
            with fs.open_output_stream(f"{part}.{kind}") as out:
                out.write(data.tobytes())
            fs.move(f"{part}.{kind}", f"{name}.{kind}")
        fs.move(f"{part}.ids", f"{name}.ids")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], ["shard", "docs", "tokens"])

    ordered = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    shards = sorted((r.asDict() for r in ordered.mapInArrow(shard, SHARD).collect()), key=lambda r: r["shard"])
    total = 0
    for s in shards:  # the prefix sums
        s["base"], total = total, total + s["tokens"]
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "tokens": total, "end_id": end_id, "shards": shards}).encode())
    return shards


def _map(fs, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it lies on a mounted folder."""
    size = fs.get_file_info(path).size
    if not size:
        return np.zeros(0, dtype)
    if fs.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class TokenFiles:
    """Random access to a written data set: len(), [i] gives (doc_id, ids) of the i-th document."""

    def __init__(self, folder: str) -> None:
        self.fs, self.base = open_fs(folder)
        with self.fs.open_input_file(f"{self.base}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.shards = self.manifest["shards"]
        self.firsts = np.cumsum([0, *(s["docs"] for s in self.shards)])

    def __len__(self) -> int:
        return int(self.firsts[-1])

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.firsts, i, "right")) - 1
        ids, off, doc, nul = shard_arrays(self.fs, self.base, self.shards[k]["shard"], self.manifest["dtype"])
        j = i - int(self.firsts[k])
        return (None if nul is not None and nul[j] else int(doc[j])), ids[off[j] : off[j + 1]]


def shard_arrays(fs, base: str, shard: int, dtype: str):
    name = f"{base}/{shard:08d}"
    nul = _map(fs, f"{name}.nul", "u1") if fs.get_file_info(f"{name}.nul").is_file else None
    return _map(fs, f"{name}.ids", dtype), _map(fs, f"{name}.off", "<i8"), _map(fs, f"{name}.doc", "<i8"), nul


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens of all documents before), n_tokens, ids_crc32 (of uint32 little-endian ids)."""
    fs, base = open_fs(folder)
    with fs.open_input_file(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype, shards = manifest["dtype"], manifest["shards"]
    if not shards:
        return spark.createDataFrame([], ROWS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for batch in batches:
            for shard, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, off, doc, nul = shard_arrays(fs, base, shard, dtype)
                for at in range(0, len(doc), 4096):
                    ends = np.array(off[at : at + 4097])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    none = None if nul is None else np.array(nul[at : at + 4096]).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(doc[at : at + 4096]), pa.int64(), mask=none), pa.array(ends[:-1] + first), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # as an Arrow table: rows would go through Python workers of another kind, which live on beside those that have encoded
    listed = spark.createDataFrame(pa.table({k: pa.array([s[k] for s in shards], pa.int64()) for k in ("shard", "base")}))
    return listed.repartition(len(shards)).mapInArrow(rows, ROWS)
