"""Best-fit packing planned on the histogram of lengths.

Best-fit decreasing runs over counts: all bins with the same room are one group, so the plan has as many
steps as there are distinct lengths and groups (thousands, whatever the number of documents). Documents
then take planned slots by their rank among the pieces of equal length, found by a join.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm import tokens
from weir.llm.shared import small_batches, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: slots (length, first rank, pieces, first sequence, pieces a sequence, offset).

    Piece of rank r >= first rank takes sequence `first sequence + (r - first rank) // k`, at
    `offset + (r - first rank) % k * length`. Sequences are numbered from 0. Lengths under 1 take no room and
    are refused, as are those over capacity.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> groups (first sequence, sequences)
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        room = length
        while left:
            while room < capacity and not rooms.get(room):
                room += 1
            each = room // length  # the same bin stays the best fit for the next piece of this length
            if room >= capacity:
                room, each = capacity, capacity // length
                first, many = sequences, -(-left // each)
                sequences += many
            else:
                first, many = rooms[room].pop()
            full = min(many, left // each)
            if full:
                slots.append((length, rank, full * each, first, each, capacity - room))
                rooms[room - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if full < many:
                rest = left  # fewer than one bin takes
                if rest:
                    slots.append((length, rank, rest, first + full, rest, capacity - room))
                    rooms[room - rest * length].append((first + full, 1))
                    rank, left = rank + rest, 0
                if many - full > bool(rest):
                    rooms[room].append((first + full + bool(rest), many - full - bool(rest)))
    return slots


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False, memory: int = tokens.MEMORY) -> DataFrame:
    """Documents as token pieces of at most `capacity`: doc_id, piece, start, length, ids_crc32 (and ids, if asked for). memory: words that a worker remembers.

    A null text counts as empty: its one piece is the end id. Other columns are ignored.
    """
    spec = tokens.read_spec(tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(spec, memory).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = []
                for doc, got in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    data = got + end
                    for k, b in enumerate(range(0, len(data), step)):
                        part = data[b : b + step]
                        rows.append((doc, k, b // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names[: len(cols)])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: few sequences of at most `capacity`, filled from 0 without gaps.

    The numbered pieces are written to the shared folder first, so that histogram and ranks see the same rows
    even if executors are lost. Only the histogram, at most `capacity` rows, comes to the driver; the ranks
    come from counts by task and length. A null length, or one outside 1 to capacity, is an error. A column
    of pieces named like one that is added (sequence_id, offset, _part, _idx, _rank) is replaced.
    """
    own = ["sequence_id", "offset", "_part", "_idx", "_rank", "_base"]
    pieces = pieces.drop(*own)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            idx = []
            for n in batch.column(batch.schema.get_field_index(length)).to_pylist():
                idx.append(seen[n])
                seen[n] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(idx), pa.int32()), pa.array(idx, pa.int64())], [*batch.schema.names, "_part", "_idx"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    numbered = written(pieces.mapInArrow(number, f"{ddl}, _part int, _idx long"), "pieces")
    counts = written(numbered.groupBy("_part", F.col(length).alias("_len")).agg(F.count("*").alias("_n")), "counts")
    histogram = {r["_len"]: r["n"] for r in counts.groupBy("_len").agg(F.sum("_n").alias("n")).collect()}
    slots = sorted(plan(histogram, capacity))
    span = max([1, *histogram.values()])
    starts = np.array([s[0] * span + s[1] for s in slots], object)
    if starts.size and starts[-1] >= 1 << 62:
        raise ValueError("too many pieces for ranks of 62 bits")
    starts = starts.astype("i8")
    table = np.array(slots, "i8").reshape(-1, 6)
    before = Window.partitionBy("_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("_part").alias("_p"), "_len", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = numbered.join(bases, (F.col("_part") == F.col("_p")) & (F.col(length) == F.col("_len"))).withColumn("_rank", F.col("_base") + F.col("_idx"))
    kept = [f.name for f in pieces.schema.fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(kept)
            size = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype("i8")
            rank = batch.column(n).to_numpy(zero_copy_only=False)
            s = table[np.searchsorted(starts, size * span + rank, "right") - 1] if len(size) else table[:0]
            k = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(s[:, 3] + k // s[:, 4].clip(1)), pa.array(s[:, 5] + k % s[:, 4].clip(1) * size)], [*kept, "sequence_id", "offset"])

    return ranked.select(*[numbered[c] for c in kept], "_rank").mapInArrow(place, f"{ddl}, sequence_id long, offset long")
