"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints at Hamming distance d <= 2 share at least 6 of their 8 positional bytes. Lists of single
bytes would hold a 256th of all fingerprints each, so an entry of the index is a set of POSITIONS = 5 positions with its
bytes (40 bits): every fingerprint stands in the 56 lists of its sets. Two that share s bytes meet in C(s, 5) lists, so
the meetings of a pair tally its shared positional bytes: 1 for five, 6 for six, 21 for seven. Pairs are formed list by
list, their meetings counted, those with fewer than the guaranteed C(6, 5) = 6 go, and the rest are verified bit by bit.

A list's pairs grow with the square of its length, and a group of near copies can make lists of thousands. Fingerprints
of lists longer than LONG are therefore filed again, under each value that differs from their own in one bit or none:
two at distance <= 2 have such a value in common, all that meet under one (65 at most) are within distance 2 of
one another, and are linked to the least. A link is thus found in short lists alone, where the tally is whole, or between two
that meet in a long one; no list is cut, and no link between classes is lost.

Work is on distinct fingerprints; copies never meet each other. Classes are found by contraction: every
fingerprint points to the neighbour of least hash in that round, edges are renamed, and a few rounds leave none.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import map_arrow, never_broadcast, written

#: Positions in an entry of the index, and the longest list whose pairs are formed one by one.
POSITIONS, LONG = 5, 32
SEED = 42


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of hashes: bit set where over half of them have it."""
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at : at + 16384].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of a text: bit set where over half of the shingles' XXH64 have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))]
    return majority(np.array(hashes, "<u8"))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). Words are runs of bytes other than space and \\t to \\r; A-Z are lower-cased."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, fp long", rows)


def _long(x: int) -> Column:
    return F.lit(signed(x))


def _entries(fp: Column) -> Column:
    """The fingerprint's entries: for each set of positions their bytes, packed, and below them the number of the set."""
    byte = [F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(0xFF).cast("long")) for k in range(8)]
    out = []
    for n, chosen in enumerate(combinations(range(8), POSITIONS)):
        key = F.lit(n).cast("long")
        for j, k in enumerate(chosen):
            key = key.bitwiseOR(F.shiftleft(byte[k], 8 * (j + 1)))
        out.append(key)
    return F.array(*out)


def links(fps: DataFrame, distance: int = 2, long: int = LONG) -> DataFrame:
    """Edges (u, v), u < v, between distinct fingerprints in column fp that connect all those within the distance (0 to 2)."""
    if not 0 <= distance <= 2:
        raise ValueError("the index guarantees distances up to 2")
    index = fps.select("fp", F.explode(_entries(F.col("fp"))).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = written(index.join(never_broadcast(sizes), "key"), "lists")
    bits = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    short = lists.where(F.col("n") <= long).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    met = short.select(F.posexplode("all").alias("at", "u"), "all").select("u", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("v"))
    tally = met.groupBy("u", "v").agg(F.count("*").alias("n"))
    pairs = tally.where((F.col("n") >= comb(8 - distance, POSITIONS)) & (bits <= distance)).select("u", "v")
    warm = lists.where(F.col("n") > long).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(_long(1 << k) for k in range(64)))
    near = warm.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"))
    stars = near.groupBy("z").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    least = stars.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u < v")
    if distance < 2:  # under a value both may be one flip away from it
        least = stars.select(F.explode("all").alias("u"), "all").select("u", F.explode("all").alias("v")).where((F.col("u") < F.col("v")) & (bits <= distance))
    return pairs.unionByName(least).distinct()


def classes(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label): one label for each connected class of the edges (u, v); nodes without an edge are absent."""
    edges = written(edges, "edges")
    assigned = written(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("label", F.col("node")), "nodes")
    for k in range(rounds):
        if edges.isEmpty():
            return assigned
        both = edges.union(edges.select("v", "u"))
        order = F.struct(F.xxhash64("v", F.lit(k)), "v")
        own = F.struct(F.xxhash64("u", F.lit(k)), "u")
        to = written(both.groupBy("u").agg(F.min(order).alias("m")).select("u", F.when(F.col("m.col1") < own.getField("col1"), F.col("m.v")).otherwise(F.col("u")).alias("m")), "to")
        edges = edges.join(to.withColumnRenamed("m", "a"), "u").join(to.select(F.col("u").alias("v"), F.col("m").alias("b")), "v")
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        assigned = written(assigned.join(to.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("m", "label").alias("label")), "nodes")
    raise RuntimeError(f"{rounds} rounds did not contract the edges")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, long: int = LONG) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable by links between fingerprints at most `distance` bits apart.

    A null text has no words, and so fingerprint 0, which links like any other. A null doc_id keeps its row; it
    is never the smallest, unless its whole class has none (then component_id is null). Repeated doc_ids give a
    row each. Other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = classes(links(distinct.select("fp"), distance, long))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    components = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = written(named.join(components, "label").select("fp", "component_id"), "by-fp")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
