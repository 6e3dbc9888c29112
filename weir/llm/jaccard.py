"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and MinHash bands find pairs, the shingles themselves decide.

SimHash fingerprints of the sets of shingles go through the byte-position index of `simhash`, with its count filter, and
what it links within two bits is compared. Alone it can't be the index here: texts at similarity 0.8 differ in some 10 of
64 bits, and blocks of bits long enough to be rare are then seldom whole. So bands find the rest. A band is ROWS minima; a pair at similarity 0.8 misses all BANDS with
probability (1 - 0.8 ** 5) ** 40 = 1.3e-7, and one below 0.8 is refused by its shingles.

Work is on distinct sets of shingles. Every list of equal bands first links its members to one of them, the one that
meets most others over all of its lists (of edited copies the original), which is linear in the list's length. In lists
in which several classes still meet, pairs are sought by counts of their shingles (`_rest`): texts whose frequent shingles
don't suffice can only be similar through rare ones, whose lists are short; where they suffice, all outside the list's
largest class are compared with all of the list. No list is cut, and large groups of near copies make no squares of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import map_arrow, never_broadcast, written
from weir.llm.simhash import SEED, classes, links, majority, signed

SHINGLE, SIMILARITY = 5, 0.8
#: Ids (8 bytes each) that may be broadcast.
SMALL = 1_000_000
#: Longest list of a shingle's texts whose pairs are tallied.
RARE = 64
#: Bands of so many minima each.
BANDS, ROWS = 40, 5
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, "u8") * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in parts], "<u8"))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of a set of shingles, as signed longs; none for the empty set."""
    if not len(own):
        return []
    least = np.full(len(_ODD), 0xFFFFFFFFFFFFFFFF, "<u8")
    for at in range(0, len(own), 512):
        np.minimum(least, (_ODD[:, None] * own[None, at : at + 512]).min(1), out=least)
    return [signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)]


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, own (a digest of the set of shingles), size, fp (the set's SimHash as a signed long), bands."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
        own = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        sizes, fps = pa.array(map(len, sets), pa.int64()), pa.array([signed(majority(s)) for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), own, sizes, fps, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "own", "size", "fp", "bands"])

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, own binary, size long, fp long, bands array<long>", rows)


def _meetings(least: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes that SimHash links: those of one fingerprint with its first, and firsts within two bits."""
    firsts = written(least.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    same = least.join(firsts, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    u, v = (firsts.select(F.col("fp").alias(n), F.col("first").alias(f"{n}_first")) for n in "uv")
    near = links(firsts.select("fp")).join(u, "u").join(v, "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    return written(same.unionByName(near), "meetings")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """node, shingles: the set of shingles of each document among ids, as signed longs."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle).view("<i8") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    few = F.broadcast(ids) if ids.count() <= SMALL else ids
    return written(map_arrow(docs.select("doc_id", "text").join(few.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), "node long, shingles array<long>", rows), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    one, other = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_own")) for n in "uv")
    both, all_ = F.size(F.array_intersect("u_own", "v_own")), F.size("u_own") + F.size("v_own")
    return pairs.join(other, "v").join(one, "u").where(both >= similarity * (all_ - both) - 1e-9).select("u", "v")


def _rest(mixed: DataFrame, sets: DataFrame, similarity: float, rare: int) -> DataFrame:
    """The pairs (u, v) of nodes with different labels that may still be similar, by counts of shingles among these nodes.

    A pair of sizes a and b needs similarity / (1 + similarity) * (a + b) shingles in common. Shingles that one node alone
    has give none; those of at most `rare` nodes are tallied per pair; of all others a pair has no more than the lesser
    number of the two. So pairs with too few frequent ones come from the lists of rare shingles, none longer than `rare`, and
    only those with enough from the lists of bands.
    """
    nodes = mixed.select("node", "size", "label").distinct()
    each = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    holders = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    few = written(each.join(never_broadcast(holders.where(F.col("n").between(2, rare)).select("shingle")), "shingle"), "few")
    gone = holders.where("n = 1").select("node").unionByName(few.select("node")).groupBy("node").agg(F.count("*").alias("gone"))
    some = few.groupBy("node").agg(F.count("*").alias("few"))
    counted = nodes.join(gone, "node", "left").join(some, "node", "left").select("node", "size", "label", (F.col("size") - F.coalesce("gone", F.lit(0))).alias("often"), F.coalesce("few", F.lit(0)).alias("few"))
    counted = written(counted, "counted")

    def both(a: str) -> tuple[DataFrame, DataFrame]:
        return tuple(counted.select(*(F.col(c).alias(f"{n}_{c}") for c in counted.columns)) for n in a)

    needed = similarity / (1 + similarity) * (F.col("u_size") + F.col("v_size")) - 1e-6
    often = F.least("u_often", "v_often")
    could = (F.col("u_label") != F.col("v_label")) & (F.least("u_size", "v_size") >= similarity * F.greatest("u_size", "v_size") - 1e-9)
    u, v = both("uv")
    by_shingle = [few.join(side, few.node == side[f"{n}_node"]).drop("node") for n, side in (("u", u), ("v", v))]
    rarely = by_shingle[0].join(by_shingle[1], "shingle").where((F.col("u_node") < F.col("v_node")) & could & (often < needed) & (often + F.least("u_few", "v_few") >= needed))
    tallied = rarely.groupBy("u_node", "v_node").agg(F.count("*").alias("n"), F.first(needed - often).alias("least")).where("n >= least").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    frequent = counted.where(F.col("often") >= similarity * F.col("size") - 1e-6)  # any partner is at least that large
    main = mixed.select("key", "node", "main").join(frequent, "node")
    a, b = (main.select("key", "main", *(F.col(c).alias(f"{n}_{c}") for c in counted.columns)) for n in "uv")
    often_ = a.where("u_label <> main").drop("main").join(b, "key").where(((F.col("v_label") == F.col("main")) | (F.col("u_node") < F.col("v_node"))) & could & (often >= needed))
    return tallied.unionByName(often_.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, rare: int = RARE) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable by links between texts of that similarity or more.

    doc_id: distinct longs, none null. Texts without words are one class.
    """
    prints = written(_prints(docs, shingle), "prints")
    least = written(prints.groupBy("own").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp")), "sets")
    meetings = _meetings(least.select("node", "fp"))
    index = prints.join(least.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "size", F.explode("bands").alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = written(index.join(never_broadcast(sizes), "key"), "lists")
    met = written(lists.groupBy("node", "size").agg(F.sum("n").alias("met")), "met")  # only these texts, and those of meetings, are shuffled
    ids = met.select("node").unionByName(meetings.select(F.col("u").alias("node"))).unionByName(meetings.select(F.col("v").alias("node")))
    sets = _sets(docs, written(ids.distinct(), "ids"), shingle)
    lists = written(lists.join(met.select("node", "met"), "node"), "lists")
    pivot = lists.groupBy("key").agg(F.max(F.struct("met", "node", "size")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.size").alias("pivot_size"))
    lists = written(lists.join(pivot, "key"), "lists")
    could = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9
    stars = lists.where((F.col("node") != F.col("pivot")) & could("size", "pivot_size")).select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    edges = written(_verified(stars.unionByName(meetings).distinct(), sets, similarity), "stars")
    labels = classes(edges)
    # lists in which several classes still meet; a pivot has been compared with all of its list
    named = lists.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named.select("key", "node", "size", "pivot", "label"), "named")
    main = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("key", "main")
    mixed = written(named.join(main, "key").where("node <> pivot"), "mixed")
    rest = _rest(mixed, sets, similarity, rare)
    more = written(_verified(rest, sets, similarity), "more")
    if not more.isEmpty():
        labels = classes(edges.unionByName(more))
    named = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    components = named.groupBy("label").agg(F.min("node").alias("component_id"))
    by_set = written(named.join(components, "label").select("own", "component_id"), "by-set")
    return prints.join(by_set, "own").select("doc_id", "component_id")
