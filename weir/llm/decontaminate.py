"""Benchmark decontamination with training suffix arrays.

Each task sorts the suffixes of the texts it reads (a shard of bounded size) by words and binary-searches every
test suffix of every item in it, all at once, one word deeper at a time. What remains of a test suffix's
range after its last matching word is its longest verbatim match, with all locations; the range at the
window's depth is every occurrence of that window. Nothing is shuffled, and no shard depends on another.

Only suffixes whose first two words (the first, if a window has a single word) begin some test suffix can
match at all, so only those are sorted: the answers are the same as over all suffixes.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null text has no words; so has an
item of null text, and items without words match nothing. Equal items, repeated documents and ids are all
reported. Items beyond BLOCK words go into blocks of that size, kept in the shared folder and
searched one after another, each read once for a shard; only the first block travels with the tasks.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import open_fs, scratch, settle, small_batches

#: Words of a training shard (about 50 bytes of memory each), and of a block of benchmark items.
SHARD, BLOCK = 1_000_000, 1_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Items:
    """A block of benchmark items as word codes (1 and up; 0 ends an item and stands for all other words)."""

    vocabulary: dict[bytes, int]
    codes: np.ndarray
    begins: np.ndarray  # of each item in codes
    ends: np.ndarray
    ids: list  # of each item
    window: int

    @staticmethod
    def of(items: list[tuple], window: int) -> Items:
        vocabulary: dict[bytes, int] = {}
        codes, begins, ends, ids = [], [], [], []
        for item, own in items:
            begins.append(len(codes))
            codes += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in own]
            ends.append(len(codes))
            codes.append(0)
            ids.append(item)
        return Items(vocabulary, np.array(codes, "i8"), np.array(begins, "i8"), np.array(ends, "i8"), ids, window)

    def prepare(self) -> None:
        """What searching needs: test suffixes, one of each distinct window, and the items that have it."""
        lengths = self.ends - self.begins
        self.shortest = int(lengths.min()) if len(lengths) else 0
        starts = [np.arange(b, e) for b, e in zip(self.begins, self.ends, strict=True)]
        self.suffixes = np.concatenate(starts) if starts else np.zeros(0, "i8")
        self.room = np.concatenate([e - s for s, e in zip(starts, self.ends, strict=True)]) if starts else np.zeros(0, "i8")
        self.owner = np.repeat(np.arange(len(starts)), lengths)
        width = np.minimum(lengths, self.window)
        self.is_window = self.room >= np.repeat(width, lengths)
        self.width = np.repeat(width, lengths)
        first = 2 if min(self.shortest, self.window) >= 2 else 1
        heads = self.suffixes[self.room >= first]
        self.first, self.base = first, len(self.vocabulary) + 1
        self.heads = np.unique(self.codes[heads] * self.base + self.codes[heads + 1] if first == 2 else self.codes[heads])


def suffix_array(codes: np.ndarray, at: np.ndarray, depth: int, base: int) -> np.ndarray:
    """The positions `at` in the order of the `depth` words that begin there; codes needs `depth` zeros at its end.

    As many words as fit into 64 bits are sorted at once; only positions still tied go on to the next words.
    """
    take = max(1, int(62 // np.log2(max(2, base))))

    def key(p: np.ndarray, begin: int) -> np.ndarray:
        k = np.zeros(len(p), "u8")
        for j in range(begin, begin + take):
            k = k * np.uint64(base) + codes[p + j].astype("u8") if j < depth else k
        return k

    k = key(at, 0)
    order = np.argsort(k, kind="stable")
    out, k = at[order], k[order]
    group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) if len(k) else np.zeros(0, "i8")
    done = take
    while done < depth and len(group):
        many = np.bincount(group)
        tied = np.flatnonzero(many[group] > 1)
        if not len(tied):
            break
        k = key(out[tied], done)
        order = np.lexsort((k, group[tied]))
        out[tied] = out[tied][order]
        split = np.zeros(len(out), "i8")
        s, g = k[order], group[tied]
        split[tied[1:]] = (s[1:] != s[:-1]) & (g[1:] == g[:-1])
        new = np.concatenate([[0], (group[1:] != group[:-1]).astype("i8")]) | split
        group = np.cumsum(new)
        done += take
    return out


def search(codes: np.ndarray, sa: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every test suffix: longest match, its range in sa, and the range at its window's depth (empty if none)."""
    n = len(items.suffixes)
    lo, hi = np.zeros(n, "i8"), np.full(n, len(sa), "i8")
    best, best_lo, best_hi = np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, "i8")
    win_lo, win_hi = np.zeros(n, "i8"), np.zeros(n, "i8")
    live, depth = np.arange(n) if len(sa) else np.zeros(0, "i8"), 0
    while len(live):
        word = items.codes[items.suffixes[live] + depth]
        ends = []
        for strict in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) // 2
                there = codes[sa[mid] + depth]
                up = there <= word[open_] if strict else there < word[open_]
                a[open_[up]] = mid[up] + 1
                b[open_[~up]] = mid[~up]
            ends.append(a)
        lo[live], hi[live] = ends
        depth += 1
        live = live[lo[live] < hi[live]]
        best[live], best_lo[live], best_hi[live] = depth, lo[live], hi[live]
        full = live[items.is_window[live] & (items.width[live] == depth)]
        win_lo[full], win_hi[full] = lo[full], hi[full]
        live = live[items.room[live] > depth]
    return best, best_lo, best_hi, win_lo, win_hi


class Shard:
    """The texts of some documents as codes, and their suffix array, for one block of items."""

    def __init__(self, texts: list[list[bytes]], items: Items) -> None:
        self.depth = int((items.ends - items.begins).max()) if len(items.ids) else 1
        lengths = np.array([len(t) for t in texts], "i8")
        self.begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        codes = np.zeros(int(self.begins[-1]) + self.depth + 2, "i8")
        get = items.vocabulary.get
        for b, t in zip(self.begins.tolist(), texts, strict=False):
            codes[b : b + len(t)] = np.fromiter((get(w, 0) for w in t), "i8", len(t))
        self.codes, self.lengths = codes, lengths
        if items.first == 2:
            heads = np.where((codes[:-1] > 0) & (codes[1:] > 0), codes[:-1] * items.base + codes[1:], -1)
        else:
            heads = codes
        at = np.flatnonzero(heads > 0)
        at = at[_among(heads[at], items.heads)]
        self.sa = suffix_array(codes, at, self.depth, items.base)

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, positions, "right") - 1


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.searchsorted(known, values).clip(max=len(known) - 1)] == values


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of ranges [lo, hi), and which range each is of."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


def window_hits(shard: Shard, items: Items) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Per word of the shard: whether a window covers it; and the (document, item) pairs with an occurring window."""
    _, _, _, lo, hi = search(shard.codes, shard.sa, items)
    found = np.flatnonzero(lo < hi)
    edge = np.zeros(len(shard.codes) + 1, "i8")
    if not len(found):
        return edge[:-1].astype(bool), []
    same = np.stack([lo[found], hi[found], items.width[found]], 1)
    kinds, which = np.unique(same, axis=0, return_inverse=True)  # equal windows have the same range
    at, of = _spread(kinds[:, 0], kinds[:, 1])
    where = shard.sa[at]
    np.add.at(edge, where, 1)
    np.add.at(edge, where + kinds[of, 2], -1)
    docs = np.unique(np.stack([of, shard.documents(where)], 1), axis=0)
    owners = np.unique(np.stack([which.reshape(-1), items.owner[found]], 1), axis=0)
    first, last = np.searchsorted(owners[:, 0], docs[:, 0]), np.searchsorted(owners[:, 0], docs[:, 0], "right")
    at, of = _spread(first, last)
    pairs = np.unique(np.stack([docs[of, 1], owners[at, 1]], 1), axis=0)
    return np.cumsum(edge[:-1]) > 0, [tuple(p) for p in pairs.tolist()]


def _blocks(benchmark: DataFrame, window: int, block: int) -> list:
    """The items as blocks: the first one itself, the others as paths in the shared folder."""
    spark, found, some, size = benchmark.sparkSession, [], [], 0

    def close() -> None:
        nonlocal some, size
        if not some:
            return
        items = Items.of(some, window)
        if found:
            path = f"{scratch(spark, 'items')}.pickle"
            fs, at = open_fs(path)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as out:
                out.write(pickle.dumps(items))
            found.append(path)
        else:
            found.append(items)
        some, size = [], 0

    for r in benchmark.select("item_id", "text").toLocalIterator():
        own = words(r["text"])
        if not own:
            continue
        some.append((r["item_id"], own))
        size += len(own)
        if size >= block:
            close()
    close()
    return found


def _load(block) -> Items:
    if isinstance(block, str):
        fs, at = open_fs(block)
        with fs.open_input_file(at) as f:
            block = pickle.loads(f.read())
    block.prepare()
    return block


def _sharded(batches: Iterator[pa.RecordBatch], at_text: int, shard: int) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """The rows in runs of about `shard` words, whole texts each: the run's (slices of) batches and its texts' words."""
    parts, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some, first = batch.slice(at, 256), 0
            for k, text in enumerate(some.column(at_text).to_pylist()):
                texts.append(words(text))
                size += len(texts[-1]) + 1
                if size >= shard:
                    yield [*parts, some.slice(first, k + 1 - first)], texts
                    parts, texts, size, first = [], [], 0, k + 1
            if first < some.num_rows:
                parts.append(some.slice(first))
    if texts:
        yield parts, texts


def _found(blocks: list, texts: list[list[bytes]], ready: list[Items]) -> tuple[np.ndarray, list[list]]:
    """Of each text of a shard: its words that are hit, and the ids of the items whose windows occur in it."""
    begins = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], "i8"))])
    covered, items = np.zeros(int(begins[-1]), bool), [[] for _ in texts]
    for k, block in enumerate(blocks):
        own = ready[0] if k == 0 else _load(block)
        hit, pairs = window_hits(Shard(texts, own), own)
        covered |= hit[: len(covered)]
        for d, i in pairs:
            items[d].append(own.ids[i])
    return np.add.reduceat(covered.astype("i8"), begins[:-1]), items


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words in any occurrence of a window), items (ids with an occurring window, sorted as strings)."""
    blocks = _blocks(benchmark, window, block)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [_load(b) for b in blocks[:1]]
        for parts, texts in _sharded(batches, 1, shard):
            hits, items = _found(blocks, texts, ready)
            ids = pa.concat_arrays([p.column(0) for p in parts])
            named = [sorted({str(i) for i in found if i is not None}) for found in items]
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, texts), pa.int64()), pa.array(hits), pa.array(named, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])
        settle()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_words long, n_hit long, items array<string>")


def _lengths(shard: Shard, items: Items, suffixes: np.ndarray, where: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many words each test suffix (by its number) and the text at `where` share, if the first `known` are the same."""
    length, room = known.copy(), items.room[suffixes]
    live = np.flatnonzero(length < room)
    while len(live):
        n = length[live]
        live = live[items.codes[items.suffixes[suffixes[live]] + n] == shard.codes[where[live] + n]]
        length[live] += 1
        live = live[length[live] < room[live]]
    return length


def longest_matches(docs: DataFrame, benchmark: DataFrame, at_least: int = 13, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Longest verbatim matches and their places: item_id (the benchmark's type), item_start, doc_id, doc_start, length, in words.

    Every place in a document where `at_least` words of an item (all, if it has fewer) stand, as long as the words
    before and after go on alike: matches that only continue one which begins a word earlier are no rows of their own.
    A row doesn't depend on other documents, nor on how they share tasks and shards. Items without id are left out.
    """
    blocks = _blocks(benchmark.where("item_id IS NOT NULL"), at_least, block)
    field = benchmark.schema["item_id"].dataType.simpleString()
    kind = pa.string() if field == "string" else pa.int64()
    ddl = f"item_id {'string' if field == 'string' else 'long'}, item_start long, doc_id long, doc_start long, length long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [_load(b) for b in blocks[:1]]
        for parts, texts in _sharded(batches, 1, shard):
            ids = pa.concat_arrays([p.column(0) for p in parts])
            for k, b in enumerate(blocks):
                items = ready[0] if k == 0 else _load(b)
                s = Shard(texts, items)
                _, _, _, lo, hi = search(s.codes, s.sa, items)
                wanted = np.flatnonzero(lo < hi)
                at, of = _spread(lo[wanted], hi[wanted])
                of, where = wanted[of], s.sa[at]
                begin = items.suffixes[of] - items.begins[items.owner[of]]
                before = np.where(where > 0, s.codes[where - 1], 0)
                fresh = (begin == 0) | (before == 0) | (before != items.codes[items.suffixes[of] - 1])
                of, where, begin = of[fresh], where[fresh], begin[fresh]
                doc = s.documents(where)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([items.ids[i] for i in items.owner[of]], kind), pa.array(begin), ids.take(pa.array(doc)), pa.array(where - s.begins[doc]), pa.array(_lengths(s, items, of, where, items.width[of]))],
                    ["item_id", "item_start", "doc_id", "doc_start", "length"],
                )
        settle()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, ddl)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """Hit at all, and in a twentieth of the words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def items_digest(named: list[str]) -> str:
    return hashlib.sha256(",".join(named).encode()).hexdigest()


def removed(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """docs without those in which any window of an item occurs, however long they are; all columns kept.

    Decided row by row in the same pass over the text. Ids play no part, so rows with a null or repeated doc_id are
    judged by their own text.
    """
    blocks = _blocks(benchmark, window, block)
    names, at_text = docs.columns, docs.columns.index("text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [_load(b) for b in blocks[:1]]
        for parts, texts in _sharded(batches, at_text, shard):
            clean, at = _found(blocks, texts, ready)[0] == 0, 0
            for some in parts:
                keep = pa.array(clean[at : at + some.num_rows])
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in some.columns], names)
                at += some.num_rows
        settle()

    return small_batches(docs).mapInArrow(rows, ddl)
