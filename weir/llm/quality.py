"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of the labelled sample are computed on the executors; the trees (a few KB) are grown on the driver
over binned columns and flattened into arrays, which numpy walks for all rows and trees of a batch at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import fold, labelled_sample, map_arrow

#: Labelled documents of each class that the trees are grown on, at most.
PER_CLASS = 6000
NAMES = [
    "bytes", "words", "lines", "word_length", "line_length", "distinct_words", "top_word", "repeated_next", "same_pair", "distinct_lines",
    "compressed", "upper", "digit", "space", "period_comma", "shout", "symbol", "pipe", "other_punctuation", "non_ascii", "marked_words",
    "long_words", "single_letters", "word_length_sd", "entropy", "longest_word", "words_a_line", "end_marks",
]
_GROUP = np.zeros((256, 10), "f8")
for _c in range(256):
    _k = 0 if 65 <= _c <= 90 else 1 if 48 <= _c <= 57 else 2 if _c in (32, 9, 10, 13) else 3 if _c in b".," else 4 if _c in b"!?" else 5 if _c in b"#$%&*@^~_=+<>" else 6 if _c == 124 else 7 if 33 <= _c <= 126 and not chr(_c).isalnum() else 8 if _c >= 128 else 9
    _GROUP[_c, _k] = 1
_MARKS = frozenset(b"#$%&*!@^~|=+")


def statistics(text: str | None) -> list[float]:
    """The columns NAMES of a whole text; an empty or null text has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    share = (counts @ _GROUP) / n
    p = counts[counts > 0] / n
    words, lines = data.split(), data.split(b"\n")
    m = len(words)
    if m:
        sizes = np.fromiter(map(len, words), "i8", m)
        seen = Counter(words)
        pairs = len(set(zip(words, words[1:], strict=False)))
        ends = Counter(w[-1] for w in words)
        word = [sizes.mean(), len(seen) / m, seen.most_common(1)[0][1] / m, sum(map(eq, words, words[1:])) / m, 1 - pairs / max(1, m - 1), sum(v for k, v in ends.items() if k in _MARKS) / m, float((sizes > 25).mean()), float((sizes == 1).mean()), sizes.std(), np.log1p(sizes.max()), ends[46] / m]
    else:
        word = [0.0] * 11
    own = len({line for line in lines if line}) / max(1, sum(1 for line in lines if line))
    packed = len(zlib.compress(data, 1)) / n
    return [np.log1p(n), np.log1p(m), np.log1p(len(lines)), word[0], np.log1p(n / len(lines)), word[1], word[2], word[3], word[4], own, packed, *share[:9], word[5], word[6], word[7], word[8], -float(p @ np.log2(p)), word[9], np.log1p(m / len(lines)), word[10]]


@dataclass
class Trees:
    """Complete binary trees of one depth: inner nodes in heap order (feature, threshold), and the leaves' values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        total = np.full(len(x), self.base)
        if len(self.leaf):
            trees, rows = np.arange(len(self.leaf)), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(trees)), "i8")
            depth = int(np.log2(self.leaf.shape[1]))
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total = total + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 1.0, empty: float = 1.0) -> Trees:
    """Boosted trees for the log loss. Without rows every score is `empty`; with one class its share, smoothed."""
    n, columns = x.shape
    inner = (1 << depth) - 1
    share = (y.sum() + 0.5 * (n > 0)) / (n + (n > 0)) if n else empty
    share = min(max(float(share), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    none = Trees(np.zeros((0, inner), "i8"), np.zeros((0, inner)), np.zeros((0, 1 << depth)), base)
    if not n or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(columns)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(columns)], 1)  # bin b: x <= edges[b]
    flat = binned + np.arange(columns) * bins
    total, found = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, "i8"), np.full(inner, np.inf), np.zeros(n, "i8")
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (columns * bins) + flat).reshape(-1)
            size = many * columns * bins
            gs, hs = (np.bincount(at, np.repeat(v, columns), size).reshape(many, columns, bins).cumsum(2) for v in (g, h))
            g_all, h_all = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
            gain[(hs < least) | (h_all - hs < least)] = 0
            for j in range(columns):
                gain[:, j, len(edges[j]) :] = 0
            best = gain.reshape(many, -1).argmax(1)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            for k in np.flatnonzero(good):
                j, b = divmod(int(best[k]), bins)
                feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        where = node - inner
        gs, hs = np.bincount(where, g, 1 << depth), np.bincount(where, h, 1 << depth)
        leaf = -rate * gs / (hs + ridge)
        total += leaf[where]
        found.append((feature, threshold, leaf))
    return Trees(*(np.stack(c) for c in zip(*found, strict=True)), base)


def train_fold(doc_id: str = "doc_id") -> Column:
    return fold(doc_id, 4) != 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", in_fold: Column | None = None, per_class: int = PER_CLASS) -> Trees:
    """Trees from the labelled sample: only its numbers (about 200 bytes a row) come to the driver."""
    sample = labelled_sample(docs, labels, label, train_fold() if in_fold is None else in_fold, per_class)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = map_arrow(sample.select("doc_id", "text", "label"), "doc_id long, label int, x array<double>", rows).collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in got], "f8").reshape(len(got), len(NAMES))
    return fit(x, np.array([r["label"] for r in got], "f8"))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with a column `score`, the probability of label 1 (a column of that name is replaced). Null texts are scored as empty ones."""
    docs = docs.drop("score")
    at = docs.columns.index("text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in batch.column(at).to_pylist()], "f8").reshape(batch.num_rows, len(NAMES))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x))], [*batch.schema.names, "score"])

    return map_arrow(docs, f"{ddl}, score double", rows)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. Repeated and null doc_ids keep their rows (a null id is in the fold of the empty text)."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return out.select("doc_id", (~train_fold()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
