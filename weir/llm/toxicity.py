"""Toxicity: a counterfactually regularised linear classifier over words and their beginnings.

Features are the words of a document and the first 3 to 6 letters of each (present or not), chosen by how
strongly they tell the classes apart in the labelled sample. Beside the log loss, training penalises
the squared change of the score when identity terms in a labelled document are swapped for other terms of
their group, so a mention of a group by itself moves the score as little as the labels allow.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import fold, labelled_sample, map_arrow, written

#: Labelled documents of each class that the weights are fitted on, at most.
PER_CLASS = 6000
#: What is chosen from by halves of the labelled sample.
SETTINGS = [{"ridge": r, "balance": b} for r in (1e-5, 1e-4, 1e-3) for b in (0.5, 1.0)]
#: Groups of terms that may stand for one another.
IDENTITY = [
    ["women", "men", "girls", "boys", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"],
    ["woman", "man", "girl", "boy", "femme", "homme", "frau", "mann", "mujer", "hombre"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "musulman", "chrétien", "juif", "muslimisch", "christlich", "jüdisch", "musulmán", "cristiano", "judío"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "musulmans", "chrétiens", "juifs", "muslime", "christen", "juden", "musulmanes", "cristianos", "judíos"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual", "homosexual"],
    ["black", "white", "asian", "latino", "arab", "african", "european", "american", "mexican", "chinese", "indian", "french", "german", "spanish"],
    ["immigrants", "refugees", "natives", "foreigners", "locals", "immigrés", "réfugiés", "einwanderer", "flüchtlinge", "inmigrantes", "refugiados"],
    ["deaf", "blind", "disabled", "autistic", "elderly", "young", "old"],
]
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def parts(word: str) -> list[str]:
    """The word itself, and its beginnings (marked with a hyphen)."""
    return [word, *(word[:k] + "-" for k in range(3, 7) if len(word) >= k)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    memory: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "memory": {}}

    def score(self, text: str | None) -> float:
        if len(self.memory) > 200_000:
            self.memory.clear()
        memory, weights, found = self.memory, self.weights, set()
        for w in words(text):
            known = memory.get(w)
            if known is None:
                known = memory[w] = tuple(p for p in parts(w) if p in weights)
            if known:
                found.update(known)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(weights[p] for p in sorted(found)), -50, 50))))


def swapped(own: set[str], groups: list[list[str]], step: int) -> set[str] | None:
    """The words with every identity term replaced by the one `step` further in its group; None if there is none."""
    at = {w: (g, i) for g in groups for i, w in enumerate(g)}
    if own.isdisjoint(at):
        return None
    out = set()
    for w in own:
        g, i = at.get(w, ([w], 0))
        out.add(g[(i + step) % len(g)] if len(g) > 1 else w)
    return out


def _loss(k: Column, n: int, p: Column) -> Column:
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return k * F.log(q) + (F.lit(n) - k) * F.log(1 - q)


def select(counts: DataFrame, n0: int, n1: int, features: int = 1500, least: int = 3) -> list[str]:
    """Features that tell the classes apart, of counts (part, k0, k1: documents of each class): by log-likelihood ratio of
    their presence, `least` documents or more. Only the chosen ones come to the driver."""
    k0, k1 = F.col("k0").cast("double"), F.col("k1").cast("double")
    p = (k0 + k1) / (n0 + n1)
    ratio = _loss(k0, n0, k0 / n0) + _loss(k1, n1, k1 / n1) - _loss(k0, n0, p) - _loss(k1, n1, p)
    best = counts.where(k0 + k1 >= least).select("part", F.round(ratio, 9).alias("ratio")).where("ratio > 6").orderBy(F.col("ratio").desc(), "part").limit(features)
    return [r["part"] for r in best.collect()]


def _largest(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x / rows, by the power method (50 steps, within a few percent).

    It begins with a random vector: rows that sum to zero, as those of swapped texts do, would lose an even one.
    """
    if not len(x):
        return 0.0
    v = np.random.default_rng(0).standard_normal(x.shape[1]).astype(x.dtype)
    v /= np.linalg.norm(v)
    size = 0.0
    for _ in range(50):
        u = x.T @ (x @ v) / len(x)
        size = float(np.linalg.norm(u))
        if not size:
            return 0.0
        v = u / size
    return size


def chosen(names: list[str], docs: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], swap: float = 1.0) -> dict:
    """The ridge and balance of SETTINGS with the least loss on one half of these rows after fitting on the other, both ways.

    The loss is the mean of both classes' mean log loss, so that neither counts for being frequent.
    """
    half = np.arange(len(docs)) % 2
    if not len(docs) or any(len(set(y[half == h])) < 2 for h in (0, 1)):
        return SETTINGS[0]
    losses = []
    for setting in SETTINGS:
        loss = 0.0
        for h in (0, 1):
            model = fit(names, [d for d, k in zip(docs, half, strict=True) if k == h], y[half == h], pairs[h::2], swap=swap, **setting)
            own = np.array([model.weights.get(f, 0.0) for f in names])
            other = np.flatnonzero(half != h)
            z = np.clip([model.bias + own[docs[i]].sum() for i in other], -50, 50)
            each = np.log1p(np.exp(-np.where(y[other] == 1, z, -z)))
            loss += each[y[other] == 1].mean() + each[y[other] == 0].mean()
        losses.append(loss)
    return SETTINGS[int(np.argmin(losses))]


def fit(names: list[str], docs: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], ridge: float = 1e-5, swap: float = 1.0, steps: int = 600, empty: float = 0.0, balance: float = 0.5) -> Model:
    """Weights by accelerated gradient descent on mean log loss + ridge |w|^2 + swap * mean (change of score on swapping)^2.

    balance: 0 weighs documents alike, 1 classes alike.

    docs: each one's features, as places in names; pairs: features of a document and of its swapped twin. Without
    rows, or with one class only, there is nothing to tell apart: every score is the class's share (`empty` without rows).
    """
    n = len(docs)
    share = min(max((float(y.sum()) + 0.5) / (n + 1) if n else empty, 1e-6), 1 - 1e-6)
    if not n or y.min() == y.max():
        return Model({}, float(np.log(share / (1 - share))))

    def rows(listed: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(listed), len(names) + 1), "f4")
        x[:, -1] = 1
        for r, own in enumerate(listed):
            x[r, own] = 1
        return x

    x = rows(docs)
    change = rows([a for a, _ in pairs])  # in place: every text may name identity terms
    change[:, -1] = 0
    for r, (_, b) in enumerate(pairs):
        change[r, b] -= 1
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** balance
    y, weight = y.astype("f4"), weight.astype("f4")
    w, v = np.zeros(x.shape[1], "f4"), np.zeros(x.shape[1], "f4")  # single precision throughout: no copies of x
    top = 1.1 * (0.25 * weight.max() * _largest(x) + 2 * swap * _largest(change)) + 2 * ridge  # how fast the gradient can change
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
        g = x.T @ ((p - y) * weight) / np.float32(n)
        g[:-1] += np.float32(2 * ridge) * v[:-1]
        if len(pairs):
            g += np.float32(2 * swap / len(pairs)) * (change.T @ (change @ v))
        new = v - g / np.float32(top)
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return Model({f: float(w[i]) for i, f in enumerate(names) if abs(w[i]) > 1e-6}, float(w[-1]))


def train_fold(doc_id: str = "doc_id") -> Column:
    return fold(doc_id, 5) != 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", in_fold: Column | None = None, per_class: int = PER_CLASS, groups: list[list[str]] = IDENTITY, swap: float = 1.0) -> Model:
    """A model from the labelled sample. Features are counted and chosen on the executors; the driver gets, by document, which of them it has."""
    sample = labelled_sample(docs, labels, label, train_fold() if in_fold is None else in_fold, per_class).select("doc_id", "text", "label")
    sample = written(map_arrow(sample, "doc_id long, label int, words string", _distinct_words), "sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    terms = sorted({w for g in groups for w in g})
    names: list[str] = []
    if sizes.get(0) and sizes.get(1):
        counts = map_arrow(sample, "part string, k0 long, k1 long", _counted).groupBy("part").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
        present = {r["part"] for r in counts.where(F.col("part").isin(terms)).select("part").collect()}
        names = list(dict.fromkeys([*select(counts, sizes[0], sizes[1]), *sorted(present)]))
    at = {f: i for i, f in enumerate(names)}

    def places(own: set[str]) -> list[int]:
        return sorted({at[p] for w in own for p in parts(w) if p in at})

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        held, twins = [], []
        for doc, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = set(own.split())
            held.append(places(own))
            twins.append([places(other) for step in (1, 2 + doc % 5) if (other := swapped(own, groups, step)) is not None])
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, ints), pa.array(twins, pa.list_(ints))], ["doc_id", "label", "own", "twins"])

    got = sorted(map_arrow(sample, "doc_id long, label int, own array<int>, twins array<array<int>>", rows).collect(), key=lambda r: (r["doc_id"], r["own"]))
    held, y, pairs = [r["own"] for r in got], np.array([r["label"] for r in got], "f8"), [(r["own"], t) for r in got for t in r["twins"]]
    return fit(names, held, y, pairs, swap=swap, **chosen(names, held, y, pairs, swap))


def _distinct_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([" ".join(sorted(words(t))) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "label", "words"])


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for label, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        counts[label].update({p for w in own.split() for p in parts(w)})
    names = sorted(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][w] for w in names], pa.int64()), pa.array([counts[1][w] for w in names], pa.int64())], ["part", "k0", "k1"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column `score`, the probability of label 1 (a column of that name is replaced). Null texts are scored as empty ones."""
    docs = docs.drop("score")
    at = docs.columns.index("text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.score(t) for t in batch.column(at).to_pylist()], pa.float64())], [*batch.schema.names, "score"])

    return map_arrow(docs, f"{ddl}, score double", rows)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted. Repeated and null doc_ids keep their rows (a null id is in the fold of the empty text)."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return out.select("doc_id", (~train_fold()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
