"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's license lines, wherever in the text, and the passages around them are compared with license templates
as sparse TF-IDF vectors; the document frequencies are those of the templates, so a file's score never depends on what
else is scanned. A file that says nothing itself takes what the licence files of the nearest directory above say: every
file lists its ancestor directories, they are joined with the directories that have a licence, and the deepest wins.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.license_texts import TEMPLATES
from weir.llm.shared import map_arrow, written

#: Stands beside open licenses too, so it counts only where no other template reaches the threshold.
WEAK = "All rights reserved."
#: Passages grow line by line (blank ones left out) until they have this many words; longer ones are runs of twice as many, four times, and so on.
NEAR, THRESHOLD = 48, 0.6
#: Bytes of directories (two paths and a name each) that may be broadcast.
SMALL = 32_000_000
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")
_TRIGGER = re.compile(r"licen[cs]|copyright|permission|redistribut|rights{_}reserved|spdx|public{_}domain|released{_}under|free{_}software".replace("{_}", r"[\s#*/;-]+"), re.I)
_SENTENCE = re.compile(r"(?<=[.;:])\s+")
_LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice|unlicense)([-._][^/]*)?$"


def terms(text: str) -> Counter:
    """Words and pairs of neighbours."""
    own = _WORD.findall(text.lower())
    return Counter([*own, *map(" ".join, zip(own, own[1:], strict=False))])


class Templates:
    """Unit TF-IDF vectors of the templates, as an inverted index from term to (template, weight)."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        listed = [(name, terms(t)) for name, some in sorted(templates.items()) for t in some]
        seen = Counter(w for _, counts in listed for w in counts)
        self.idf = {w: math.log((1 + len(listed)) / (1 + n)) + 1 for w, n in seen.items()}
        self.unknown = math.log(1 + len(listed)) + 1
        self.names = [name for name, _ in listed]
        self.weak = {k for k, (_, counts) in enumerate(listed) if counts == terms(WEAK)}
        self.index: dict[str, list[tuple[int, float]]] = {}
        for k, (_, counts) in enumerate(listed):
            size = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in counts.items()))
            for w, n in counts.items():
                self.index.setdefault(w, []).append((k, n * self.idf[w] / size))

    def best(self, text: str, weak: bool = True) -> tuple[float, str | None]:
        """The highest cosine, and its license; of equals the first name. The weak template can be left out."""
        counts = terms(text)
        size = math.sqrt(sum((n * self.idf.get(w, self.unknown)) ** 2 for w, n in counts.items()))
        scores: Counter = Counter()
        for w, n in counts.items():
            for k, weight in self.index.get(w, ()):
                if weak or k not in self.weak:
                    scores[k] += n * self.idf[w] * weight
        if not scores:
            return 0.0, None
        k = min(scores, key=lambda k: (-round(scores[k], 12), self.names[k], k))
        return scores[k] / size, self.names[k]

    def scan(self, text: str | None, threshold: float = THRESHOLD) -> tuple[float, str | None]:
        """The best over all passages, without the weak template where another reaches the threshold."""
        best = self._scan(text)
        if best[1] is not None and any(self.names[k] == best[1] for k in self.weak):
            other = self._scan(text, False)
            return other if other[0] >= threshold else best
        return best

    def _scan(self, text: str | None, weak: bool = True) -> tuple[float, str | None]:
        """The best over the passages of the whole text."""
        best: tuple[float, str | None] = (0.0, None)
        for passage in passages(text or ""):
            found = self.best(passage, weak)
            if found[0] > best[0] + 1e-12:
                best = found
        return best


def _pieces(sentence: str) -> list[str]:
    """The sentence; one of over NEAR words in pieces of 8 words, the first words of triggers beginning new ones."""
    words = sentence.split()
    if len(words) <= NEAR:
        return [sentence] if words else []
    at = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    starts = {bisect.bisect_right(at, m.start()) - 1 for m in _TRIGGER.finditer(" ".join(words))}
    cuts, out = sorted(starts | {0, len(words)}), []
    for a, b in itertools.pairwise(cuts):
        out += [" ".join(words[k : min(k + 8, b)]) for k in range(a, b, 8)]
    return out


def passages(text: str) -> dict[str, None]:
    """Lines that hold a trigger word, their sentences, passages around a trigger, and the whole text if it has one.

    Passages run from a line or sentence that begins up to NEAR words before the trigger to the end of a line or sentence,
    over as many lines as it takes, until they have NEAR words. A trigger may itself be broken over lines. From the line of
    each trigger on there are also passages of 2 NEAR words, 4 NEAR and so on; of the triggers of one line, and of
    lines within half such a passage, one is enough. So texts are compared as far as they go, in time N log N.
    """
    out: dict[str, None] = {}
    if not _TRIGGER.search(text):
        return out
    lines = [line for line in text.split("\n") if line.strip()]
    units, line_of, begins = [], [], []
    for i, line in enumerate(lines):
        begins.append(len(units))
        for part in _SENTENCE.split(line):
            for piece in _pieces(part):
                units.append(piece)
                line_of.append(i)
    begins.append(len(units))
    sizes = [len(u.split()) for u in units]
    starts = list(itertools.accumulate((len(u) + 1 for u in units), initial=0))
    ahead = list(itertools.accumulate(sizes, initial=0))
    done, taken = set(), {}
    for m in _TRIGGER.finditer("\n".join(units)):
        s, e = bisect.bisect_right(starts, m.start()) - 1, bisect.bisect_right(starts, m.end() - 1) - 1
        if (s, e) in done:
            continue
        done.add((s, e))
        first, last = line_of[s], line_of[e]
        for i in range(first, last + 1):
            out |= dict.fromkeys([lines[i], *units[begins[i] : begins[i + 1]]])
        around, j = lines[first], first + 1
        while j < len(lines) and len(around.split()) < NEAR:
            around += "\n" + lines[j]
            out[around] = None
            j += 1
        a, before = s, 0
        while a >= 0 and before <= NEAR:
            b, words = e, sum(sizes[a : e + 1])
            while True:
                out["\n".join(units[a : b + 1])] = None
                b += 1
                if b >= len(units) or words >= NEAR:
                    break
                words += sizes[b]
            a -= 1
            before += sizes[a] if a >= 0 else 0
        begin, size = begins[first], 2 * NEAR
        while size < 2 * (ahead[-1] - ahead[begin]):
            if ahead[begin] - taken.get(size, -size) >= size // 2:
                taken[size] = ahead[begin]
                out["\n".join(units[begin : bisect.bisect_left(ahead, ahead[begin] + size)])] = None
            size *= 2
    out["\n".join(units)] = None
    return out


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, path: str = "path", text: str = "text") -> DataFrame:
    """files with own_license, own_score, license, inherited_from.

    own_license is what the file says (null under the threshold); license is that, or what the nearest
    directory above says, whose name is then in inherited_from (the file's own directory comes first, the
    root is ''). A directory says what its licence files (LICENSE, COPYING, NOTICE and the like) say: with several, the
    highest score, then the first name. A null path inherits nothing; a null text says nothing. Rows are
    kept as they are, repeated ones too; columns named like those added are replaced.
    """
    templates = Templates(templates or TEMPLATES)
    added = ["own_license", "own_score", "license", "inherited_from"]
    files = files.drop(*added, "_up", "_dir", "_depth", "_said", "_dirs")
    at = files.columns.index(text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [templates.scan(t, threshold) for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([name if s >= threshold else None for s, name in found], pa.string()), pa.array([s for s, _ in found], pa.float64())], [*batch.schema.names, "own_license", "own_score"])

    scanned = f"{ddl}, own_license string, own_score double"
    own = map_arrow(files, scanned, rows)
    directory = F.regexp_replace(F.col(path), "/?[^/]*$", "")
    said = map_arrow(files.where(F.col(path).rlike(_LICENCE_FILE)), scanned, rows).where(F.col("own_license").isNotNull())
    said = said.groupBy(directory.alias("_dir")).agg(F.min_by("own_license", F.struct(-F.col("own_score"), "own_license")).alias("_said"))
    parts = F.split(directory, "/")
    depth = F.when(directory == "", 0).otherwise(F.size(parts))
    ancestors = F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    # one row a directory, not a file: few however many files a directory holds
    dirs = files.where(F.col(path).isNotNull()).select(directory.alias("_up"), ancestors.alias("_dirs")).distinct()
    dirs = dirs.select("_up", F.posexplode("_dirs").alias("_depth", "_dir")).join(said, "_dir").groupBy("_up").agg(F.max_by(F.struct("_dir", "_said"), "_depth").alias("_near"))
    dirs = written(dirs, "directories")
    size = F.sum(64 + F.length("_up") + F.length("_near._dir") + F.length("_near._said"))  # 64 for what a row costs
    if dirs.agg(F.coalesce(size, F.lit(0)).alias("n")).first()["n"] <= SMALL:
        dirs = F.broadcast(dirs)
    joined = own.withColumn("_up", directory).join(dirs, "_up", "left")
    inherits = F.col("own_license").isNull()
    return joined.select(*files.columns, "own_license", "own_score", F.coalesce("own_license", "_near._said").alias("license"), F.when(inherits, F.col("_near._dir")).alias("inherited_from"))
