"""Exact tokenisation with the tokenizers library, with a bounded memory of words already seen.

A text is cut where the tokenizer always cuts as well, at spaces and line ends, and each distinct word is encoded
once. New words of plain letters, and marks after them, go to the library's BPE model directly; whatever is
not plain goes through the whole tokenizer. A tokenizer of another kind is called on whole texts.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Words remembered by a Python worker: two generations of this many, and of this many bytes as Python holds them, at most.
MEMORY, MEMORY_BYTES = 800_000, 72 << 20
#: A dictionary's own bytes for a word, with what is lost to rounding.
_ENTRY = 64
#: Longer beginnings of texts, and longer runs of marks, aren't remembered.
SHORT = 64
#: Three white-space characters together, or two at the end: the only runs that are not cut into single ones.
_RUN = re.compile(r"\s\s(?:\s|\Z)")
_PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """The byte-level spelling of the letters beyond ASCII in _PLAIN."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    spelling = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(spelling[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_SPELLING = _byte_letters()


def kind_of(spec: dict) -> str:
    """'spaced' (a space belongs to the word after it), 'spaceless' (white space is dropped) or 'whole'."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if any(t.get("normalized") for t in spec.get("added_tokens") or []):  # these are sought in the normalised text
        return "whole"
    if spec.get("post_processor") not in (None, {}) and spec["post_processor"].get("type") != "ByteLevel":
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "spaced"
    steps = pre.get("pretokenizers", [])
    norms = [n.get("type") for n in norm.get("normalizers", [])]
    if norms == ["NFC", "Replace", "Lowercase"] and steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        pattern = steps[0].get("pattern", {}).get("Regex", "")
        if pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
            return "spaceless"
    return "whole"


assert sys.byteorder == "little" and array("I").itemsize == 4


class Encoder:
    """Texts to the ids that encode(text, add_special_tokens=False) gives, as little-endian uint32 bytes.

    The library finds its added tokens (`<|endoftext|>` and the like) inside texts too, across spaces if they hold any,
    and then may take white space beside them: texts in which one of their names occurs are encoded whole.
    """

    def __init__(self, spec: str, memory: int = MEMORY) -> None:
        self.memory = memory
        self.tokenizer = Tokenizer.from_str(spec)
        names = [t["content"] for t in json.loads(spec).get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, names))).search if names else lambda text: None
        self.kind = kind_of(json.loads(spec))
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of `words`
        self.marks: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.line = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str], lead: str) -> dict[str, bytes]:
        """The ids of words that have not been seen, each with `lead` before it (or the line end it begins with)."""
        out, rest = {}, []
        spaced, tokenize, plain, marks = self.kind == "spaced", self.model.tokenize, _PLAIN.fullmatch, self.marks
        for w in words:
            core = w.rstrip(_MARKS)
            tail = w[len(core) :]
            line = core[:1] == "\n"
            if line:
                core = core[1:]
            if len(marks) > 10_000:
                marks.clear()
            if not plain(core) or line and not spaced:
                rest.append(w)
                continue
            known = self.words.get(core) or self.older.get(core) or out.get(core) if tail and not line and (lead or not spaced) else None
            spelt = "" if known else core if core.isascii() else core.translate(_SPELLING) if spaced else core.lower().translate(_SPELLING)
            spelt = (spelt if line or not lead else "\u0120" + spelt) if spaced else spelt.lower() if core.isascii() else spelt
            ids = known or array("I", [t.id for t in tokenize(spelt)]).tobytes()
            if tail:
                end = marks.get(tail) or self._encode([tail])[0]
                if len(tail) <= SHORT:
                    marks[tail] = end
                ids += end
            out[w] = self.line + ids if line else ids
        if rest:
            out.update(zip(rest, self._encode([w if w[:1] == "\n" else lead + w for w in rest]), strict=True))
        return out

    def _learn(self, missing: list[str], lead: str) -> None:
        if len(self.words) > self.memory or self.held > MEMORY_BYTES:
            self.older, self.words, self.held = self.words, {}, 0
        new, got = [], {}
        for w in dict.fromkeys(missing):
            ids = self.older.get(w)
            if ids is None:
                new.append(w)
            else:
                got[w] = ids
        got.update(self._new(new, lead))
        self.words.update(got)
        self.held += len(got) * _ENTRY + sum(map(sys.getsizeof, got)) + sum(map(sys.getsizeof, got.values()))

    def _first(self, word: str) -> bytes:
        """The ids of a word that begins a text."""
        ids = self.firsts.get(word)
        if ids is None:
            if len(self.firsts) > 50_000:
                self.firsts.clear()
            ids = self._new([word], "")[word]
            if len(word) <= SHORT:
                self.firsts[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if self.kind == "whole":
            return self._encode(texts)
        out: list[bytes] = [b""] * len(texts)
        spaced = self.kind == "spaced"
        whole = [i for i, t in enumerate(texts) if self.added(t) or spaced and _RUN.search(t)]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        left = set(whole)
        if spaced:
            split = [(i, t.replace("\n", " \n").split(" ")) for i, t in enumerate(texts) if i not in left]
            lead = " "
        else:
            split = [(i, t.replace("\n", " ").split(" ")) for i, t in enumerate(texts) if i not in left]
            lead = ""
        get = self.words.get
        known = [list(map(get, parts)) for _, parts in split]
        gaps = [[k for k, ids in enumerate(row) if ids is None] for row in known]
        missing = [split[r][1][k] for r, row in enumerate(gaps) for k in row]
        if missing:
            self._learn(missing, lead)
            new = self.words
            for r, row in enumerate(gaps):
                parts, ids = split[r][1], known[r]
                for k in row:
                    ids[k] = new[parts[k]]
        for k, (i, parts) in enumerate(split):
            if lead:  # nothing stands before the first
                known[k][0] = self._first(parts[0])
            out[i] = b"".join(known[k])
        return out


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder(spec: str, memory: int = MEMORY) -> Encoder:
    """The Python worker's encoder for this tokenizer file's content."""
    key = hash(spec), memory
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, memory)
    return _ENCODERS[key]


def read_spec(path: str) -> str:
    """The tokenizer file, read on the driver and sent along with the tasks (a file of a few MB)."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64_000_000:
        raise ValueError(f"{path} is not a tokenizer file: {len(spec)} characters")
    return spec


def vocabulary_size(spec: str) -> int:
    ids = [int(x) for x in json.loads(spec)["model"]["vocab"].values()] + [int(t["id"]) for t in json.loads(spec).get("added_tokens", [])]
    return max(ids) + 1


def default_path(name: str) -> str:
    import public_tokenizers

    if not re.fullmatch(r"[\w.]+", name):
        raise ValueError(name)
    return public_tokenizers.path(name)
