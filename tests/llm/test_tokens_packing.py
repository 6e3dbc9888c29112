"""Token files and packing against whole-text encoding and brute force."""

import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weir.llm import packing, queries, token_files, tokens
from weir.llm.shared import scratch

BYTES, WORDS = (tokens.default_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", None, " ", "  a", "a  b", "a \n b", "a  b  \n", "it's 'tis\t x", "é ́x", "ΑΣ ΟΔΟΣ.", "<|endoftext|> <|startoftext|>", "hello <|endoftext|> world", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext", "tail <|endoftext|>\n", "a" * 5000, "퟿ 😀 1 23", "x " * 3000, "\n\n a", "a   b"]



def pair(path):
    plain = Tokenizer.from_file(path)
    return plain, tokens.Encoder(tokens.read_spec(path))


PAIRS = {p: pair(p) for p in (BYTES, WORDS)}


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'sTé́ \n\t 1!,漢", max_size=30), max_size=5))
def test_words_looked_up_give_the_same_ids(path, texts):
    plain, quick = PAIRS[path]
    got = quick.encode([*texts, *ODD])
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in [*texts, *ODD]]
    assert got == want


def test_names_of_added_tokens_in_texts_are_those_tokens():
    for path, (plain, quick) in PAIRS.items():
        ids = np.frombuffer(quick.encode(["hello <|endoftext|> world"])[0], "<u4").tolist()
        assert plain.token_to_id("<|endoftext|>") in ids and ids == Tokenizer.from_file(path).encode("hello <|endoftext|> world", add_special_tokens=False).ids


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    e = tokens.Encoder(tokens.read_spec(BYTES))
    fresh = tokens.Encoder(tokens.read_spec(BYTES))
    for text in ("a b c d e f g", "h a b c", "q w e r t y u i", "a b c d"):
        assert e.encode([text]) == fresh.encode([text])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20), st.integers(40, 64))
def test_plan_places_every_rank_once(counts, capacity):
    bins, seen = {}, Counter()
    for length, rank, n, first, each, offset in packing.plan(counts, capacity):
        for r in range(n):
            bins.setdefault(first + r // each, []).append((offset + r % each * length, length))
            seen[length, rank + r] += 1
    assert seen == Counter({(k, r): 1 for k, n in counts.items() for r in range(n)})
    for parts in bins.values():
        at = 0
        for begin, length in sorted(parts):
            assert begin == at
            at += length
        assert at <= capacity
    # best-fit decreasing, one item after another
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((fit or capacity) - length)
    assert len(bins) == len(rooms)


def test_plan_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, offset string, _len int")


def test_packing_whole(spark, tmp_path):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, "again", None, None), (None, "no id", "", 0)] + [(100 + i, "same text", "", 0) for i in range(400)]
    out = packing.pack(packing.token_pieces(docs_of(spark, rows), WORDS, 64), 64).collect()
    plain = Tokenizer.from_file(WORDS)
    want = Counter()
    for d, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for begin, n in sorted(parts):
            assert begin == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in out) // 64) + 1


def test_packing_nothing(spark):
    out = packing.pack(packing.token_pieces(docs_of(spark, []), WORDS, 64), 64)
    assert out.count() == 0 and out.columns[-2:] == ["sequence_id", "offset"]


def test_token_files_round_trip(spark):
    rows = [(i * 7 % 40, t, "x", 1) for i, t in enumerate(ODD)] + [(5, "b", "", 0), (5, "a", "", 0), (None, "no id", "", 0)] * 2
    folder = scratch(spark, "t")
    token_files.write(docs_of(spark, rows).repartition(3), folder, BYTES)
    plain = Tokenizer.from_file(BYTES)
    out = token_files.read(spark, folder).orderBy("start").collect()
    at, files = 0, token_files.TokenFiles(folder)
    assert len(files) == len(rows) == len(out)
    left = Counter((d, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0])) for d, t, *_ in rows)
    for i, r in enumerate(out):
        d, ids = files[i]
        assert (r.doc_id, r.start, r.n_tokens) == (d, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        left[d, tuple(ids.tolist())] -= 1
        at += len(ids)
    assert not +left and not -left
    order = [r.doc_id if r.doc_id is not None else -1 for r in out]
    assert order == sorted(order)


def test_token_files_of_nothing(spark):
    folder = scratch(spark, "t")
    assert token_files.write(docs_of(spark, []), folder, BYTES) == []
    assert token_files.read(spark, folder).count() == 0


def test_queries_match_whole_text_encoding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for path, got in ((BYTES, {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op10_token_files(spark, sf).collect()}),):
        plain = Tokenizer.from_file(path)
        for d in docs:
            ids = np.array([*plain.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
            assert got[d.doc_id] == (len(ids), zlib.crc32(ids.tobytes()))
    packed = queries.op8_best_fit_packing(spark, sf).collect()
    tokens_all = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= 1.02 * tokens_all / 2048 + 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_before_marks_are_encoded_once(name):
    """A known word with marks after it isn't tokenised again; at the beginning of a text or line its ids are others."""
    spec = tokens.read_spec(tokens.default_path(name))
    own = tokens.Encoder(spec)
    seen, model = [], own.model

    class Counted:
        def tokenize(self, word):
            seen.append(word)
            return model.tokenize(word)

    own.model = Counted()
    texts = ["an otherwise unseenword here", "an unseenword, unseenword. unseenword; unseenword!?", "unseenword, it\nunseenword, caf\u00e9 caf\u00e9!"]
    got = [b"".join(own.encode([t])) for t in texts]
    assert got == [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sum(w.lstrip("\u0120") == "unseenword" and (w != "unseenword" or own.kind != "spaced") for w in seen) == 1


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_remembered_words_are_bounded_in_bytes(path, monkeypatch):
    """Long words count by their size, and long beginnings of texts and long runs of marks aren't kept; ids stay the same."""
    bound = 200_000
    monkeypatch.setattr(tokens, "MEMORY_BYTES", bound, raising=False)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(tokens.read_spec(path))
    most, fits = 0, []
    for n in range(40):
        word = "".join(chr(97 + (n * 7 + k * k) % 26) for k in range(4000))
        texts = [f"{word}first{n} short{n} b{word}{n} c{word}, end{'.' * (200 + n)}", f"{word}second{n}"]
        got = own.encode(texts)
        if n % 8 == 0:
            assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        most = max(most, sum(sys.getsizeof(x) for d in (own.words, own.older, own.firsts, own.marks) for pair in d.items() for x in pair))
        fits.append(len(own.words))
    assert most < 2 * bound + 200_000  # two generations, and a batch of texts
    assert max(fits) > 4  # and yet words are remembered


def test_reading_back_starts_no_workers_for_rows(spark, tmp_path):
    """The list of shards comes from Arrow, not from a Python RDD, whose workers would stay beside the encoding ones."""
    folder = scratch(spark, "t")
    token_files.write(docs_of(spark, [(i, f"text {i}", "", 0) for i in range(20)]), folder, BYTES)
    out = token_files.read(spark, folder)
    assert "PythonRDD" not in out._jdf.queryExecution().toRdd().toDebugString()
    assert sorted(r.doc_id for r in out.collect()) == list(range(20))
