"""Near-duplicates of the pipeline's stage against brute force over five-word shingles."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from weir.llm import jaccard


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def plain_components(texts):
    """Smallest id of each class, by comparing all that share a shingle."""
    sets, label, holders = {d: plain_shingles(t) for d, t in texts.items()}, {d: d for d in texts}, defaultdict(list)

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for d in sorted(sets):
        for other in {o for s in sets[d] for o in holders[s]}:
            if 5 * len(sets[d] & sets[other]) >= 4 * len(sets[d] | sets[other]):
                a, b = sorted((root(d), root(other)))
                label[b] = a
        for s in sets[d]:
            holders[s].append(d)
    return {d: root(d) for d in texts}


def test_stage_drops_near_copies_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_components({r.doc_id: r.text for r in docs.collect()})
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert left == set(want.values())
    assert not {56, 467, 914} & left


@pytest.mark.parametrize("edits", [1, 3, 6])
def test_classes_of_edited_copies(spark, edits):
    """Copies of one text with a few words changed link in chains; texts of a common line don't."""
    rng = random.Random(edits)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for d in range(120):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(words)
    for d in range(120, 200):
        texts[d] = " ".join([f"y{rng.randrange(10**6)}" for _ in range(30)] + base[:12])
    texts |= {200: "", 201: None, 202: " \n", 203: "two words", 204: "Two  WORDS", 205: "two words more"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for rare in (1, 4, jaccard.RARE):
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, rare=rare).collect()} == plain_components(texts)
    assert jaccard.near_duplicates(df.where("false")).count() == 0


def test_classes_without_their_original(spark):
    """Two generations of copies, some edits in common: far from the original and from one another, near to a few."""
    rng = random.Random(5)
    base, texts = [f"w{k}" for k in range(120)], {}
    heads = [[w if rng.random() > 0.06 else f"h{rng.randrange(8)}" for w in base] for _ in range(25)]
    for d in range(150):
        words = list(heads[d % 25])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(words[: 120 - rng.randrange(30)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for rare in (3, jaccard.RARE):
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, rare=rare).collect()} == plain_components(texts)


def test_lists_are_not_broadcast(spark, monkeypatch):
    """Rows of an explode look few to Spark: lists of keys and of shingles came to the driver, which failed on large tables."""
    plans, write = {}, jaccard.written

    def spy(df, what):
        plans.setdefault(what, df._jdf.queryExecution().executedPlan().toString())
        return write(df, what)

    monkeypatch.setattr(jaccard, "written", spy)
    base = [f"w{k}" for k in range(100)]
    df = spark.createDataFrame([(d, " ".join([*base[: 40 + d], *(f"x{d}.{k}" for k in range(d % 7))])) for d in range(60)], "doc_id long, text string")
    jaccard.near_duplicates(df).collect()
    for what in ("lists", "few"):
        assert "SortMergeJoin [" + {"lists": "key", "few": "shingle"}[what] in plans[what]


def test_simhash_step_links_fingerprints(spark):
    """The stage's SimHash step joins all within two bits of one another, and those of one fingerprint."""
    rng = random.Random(9)
    fps = {d: rng.getrandbits(64) for d in range(40)}
    for d in range(40, 120):
        fps[d] = fps[rng.randrange(d)] ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4)))
    pairs = jaccard._meetings(spark.createDataFrame([(d, jaccard.signed(f)) for d, f in fps.items()], "node long, fp long"))
    label = {r.node: r.label for r in jaccard.classes(pairs).collect()}
    for a in fps:
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                assert label[a] == label[b]
    assert all((fps[r.u] ^ fps[r.v]).bit_count() <= 2 for r in pairs.collect())


def test_stage_runs_the_simhash_step(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard, "links", lambda fps, find=jaccard.links: seen.append(fps) or find(fps))
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40))), (2, "other words")], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, df, "").count() == 2 and seen[0].count() == 2
