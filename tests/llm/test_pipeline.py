"""The pipeline against its stages by brute force, and its care for odd rows."""

from collections import defaultdict

import corpus_pipeline
import pytest
from tests.llm.test_jaccard import plain_components
from tests.llm.test_operators import plain_overlap
from weir.llm import quality, toxicity

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels), quality.train(docs, labels)


def by_hand(rows, items, toxic, good):
    kept = [r for r in rows if toxic.score(r[1]) < 0.5]
    kept = [r for r in kept if good.scores(quality.np.array([quality.statistics(r[1])]))[0] >= 0.7]
    label = plain_components(dict(kept))
    groups = defaultdict(list)
    for r in kept:
        groups[label[r[0]]].append(r)
    kept = [min(g) for g in groups.values()]
    hit = {d: h for d, _, h, _ in plain_overlap(kept, items)}
    return [r for r in kept if not hit[r[0]]]


def test_run(spark, models):
    out = corpus_pipeline.run(spark, D).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    want = by_hand(rows, items, *models)
    assert {r.doc_id for r in out} == {r[0] for r in want} and 0 < len(want) < len(rows)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 2048 for parts in bins.values())


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1.5, 7), (1, "", 2.5, 8), (1, "plain words in a row", 3.5, 9), (2, "plain words in a row", 4.5, 10), (None, "plain words in a row", 5.5, 11)], "doc_id long, text string, score double, _n int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = [r.score for r in out.collect()]
        assert set(got) <= {1.5, 2.5, 3.5, 4.5, 5.5} and len(got) == len(set(got))
        if name == "simhash_near_dedup":
            assert sorted(got) == [2.5, 3.5]
        if name == "benchmark_decontamination":
            assert len(got) == 5
        assert stage(spark, docs.where("false"), D).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, D).count() == 5 and last(spark, docs.where("false"), D).count() == 0
