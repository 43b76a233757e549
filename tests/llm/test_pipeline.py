"""Each stage of the pipeline against what the stage before kept."""

import pytest

pytest.importorskip("loamgraph.llm")
pytest.importorskip("corpus_pipeline")
import corpus_pipeline
from loamgraph.llm import packing, quality, toxicity
from loamgraph.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    at = []
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), "t")
        at.append((docs, out))
        docs = out
    names = [x.name for x in table(spark, sf, "documents").schema]
    assert all(out.columns == names for _, out in at[:-1])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, packed) = at
    assert ids(d1) == ids(toxicity.score(d0, toxicity.train(d0, labels)).where("score < 0.5"))
    assert ids(d2) == ids(quality.score(d1, quality.train(d1, labels)).where("score >= 0.3"))
    from test_near_and_packing import brute

    want = brute([(r.doc_id, r.text) for r in d2.select("doc_id", "text").collect()])
    assert ids(d3) == sorted(k for k, (_, c) in want.items() if k == c)
    assert set(ids(d4)) <= set(ids(d3)) and max(ids(d4).count(k) for k in set(ids(d4))) <= 2
    assert packed.select("length").groupBy().sum().first()[0] == packing.pieces(d4).groupBy().sum("length").first()[0]
