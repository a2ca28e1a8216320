"""The pipeline's stages over edge cases and against its operators."""

import corpus_pipeline
from wardframe.llm.common import written

from . import cases


def test_stages(spark, small):
    docs = cases.documents(spark)
    names = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, small), "t")
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        assert docs.count()
    docs = cases.empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), "t")
        assert docs.count() == 0


def test_passages_go_once(spark, small):
    passage = cases.prose(99, 60)
    texts = [(i, cases.prose(i, 100) + "\n" + passage + "\n" + cases.prose(50 + i, 100))
             for i in range(5)]
    stage = dict(corpus_pipeline.STAGES)["repeated passages"]
    got = {r.doc_id: r for r in stage(spark, cases.documents(spark, texts), small).collect()}
    assert got[0].text == texts[0][1]
    for i in range(1, 5):
        assert passage not in got[i].text and cases.prose(i, 100)[:-8] in got[i].text
        assert got[i].n_chars == len(got[i].text)


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and sum(r.start == 0 for r in rows) == len({r.doc_id for r in rows})
