import os

import pytest

import corpus_pipeline
from tickloom.llm import common, decontaminate, exact_dedup, quality, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_each_stage_takes_effect_on_what_its_predecessor_kept(spark):
    docs = common.table(spark, SF, "documents")
    labels, bench = common.table(spark, SF, "labels"), common.table(spark, SF, "benchmark")
    columns = docs.columns

    def ids(df):
        return sorted(r["doc_id"] for r in df.select("doc_id").collect())

    want = {
        "quality": lambda d: quality.scores(d, labels).where("predicted = 1"),
        "exact_dedup": lambda d: exact_dedup.exact_groups(d).where("kept"),
        "near_dedup": lambda d: simhash.near_groups(d).where("doc_id = component_id"),
        "decontamination": lambda d: decontaminate.contamination(d, bench).where("not contaminated"),
        "mixing": lambda d: d,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, SF), f"test-{name}")
        assert ids(out) == ids(want[name](docs))
        if name != "mixing":
            assert out.columns == columns
        docs = out
    assert 0 < docs.count() < 200
    assert corpus_pipeline.ORACLE_SQL is None
