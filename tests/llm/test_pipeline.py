"""The pipeline stage by stage, and its result as a whole."""

from collections import Counter

import corpus_pipeline
from netsift.llm import mixing, order_minhash
from netsift.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == docs.columns, name
        before, now = (Counter(r.doc_id for r in x.select("doc_id").collect()) for x in (at, after))
        assert set(now) <= set(before), name
        if name == "near_duplicates":
            shingles = {r.doc_id: order_minhash.labelled_shingles(r.text) for r in after.collect()}
            ids = sorted(shingles)
            assert not any(
                order_minhash.aligned_similarity(shingles[a], shingles[b]) >= 0.8 for k, a in enumerate(ids) for b in ids[k + 1 :]
            )
        if name == "mix":
            plan = {r.doc_id: r.taken / r.size for r in mixing.mixed(at).collect()}
            assert now == Counter({i: int(x + 0.5) for i, x in plan.items() if int(x + 0.5)})
        at = spark.createDataFrame(after.collect(), docs.schema)
    made = Counter((r.doc_id, r.decoded_same) for r in corpus_pipeline.run(spark, SF).collect())
    assert made == Counter((r.doc_id, True) for r in at.collect())


def test_odd_and_empty_tables(spark):
    from tests.llm.test_operators import DOCS, ODD

    for data in ([], ODD):
        docs = spark.createDataFrame(data, DOCS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).select(docs.columns).collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
