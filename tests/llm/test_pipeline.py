"""The pipeline on the smallest tables, stage by stage and as a whole."""

from collections import Counter

from quillveil.runtime import table


def test_stages(spark, sf):
    import corpus_pipeline as p

    docs = table(spark, sf, "documents")
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "mixing", "packing"]
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        if name != "mixing":
            assert 0.8 * before <= docs.count() <= before
            before = docs.count()
            assert max(Counter(r.doc_id for r in docs.select("doc_id").collect()).values()) == 1
    packed = p.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)
    words = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in packed.select("doc_id").collect()} == words


def test_stages_of_an_empty_table(spark, sf):
    import corpus_pipeline as p

    docs = table(spark, sf, "documents").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, sf).count() == 0
