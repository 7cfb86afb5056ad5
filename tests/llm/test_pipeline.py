import corpus_pipeline as cp
from deltaweave.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(10**6, "12 34 !!", "en", "src0", 8), (10**6 + 1, None, None, "src0", 0)], docs.schema)
    docs = docs.unionByName(extra)
    ids = []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name == "personal_data":
            assert docs.where("text rlike '[a-z]@[a-z-]+[.]'").count() == 0
    assert not ids[0] & {10**6, 10**6 + 1} and len(ids[0]) >= 195  # clean documents stay
    assert ids[1] < ids[0] and ids[2] == ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0 and cp.ORACLE_SQL is None
