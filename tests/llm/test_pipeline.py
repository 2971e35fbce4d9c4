import corpus_pipeline
from hushframe.llm import queries
from hushframe.llm.shared import staged

SF = "/root/testdata/sf0.001"


def test_stages_narrow_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mix_sources"]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "t")
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids and left
        assert docs.columns == columns or name == "mix_sources"
        ids = set(left)
    assert docs.where("copies NOT IN (1, 2)").count() == 0


def test_queries_are_complete():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")] == list(range(1, 14))
    assert "pipeline" in queries.QUERIES and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
