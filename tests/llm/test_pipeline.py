import corpus_pipeline as P

from lexloom.llm import jaccard, toxicity


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, before, sf)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(P.STAGES) - 1:
            assert out.columns == columns, name
        if name == "toxicity":
            index = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert out.count() == toxicity.score(before, index).where("predicted = 0").count()
        if name == "n-gram Jaccard join":
            assert out.count() == jaccard.near_duplicates(before).where("kept").count()
            assert jaccard.near_duplicates(out).where("n_links > 0").count() == 0
        if name == "substring dedup":
            assert out.count() == before.count()
        before = out
    assert before.count() > 0 and "sequence_id" in before.columns


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
