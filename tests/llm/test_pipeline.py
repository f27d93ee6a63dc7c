import corpus_pipeline
from pagewright.llm import queries


def test_stages_keep_columns(spark, sf_dir, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = docs
    for _, stage in corpus_pipeline.STAGES:
        expected = stage(spark, expected, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(key).collect()))
    assert got == sorted(map(tuple, expected.select(key).collect())) and got


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
