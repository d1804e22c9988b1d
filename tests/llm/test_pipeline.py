"""The pipeline on small documents: every stage's decisions take effect."""

import pytest

import corpus_pipeline
from tilespan.llm import mixing, packing, quality, simhash
from tilespan.llm.common import materialise

from .cases import documents, frame, row


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    extra = [row(6000 + k, f"number {k} of prose with an address jo{k}@mail.example.com and some more words here to be kept whole") for k in range(10)]
    frame(spark, documents() + extra).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 9 > 0), 0) for k in range(0, 300, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packing"]
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, folder), name)
        kept[name] = before, docs
        if name != "packing":
            assert docs.columns == names and docs.schema == before.schema
    before, after = kept["quality_rules"]
    assert after.count() == quality.assess(before, labels).where("kept").count() < before.count()
    before, after = kept["near_duplicates"]
    assert after.count() == simhash.classes(before).select("component_id").distinct().count() < before.count()
    assert simhash.classes(after).select("component_id").distinct().count() == after.count()
    before, after = kept["personal_data"]
    assert after.count() == before.count() and after.where("text like '%@%'").count() == 0 < after.where("text like '%[EMAIL]%'").count()
    before, after = kept["source_mix"]
    assert mixing.mix(before).selectExpr("sum(taken)").first()[0] == after.select(mixing.word_count(after.text).alias("n")).selectExpr("sum(n)").first()[0]
    before, after = kept["packing"]
    assert after.selectExpr("sum(length)").first()[0] == packing.pieces(before).selectExpr("sum(length)").first()[0]


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and got.columns[:3] == ["doc_id", "start", "length"]


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
