"""The corpus pipeline, stage by stage, against what each stage's operator decides."""

from __future__ import annotations

import pytest
from conftest_data import HOSTILE
from pyspark.sql import functions as F

import corpus_pipeline
from returnlens.llm import line_dedup, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and what each stage makes of its predecessor's."""
    folder = tmp_path_factory.mktemp("stages")
    found = [spark.read.parquet(f"{SF}/documents.parquet")]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], SF).write.parquet(f"{folder}/{number}")
        found.append(spark.read.parquet(f"{folder}/{number}"))
    return found


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_columns_and_lengths(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)
        assert after.filter("n_chars != length(text)").count() == 0
    assert [s.count() for s in stages[:5]] == sorted((s.count() for s in stages[:5]), reverse=True)


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    expected = toxicity.classified(stages[0], model).filter("predicted = 0").select(*stages[0].columns)
    assert rows(stages[1]) == rows(expected)


def test_low_quality_goes(stages):
    judged = quality.quality(stages[1]).filter("kept")
    assert rows(stages[2].select("doc_id", "text")) == rows(judged.select("doc_id", "clean_text"))


def test_repeated_lines_go(stages):
    kept = {(r.doc_id, r.line_no) for r in line_dedup.line_classes(stages[2]).filter("kept").collect()}
    expected = []
    for r in stages[2].collect():
        lines = [line for i, line in enumerate(r.text.split("\n")) if (r.doc_id, i) in kept]
        if "\n".join(lines).strip(quality.SPACES):
            expected.append((r.doc_id, "\n".join(lines)))
    assert rows(stages[3].select("doc_id", "text")) == sorted(expected, key=str)


def test_one_document_of_each_group_stays(stages):
    groups = simhash.simhash_groups(stages[3])
    assert rows(stages[4].select("doc_id")) == rows(groups.select("component_id").distinct())


def test_all_kept_documents_are_packed(stages):
    packed = stages[5]
    assert rows(packed.select("doc_id").distinct()) == rows(stages[4].select("doc_id"))
    end = F.max(F.col("offset") + F.col("length"))
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), end.alias("end"))
    assert fill.filter("n != end or n > 4096").count() == 0


def test_hostile_documents_pass_every_stage(spark):
    extra = [(*row, "en", "s", 0, "x", "x", "x") for row in HOSTILE]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, score string"
    docs = spark.createDataFrame(extra, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns, name
        found.collect()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(found.select(*columns)) == rows(stages[-1].select(*columns))
