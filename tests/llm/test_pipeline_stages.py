"""Each stage of the pipeline on odd rows and on an empty table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents, and rows without a text, with an empty, a very long and a repeated one, and without an id."""
    held = spark.read.parquet(f"{SF}/documents.parquet")
    first = held.where("text is not null and lang is not null").orderBy("doc_id").limit(1)
    long = "the quick brown fox jumps over the lazy dog and runs away " * 5000
    odd = first.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(t).alias("text")) for i, t in ((900_001, None), (900_002, ""), (900_003, long), (900_004, long), (None, long))])).alias("x"), *[c for c in held.columns if c not in ("doc_id", "text")])
    return held.unionByName(odd.select("x.*", *[c for c in held.columns if c not in ("doc_id", "text")]).select(*held.columns)).cache()


@pytest.mark.parametrize(("name", "stay"), [("toxicity", {900_001, 900_002, 900_003, 900_004}), ("language", {900_003, 900_004}), ("near_duplicates", {900_001, 900_003}), ("decontamination", {900_001, 900_002, 900_003, 900_004})])
def test_stage_keeps_columns_and_clean_odd_rows(spark, docs, name, stay):
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.where("doc_id > 900000").select("doc_id").collect()} == stay
    assert out.where("doc_id is null").count() == 1


def test_last_stage_has_a_row_for_each_document(spark, docs):
    out = STAGES["bpe"](spark, docs, SF)
    assert out.count() == docs.count()
    assert out.where("doc_id in (900001, 900002) and n_tokens <> 0").count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_of_an_empty_table(spark, docs, name):
    assert STAGES[name](spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize(("name", "column"), [("toxicity", "_toxicity"), ("language", "_language"), ("near_duplicates", "_row"), ("decontamination", "m")])
def test_stage_keeps_a_column_named_like_its_own(spark, docs, name, column):
    some = docs.where("doc_id < 60 or doc_id > 900000").withColumn(column, F.concat(F.lit("mine "), F.col("doc_id").cast("string")))
    out = STAGES[name](spark, some, SF)
    assert out.columns == some.columns and out.schema == some.schema
    assert out.where(F.col(column) != F.concat(F.lit("mine "), F.col("doc_id").cast("string"))).count() == 0


def test_last_stage_without_source_and_language(spark, docs):
    assert STAGES["bpe"](spark, docs.select("doc_id", "text").limit(3), SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_rows_that_go_whatever_the_filter_keeps_by_chance(spark, monkeypatch, bits):
    """Repeated ids with different texts, null ids and copies, with a filter that nearly all rows pass."""
    from tessera.llm import _common, simhash

    monkeypatch.setattr(simhash, "id_filter", lambda ids, key: _common.id_filter(ids, key, bits))
    rows = [(i, f"text {i}", {"k": i}) for i in range(300)] + [(7, "a first", {"k": 1}), (7, "a first", {"k": 1}), (8, "z", None), (None, "x", None), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").repartition(4)
    classes = docs.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 3).alias("component_id"))
    kept = simhash.first_rows(docs, classes, "doc_id")
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect())
    assert found == [(i, f"text {i}") for i in range(0, 300, 3)]
    assert kept.where("doc_id is null").count() == 2
    twice = simhash.first_rows(docs, docs.select("doc_id", F.col("doc_id").alias("component_id")), "doc_id")
    assert {r["text"] for r in twice.where("doc_id in (7, 8)").collect()} == {"a first", "text 8"}
    assert twice.count() == 302


def test_near_duplicates_are_classes_of_simhash_and_of_shingles(spark, docs, monkeypatch):
    """A text that only fingerprints link goes, and a chain of links of both kinds is one class."""
    from tessera.llm import nearcopies, simhash

    held = {r["doc_id"] for r in docs.where("doc_id is not null").select("doc_id").collect()}
    one, two, three = sorted(held)[:3]
    said = lambda **links: lambda rows: rows.where("doc_id is not null").select("doc_id", F.lit(0).cast("long").alias("fp"), F.when(F.col("doc_id") == links["of"], links["to"]).otherwise(F.col("doc_id")).alias("component_id"))
    monkeypatch.setattr(simhash, "near_duplicates", said(of=two, to=one))
    monkeypatch.setattr(nearcopies, "near_copies", lambda rows: said(of=three, to=two)(rows).drop("fp"))
    kept = {r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, SF).where("doc_id is not null").select("doc_id").collect()}
    assert kept == held - {two, three}
