"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, nearcopies, simhash, toxicity
from tessera.llm._common import free_name, new_path, stored
from tessera.operators.graph import components

#: Runs that the last stage's memo holds a generation: executors that have run four stages before have less room.
MEMO_RUNS = 30_000
#: Least posterior of a language that keeps a document.
LEAST_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted severity grade is 0."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = free_name(docs, "_toxicity")
    return toxicity.scored(docs, model, out=out).where(~F.col(f"{out}.toxic")).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the predicted one."""
    out = free_name(docs, "_language")
    found = langid.predicted(docs, langid.fit(docs), out=out)
    found = found.where((F.col(f"{out}.lang_pred") != langid.UNKNOWN) & (F.col(f"{out}.score") >= LEAST_SCORE))
    return found.select(*[F.col(f"{out}.lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id.

    Texts are linked by SimHash fingerprints at 4 bits, and by a 5-word Jaccard similarity of 0.8 or more,
    whose fingerprints may differ in more; classes are those of both together.
    """
    near = stored(nearcopies.near_copies(docs), "near-copies")
    links = near.unionByName(simhash.near_duplicates(docs).select("doc_id", "component_id"))
    roots = stored(components(links, "doc_id", "component_id").withColumnRenamed("node", "doc_id"), "classes")
    classes = near.select("doc_id").join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
    return simhash.first_rows(docs, classes, "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256): ids of each text, and what they decode to."""
    kept = ["doc_id", *[c for c in ("lang", "source") if c in docs.columns]]
    found = bpe.round_trip(docs.select(*kept, "text"), public_tokenizers.path("word_bpe_49k.json"), limit=MEMO_RUNS)
    return found.select(*kept, "bpe.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL has neither the trained models nor the transducer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
