"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import align, bpe, chat, decontam, fim, langid, pii, quality, rollup, simhash, tokenfile, toxicity, vptree
from tessera.llm._common import fold, new_path, stored

END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select("doc_id", "text"), model).select("doc_id", "toxicity.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of every passage of a document that matches a benchmark item."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return langid.predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "language.*")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "bpe.*")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, lang, version, n_docs, n_tokens) after inserts, revisions, deletes and a batch delivered again.

    Version w1 counts words between white space. w2 counts letters' runs, and is
    first inserted with w1's counts, then revised. Empty documents are deleted.
    """
    text = F.coalesce("text", F.lit(""))
    counted = table(spark, sf_dir, "documents").select(
        "source", "lang", F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).alias("w1"), F.regexp_count(text, F.lit("[A-Za-z]+")).alias("w2")
    )
    counted = stored(counted, "counts")
    one = rollup.image(F.col("source"), F.col("lang"), F.lit("w1"), F.col("w1"))
    early = rollup.image(F.col("source"), F.col("lang"), F.lit("w2"), F.col("w1"))
    two = rollup.image(F.col("source"), F.col("lang"), F.lit("w2"), F.col("w2"))
    kept = rollup.Rollup(spark, new_path(spark, "rollup"))
    kept.commit("insert-w1", counted.select(*rollup.inserted(one)))
    kept.commit("insert-w2", counted.select(*rollup.inserted(early)))
    kept.commit("revise-w2", counted.select(*rollup.revised(early, two)))
    kept.commit("revise-w2", counted.select(*rollup.revised(early, two)))
    kept.commit("delete-empty", counted.where("w1 = 0").select(*rollup.deleted(one)))
    return kept.totals()


OP6_SQL = r"""
WITH c AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS w1,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS w2
  FROM documents)
SELECT source, lang, 'w1' AS version, count(*) AS n_docs, CAST(sum(w1) AS BIGINT) AS n_tokens
FROM c WHERE w1 > 0 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'w2', count(*), CAST(sum(w2) AS BIGINT) FROM c GROUP BY source, lang
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold("doc_id", 3) != 1))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scored = quality.scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 20 nearest of every 20th vector."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the examples."""
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(own)
    made = chat.examples(rows)
    turns = F.concat_ws("", F.transform(chat.turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    read = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),  # the last example holds every turn
        F.sort_array(F.collect_list(F.struct("example", chat.trainable(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text")))).alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    loss = F.concat_ws("", F.transform("loss", lambda x: x["text"]))
    return read.select(
        "conv_id",
        F.size(chat.turns_of(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         6 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c'))
         + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) + 8 AS chars
  FROM rows),
c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS prefix, max(i) OVER (PARTITION BY conv_id) AS n FROM w)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the token file."""
    out = new_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), END_ID, vocabulary=50_257)
    return tokenfile.read(spark, out).withColumnRenamed("key", "doc_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), *files)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return align.weighed(aligned.select(*[c for c in aligned.columns if c != "groups"], digest)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    made = fim.examples(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = made.select("doc_id", "fim.*")
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


OP12_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT *, len(lines) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(lines) + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(lines) + 1) AS c2,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS spm,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain
  FROM l),
p AS (
  SELECT *, array_to_string(lines[1:least(c1, c2)], '') AS prefix,
         array_to_string(lines[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(lines[greatest(c1, c2) + 1:], '') AS suffix
  FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars,
       CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif("terms", F.lit(""))).alias("spans"))


def queries() -> dict:
    import corpus_pipeline

    found = [op1_toxicity, op2_simhash, op3_decontamination, op4_language_id, op5_bpe, op6_token_counts, op7_quality, op8_nearest, op9_chat, op10_token_file, op11_alignment, op12_fill_in_middle, op13_pii]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op6_token_counts": OP6_SQL, "op9_chat": OP9_SQL, "op12_fill_in_middle": OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
