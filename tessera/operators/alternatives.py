"""Alternatives of open conflicts that a company's own site decides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.operators.joins import spread

#: Fields that a text can decide, and patterns of a site that one automaton holds, about.
NUMBER, NAME = "nif", "razon_social"
BLOCK_PATTERNS = 2048


def _found(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The patterns of each row that stand in its text: one automaton, one pass over the text."""
    import ahocorasick

    for bodies, patterns in rows:
        out = []
        for body, wanted in zip(bodies.to_pylist(), patterns.to_pylist()):
            automaton = ahocorasick.Automaton()
            for pattern in wanted:
                automaton.add_word(pattern, pattern)
            automaton.make_automaton()
            out.append(sorted({p for _, p in automaton.iter(body)}))
        yield pa.array(out, pa.list_(pa.string()))


def only_alternatives(conflicts: DataFrame, texts: DataFrame, key: str = "conflict_id", site: str = "site") -> DataFrame:
    """(key, value): conflicts of which exactly one alternative stands in the site's text.

    ``conflicts``: (key, site, field, alternatives). A number is looked for in the
    text without spaces and hyphens, a name as whole words of the plain text. Patterns of a
    site are dealt into blocks of bounded size; each block is one pass over the
    text, whatever the number of patterns in it. Other fields, sites without a text and
    empty alternatives decide nothing; an alternative that is listed twice counts twice.
    """
    listed = spread(conflicts).select(key, site, "field", F.posexplode("alternatives").alias("i", "value")).where(F.col("field").isin(NUMBER, NAME))
    # a column of its own, so that a name is normalised once
    listed = listed.withColumn("_name", F.when(F.col("field") == NAME, text.norm_name(F.coalesce("value", F.lit("")))))
    pattern = F.when(F.col("field") == NUMBER, F.upper("value")).when(F.col("_name") != "", F.concat(F.lit(" "), F.col("_name"), F.lit(" ")))
    listed = listed.withColumn("pattern", pattern).drop("_name").where("pattern is not null and pattern <> ''")
    # blocks by the pattern's hash: at most 4096 of them, as many as the site's patterns need
    distinct = listed.select(site, "field", "pattern").distinct()
    sizes = distinct.groupBy(site, "field").agg(F.least(F.lit(4096), F.ceil(F.count(F.lit(1)) / BLOCK_PATTERNS)).alias("blocks"))
    dealt = distinct.join(sizes.hint("merge"), [site, "field"]).withColumn("block", F.pmod(F.xxhash64("pattern"), F.col("blocks")))
    blocks = dealt.groupBy(site, "field", "block").agg(F.collect_list("pattern").alias("patterns"))
    body = F.coalesce("text", F.lit(""))
    plain = spread(texts).select(site, F.translate(F.upper(body), "- ", "").alias("number"), F.concat(F.lit(" "), text.norm_text(body), F.lit(" ")).alias("name"))
    # merged: the texts of all sites never go through the driver
    rows = blocks.join(plain.hint("merge"), site).select(site, "field", F.when(F.col("field") == NUMBER, F.col("number")).otherwise(F.col("name")).alias("body"), "patterns")
    udf = F.arrow_udf(_found, T.ArrayType(T.StringType())).asNondeterministic()
    hits = rows.select(site, "field", udf(F.col("body"), F.col("patterns")).alias("found")).select(site, "field", F.explode("found").alias("pattern"))
    shown = listed.join(hits.hint("merge"), [site, "field", "pattern"]).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    return shown.where("n = 1").select(key, "value")
