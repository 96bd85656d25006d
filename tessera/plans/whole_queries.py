"""Queries on texts of cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import resolution
from tessera.plans.queries import query
from tessera.plans.tables import derived, read
from tessera.storage import stored


def text_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card, nif, domain, phones, name) of all documents.

    Digests of the whole text play number (a third have none) and domain: with
    spaces made one, and letters and digits only. Phones are those of the orders
    of the customer with the card's key, the name is that of the part with it.
    """
    body = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    plain = text.norm_text(F.col("text"))
    cards = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("card"),
        F.when((body != "") & (F.col("doc_id") % 3 != 0), F.concat(F.lit("n"), F.md5(body))).alias("nif"),
        F.when(plain != "", F.concat(F.lit("d"), F.md5(plain))).alias("domain"),
    )
    phones = derived(spark, sf_dir, "channels").where("kind = 'phone'").groupBy(F.col("company_id").alias("card")).agg(F.collect_set("value").alias("phones"))
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("card"), text.norm_text(F.col("p_name")).alias("name"))
    return cards.join(phones, "card", "left").join(names, "card", "left")


@query()
def duplicate_groups_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of cards of one number or domain, or of one phone and similar names. Tests hold it against all pairs."""
    cards = stored(text_cards(spark, sf_dir), "cards")
    names = cards.where("name is not null").select("name").distinct()
    alike = resolution.similar_names(names, names, "name", "name", least=0.6).select(F.col("l_key").alias("a_name"), F.col("r_key").alias("b_name"))
    similar = stored(resolution.phone_stars(cards, alike), "phone-links")
    return resolution.duplicate_groups(resolution.duplicate_links(cards.drop("name"), similar))
