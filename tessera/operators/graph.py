"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, stored_at


def _large_stars(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the smallest of its neighbours and itself."""
    ends = links.select(F.col("low").alias("node"), F.col("high").alias("near")).union(links.select("high", "low"))
    least = ends.groupBy("node").agg(F.least("node", F.min("near")).alias("least"))
    moved = links.join(least.withColumnRenamed("node", "low"), "low")
    return moved.select(F.col("least").alias("low"), "high").distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, go to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low <> least").select(F.col("least").alias("low"), F.col("low").alias("high"))
    return moved.union(least.select("least", "high")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has a link, with the smallest node that links lead to.

    Alternating stars: each half round only moves ends of links to smaller nodes
    of the same component, so links never grow in number, a dense group shrinks
    to one star at once and a chain halves. Each round's links are a written
    table, which goes when the next one is; they are done when a round changes none. Null ends are left out.
    """
    ends = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}")
    spark = edges.sparkSession
    links, path = stored_at(ends.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
    before = mark(links)
    while True:
        older = path
        links, path = stored_at(_small_stars(_large_stars(links)), "links")
        discard(spark, older)
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).union(links.select("low", "low").distinct())
