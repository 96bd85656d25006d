"""Write semantics on tables without keys: idempotent loads, upserts, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def new_records(incoming: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose key isn't held yet, one of each: loading a batch again adds nothing."""
    return incoming.join(held.select(*keys), keys, "left_anti").dropDuplicates(keys)


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row of each key: the greatest by the columns ``order``."""
    by = W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_at", F.row_number().over(by)).where("_at = 1").drop("_at")


def upsert(held: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Incoming rows replace held ones of the same key; of the columns ``keep`` a null doesn't replace a value."""
    values = [c for c in held.columns if c not in keys]
    old = held.select(*keys, F.struct(*values).alias("_old"))
    new = incoming.select(*keys, F.struct(*values).alias("_new"))
    both = old.join(new, keys, "full_outer")
    pick = lambda c: F.coalesce(f"_new.{c}", f"_old.{c}") if c in keep else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in held.columns])


def fan_out(rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, value): the named values of each row as rows, blank ones left out."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), value.cast("string").alias("value")) for name, value in fields.items()])
    return rows.select(key, F.explode(parts).alias("o")).select(key, "o.field", "o.value").where(F.trim("value") != "")


def first_writer(rows: DataFrame, unique: list[str], seq: str) -> DataFrame:
    """Of rows that claim one unique value the first one stays."""
    by = W.partitionBy(*unique).orderBy(seq)
    return rows.withColumn("_at", F.row_number().over(by)).where("_at = 1").drop("_at")


def ordered_pairs(pairs: DataFrame, a: str, b: str, held: DataFrame | None = None) -> DataFrame:
    """Distinct pairs with the smaller end first, without those already held."""
    out = pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a) != F.col(b)).distinct()
    return out.join(held.select(a, b), [a, b], "left_anti") if held is not None else out


def snapshot(rows: DataFrame, key: str) -> DataFrame:
    """(key, snapshot): each row as JSON, for undoing a merge."""
    return rows.select(key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("snapshot"))


def missing_days(loaded: DataFrame, first: str, last: str, day: str = "day") -> DataFrame:
    """(day): weekdays of a range that aren't loaded yet."""
    spark = loaded.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    return days.where(F.weekday(day) < 5).join(loaded.select(F.col(day).cast("date").alias(day)), day, "left_anti")
