"""Raw records from arrival to golden rows, batch by batch.

A batch's records are compared with the companies that earlier batches have made:
their profiles come from the evidence. A record goes to its best candidate if it
is surely or perhaps the same company; a doubt is kept as an identity conflict, which
a split can settle. A record without a candidate makes a company, if it has a name or a
valid number; records of one batch that are surely the same make one. What it says
becomes evidence, and the golden rows of the companies it touches are written anew.

Only earlier batches count for a decision, so a batch that is delivered again is
decided as before and writes the same folders.

Nulls and edge cases: a record that can't make a company and has no candidate is
discarded. Repeated records of a batch count once. Blank values are no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import matching
from tessera.operators.graph import components
from tessera.operators.writes import fan_out
from tessera.storage import stored
from tessera.streaming.golden import GoldenStore

#: Fields of a record that are evidence, those that a company has several of, and a golden row's columns.
SINGLE = ["nif", "name", "trade_name", "form", "domain", "cp", "province", "place_id", "sheet", "place"]
SEVERAL = {"phones": "phone", "emails": "email"}
GOLDEN = ["nif", "name", "trade_name", "form", "domain"]
CONFLICT = T.StructType([T.StructField("entity", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("score", T.DoubleType())])


def profiles(evidence: DataFrame) -> DataFrame:
    """Companies as records to compare with: of each field the strongest, then latest, value, all phones and e-mails."""
    said = evidence.where("value is not null and value <> ''")
    order = F.struct(F.coalesce("confidence", F.lit(0.0)), "observed_at", "value")
    best = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, order)).alias(f)
    every = [F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(name) for name, f in SEVERAL.items()]
    rows = said.groupBy(F.col("entity").alias("company_id")).agg(*[best(f) for f in SINGLE], *every)
    at = F.split("place", ",")
    rows = rows.withColumns({"nif_valid": F.col("nif").isNotNull(), "lat": F.get(at, F.lit(0)).cast("double"), "lon": F.get(at, F.lit(1)).cast("double")})
    return matching.as_records(rows, "company_id")


class Processor:
    """Takes raw records in comparable form into a ``GoldenStore``.

    Records: record_id, source, source_group, confidence, observed_at, official, and the fields of ``matching.FIELDS``.
    """

    def __init__(self, store: GoldenStore):
        self.store = store

    def conflicts(self) -> DataFrame:
        """(entity, record_id, score): records that were joined in doubt and haven't been split off since."""
        held = self.store._table("identity", CONFLICT, "batch").drop("batch")
        return held.join(self.store.moved(), "record_id", "left_anti").select("entity", "record_id", "score")

    def decided(self, batch: int, records: DataFrame, shared: DataFrame | None = None) -> DataFrame:
        """(record_id, entity, score, action) of each record; action is link, review, create or discard."""
        companies = profiles(self.store.evidence(before=batch))
        own = matching.as_records(records.dropDuplicates(["record_id"]), "record_id")
        found = stored(matching.decisions(own, companies, shared), "decided")
        linked = found.where("action <> 'create'").select("record_id", F.col("company_id").alias("entity"), "score", F.when(F.col("action") == "link", "link").otherwise("review").alias("action"))
        rest = found.where("action = 'create'").select("record_id")
        told = F.coalesce(F.coalesce("name", F.lit("")) != "", F.lit(False)) | F.coalesce(F.coalesce("trade_name", F.lit("")) != "", F.lit(False)) | F.coalesce(F.col("nif_valid"), F.lit(False))
        new = own.join(rest, "record_id").withColumn("_told", told)
        lost = new.where("not _told").select("record_id", F.lit(None).cast("string").alias("entity"), F.lit(None).cast("double").alias("score"), F.lit("discard").alias("action"))
        fresh = stored(matching.as_records(new.where("_told").withColumnRenamed("record_id", "company_id"), "company_id"), "fresh-companies")
        same = matching.stored_duplicates(fresh, shared).where("decision = 'same'")
        rooted = fresh.select("company_id").join(components(same, "a", "b").withColumnRenamed("node", "company_id"), "company_id", "left")
        made = rooted.select(F.col("company_id").alias("record_id"), F.concat(F.lit("c:"), F.coalesce("root", "company_id")).alias("entity"), F.lit(None).cast("double").alias("score"), F.lit("create").alias("action"))
        return linked.unionByName(made).unionByName(lost)

    def add(self, batch: int, records: DataFrame, as_of: Column, shared: DataFrame | None = None) -> DataFrame:
        """Take in a batch and return ``decided``; a batch again changes nothing."""
        records = stored(records, "records")
        decided = stored(self.decided(batch, records, shared), "decisions")
        kept = records.join(decided.where("entity is not null").select("record_id", "entity"), "record_id")
        head = ["record_id", "source", "entity", "source_group", "confidence", "observed_at", "official"]
        place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")))
        kept = kept.withColumns({"place": place, "nif": F.when(F.coalesce("nif_valid", F.lit(False)), F.col("nif"))})
        values = fan_out(kept.withColumn("_head", F.struct(*head)), "_head", {f: F.col(f) for f in SINGLE}).select("_head.*", "field", "value")
        for name, field in SEVERAL.items():
            values = values.unionByName(kept.select(*head, F.lit(field).alias("field"), F.explode(name).alias("value")))
        self.store.add(batch, values.where("value is not null and value <> ''").withColumn("original", F.col("value")), as_of)
        doubts = decided.where("action = 'review'").select("entity", "record_id", F.col("score").cast("double").alias("score"))
        self.store._write(doubts, "identity", batch)
        return decided


def store_of(spark, path: str) -> GoldenStore:
    """A store with the columns of a company's golden row."""
    return GoldenStore(spark, path, GOLDEN)
