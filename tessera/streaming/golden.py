"""Golden rows kept up to date batch by batch.

A store is a folder of Parquet tables. Every batch writes a subfolder of its own
in each, named by the batch's id and overwritten if the batch comes again:

* ``records``: (source, content_hash), the records a batch has brought;
* ``evidence``: their observations, in parts by a hash of the entity;
* ``moved``: records that a split has given to another entity;
* ``golden``: rows of the entities that the batch has touched.

A batch reads the evidence of the entities it touches and writes their rows; of
an entity the row of the last batch holds. Evidence lies in parts by a hash of
its entity, so a small batch opens few of them. A record that another batch has
brought, by source and content, adds nothing, and a batch that is delivered twice
writes the same folders again: the store doesn't change.

Nulls and edge cases: records without an entity are left out. An empty batch
writes empty folders. Repeated rows of a batch count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import evidence, matching, upkeep
from tessera.operators.writes import content_hash
from tessera.storage import stored

#: Parts of the evidence by a hash of the entity.
PARTS = 64

OBSERVATION = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("source_group", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("official", T.BooleanType()),
        T.StructField("original", T.StringType()),
    ]
)
MOVED = T.StructType([T.StructField(n, T.StringType()) for n in ("record_id", "entity", "new_entity")])
NAMES = [f.name for f in OBSERVATION.fields]


class GoldenStore:
    """Evidence and golden rows in the folder ``path``; ``fields`` are the columns of a golden row."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], parts: int = PARTS):
        self.spark, self.path, self.fields, self.parts = spark, path.rstrip("/"), fields, parts
        golden = [T.StructField(f, T.StringType()) for f in ("entity", *fields)]
        self.golden_schema = T.StructType([*golden, T.StructField("n_fields", T.LongType()), T.StructField("gone", T.BooleanType())])

    # tables

    def _table(self, name: str, schema: T.StructType, *folders: str) -> DataFrame:
        """A table of all batches with the columns ``folders`` from its paths; empty before the first batch."""
        place = f"{self.path}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        whole = schema
        for f in folders:
            whole = T.StructType([*whole.fields, T.StructField(f, T.IntegerType() if f == "part" else T.LongType())])
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", place).parquet(place)

    def _write(self, rows: DataFrame, name: str, batch: int, *by: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}/batch={batch}")

    def _part(self, entity: str) -> Column:
        return F.pmod(F.xxhash64(entity), F.lit(self.parts)).cast("int")

    def moved(self) -> DataFrame:
        """(record_id, new_entity): the last split of each record."""
        rows = self._table("moved", MOVED, "batch")
        return rows.groupBy("record_id").agg(F.max_by("new_entity", "batch").alias("new_entity"))

    def evidence(self, touched: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """All observations, each of the entity it belongs to now; those of the entities ``touched`` and of batches under ``before`` only, if given."""
        rows = self._held(before)
        if touched is not None:
            rows = rows.where(F.col("part").isin(self._parts_of(touched)))
        rows = rows.join(self.moved(), "record_id", "left").where("new_entity is null").drop("new_entity")
        split = self._moved_evidence(before)
        every = rows.select(*NAMES).unionByName(split.select(*NAMES))
        return every.join(touched, "entity", "left_semi") if touched is not None else every

    def _held(self, before: int | None = None) -> DataFrame:
        rows = self._table("evidence", OBSERVATION, "batch", "part")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _moved_evidence(self, before: int | None = None) -> DataFrame:
        """Observations of split records under their new entity, read from the parts of the entities they were split from."""
        splits = self._table("moved", MOVED, "batch")
        if not splits.take(1):
            return self.spark.createDataFrame([], OBSERVATION)
        held = self._held(before).where(F.col("part").isin(self._parts_of(splits.select("entity"))))
        return held.drop("entity").join(self.moved(), "record_id").withColumnRenamed("new_entity", "entity")

    def _parts_of(self, entities: DataFrame) -> list[int]:
        """The parts that the entities' evidence lies in; at most ``parts`` numbers."""
        return sorted(r["p"] for r in entities.select(self._part("entity").alias("p")).distinct().collect())

    def golden(self) -> DataFrame:
        """(entity, a column for each field, n_fields): the last row of every entity that has evidence."""
        rows = self._table("golden", self.golden_schema, "batch")
        held = F.struct(*self.fields, "n_fields", "gone")
        last = rows.groupBy("entity").agg(F.max_by(held, "batch").alias("r")).select("entity", "r.*")
        return last.where("not gone").drop("gone")

    def recomputed(self, as_of: Column) -> DataFrame:
        """What ``golden`` has to be: the rows of all entities from all evidence."""
        return upkeep.golden_rows(evidence.consolidate(self.evidence(), as_of), self.fields)

    # batches

    def add(self, batch: int, observations: DataFrame, as_of: Column) -> None:
        """Take in a batch of observations: record_id, source, entity, field, value, and those of ``evidence``.

        A record's content is all its observations; a record of a source with the
        content of one that another batch has brought is left out.
        """
        rows = observations.where("entity is not null")
        own = [c for c in NAMES if c not in ("content_hash", "record_id", "source")]
        rows = rows.withColumn("line", content_hash(*own))
        content = rows.groupBy("record_id", "source").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("line")), ","), 256).alias("content_hash"))
        known = self._table("records", T.StructType([T.StructField("source", T.StringType()), T.StructField("content_hash", T.StringType())]), "batch")
        fresh = content.join(known.where(F.col("batch") != batch).select("source", "content_hash"), ["source", "content_hash"], "left_anti")
        fresh = fresh.groupBy("source", "content_hash").agg(F.min("record_id").alias("record_id"))  # of copies in a batch the first
        rows = stored(rows.join(fresh, ["record_id", "source"]).select(*NAMES).distinct(), "fresh")
        self._write(rows.withColumn("part", self._part("entity")), "evidence", batch, "part")
        self._write(rows.select("source", "content_hash").distinct(), "records", batch)
        self._refresh(batch, rows.select("entity").distinct(), as_of)

    def decide(self, batch: int, choices: DataFrame, as_of: Column) -> None:
        """A person's choices (entity, field, value, observed_at) as observations of a record of their own."""
        rows = matching.human_decisions(choices)
        self.add(batch, rows.withColumn("record_id", F.concat_ws(":", F.lit("human"), "entity", "field", "value")).withColumn("source", F.lit("human")), as_of)

    def split(self, batch: int, records: DataFrame, as_of: Column) -> None:
        """Give records (record_id, new_entity) that were joined wrongly to another entity."""
        held = self._table("evidence", OBSERVATION, "batch", "part").select("record_id", F.col("entity").alias("first"))
        found = held.join(records, "record_id").join(self.moved().withColumnRenamed("new_entity", "now"), "record_id", "left")
        found = stored(found.select("record_id", F.col("first").alias("entity"), "new_entity", F.coalesce("now", "first").alias("now")).distinct(), "split")
        self._write(found.select(*MOVED.fieldNames()), "moved", batch)
        touched = found.select(F.col("now").alias("entity")).union(found.select("new_entity")).distinct()
        self._refresh(batch, touched, as_of)

    def _refresh(self, batch: int, touched: DataFrame, as_of: Column) -> None:
        """Rows of the touched entities from all their evidence; an entity without any is gone."""
        touched = stored(touched, "touched")
        rows = upkeep.golden_rows(evidence.consolidate(self.evidence(touched), as_of), self.fields)
        rows = touched.join(rows, "entity", "left").withColumn("gone", F.col("n_fields").isNull())
        self._write(rows.select(*self.golden_schema.fieldNames()), "golden", batch)

    def follow(self, source: DataFrame, checkpoint: str, as_of: Column) -> StreamingQuery:
        """Take in what a stream of observations has now, batch by batch."""
        return (
            source.writeStream.foreachBatch(lambda rows, batch: self.add(batch, rows, as_of))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
