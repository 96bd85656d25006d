"""Token counts as delta-maintained rollups.

A batch holds changes of documents' counts. Each change is a before and an after
image (source, language, tokenizer version, tokens): an insert has no before, a
delete no after, a revision both. A change adds its after image and takes its
before image away, so totals are sums of signed deltas and batches may be
committed in any order.

``Rollup.commit`` sums a batch's deltas by source, language and version and
writes them to the batch's own folder, whose success marker is the commit. A
batch id that has been committed is left alone, and one whose write was
interrupted is overwritten; so delivering a batch again changes nothing.

Nulls and edge cases: source, language or version may be null and form groups of
their own. A null count adds 0 tokens, and its document still counts. Repeated
rows in a batch are changes of their own. Groups whose documents and tokens have
all gone again leave the totals. An empty batch commits nothing but its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens"]


def image(source: Column, lang: Column, version: Column, tokens: Column) -> Column:
    return F.struct(source.alias("source"), lang.alias("lang"), version.alias("version"), tokens.cast("long").alias("tokens"))


def inserted(after: Column) -> list[Column]:
    return [F.lit(None).cast("struct<source:string,lang:string,version:string,tokens:bigint>").alias("before"), after.alias("after")]


def deleted(before: Column) -> list[Column]:
    return [before.alias("before"), F.lit(None).cast("struct<source:string,lang:string,version:string,tokens:bigint>").alias("after")]


def revised(before: Column, after: Column) -> list[Column]:
    return [before.alias("before"), after.alias("after")]


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch of (before, after) images by source, lang and version."""
    signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("i")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("i")))
    rows = changes.select(F.explode(signed).alias("d")).where("d.i is not null")
    parts = rows.select(
        *[F.col(f"d.i.{c}").alias(c) for c in DIMENSIONS],
        F.col("d.sign").cast("long").alias("n_docs"),
        (F.col("d.sign") * F.coalesce(F.col("d.i.tokens"), F.lit(0))).cast("long").alias("n_tokens"),
    )
    return parts.groupBy(*DIMENSIONS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    """Totals kept in a folder, one subfolder a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.path}/batch={batch}/_SUCCESS")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was there already."""
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        schema = "source string, lang string, version string, n_docs bigint, n_tokens bigint"
        if not self._exists(self.path):
            return self.spark.createDataFrame([], schema)
        # an unfinished batch has no success marker: name the committed ones
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        paths = [str(s.getPath()) for s in found if s.isDirectory()]
        paths = [p for p in paths if self._exists(f"{p}/_SUCCESS")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        sums = rows.groupBy(*DIMENSIONS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where("n_docs <> 0 or n_tokens <> 0")
