"""Merges of companies: chains, child tables, tombstones, pairs, and undoing.

A merge is a row (loser, winner, seq) with a reason, a score, who decided it, and
the pair that it settles, if any; merges apply in the order of ``seq``. A winner
may lose to another company later: everything ends with the last winner. The
rows of a child table follow their company. Where a table may hold one row of a key for a company,
the row that stood there first stays and the other is left with the loser: the
winner's own row comes first, then those of the losers in the order of their
merges, at the company where they first meet.

All tables of a commit are written under one version; a version counts once its
manifest stands, so readers see all tables of a merge or none.

Nulls and edge cases: merges with a null end, of a company with itself or of companies that don't exist are
refused, as are a loser that loses twice and a circle. Rows without a company stay as they are;
a row with a null in its key collides with none. Of rows of one company that hold one key already,
all move or none. Tables may be empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import stored

#: Child tables and the columns of which a company may hold each value once; none where rows always move.
CHILDREN: dict[str, list[str]] = {
    "sites": [], "identifiers": [], "observations": [],
    "channels": ["kind", "value"], "roles": ["person_id", "role"], "results": ["search_id"],
}
COMPANY, ORIGIN = "company_id", "merged_from"


def checked(merges: DataFrame, companies: DataFrame) -> None:
    """Raise ValueError where merges can't be applied; one aggregated row comes to the driver."""
    known = companies.select(F.col(COMPANY).alias("id"))
    ends = merges.select(F.explode(F.array("loser", "winner")).alias("id"))
    bad = merges.agg(
        F.count_if(F.col("loser").isNull() | F.col("winner").isNull() | F.col("seq").isNull()).alias("nulls"),
        F.count_if(F.col("loser") == F.col("winner")).alias("selves"),
        (F.count("loser") - F.count_distinct("loser")).alias("twice"),
    ).first()
    unknown = ends.where("id is not null").join(known, "id", "left_anti").limit(1).count()
    said = {"a merge without loser, winner or seq": bad["nulls"], "a company merged with itself": bad["selves"], "a company that loses twice": bad["twice"], "a company that doesn't exist": unknown}
    found = [name for name, n in said.items() if n]
    if found:
        raise ValueError("merges can't be applied: " + ", ".join(found))


def resolved(merges: DataFrame) -> DataFrame:
    """(loser, root, path): the last winner of each loser, and the seqs of the merges from there back to the loser.

    Pointer jumping: every round a loser takes over the pointer of the winner it
    points to, so a chain of n merges needs about log2(n) rounds. A circle never ends in a winner and is refused.
    """
    at = stored(merges.select("loser", F.col("winner").alias("root"), F.array("seq").alias("path")), "merge-pointers")
    n = at.count()
    while True:
        onward = at.select(F.col("loser").alias("root"), F.col("root").alias("next"), F.col("path").alias("before"))
        whole = F.when(F.col("next").isNotNull(), F.concat("before", "path")).otherwise(F.col("path"))
        moved = at.join(onward, "root", "left").select("loser", F.coalesce("next", "root").alias("root"), whole.alias("path"), F.col("next").isNotNull().alias("moved"))
        moved = stored(moved, "merge-pointers")
        left = moved.agg(F.count_if("moved").alias("moved"), F.max(F.size("path")).alias("longest")).first()
        if (left["longest"] or 0) > n:  # more merges than there are
            raise ValueError("merges can't be applied: a circle")
        at = moved.drop("moved")
        if not left["moved"]:
            return at


def moved_child(table: DataFrame, roots: DataFrame, unique: list[str]) -> DataFrame:
    """A child table after the merges, with the column ``merged_from``: where a moved row stood before.

    ``roots`` is what ``resolved`` gives. Only rows of companies that take part are looked at for collisions.
    """
    out = table.join(roots.select(F.col("loser").alias(COMPANY), "root"), COMPANY, "left")
    to = F.coalesce("root", COMPANY)
    if unique:
        out = out.join(_stops(table, roots, unique), [COMPANY, *unique], "left")
        to = F.coalesce("_stop", "root", COMPANY)
    moved = to != F.col(COMPANY)
    return out.select(*[to.alias(c) if c == COMPANY else F.col(c) for c in table.columns], F.when(moved, F.col(COMPANY)).alias(ORIGIN))


def _stops(table: DataFrame, roots: DataFrame, unique: list[str]) -> DataFrame:
    """(company_id, key, _stop): how far a key that several companies of one root hold gets.

    A path names every company between a root and a loser by a beginning of it. Of the
    holders below a company the one of the least path reaches it: its own row before
    all others, then that of the earlier merge. So a row ends at the highest company
    for which it is the least below; only contested keys are spread over their paths.
    """
    no_path = F.array().cast("array<bigint>")
    keys = table.select(COMPANY, *unique).distinct().join(roots.withColumnRenamed("loser", COMPANY), COMPANY, "left")
    keys = keys.select(COMPANY, *unique, F.coalesce("root", COMPANY).alias("_to"), F.coalesce(F.col("path").cast("array<bigint>"), no_path).alias("_path"))
    contested = keys.groupBy("_to", *unique).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    held = keys.join(contested, ["_to", *unique])
    above = F.transform(F.sequence(F.lit(0), F.size("_path")), lambda n: F.slice("_path", F.lit(1), n))
    spread = held.withColumn("_above", F.explode(above))
    least = spread.groupBy("_to", *unique, "_above").agg(F.min("_path").alias("_least"))
    reached = spread.join(least, ["_to", *unique, "_above"]).where(F.col("_path") == F.col("_least"))
    highest = reached.groupBy(COMPANY, *unique, "_to").agg(F.min_by("_above", F.size("_above")).alias("_above"))
    places = roots.select(F.col("root").alias("_to"), F.col("path").cast("array<bigint>").alias("_above"), F.col("loser").alias("_place"))
    found = highest.join(places, ["_to", "_above"], "left")
    return found.select(COMPANY, *unique, F.coalesce("_place", "_to").alias("_stop"))


def merged_tables(tables: dict[str, DataFrame], merges: DataFrame, children: dict[str, list[str]] = CHILDREN) -> dict[str, DataFrame]:
    """All tables after the merges: companies with ``merged_into``, the children, pairs, and the log ``merges``.

    ``tables``: companies (company_id, merged_into, ...), the child tables, pairs (a,
    b, state, decided_by) and merges made before, each if there. A loser keeps its row as a tombstone that
    names its direct winner; the log holds that row as JSON. The pairs of a loser and its winner are confirmed, and
    open ones whose ends have become one company are closed as settled.
    """
    companies = tables["companies"]
    merges = stored(merges, "merge-orders")
    checked(merges, companies)
    roots = stored(resolved(merges), "merge-roots")
    out = {name: moved_child(tables[name], roots, unique) for name, unique in children.items() if name in tables}
    direct = merges.select(F.col("loser").alias(COMPANY), F.col("winner").alias("_winner"))
    dead = companies.join(direct, COMPANY, "left")
    out["companies"] = dead.select(*[F.coalesce("_winner", c).alias(c) if c == "merged_into" else F.col(c) for c in companies.columns])
    shot = companies.select(F.col(COMPANY).alias("loser"), F.to_json(F.struct(*companies.columns), {"ignoreNullFields": "false"}).alias("snapshot"))
    log = merges.join(shot, "loser")
    out["merges"] = tables["merges"].unionByName(log, allowMissingColumns=True) if "merges" in tables else log
    if "pairs" in tables:
        out["pairs"] = _closed(tables["pairs"], merges, roots)
    return out


def _closed(pairs: DataFrame, merges: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs after the merges; those that somebody has decided stay as they are."""
    decided = merges.select(F.least("loser", "winner").alias("_lo"), F.greatest("loser", "winner").alias("_hi"), F.col("decided_by").alias("_by"))
    found = pairs.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")}).join(decided, ["_lo", "_hi"], "left")
    for end in ("a", "b"):
        found = found.join(roots.select(F.col("loser").alias(end), F.col("root").alias(f"_{end}")), end, "left")
    one = F.coalesce("_a", "a") == F.coalesce("_b", "b")
    state = F.when(F.col("state") != "pending", F.col("state")).when(F.col("_by").isNotNull(), "confirmed").when(one, "settled").otherwise(F.col("state"))
    by = F.when(F.col("state") == "pending", F.coalesce("_by", "decided_by")).otherwise(F.col("decided_by"))
    values = {"state": state, "decided_by": by}
    return found.select(*[values.get(c, F.col(c)).alias(c) for c in pairs.columns])


def undone(tables: dict[str, DataFrame], children: dict[str, list[str]] = CHILDREN) -> dict[str, DataFrame]:
    """The children and companies as they were before the last ``merged_tables``: rows go back, tombstones live again from the log's snapshots.

    What has been written since stays; pairs and the log are history and aren't touched.
    """
    merges = tables["merges"]
    out = {}
    for name in children:
        if name in tables:
            table = tables[name]
            out[name] = table.select(*[F.coalesce(ORIGIN, c).alias(c) if c == COMPANY else F.col(c) for c in table.columns if c != ORIGIN])
    companies = tables["companies"]
    before = merges.select(F.col("loser").alias(COMPANY), F.from_json("snapshot", companies.schema).alias("_was"))
    whole = companies.join(before, COMPANY, "left")
    out["companies"] = whole.select(*[F.when(F.col("_was").isNotNull(), F.col(f"_was.{c}")).otherwise(F.col(c)).alias(c) for c in companies.columns])
    return out


# Versions


class Versions:
    """Tables that change together: a folder for each version, of which the last one with a manifest counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def numbers(self) -> list[int]:
        """The committed versions, ascending."""
        fs, place = self._fs(f"{self.path}/manifests")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(place)) if fs.exists(place) else []

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables, then the manifest in one rename; a writer that comes second fails and leaves the version as it is."""
        number = max(self.numbers(), default=0) + 1
        place = f"{self.path}/v{number}-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{place}/{name}")
        fs, draft = self._fs(f"{place}/manifest")
        with_names = fs.create(draft)
        with_names.write(bytearray("\n".join([place, *tables]).encode()))
        with_names.close()
        _, made = self._fs(f"{self.path}/manifests/{number}")
        fs.mkdirs(made.getParent())
        if not fs.rename(draft, made):
            raise RuntimeError(f"version {number} was committed by another writer")
        return number

    def read(self, number: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the last one if none is asked for."""
        number = number or self.numbers()[-1]
        place, *names = [r["value"] for r in self.spark.read.text(f"{self.path}/manifests/{number}").collect()]
        return {name: self.spark.read.parquet(f"{place}/{name}") for name in names}

