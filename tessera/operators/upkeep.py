"""Upkeep of stored companies: sites, conflicts, sweeps over results, golden rows, export cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import export
from tessera.functions.text import norm_text
from tessera.operators.evidence import ENTITY

#: Verdicts that a sweep never changes.
SETTLED = ["descartado", "rechazado", "aceptado"]
RELEVANT_FROM, DOUBTFUL_FROM, DOUBTFUL_MOST = 0.8, 0.6, 3
#: A day without acts counts as loaded only when it is so old: later deliveries are rare.
SETTLED_DAYS = 7


def latest_sites(observed: DataFrame, values: list[str], seq: str = "seq") -> DataFrame:
    """(company_id, kind, values): one site of each kind; of each column the last value that is known."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in values]
    return observed.groupBy("company_id", "kind").agg(*last)


def address_changes(observed: DataFrame, seq: str = "seq") -> DataFrame:
    """(company_id, kind, seq, before, after): where a known address differs from the last known one."""
    by = W.partitionBy("company_id", "kind").orderBy(seq)
    known = observed.where("address is not null").withColumn("before", F.lag("address").over(by))
    return known.where("before <> address").select("company_id", "kind", seq, "before", F.col("address").alias("after"))


def with_place_codes(sites: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds ``code`` from a catalogue (name, province, code), by names without case, accents and signs; null if unknown."""
    keys = lambda name, province: [norm_text(F.col(name)).alias("_n"), norm_text(F.col(province)).alias("_p")]
    known = catalogue.select(*keys("name", "province"), "code").dropDuplicates(["_n", "_p"])
    return sites.select("*", *keys("municipality", "province")).join(known, ["_n", "_p"], "left").drop("_n", "_p")


def upsert_conflicts(held: DataFrame, found: DataFrame, decided: DataFrame, generic: str) -> DataFrame:
    """Open conflicts (entity, field, values, reason) after new findings.

    A conflict isn't opened again if the last decision on its field was about the
    same set of values. The generic reason never replaces a reason that is held.
    """
    last = decided.groupBy(*ENTITY).agg(F.max_by("values", "decided_at").alias("_values"))
    fresh = found.join(last, ENTITY, "left").where(F.coalesce(F.array_sort("values") != F.array_sort("_values"), F.lit(True)))
    fresh = fresh.select(*ENTITY, F.struct("values", "reason").alias("_new"))
    both = held.select(*ENTITY, F.struct("values", "reason").alias("_old")).join(fresh, ENTITY, "full_outer")
    keeps = (F.col("_new.reason") == generic) & F.col("_old.reason").isNotNull()
    reason = F.when(F.col("_new").isNull() | keeps, F.col("_old.reason")).otherwise(F.col("_new.reason"))
    values = F.when(F.col("_new").isNotNull(), F.col("_new.values")).otherwise(F.col("_old.values"))
    return both.select(*ENTITY, values.alias("values"), reason.alias("reason"))


def swept(results: DataFrame, reason: Column, unseen: str | None = None) -> DataFrame:
    """Results with a verdict 'descartado' and its reason where ``reason`` isn't null.

    What a person reviewed or what is settled stays. ``unseen`` is the verdict of
    results that have none and fail nothing.
    """
    free = ~F.coalesce("reviewed", F.lit(False)) & ~F.coalesce("verdict", F.lit("")).isin(*SETTLED)
    verdict = F.when(free & reason.isNotNull(), "descartado").otherwise(F.col("verdict"))
    if unseen:
        verdict = F.when(free & reason.isNull() & F.col("verdict").isNull(), unseen).otherwise(verdict)
    return results.withColumns({"reason": F.when(free, reason), "verdict": verdict})


def ranked_verdicts(scored: DataFrame, search: str = "search_id", candidate: str = "candidate_id") -> DataFrame:
    """(search, candidate, verdict): relevant by score, the best few doubtful ones, and the rest discarded."""
    doubtful = (F.col("score") >= DOUBTFUL_FROM) & (F.col("score") < RELEVANT_FROM)
    at = F.row_number().over(W.partitionBy(search, doubtful).orderBy(F.desc("score"), candidate))
    verdict = F.when(F.col("score") >= RELEVANT_FROM, "relevante").when(doubtful & (at <= DOUBTFUL_MOST), "dudoso").otherwise("descartado")
    return scored.select(search, candidate, verdict.alias("verdict"))


def groups_by(rows: DataFrame, attribute: str, distinct: str) -> DataFrame:
    """The rows whose ``attribute`` goes with more than one value of ``distinct``, and how many: people of several companies."""
    many = rows.where(F.col(attribute).isNotNull()).groupBy(attribute).agg(F.count_distinct(distinct).alias("n_distinct"))
    return rows.join(many.where("n_distinct > 1"), attribute)


def retired_channels(evidence: DataFrame, reread: DataFrame, web: str = "web") -> DataFrame:
    """(company_id, kind, value): channels that the company's web alone proved and that reading it again didn't show.

    Only where the new reading showed some channel of that kind.
    """
    key = ["company_id", "kind", "value"]
    only_web = evidence.groupBy(*key).agg(F.bool_and(F.col("source") == web).alias("_only")).where("_only").drop("_only")
    return only_web.join(reread.select(*key), key, "left_anti").join(reread.select("company_id", "kind"), ["company_id", "kind"], "left_semi")


def state_changes(held: DataFrame, found: DataFrame) -> DataFrame:
    """(company_id, before, after): companies for which new signals give another state."""
    new = found.where("state is not null").select("company_id", F.col("state").alias("after"))
    return held.select("company_id", F.col("state").alias("before")).join(new, "company_id").where(~F.col("before").eqNullSafe(F.col("after")))


def value_details(observations: DataFrame, most: int = 3) -> DataFrame:
    """(entity, field, value, sources, originals): sorted sources and the first ``most`` original texts of each value."""
    by = W.partitionBy(*ENTITY, "value").orderBy("observed_at", "original")
    first = observations.withColumn("_at", F.row_number().over(by))
    kept = F.when(F.col("_at") <= most, F.struct("_at", "original"))  # nulls are not collected
    return first.groupBy(*ENTITY, "value").agg(
        F.array_sort(F.collect_set("source_group")).alias("sources"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["original"]).alias("originals")
    )


def golden_rows(consolidated: DataFrame, fields: list[str]) -> DataFrame:
    """(entity, a column for each field, n_fields): the first value of every field of an entity in one row."""
    best = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return consolidated.where("rank = 1").groupBy("entity").agg(*best, F.count_if(F.col("field").isin(*fields)).alias("n_fields"))


def loaded_days(days: DataFrame, acts: DataFrame, as_of: Column) -> DataFrame:
    """(day, n): delivered days that count as loaded; an empty one only when it is old enough."""
    counts = acts.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    out = days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    return out.where((F.col("n") > 0) | (F.datediff(as_of, "day") >= SETTLED_DAYS))


def resolved_by_rule(pairs: DataFrame, sheets: DataFrame) -> DataFrame:
    """(a, b, action) of open duplicate pairs (a, b, rule): merge those of one registry sheet, reject numbered series."""
    plain = sheets.where("sheet is not null").select("company_id", F.upper("sheet").alias("sheet")).distinct()
    mine = pairs.select("a", "b").join(plain.withColumnRenamed("company_id", "a"), "a")
    same = mine.join(plain.withColumnRenamed("company_id", "b"), ["b", "sheet"]).select("a", "b").distinct().withColumn("_same", F.lit(True))
    action = F.when(F.col("_same"), "merge").when(F.col("rule") == "R7", "reject").otherwise("keep")
    return pairs.join(same, ["a", "b"], "left").select("a", "b", action.alias("action"))


def correspondence(sheet: DataFrame, old: str, new: str) -> DataFrame:
    """(from_version, source_code, target_code): distinct code pairs of a sheet in both directions."""
    pair = lambda version, a, b: sheet.select(F.lit(version).alias("from_version"), F.col(a).alias("source_code"), F.col(b).alias("target_code"))
    return pair("old", old, new).unionByName(pair("new", new, old)).where("source_code is not null and target_code is not null").distinct()


def export_cards(companies: DataFrame, channels: DataFrame) -> DataFrame:
    """One card a living company: names, number and web in the target's form, the best two phones and e-mails.

    Phone 1 is the first mobile, phone 2 the first other number or else the second
    mobile; personal addresses come before generic ones. A company's channels fit one row.
    """
    usable = channels.where("state is null or state <> 'invalid'")
    order = F.struct((-F.coalesce(F.col("confidence").cast("double"), F.lit(float("-inf")))).alias("c"), F.col("value").alias("v"))
    listed = lambda kind, value: F.array_sort(F.collect_list(F.when(kind, F.struct(order.alias("o"), value.alias("x")))))
    sides = usable.groupBy("company_id").agg(
        listed(F.col("kind") == "phone", export.national_phone(F.col("value"))).alias("p"),
        listed((F.col("kind") == "email") & ~F.coalesce("generic", F.lit(False)), F.col("value")).alias("own"),
        listed((F.col("kind") == "email") & F.coalesce("generic", F.lit(False)), F.col("value")).alias("box"),
    )
    values = lambda c: F.array_distinct(F.transform(c, lambda x: x["x"]))
    phones = values("p")
    mobile = F.filter(phones, lambda p: export.is_mobile(p))
    other = F.filter(phones, lambda p: ~export.is_mobile(p))
    own, box = values("own"), values("box")
    email = F.coalesce(F.get(own, F.lit(0)), F.get(box, F.lit(0)))
    corporate = F.get(F.filter(F.concat(box, own), lambda m: m != email), F.lit(0))
    card = companies.where("merged_into is null").join(sides, "company_id", "left")
    return card.select(
        "company_id",
        F.upper(F.coalesce("name", "trade_name", F.lit(""))).alias("name"),
        F.regexp_replace(F.upper(F.coalesce("nif", F.lit(""))), "[^A-Z0-9]", "").alias("nif"),
        export.www(F.col("domain")).alias("web"),
        F.coalesce(F.get(mobile, F.lit(0)), F.lit("")).alias("phone_1"),
        F.coalesce(F.get(other, F.lit(0)), F.get(mobile, F.lit(1)), F.lit("")).alias("phone_2"),
        F.coalesce(email, F.lit("")).alias("email"),
        F.coalesce(corporate, F.lit("")).alias("corporate_email"),
        export.activity(F.col("purpose")).alias("activity"),
    )


def card_xml(cards: DataFrame) -> DataFrame:
    """(company_id, xml): every card as an XML element, empty fields included."""
    return cards.select("company_id", F.to_xml(F.struct(*[c for c in cards.columns if c != "company_id"]), {"rowTag": "card"}).alias("xml"))
