"""Result queries over companies, their channels, roles and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import role_priority

REJECTED = ["descartado", "rechazado"]
DELIVERABLE = ["activa", "probablemente_activa"]
#: A phone that companies of so many webs have is nobody's own.
PHONE_WEBS_UNDER = 3


def _down(c: str) -> Column:
    """Sort key for min_by of a descending number, unknown last."""
    return -F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))


def best_phone(channels: DataFrame, companies: DataFrame) -> DataFrame:
    """(company_id, phone): a Spanish number first, then one of this company's web only, then by confidence."""
    phones = channels.where("kind = 'phone' and (state is null or state <> 'invalid')")
    owners = companies.where("merged_into is null").select("company_id", F.coalesce("domain", F.col("company_id").cast("string")).alias("web"))
    webs = channels.where("kind = 'phone'").join(owners, "company_id").groupBy("value").agg(F.count_distinct("web").alias("webs"))
    rated = phones.join(webs.where(F.col("webs") < PHONE_WEBS_UNDER), "value")
    order = F.struct((~F.col("value").startswith("+34")).alias("a"), (F.col("webs") != 1).alias("b"), _down("confidence").alias("c"), F.col("value").alias("d"))
    return rated.groupBy("company_id").agg(F.min_by("value", order).alias("phone"))


def best_email(channels: DataFrame, generic_only: bool = False) -> DataFrame:
    """(company_id, email) by confidence."""
    mails = channels.where("kind = 'email' and (state is null or state <> 'invalid')")
    if generic_only:
        mails = mails.where("generic")
    return mails.groupBy("company_id").agg(F.min_by("value", F.struct(_down("confidence").alias("a"), F.col("value").alias("b"))).alias("email"))


def best_contact(roles: DataFrame) -> DataFrame:
    """(company_id, contact, role): the weightiest current role, the latest seen among equals."""
    current = roles.where("current is null or current")
    order = F.struct(role_priority(F.col("role")).alias("a"), (-F.coalesce(F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(-(1 << 62)))).alias("b"), F.col("person").alias("c"))
    best = current.groupBy("company_id").agg(F.min_by(F.struct("person", "role"), order).alias("r"))
    return best.select("company_id", F.col("r.person").alias("contact"), F.col("r.role").alias("role"))


def ranked_results(results: DataFrame, companies: DataFrame, channels: DataFrame, roles: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The results of a search with best phone, e-mail and contact, open conflicts and completeness (0 to 5).

    Tops are taken by aggregation before the joins, so no row is looked up on its own.
    """
    kept = results.where(~F.coalesce("verdict", F.lit("")).isin(*REJECTED)).join(companies.where("merged_into is null"), "company_id")
    open_ones = conflicts.where("state = 'pendiente'").groupBy("company_id").agg(
        F.count_if(F.col("kind") == "sin_contrastar").alias("uncontrasted"), F.count_if(F.col("kind") != "sin_contrastar").alias("in_review")
    )
    out = kept
    for side in (best_phone(channels, companies), best_email(channels), best_contact(roles), open_ones):
        out = out.join(side, "company_id", "left")
    contact = F.coalesce("contact", F.when(F.col("natural_person"), F.col("name")))
    role = F.when(F.col("contact").isNotNull(), F.col("role")).when(F.col("natural_person") & F.col("name").isNotNull(), "titular_autonomo")
    out = out.withColumn("role", role).withColumn("contact", contact)
    present = [F.col("contact"), F.coalesce("name", "trade_name"), F.col("nif"), F.col("phone"), F.col("email")]
    score = sum((c.isNotNull().cast("int") for c in present), F.lit(0))
    return out.withColumns({"completeness": score, "uncontrasted": F.coalesce("uncontrasted", F.lit(0)), "in_review": F.coalesce("in_review", F.lit(0))})


def page(ranked: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of ranked results: the most complete first, then by confidence, unknown last."""
    ordered = ranked.orderBy(F.desc("completeness"), F.desc_nulls_last("confidence"), "company_id")
    return ordered.offset(max(offset, 0)).limit(max(limit, 0))


def summary(ranked: DataFrame) -> DataFrame:
    has = lambda c: F.count_if(F.col(c).isNotNull())
    return ranked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("completeness") == 5).alias("complete"),
        has("nif").alias("with_nif"),
        has("contact").alias("with_contact"),
        has("phone").alias("with_phone"),
        has("email").alias("with_email"),
    )


# The columns of a search's result, in their order.
WHOLE_RESULT = [
    "company_id", "reason", "verdict", "verdict_reason", "name", "trade_name", "nif", "state", "confidence", "domain", "natural_person",
    "phone", "email", "contact", "role", "uncontrasted", "in_review", "completeness", "size_lo", "size_hi", "size_source",
]


def whole_page(ranked: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a search with all its columns; those that neither results nor companies have are null."""
    held = set(ranked.columns)
    return page(ranked, limit, offset).select(*[F.col(c) if c in held else F.lit(None).cast("string").alias(c) for c in WHOLE_RESULT])


def whole_summary(results: DataFrame, companies: DataFrame, ranked: DataFrame) -> DataFrame:
    """``summary`` and ``rejected``: the results that were turned down, of companies that were not merged."""
    down = results.where(F.col("verdict").isin(*REJECTED)).join(companies.where("merged_into is null").select("company_id"), "company_id", "left_semi")
    return summary(ranked).crossJoin(down.agg(F.count(F.lit(1)).alias("rejected")))  # two single rows


def asked_of_store(companies: DataFrame, channels: DataFrame, sample: int = 10) -> DataFrame:
    """One row about a selection of companies: count, mean confidence, shares with phone, mail, web and number, and a sample.

    The sample holds the companies of greatest confidence, taken in partial tops.
    """
    live = channels.where("state is null or state <> 'invalid'")
    held = live.groupBy("company_id").agg(F.bool_or(F.col("kind") == "phone").alias("has_phone"), F.bool_or(F.col("kind") == "email").alias("has_email"))
    rows = companies.join(held, "company_id", "left")
    share = lambda c: F.round(100.0 * F.count_if(c) / F.greatest(F.count(F.lit(1)), F.lit(1)), 1)
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"), share(F.col("has_phone")).alias("pct_phone"), share(F.col("has_email")).alias("pct_email"),
        share(F.col("domain").isNotNull()).alias("pct_web"), share(F.col("nif").isNotNull()).alias("pct_nif"),
    )
    best = companies.orderBy(F.desc_nulls_last("confidence"), "company_id").limit(sample)
    place = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "company_id", "name", "domain")
    return stats.crossJoin(best.agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x.dropFields("c")).alias("sample")))  # two single rows


def deliverables(companies: DataFrame, sites: DataFrame, channels: DataFrame) -> DataFrame:
    """Living companies with their best active site, phone and generic e-mail."""
    order = F.struct((F.col("kind") != "sede_operativa").alias("a"), (F.col("kind") != "domicilio_social").alias("b"), _down("confidence").alias("c"), F.col("site_id").alias("d"))
    best = sites.where("active").groupBy("company_id").agg(F.min_by(F.struct("municipality", "province", "postal_code"), order).alias("site"))
    phones = channels.where("kind = 'phone' and state <> 'invalid'")
    phones = phones.groupBy("company_id").agg(F.min_by("value", F.struct(_down("confidence").alias("a"), F.col("value").alias("b"))).alias("phone"))
    living = companies.where(F.col("merged_into").isNull() & F.col("state").isin(*DELIVERABLE))
    out = living.join(best, "company_id", "left").join(phones, "company_id", "left").join(best_email(channels, generic_only=True), "company_id", "left")
    return out.select(*companies.columns, "site.municipality", "site.province", "site.postal_code", "phone", F.col("email").alias("generic_email"))


def quality_stats(companies: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean confidence and shares with a phone and a valid number, in percent with one decimal."""
    share = lambda c: F.round(100.0 * F.count_if(F.coalesce(F.col(c), F.lit(False))) / F.count(F.lit(1)), 1)
    return companies.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"), share("has_phone").alias("pct_phone"), share("nif_valid").alias("pct_nif")
    )


def coverage(own: DataFrame, official: DataFrame, by: list[str]) -> DataFrame:
    """(by, own, official, pct): own companies against the official counts, which are summed, never re-rolled."""
    mine = own.groupBy(*by).agg(F.count(F.lit(1)).alias("own"))
    whole = official.groupBy(*by).agg(F.sum("n").alias("official"))
    both = whole.join(mine, by, "left").select(*by, F.coalesce("own", F.lit(0)).alias("own"), "official")
    return both.withColumn("pct", F.when(F.col("official") > 0, F.round(100.0 * F.col("own") / F.col("official"), 1)))


def history(observations: DataFrame) -> DataFrame:
    """Observations of a company sheet: how often and between when each source said a value."""
    return observations.groupBy("entity", "field", "value", "source_group").agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen")
    )


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most common value of each key, null if two are equally common."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(key).agg(F.max("n").alias("n"))
    firsts = counts.join(top, [key, "n"]).groupBy(key).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("ties"))
    return firsts.select(key, F.when(F.col("ties") == 1, F.col(value)).alias(value))


def translate_codes(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Codes of one catalogue version as those of another: all targets of a code, or the code itself without one."""
    targets = mapping.select(F.col("source_code").alias(column), "target_code").distinct()
    return rows.join(targets, column, "left").withColumn("target_code", F.coalesce("target_code", column))
