"""Lists, sweeps and reports that searches work through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import size, text
from tessera.functions.ident import postal_code


def in_zone(cp: Column, prefixes: list[str]) -> Column:
    """Whether a postal code begins with one of some prefixes; an unknown one may."""
    inside = F.exists(F.array(*map(F.lit, prefixes)), lambda p: cp.startswith(p))
    return F.coalesce(F.when(F.trim(cp) == "", True).otherwise(inside), F.lit(True))


def covered_provinces(places: DataFrame, provinces: list[str] = (), municipalities: list[str] = (), regions: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """(province): the provinces that a filter touches; of ``places`` (province, municipality, region, code) any of its terms will do.

    Names are compared plain, regions without regard to the order of their words.
    """
    keys = lambda names: [F.lit(n) for n in names]
    among = lambda c, names, key: F.exists(F.array(*keys(names)), lambda n: key(n) == key(F.col(c))) if names else F.lit(False)
    wanted = (
        among("province", provinces, text.norm_text)
        | among("municipality", municipalities, text.norm_text)
        | among("region", regions, text.unordered_key)
        | (F.exists(F.array(*keys(prefixes)), lambda p: F.substring(p, 1, 2) == F.col("code")) if prefixes else F.lit(False))
    )
    return places.where(wanted).select("province").distinct()


def size_sweep(results: DataFrame, companies: DataFrame, least: int | None, most: int | None) -> DataFrame:
    """(company_id, fit): the sizes of a search's undecided results; human verdicts stay out."""
    open_ = results.where("verdict is null or verdict not in ('rechazado', 'descartado')").select("company_id")
    sized = open_.join(companies.select("company_id", "size_lo", "size_hi"), "company_id")
    return sized.select("company_id", size.size_fit(F.col("size_lo"), F.col("size_hi"), least, most).alias("fit"))


# Words of names of public bodies and of providers of web sites, plain and small.
PUBLIC_WORDS = ["ayuntamiento", "diputacion", "junta de", "ministerio", "consejeria", "universidad", "mancomunidad", "consorcio"]
PROVIDER_WORDS = ["hosting", "diseno web", "agencia digital", "marketing digital", "posicionamiento"]


def name_kind(name: Column) -> Column:
    """public, provider or company, by the words of a name."""
    plain = F.concat(F.lit(" "), text.norm_text(name), F.lit(" "))
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: plain.contains(F.concat(F.lit(" "), w, F.lit(" "))))
    return F.when(says(PUBLIC_WORDS), "public").when(says(PROVIDER_WORDS), "provider").otherwise("company")


def open_conflicts(conflicts: DataFrame, results: DataFrame) -> DataFrame:
    """(company_id, kind, n): open conflicts of a search's companies that nobody rejected, each kind once."""
    wanted = results.where("verdict is null or verdict not in ('rechazado', 'descartado')").select("company_id").distinct()
    return conflicts.where("state = 'pendiente'").join(wanted, "company_id", "left_semi").groupBy("company_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def size_pick(observations: DataFrame) -> DataFrame:
    """(entity, lo, hi): of an entity's observed sizes that can be read, the one of greatest confidence, then the latest."""
    read = observations.withColumn("r", size.employee_range(F.col("value"))).where("r is not null")
    order = F.struct("confidence", "observed_at", F.col("r"))
    return read.groupBy("entity").agg(F.max_by("r", order).alias("r")).select("entity", "r.lo", "r.hi")


def completeness_change(before: DataFrame, after: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, n_before, n_after): companies with a channel of each kind, before and after a run."""
    asked = before.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    count = lambda df, name: df.where(F.col("kind").isin(*kinds)).groupBy("kind").agg(F.count_distinct("company_id").alias(name))
    out = asked.join(count(before, "n_before"), "kind", "left").join(count(after, "n_after"), "kind", "left")
    return out.select("kind", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def best_sample(companies: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` companies of greatest confidence: a report's sample."""
    return companies.orderBy(F.desc_nulls_last("confidence"), "company_id").limit(n)


def interleaved(zones: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """(place, query): a query for each zone and word, every zone's first word before any second one, up to ``most``.

    ``zones``: (zone, z), ``words``: (word, w), with their places from 0; both are a search's own short lists.
    """
    both = zones.crossJoin(F.broadcast(words)).select(F.concat_ws(" ", "word", "zone").alias("query"), "w", "z")
    ranked = both.orderBy("w", "z").limit(most).groupBy().agg(F.array_sort(F.collect_list(F.struct("w", "z", "query"))).alias("q"))
    return ranked.select(F.posexplode("q").alias("place", "q")).select("place", "q.query")


def pending_order(candidates: DataFrame, most: int) -> DataFrame:
    """The next ``most`` companies to work on: relevant ones first, then those without a size, then by score."""
    return candidates.orderBy(F.desc(F.coalesce(F.col("verdict") == "relevante", F.lit(False))), F.desc(F.col("size_lo").isNull() & F.col("size_hi").isNull()), F.desc_nulls_last("score"), "company_id").limit(most)


def first_people(roles: DataFrame) -> DataFrame:
    """(company_id, person, role): one row for each person of a company and role; people are known by their plain names."""
    named = roles.withColumn("person", text.norm_text(F.col("person"))).where("person <> ''")
    return named.groupBy("company_id", "person", "role").agg(F.min("seen_at").alias("seen_at"))


def closed_conflicts(open_: DataFrame, found: DataFrame) -> DataFrame:
    """Open conflicts (company_id, field) that no longer show in ``found`` close by themselves."""
    return open_.join(found.select("company_id", "field").distinct(), ["company_id", "field"], "left_anti").withColumn("state", F.lit("auto_resuelto"))


def progress(results: DataFrame, companies: DataFrame, channels: DataFrame) -> DataFrame:
    """(companies, with_phone, with_email, with_web, with_nif) of a search, merged companies left out."""
    held = channels.groupBy("company_id").agg(F.max(F.col("kind") == "phone").alias("phone"), F.max(F.col("kind") == "email").alias("email"))
    rows = results.join(companies.where("merged_into is null"), "company_id").join(held, "company_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("companies"),
        F.count_if(F.coalesce("phone", F.lit(False))).alias("with_phone"),
        F.count_if(F.coalesce("email", F.lit(False))).alias("with_email"),
        F.count("domain").alias("with_web"),
        F.count("nif").alias("with_nif"),
    )


def arbitration_context(pairs: DataFrame, companies: DataFrame, channels: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, left, right): both companies of each pair, with up to ``most`` of their channels, the surest first."""
    asked = pairs.select(F.col("a").alias("company_id")).union(pairs.select("b")).distinct()
    kept = channels.join(asked, "company_id", "left_semi").groupBy("company_id", "kind", "value").agg(F.max(F.coalesce("confidence", F.lit(-1.0))).alias("c"))
    ranked = kept.groupBy("company_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "kind", "value"))), 1, most).alias("channels"))
    about = companies.join(asked, "company_id", "left_semi").join(ranked, "company_id", "left")
    told = about.select("company_id", F.struct("name", "nif", "domain", F.transform("channels", lambda c: F.concat_ws(":", c["kind"], c["value"])).alias("channels")).alias("about"))
    return pairs.join(told.toDF("a", "left"), "a").join(told.toDF("b", "right"), "b").select("a", "b", "left", "right")


def relevance_profiles(results: DataFrame, companies: DataFrame, sites: DataFrame, channels: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each undecided company of a search: what a judge of its relevance reads."""
    place = sites.where("municipality is not null").groupBy("company_id").agg(F.min("municipality").alias("municipality"))
    post = sites.where("postal_code is not null").groupBy("company_id").agg(F.min("postal_code").alias("postal_code"))
    phone = channels.where("kind = 'phone'").groupBy("company_id").agg(F.min("value").alias("phone"))
    kinds = records.where("category is not null").groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))
    rows = results.where("verdict is null").select("company_id").join(companies.where("merged_into is null"), "company_id")
    for part in (place, post, phone, kinds):
        rows = rows.join(part, "company_id", "left")
    named = F.coalesce("name", "trade_name").alias("shown")
    return rows.select("company_id", named, "trade_name", "domain", F.left("purpose", F.lit(300)).alias("purpose"), "code", "municipality", "categories", "phone", "postal_code", "form", "size_lo", "size_hi")


def split_entities(rows: DataFrame, truth: str = "truth", cluster: str = "cluster") -> DataFrame:
    """(truth, n_clusters): true entities whose records went to several clusters."""
    return rows.groupBy(truth).agg(F.count_distinct(cluster).alias("n_clusters")).where("n_clusters > 1")


def missing_codes(official: DataFrame, asked: list[str]) -> DataFrame:
    """(code): asked codes that the official statistics lack."""
    wanted = official.sparkSession.createDataFrame([(c,) for c in asked], "code string")
    return wanted.join(official.select("code").distinct(), "code", "left_anti")


def postal_province(cp: Column) -> Column:
    return postal_code(cp)["province"]
