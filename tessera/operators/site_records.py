"""Records from the texts of company sites: what rules and a model have read, and what may not be believed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import export, record, site, text
from tessera.operators.worklist import name_kind
from tessera.storage import stored

# Words that no person's name has, and titles that say nothing about a role.
NO_NAME = [
    "arquitecto", "arquitecta", "director", "directora", "socio", "socia", "fundador", "fundadora", "gerente", "ceo",
    "administracion", "obra", "procurement", "manager", "ingeniero", "ingeniera", "tecnico", "tecnica", "co",
    "diseno", "departamento", "dpto", "responsable", "contacto", "equipo", "proyectos", "comercial", "presidente",
]
NO_ROLE = ["contacto", "persona"]
#: Characters on either side of a name in which its role stands.
NEAR = 120
#: People of one site.
MOST_PEOPLE = 5


def spaced(c: Column) -> Column:
    """Plain small letters with single spaces; characters without a plain form are left out."""
    plain = F.regexp_replace(F.lower(text.strip_accents(F.coalesce(c, F.lit("")))), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def is_name(name: Column) -> Column:
    """Two to five words on one line, without digits, marks or words of titles."""
    words = F.filter(F.split(F.translate(spaced(name), ".", " "), " "), lambda w: w != "")
    odd = name.contains("\n") | name.rlike(r"[0-9@|/]")
    return F.coalesce((F.size(words) >= 2) & (F.size(words) <= 5) & ~odd & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in NO_NAME])), F.lit(False))


def told_people(sites: DataFrame, people: DataFrame, key: str = "site") -> DataFrame:
    """(key, name, role): people that a model has found whose name stands in the site's text, with their role near it.

    ``sites``: (key, text). ``people``: (key, name, role). The mentions of a name come
    as places in the plain text, and the first word of four letters or more of the role must stand
    within ``NEAR`` characters of one of them. A role without such a word, or that
    only says contact or person, is believed. Names that are none, roles of several
    lines and null texts are not. Repeated rows stay.
    """
    asked = people.where(is_name(F.col("name")) & ~F.coalesce(F.col("role"), F.lit("")).contains("\n"))
    said = F.filter(F.regexp_extract_all(spaced(F.col("role")), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*NO_ROLE))
    asked = asked.withColumns({"_name": spaced(F.col("name")), "_word": F.get(said, F.lit(0))})
    rows = asked.join(sites.select(key, spaced(F.col("text")).alias("_text")), key)
    # a mention begins where the pieces before it and the names between them end
    pieces = F.split(F.col("_text"), F.concat(F.lit("\\Q"), F.col("_name"), F.lit("\\E")))
    rows = rows.withColumn("_lengths", F.transform(pieces, lambda p: F.length(p))).where(F.size("_lengths") > 1)
    size = F.length("_name")
    before = lambda i: F.aggregate(F.slice("_lengths", F.lit(1), i + 1), F.lit(0), lambda a, b: a + b) + i * size
    starts = F.transform(F.sequence(F.lit(0), F.size("_lengths") - 2), before)
    around = lambda at: F.substring("_text", F.greatest(F.lit(1), at - NEAR + 1), at + size + NEAR - F.greatest(F.lit(0), at - NEAR))
    near = F.exists(starts, lambda at: around(at).contains(F.col("_word")))
    return rows.where(F.col("_word").isNull() | near).select(key, "name", "role")


def site_records(sites: DataFrame, people: DataFrame | None = None, key: str = "site") -> DataFrame:
    """(key, name, nif, dropped_name, postal_code, phones, emails, web, sheet, people): a record of each site that is one company's.

    ``sites``: (key, text, domain). Pages that list many contacts and those of public
    bodies give none. The name of a provider of sites is dropped, and its number with
    it. Of several addresses one at the site's own domain stands alone; foreign phones go
    where there is a Spanish one. ``people`` (key, name, role), found by a model, follow those of
    the rules as far as ``told_people`` believes them; each name once, ``MOST_PEOPLE`` at most.
    """
    legal = site.legal_data(F.coalesce(F.col("text"), F.lit("")))
    # written before it is filtered: each filter would read the texts anew
    rows = stored(sites.select(key, "domain", legal.alias("r")), "legal-data")
    mails = F.transform("r.emails", lambda m: m["email"])
    rows = rows.where(~export.directory_page(F.col("r.phones"), mails))
    name = F.get("r.names", F.lit(0))
    rows = rows.withColumn("_kind", F.coalesce(name_kind(name), F.lit("company"))).where("_kind <> 'public'")
    provider = F.col("_kind") == "provider"
    own = F.get(F.filter("r.emails", lambda m: F.coalesce(m["host"] == F.col("domain"), F.lit(False))), F.lit(0))
    by_rules = F.filter("r.people", lambda p: is_name(p["name"]))
    out = rows.select(
        key,
        F.when(~provider, name).alias("name"),
        F.when(~provider, F.col("r.nif")).alias("nif"),
        F.when(provider, name).alias("dropped_name"),
        F.get("r.postal_codes", F.lit(0)).alias("postal_code"),
        export.without_foreign(F.col("r.phones")).alias("phones"),
        F.when(own.isNotNull(), F.array(own["email"])).otherwise(mails).alias("emails"),
        F.col("domain").alias("web"),
        F.col("r.registry.sheet").alias("sheet"),
        by_rules.alias("_rules"),
    )
    if people is None:
        return out.select(*out.columns[:-1], F.slice("_rules", 1, MOST_PEOPLE).alias("people"))
    told = told_people(sites, people, key).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("name", F.coalesce("role", F.lit("Contacto")).alias("role")))).alias("_told"))
    held = out.join(told, key, "left")
    names = lambda c: F.transform(c, lambda p: F.lower(p["name"]))
    fresh = F.filter(F.coalesce("_told", F.col("_rules")), lambda p: ~F.array_contains(names(F.col("_rules")), F.lower(p["name"])))
    every = F.concat(F.col("_rules"), F.transform(fresh, lambda p: F.struct(p["name"].alias("name"), p["role"].alias("role"))))
    once = F.filter(every, lambda p, i: F.array_position(names(every), F.lower(p["name"])) == i + 1)
    return held.select(*out.columns[:-1], F.slice(once, 1, MOST_PEOPLE).alias("people"))


def record_matches(company_nif: Column, company_phones: Column, nif: Column, phones: Column, agree: Column) -> Column:
    """Whether a record found for a company is that company's: one number, one phone by its last nine digits, or agreeing names."""
    same = F.coalesce((F.coalesce(company_nif, F.lit("")) != "") & (F.upper(company_nif) == F.upper(nif)), F.lit(False))
    nine = lambda c: F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), record.last_nine))
    return same | F.arrays_overlap(nine(company_phones), nine(phones)) | F.coalesce(agree, F.lit(False))
