"""Faceted company search: a filter object compiled to one predicate and semi-joins.

Unknown never excludes, but for contacts that are asked for. Sector codes and
keywords are alternatives; exclusions are taken away.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import place_key, strip_accents, unordered_key
from tessera.operators.evidence import DEAD_STATES

#: Zones from the most to the least precise; only the first one asked for applies.
ZONES = ("postal_codes", "provinces", "municipalities", "regions")
FOREIGN_TLDS = ["pt", "fr", "it", "de", "uk", "mx", "ar", "co", "cl", "pe", "br", "us", "ve", "ec", "uy", "bo", "py"]


@dataclass(frozen=True)
class Filters:
    states: list[str] = field(default_factory=list)
    natural_persons: bool = True
    codes: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    size_least: int | None = None
    size_most: int | None = None
    forms: list[str] = field(default_factory=list)
    postal_codes: list[str] = field(default_factory=list)
    provinces: list[str] = field(default_factory=list)
    municipalities: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    needs_web: bool = False
    needs_phone: bool = False
    needs_generic_email: bool = False
    least_confidence: float = 0.0
    fresh_days: int | None = None


def code_matches(code: Column, prefixes: list[str]) -> Column:
    """Prefix match without dots or case; no prefixes accept all, a null code matches none."""
    if not prefixes:
        return F.lit(True)
    plain = F.lower(F.replace(code, F.lit("."), F.lit("")))
    tests = [plain.startswith(p.replace(".", "").lower()) for p in prefixes]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def mentions(text: Column, keywords: list[str]) -> Column:
    """Whether a text holds any of the keywords, without accents or case."""
    plain = F.lower(strip_accents(F.coalesce(text, F.lit(""))))
    out = F.lit(False)
    for k in keywords:
        out = out | plain.contains(F.lower(strip_accents(F.lit(k))))
    return out


def row_predicate(f: Filters) -> Column:
    """The conditions that one company row decides. Absent conditions add nothing to the plan."""
    parts = [F.col("merged_into").isNull()]
    if f.states:
        parts.append(F.col("state").isin(*f.states))
    if not f.natural_persons:
        parts.append(~F.col("natural_person"))
    about = F.concat_ws(" ", "purpose", "name")
    sector = ([code_matches(F.col("code"), f.codes)] if f.codes else []) + ([mentions(about, f.keywords)] if f.keywords else [])
    if sector:
        parts.append(sector[0] | sector[1] if len(sector) > 1 else sector[0])
    if f.exclusions:
        parts.append(~mentions(about, f.exclusions))
    if f.size_least is not None:
        parts.append(F.col("size_hi").isNull() | (F.col("size_hi") >= f.size_least))
    if f.size_most is not None:
        parts.append(F.col("size_lo").isNull() | (F.col("size_lo") <= f.size_most))
    if f.forms:
        parts.append(F.col("form").isin(*f.forms))
    if f.needs_web:
        parts.append(F.col("domain").isNotNull())
    if f.least_confidence > 0:
        parts.append(F.coalesce("confidence", F.lit(0.0)) >= f.least_confidence)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def zone_of(f: Filters, order: tuple[str, ...] = ZONES) -> tuple[str, list[str]] | None:
    """The zone that applies: the first of ``order`` that is asked for."""
    return next(((z, getattr(f, z)) for z in order if getattr(f, z)), None)


def search(companies: DataFrame, f: Filters, sites: DataFrame, channels: DataFrame, observations: DataFrame, as_of: Column, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """The companies (company_id, ...) that meet the filter; existence conditions are semi-joins."""
    out = companies.where(row_predicate(f))
    if zone := zone_of(f, zones):
        column = {"postal_codes": "postal_code", "provinces": "province", "municipalities": "municipality", "regions": "region"}[zone[0]]
        inside = F.col(column).isin(*zone[1])
        if column == "region":  # a region's name may stand in another order
            inside = unordered_key(F.col(column)).isin(*[unordered_key(F.lit(name)) for name in zone[1]])
        out = out.join(sites.where(F.col("active") & inside), "company_id", "left_semi")
    if f.needs_phone:
        out = out.join(channels.where((F.col("kind") == "phone") & (F.col("state") != "invalid")), "company_id", "left_semi")
    if f.needs_generic_email:
        out = out.join(channels.where((F.col("kind") == "email") & F.col("generic") & (F.col("state") != "invalid")), "company_id", "left_semi")
    if f.fresh_days:
        out = out.join(observations.where(F.col("observed_at") >= as_of - F.make_dt_interval(F.lit(f.fresh_days))), "company_id", "left_semi")
    return out


def looks_foreign(phones: Column, web: Column) -> Column:
    """Has phones and no Spanish one, or a web under another country's domain."""
    none_spanish = (F.size(phones) > 0) & ~F.exists(phones, lambda p: p.startswith("+34"))
    return F.coalesce(none_spanish, F.lit(False)) | F.coalesce(F.substring_index(web, ".", -1).isin(*FOREIGN_TLDS), F.lit(False))


def out_of_zone(municipality: Column, asked: list[str]) -> Column:
    """Only if a zone is asked for and the municipality is known and not in it."""
    if not asked:
        return F.lit(False)
    return F.coalesce(~place_key(municipality).isin(*[a.lower() for a in asked]) & (place_key(municipality) != ""), F.lit(False))


def failing_rule(
    f: Filters, provinces: list[str], *, phones: Column, web: Column, postal_codes: Column, province_codes: Column, municipalities: Column, state: Column, form: Column, generic_email: Column
) -> Column:
    """Name of the first rule that a company fails, or null if it meets them all or can't be judged."""
    known = lambda c: F.size(c) > 0
    asked = lambda values: F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
    apart = lambda c, values: known(c) & ~F.arrays_overlap(c, asked(values)) if values else F.lit(False)
    cp_confirmed = F.coalesce(F.arrays_overlap(postal_codes, asked(f.postal_codes)), F.lit(False)) if f.postal_codes else F.lit(False)
    plain_form = F.trim(F.upper(F.replace(form, F.lit("."), F.lit(""))))
    rules = [
        ("foreign", looks_foreign(phones, web)),
        ("postal_code", apart(postal_codes, f.postal_codes)),
        ("province", apart(province_codes, provinces)),
        ("municipality", apart(F.transform(municipalities, place_key), f.municipalities) & ~cp_confirmed),
        ("state", state.isin(*[s for s in DEAD_STATES if s not in f.states]) if set(DEAD_STATES) - set(f.states) else F.lit(False)),
        ("form", (plain_form != "") & ~plain_form.isin(*f.forms) if f.forms else F.lit(False)),
        ("web", F.coalesce(web, F.lit("")) == "" if f.needs_web else F.lit(False)),
        ("phone", ~F.coalesce(known(phones), F.lit(False)) if f.needs_phone else F.lit(False)),
        ("email", ~F.coalesce(generic_email, F.lit(False)) if f.needs_generic_email else F.lit(False)),
    ]
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(fails, name).otherwise(out)
    return out


def sole_trader(checked_nif: Column, natural_person: Column, form: Column, has_registry_roles: Column, said_so: Column) -> Column:
    """A valid number decides; then the flag, a company's form, roles in the registry, and what a reader said."""
    from tessera.functions.ident import COMPANY_FORMS

    valid = F.coalesce(checked_nif["valid"], F.lit(False))
    return (
        F.when(valid & (checked_nif["kind"] == "company"), False)
        .when(valid & checked_nif["natural_person"], True)
        .when(F.coalesce(natural_person, F.lit(False)), True)
        .when(form.isin(*COMPANY_FORMS), False)
        .when(F.coalesce(has_registry_roles, F.lit(False)), False)
        .otherwise(F.coalesce(said_so, F.lit(False)))
    )
