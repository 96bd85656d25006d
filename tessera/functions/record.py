"""A source's record in the form that comparisons and evidence use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import ident, text


def list_of(c: Column) -> Column:
    """The parts of a list written as one text: parted by ; , / | or a lone 'y'; blank parts are left out."""
    marked = F.replace(F.translate(F.coalesce(c, F.lit("")), ";,/", "|||"), F.lit(" y "), F.lit("|"))
    return F.filter(F.split(marked, "[|]"), lambda x: F.trim(x) != "")


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def company_domain(web: Column, mails: Column) -> Column:
    """A record's own domain: that of its web, or else that of its first valid address at no free or shared host."""
    own = F.when(~ident.is_platform(ident.domain(web)), ident.domain(web))
    corporate = F.filter(mails, lambda m: m["valid"] & ~m["free"] & ~ident.is_platform(m["host"]))
    return F.coalesce(own, ident.domain(F.get(corporate, F.lit(0))["email"]))


def normalised(
    name: Column, trade_name: Column, nif: Column, form: Column, phones: Column, emails: Column, web: Column, cp: Column, province: Column, sheet: Column, place_id: Column
) -> Column:
    """struct of a record's values in comparable form; ``phones`` and ``emails`` are arrays as given.

    Addresses of data protection officers and of web templates are no contact. A
    person's number never identifies a company, so it is dropped there. The legal
    form is the one given, or else that of the name. The province's code is that
    of the postal code, or else that of the province's name.
    """
    given_form = F.nullif(F.upper(F.translate(F.coalesce(form, F.lit("")), ". ", "")), F.lit(""))
    useful = F.filter(F.coalesce(emails, F.array().cast("array<string>")), lambda m: ~ident.privacy_mailbox(m) & ~ident.template_mailbox(m))
    read = F.struct(
        ident.nif_check(nif).alias("checked"),
        F.coalesce(given_form, text.legal_form(name)["form"]).alias("form"),
        F.transform(F.coalesce(phones, F.array().cast("array<string>")), lambda p: F.struct(p.alias("raw"), ident.phone(p).alias("p"))).alias("told"),
        F.transform(useful, lambda m: ident.email(m)).alias("mails"),
        ident.postal_code(cp, province).alias("post"),
        ident.province_code(province).alias("province_code"),
    )

    def composed(r: Column) -> Column:
        checked, told, mails, post = r["checked"], r["told"], r["mails"], r["post"]
        other_s = ident.person_number_in_company(r["form"], checked)
        number = F.when(~other_s, _given(checked["nif"]))
        valid = F.filter(told, lambda x: x["p"]["valid"])
        e164 = lambda xs: F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["p"]["e164"])))
        addresses = lambda keep: F.array_sort(F.array_distinct(F.transform(F.filter(mails, keep), lambda m: m["email"])))
        named = F.element_at(F.create_map(*[F.lit(x) for kv in ident.province_names().items() for x in kv]), post["province"])
        return F.struct(
            number.alias("nif"),
            F.when(number.isNotNull(), checked["valid"]).alias("nif_valid"),
            F.when(~other_s, checked["kind"]).alias("nif_kind"),
            other_s.alias("nif_dropped"),
            F.when(~other_s, checked["natural_person"]).alias("natural_person"),
            text.norm_name(name).alias("name"),
            text.norm_name(trade_name).alias("trade_name"),
            r["form"].alias("form"),
            F.when(checked["valid"] & ~other_s, ident.form_fits_nif(r["form"], checked["nif"])).alias("form_fits_nif"),
            e164(valid).alias("phones"),
            e164(F.filter(valid, lambda x: x["p"]["kind"] == "special")).alias("special_phones"),
            F.transform(F.filter(told, lambda x: ~x["p"]["valid"]), lambda x: x["raw"]).alias("invalid_phones"),
            addresses(lambda m: m["valid"]).alias("emails"),
            addresses(lambda m: m["valid"] & ~m["generic"]).alias("personal_emails"),
            company_domain(web, mails).alias("domain"),
            post["cp"].alias("cp"),
            post["fits"].alias("cp_fits"),
            F.coalesce(_given(province), named).alias("province"),
            F.coalesce(F.substring(post["cp"], 1, 2), r["province_code"]).alias("province_code"),
            F.upper(_given(sheet)).alias("sheet"),
            _given(place_id).alias("place_id"),
        )

    # a one-element array gives the parsed values a name, so that each is computed once a row
    return F.get(F.transform(F.array(read), composed), F.lit(0))


# Words that show that a sentence counts people.
PEOPLE = ["empleados", "empleadas", "trabajadores", "trabajadoras", "profesionales", "personas", "operarios", "employees", "people"]


def headcount(site: Column) -> Column:
    """The phrase that says how many people a company has, or null: a number of up to six digits before a word for people."""
    phrase = rf"(?i)((?:m[aá]s de|over|more than) )?([0-9][0-9.]{{0,6}}) (?:{'|'.join(PEOPLE)})\b"
    more, number = F.regexp_extract(site, phrase, 1), F.regexp_extract(site, phrase, 2)
    return F.when(number != "", F.trim(F.concat(F.lower(more), number)))


def last_nine(phone: Column) -> Column:
    """The last nine digits of a phone; null if it has fewer."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 9, F.right(digits, F.lit(9)))


def compact(name: Column) -> Column:
    """Letters and digits only, plain and small."""
    return F.replace(text.norm_text(name), F.lit(" "), F.lit(""))


def search_name(name: Column, municipality: Column | None = None) -> Column:
    """A name for looking a company up: up to the first separator, without legal form and without its municipality's words."""
    base = text.legal_form(F.trim(F.get(F.split(F.coalesce(name, F.lit("")), r"\s+[|·–—-]\s+"), F.lit(0))))["bare"]
    if municipality is None:
        return base
    place = F.filter(text.words(text.norm_text(municipality)), lambda w: F.length(w) > 2)
    left = F.array_join(F.array_except(text.words(base), place), " ")
    return F.when(left == "", base).otherwise(left)


def denomination(title: Column) -> Column:
    """Of a title's parts the first with a legal form, or else the first."""
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+[|·–—-]\s+|:\s+"), lambda x: F.trim(x)), lambda x: x != "")
    formal = F.filter(parts, lambda x: text.legal_form(x)["form"].isNotNull())
    return F.coalesce(F.get(formal, F.lit(0)), F.get(parts, F.lit(0)), title)


def names_agree(similarity: Column, a: Column, b: Column) -> Column:
    """Whether two names mean one company: similar by 0.6 or more, or with a distinctive word in common."""
    shared = F.arrays_overlap(text.distinctive_tokens(text.norm_name(a)), text.distinctive_tokens(text.norm_name(b)))
    return (similarity >= 0.6) | F.coalesce(shared, F.lit(False))


def number_fits(nif: Column, form: Column, agree: Column) -> Column:
    """Whether a proposed number can be a company's: a valid company number of an agreeing name, against no legal form."""
    checked = ident.nif_check(nif)
    return checked["valid"] & (checked["kind"] == "company") & agree & F.coalesce(ident.form_fits_nif(form, checked["nif"]), F.lit(True))


def mentions_place(body: Column, places: Column) -> Column:
    """Whether a text names one of some places (plain and small); true if there are none to look for."""
    plain = F.lower(text.strip_accents(F.coalesce(body, F.lit(""))))
    return (F.size(places) == 0) | F.exists(places, lambda p: plain.contains(p))


def address_numbers(address: Column) -> Column:
    """The short numbers of an address in order of size: equal for two spellings of one address."""
    found = F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(r"\b([0-9]{1,4})\b"), F.lit(1))
    return F.array_join(F.transform(F.array_sort(F.transform(found, lambda x: x.cast("int"))), lambda x: x.cast("string")), "-")


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost of a call from prices per million tokens in and out; 0 for an unknown model."""
    out = F.lit(0.0)
    for name, (price_in, price_out) in prices.items():
        out = F.when(model == name, (tokens_in * price_in + tokens_out * price_out) / 1e6).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def first_match(value: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first rule (pattern on plain small text, name) that a value matches."""
    plain = F.lower(text.strip_accents(F.coalesce(value, F.lit(""))))
    out = F.lit(default).cast("string")
    for pattern, name in reversed(rules):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out
