"""What a company's web site says of its owner: numbers, names, registry entry, contacts and people."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import ident, text

#: Characters on either side of a number that its label and a web agency's mention are looked for in.
LABEL_CHARS, AGENCY_CHARS = 120, 150
MOST_NAMES, MOST_PEOPLE, MOST_CODES = 5, 5, 5

# Words of labels and of agencies, plain and small.
NUMBER_LABELS = ["cif", "nif", "identificacion fiscal"]
AGENCY_WORDS = ["diseno web", "diseno y desarrollo web", "desarrollado por", "disenado por", "web creada por", "powered by"]
NAME_LABELS = ["denominacion social", "razon social", "titular", "propiedad de"]
NAME_PREFIXES = ["la empresa", "la sociedad", "el titular", "esta web es propiedad de", "propiedad de", "titularidad de", "perteneciente a", "filial de", "titular", "razon social", "denominacion social", "denominacion", "empresa"]
LEGAL_PHRASES = ["derechos", "propiedad intelectual", "pagina web", "sitio web", "presente sitio", "presente pagina", "presente aviso", "usuario", "condiciones", "aviso legal", "politica de", "responsable del", "datos personales", "cookies"]
TITLES = ["gerente", "director general", "directora general", "director gerente", "director comercial", "directora comercial", "director tecnico", "directora tecnica", "director", "directora", "ceo", "fundador", "fundadora", "cofundador", "cofundadora", "propietario", "propietaria", "administrador unico", "administradora unica", "administrador", "administradora", "socio fundador", "socia fundadora", "socio", "socia", "responsable comercial", "responsable tecnico", "responsable tecnica", "jefe de obra", "jefa de obra", "encargado", "encargada", "presidente", "presidenta", "tecnico comercial", "persona de contacto"]
NO_PERSON = ["aviso", "legal", "politica", "privacidad", "cookies", "nuestro", "nuestra", "equipo", "empresa", "servicios", "contacto", "inicio", "reformas", "construcciones", "sociedad", "limitada", "calle", "avenida", "madrid", "sevilla", "espana", "telefono", "email", "correo", "web", "general", "comercial"]
PARTICLES = ["de", "la", "los", "del"]


def _plain(c: Column) -> Column:
    return F.lower(text.strip_accents(c))


def _any(words: list[str]) -> str:
    """A pattern of some plain words."""
    return "|".join(map(re.escape, words))


def _around(body: Column, at: Column, chars: int) -> Column:
    start = F.greatest(F.lit(1), at - chars)
    return F.substring(body, start, at + chars - start)


def numbers(body: Column) -> Column:
    """array<struct<nif, kind, labelled, agency, at>> of the valid tax numbers, the owner's likeliest first.

    Numbers away from a web agency's mention come first, then those near a label,
    then by place. Each number counts once, where it stands first.
    """

    def placed(t: Column) -> Column:
        words = F.regexp_extract_all(t["upper"], F.lit(r"(?<![A-Z0-9])(?:ES[ -]?)?[A-Z]?(?:[ .-]?[0-9]){7,8}[ -]?[A-Z0-9]?(?![A-Z0-9])"), F.lit(0))
        held = F.transform(F.array_distinct(words), lambda w: F.struct(ident.nif_check(w).alias("n"), F.instr(t["upper"], w).alias("at")))
        return F.struct(t["plain"].alias("plain"), F.filter(held, lambda p: p["n"]["valid"]).alias("valid"))

    def marked(t: Column) -> Column:
        valid = t["valid"]
        first = F.filter(valid, lambda p: ~F.exists(valid, lambda o: (o["n"]["nif"] == p["n"]["nif"]) & (o["at"] < p["at"])))
        near = lambda p, chars: F.translate(_around(t["plain"], p["at"], chars), ".", "")
        says = lambda p, chars, words: near(p, chars).rlike(_any(words))
        told = F.transform(first, lambda p: F.struct(says(p, AGENCY_CHARS, AGENCY_WORDS).alias("agency"), (~says(p, LABEL_CHARS, NUMBER_LABELS)).alias("bare"), p["at"].alias("at"), p["n"]["nif"].alias("nif"), p["n"]["kind"].alias("kind")))
        return F.transform(F.array_sort(told), lambda m: F.struct(m["nif"], m["kind"], (~m["bare"]).alias("labelled"), m["agency"], m["at"]))

    body = F.coalesce(body, F.lit(""))
    both = lambda b: F.struct(F.upper(b).alias("upper"), _plain(b).alias("plain"))
    return text.let(text.let(text.let(body, both), placed), marked)


def owner_number(found: Column) -> Column:
    """The first number that stands near no agency's mention."""
    return F.get(F.filter(found, lambda n: ~n["agency"]), F.lit(0))["nif"]


def company_name(c: Column) -> Column:
    """A candidate without its lead-in; null if it reads like legal text or is no name by its length."""

    def without(name: Column, prefix: Column) -> Column:
        begins = text.let(_plain(name), lambda p: p.startswith(F.concat(prefix, F.lit(" "))) | p.startswith(F.concat(prefix, F.lit(":"))))
        return F.when(begins, F.ltrim(F.substring(name, F.length(prefix) + 1, F.length(name)), F.lit(" :"))).otherwise(name)

    def bare(name: Column) -> Column:
        # most names begin with no prefix at all
        begins = _plain(name).rlike(f"^(?:{_any(NAME_PREFIXES)})[ :]")
        return F.when(begins, F.reduce(F.array(*map(F.lit, NAME_PREFIXES)), name, without)).otherwise(name)

    def judged(name: Column) -> Column:
        fits = F.length(name).between(3, 100) & (F.size(F.split(name, " ")) <= 12)
        return F.when(fits & ~_plain(name).rlike(_any(LEGAL_PHRASES)), name)

    unled = text.let(F.trim(F.regexp_replace(c, r"\s+", " ")), bare)
    return text.let(F.trim(F.regexp_replace(unled, r"^[A-Za-z]?[0-9]{7,8}[A-Za-z]?[ .,:;-]+", ""), F.lit(" ,:;-")), judged)


def _parts(line: Column, marks: str) -> Column:
    """A line parted at a pattern, which is read once a task and not anew for each line."""
    return F.split(F.regexp_replace(line, marks, "\n"), "\n")


def company_names(body: Column) -> Column:
    """Up to five names of the owner: behind a label first, then phrases with a legal form; each once, whatever its case."""

    def found(lines: Column) -> Column:
        def labelled(line: Column) -> Column:
            label = _plain(F.substring_index(line, ":", 1)).rlike(_any(NAME_LABELS))
            said = F.regexp_replace(F.substring(line, F.instr(line, ":") + 1, F.length(line)), r"[;|(].*$", "")
            return F.when(line.contains(":"), F.when(label, F.split_part(said, F.lit(", "), F.lit(1))))

        phrases = F.flatten(F.transform(lines, lambda line: _parts(line, r"[;:|()]|\.\s")))
        formal = F.filter(phrases, lambda x: x.rlike(r"^\s*[\p{Lu}0-9]") & (F.length(x) <= 100) & text.has_legal_form(x) & ~_plain(x).rlike(_any(AGENCY_WORDS)))
        both = F.concat(F.array_compact(F.transform(lines, labelled)), formal)
        return F.array_compact(F.transform(both, lambda x: company_name(F.trim(x, F.lit(" .,:")))))

    def once(names: Column) -> Column:
        small = F.transform(names, lambda m: F.lower(m))
        first = F.transform(names, lambda n, i: F.when(F.array_position(small, F.lower(n)) == i + 1, n))
        return F.slice(F.array_compact(first), 1, MOST_NAMES)

    return text.let(text.let(F.split(F.coalesce(body, F.lit("")), "\n"), found), once)


def registry_entry(body: Column) -> Column:
    """struct<registry, volume, folio, sheet> of a company register's entry, or null: its four labels in this order."""

    def told(t: Column) -> Column:
        behind = lambda label, value: F.regexp_extract(t, rf"(?i)registro mercantil de .*?\b{label}[ .:º°nN]*({value})", 1)
        place = F.trim(F.regexp_extract(t, r"Registro Mercantil de ((?:\p{Lu}\p{Ll}+|de|del|la)(?: (?:\p{Lu}\p{Ll}+|de|del|la))*)", 1))
        volume, folio, sheet = behind("tomo", "[0-9][0-9.]*"), behind("folio", "[0-9]+"), behind("hoja", "[A-Z]{1,2}[ -]?[0-9][0-9.]*")
        return F.when(t.contains("Registro Mercantil de "), F.struct(place.alias("place"), volume.alias("volume"), folio.alias("folio"), sheet.alias("sheet")))

    def entry(x: Column) -> Column:
        held = F.struct(x["place"].alias("registry"), F.rtrim(x["volume"], F.lit(".")).alias("volume"), x["folio"].alias("folio"), F.rtrim(F.replace(x["sheet"], F.lit(" "), F.lit("")), F.lit(".")).alias("sheet"))
        return F.when((x["place"] != "") & (x["volume"] != "") & (x["folio"] != "") & (x["sheet"] != ""), held)

    return text.let(text.let(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " "), told), entry)


def phones(body: Column) -> Column:
    """Valid Spanish phones in order, each once."""
    raw = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?<![0-9])(?:(?:[+]|00)34[ .-]?)?[(]?[6-9](?:[ .()-]{0,2}[0-9]){8}(?![0-9])"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.transform(raw, lambda x: ident.phone(x)), lambda p: p["valid"]), lambda p: p["e164"]))


def emails(body: Column) -> Column:
    """array<struct<email, generic, host>> of valid addresses at no platform, in order, each once."""
    spelt = F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), r"\s*(?:\[at\]|\(at\)|\(arroba\)|\sarroba\s)\s*", "@")
    raw = F.array_distinct(F.regexp_extract_all(spelt, F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), F.lit(0)))
    found = F.filter(F.transform(raw, lambda x: ident.email(x)), lambda e: e["valid"] & ~e["host"].isin(*ident.PLATFORMS))
    return F.transform(found, lambda e: F.struct(e["email"], e["generic"], e["host"]))


def postal_codes(body: Column) -> Column:
    raw = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?<![0-9])([0-9]{5})(?![0-9])"), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(F.filter(raw, lambda x: F.substring(x, 1, 2).between("01", "52")))), 1, MOST_CODES)


def is_person(name: Column) -> Column:
    """Two or more words beside particles, all but those with a capital, none of a page's usual words."""

    def judged(words: Column) -> Column:
        own = F.filter(words, lambda w: ~w.isin(*PARTICLES))
        shaped = F.forall(own, lambda w: w.rlike(r"^\p{Lu}\p{Ll}+$"))
        return (F.size(own) >= 2) & (F.size(own) <= 4) & shaped & ~F.exists(words, lambda w: _plain(w).isin(*NO_PERSON))

    return text.let(F.split(name, " "), judged)


def people(body: Column) -> Column:
    """Up to five array<struct<name, role>>, read line by line: 'Role: Name', 'Name - Role', 'Name, Role' or 'Name (Role)'; each name once."""

    def pair(line: Column) -> Column:
        parts = F.transform(_parts(line, r"\s*[:|(),]\s*|\s+[–—-]\s+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "), F.lit(" .)")))
        read = F.transform(parts, lambda x: F.struct(x.alias("said"), _plain(x).isin(*TITLES).alias("titled")))
        # most lines name no title, so nobody is looked for there
        return text.let(read, lambda r: F.when(F.exists(r, lambda x: x["titled"]), named(r)))

    def named(read: Column) -> Column:
        both = F.transform(F.slice(read, 1, F.size(read) - 1), lambda a, i: F.struct(a.alias("a"), F.get(read, i + 1).alias("b")))
        said = F.filter(both, lambda p: (p["a"]["titled"] & is_person(p["b"]["said"])) | (p["b"]["titled"] & is_person(p["a"]["said"])))
        shown = lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 100)))
        told = lambda name, role: F.struct(name["said"].alias("name"), shown(role["said"]).alias("role"))
        return F.transform(said, lambda p: F.when(p["a"]["titled"], told(p["b"], p["a"])).otherwise(told(p["a"], p["b"])))

    def once(found: Column) -> Column:
        names = F.transform(found, lambda p: F.lower(p["name"]))
        first = F.transform(found, lambda p, i: F.when(F.array_position(names, F.lower(p["name"])) == i + 1, p))
        return F.slice(F.array_compact(first), 1, MOST_PEOPLE)

    return text.let(F.flatten(F.array_compact(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), pair))), once)


# What tells that a page names somebody in charge; the endings are those of either gender.
IN_CHARGE = ["gerente", "ceo", "persona de contacto", "nuestro equipo"]
IN_CHARGE_ENDED = [("fundador", ["", "a"]), ("propietari", ["o", "a"]), ("encargad", ["o", "a"])]
CHIEFS, OF_CHIEFS = ["jefe", "jefa"], ["de obra"]
DIRECTORS, OF_DIRECTORS = ["director", "directora"], ["general", "comercial", "tecnico", "tecnica"]


def mentions_role(body: Column) -> Column:
    """Whether a page names somebody in charge, in whole words."""
    spaced = F.regexp_replace(_plain(F.coalesce(body, F.lit(""))), r"(?!\s)\W", " | ")
    words = F.concat(F.lit(" "), F.regexp_replace(spaced, r"\s+", " "), F.lit(" "))
    asked = IN_CHARGE + [stem + end for stem, ends in IN_CHARGE_ENDED for end in ends]
    asked += [f"{who} {what}" for whos, whats in ((CHIEFS, OF_CHIEFS), (DIRECTORS, OF_DIRECTORS)) for who in whos for what in whats]
    return words.rlike(f" (?:{_any(asked)}) ")


def legal_data(body: Column) -> Column:
    """struct<nif, n_nifs, names, registry, phones, emails, postal_codes, people, needs_model> of a site's text.

    ``needs_model`` says that rules are not enough: number, name or postal code is
    missing, there are several numbers, or roles are named without a person.
    """

    def told(t: Column) -> Column:
        lacking = owner_number(t["numbers"]).isNull() | (F.size(t["names"]) == 0) | (F.size(t["codes"]) == 0)
        return F.struct(
            owner_number(t["numbers"]).alias("nif"),
            F.size(t["numbers"]).alias("n_nifs"),
            t["names"].alias("names"),
            t["registry"].alias("registry"),
            t["phones"].alias("phones"),
            t["emails"].alias("emails"),
            t["codes"].alias("postal_codes"),
            t["people"].alias("people"),
            (lacking | (F.size(t["numbers"]) > 1) | (t["roles"] & (F.size(t["people"]) == 0))).alias("needs_model"),
        )

    parts = lambda b: F.struct(
        numbers(b).alias("numbers"), company_names(b).alias("names"), registry_entry(b).alias("registry"), phones(b).alias("phones"),
        emails(b).alias("emails"), postal_codes(b).alias("codes"), people(b).alias("people"), mentions_role(b).alias("roles"),
    )
    return text.let(text.let(body, parts), told)


def overlaid(rules: dict[str, Column], model: dict[str, Column]) -> dict[str, Column]:
    """Fields by rules, with what a model found in their place where it found something."""
    return {name: F.coalesce(model[name], c) if name in model else c for name, c in rules.items()}


def description(html: Column, most: int = 300) -> Column:
    """A page's meta description, up to ``most`` characters."""
    tag = F.regexp_extract(html, r"(?is)<meta\b[^>]*name=[\"']description[\"'][^>]*>", 0)
    return F.nullif(F.left(F.trim(F.regexp_extract(tag, r"(?is)content=[\"']([^\"']*)[\"']", 1)), F.lit(most)), F.lit(""))


def social_links(links: Column, most: int = 2) -> Column:
    """The first targets at social networks."""
    return F.slice(F.filter(links, lambda u: ident.domain(u).isin("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com")), 1, most)


def third_party_page(url: Column, name: Column) -> Column:
    """A page about a company on someone else's site: a distinctive word of the name stands in the path, none in the host."""
    behind = F.regexp_replace(F.lower(url), "^[a-z]+://", "")
    host = F.substring_index(behind, "/", 1)
    words = text.distinctive_tokens(text.norm_name(name))
    path = F.substring(behind, F.length(host) + 1, F.length(behind))
    return F.exists(words, lambda w: path.contains(w)) & ~F.exists(words, lambda w: host.contains(w))
