"""Company registry gazette: XML listings of a province and day to acts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SPACES, let, norm_text

# The words by which the gazette's text names kinds of acts, plain and in small letters;
# those of WHOLE_WORDS count as whole words only.
ACT_KINDS = {
    "constitucion": "constitucion",
    "disolucion": "disolucion",
    "extincion": "extincion",
    "cambio_domicilio": "cambio de domicilio social",
    "cambio_denominacion": "cambio de denominacion",
    "concurso": "concurso",
}
WHOLE_WORDS = ["constitucion", "disolucion", "extincion", "concurso"]
# The gazette's names of roles, without full stops.
ROLES = {
    "administrador_unico": "Adm Unico",
    "administrador_solidario": "Adm Solid",
    "administrador_mancomunado": "Adm Mancom",
    "consejero_delegado": "Consejero Delegado",
    "consejero": "Consejero",
    "presidente": "Presidente",
}
# Headings of the sections that follow an address, and of those that follow a purpose.
AFTER_ADDRESS = ["Capital", "Nombramiento", "Nombramientos", "Datos registrales", "Declaración", "Declaracion", "Otros conceptos", "Cambio de objeto social", "Modificaciones estatutarias"]
AFTER_PURPOSE = ["Domicilio", "Capital", "Nombramientos", "Datos registrales"]

#: A listing in the source's form, with made-up contents.
EXAMPLE = """<documento><metadatos><identificador>BOL-A-1</identificador><fecha_publicacion>20240102</fecha_publicacion></metadatos><texto>
<p class="articulo">101 - EJEMPLO UNO SL.</p>
<p class="parrafo">Constitución. Objeto social: Venta de muebles. Domicilio: C/ MAYOR 1 - CP 41001 (SEVILLA). Capital: 3.000,00 Euros. Nombramientos. Adm. Unico: PEREZ ANA. Datos registrales. S 8 , H SE 12345, I/A 1.</p>
<p class="articulo">102 - EJEMPLO DOS SA.</p>
<p class="parrafo">Disolución. Voluntaria. Extinción. Nombramientos. Adm. Solid.: RUIZ EVA;GIL LUZ. Datos registrales. S 8 , H M54321, I/A 3.</p>
</texto></documento>"""

LISTING = "metadatos struct<identificador:string,fecha_publicacion:string>, texto struct<p:array<struct<_VALUE:string,_class:string>>>"


def _blank_null(c: Column) -> Column:
    return F.when(c != "", c)


def _after(body: Column, *labels: str) -> Column:
    """What follows the earliest of some labels; null if there is none."""
    at = F.array_min(F.array(*[F.when(F.instr(body, label) > 0, F.struct(F.instr(body, label).alias("at"), F.lit(len(label)).alias("n"))) for label in labels]))
    return F.ltrim(F.substring(body, at["at"] + at["n"], F.length(body)))


def _until(text: Column, headings: list[str]) -> Column:
    """A section's text up to the first sentence that begins with another section's heading."""
    end = F.regexp_instr(text, F.lit(rf"[.][{SPACES}-]*(?:{'|'.join(headings)})\b"))
    return F.when(end > 0, F.left(text, end - 1)).otherwise(F.regexp_replace(text, r"[.]\s*$", ""))


def _postal_code(address: Column, before_town: Column) -> Column:
    """Five digits (a full stop may part the first two) that stand behind a label, or else at the end."""
    whole = F.regexp_replace(F.upper(address), r"\b([0-9]{2})[.]([0-9]{3})\b", "$1$2")
    # one sign between words: parting at a longer pattern would read that anew for each row
    words = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"(?<=[A-ZÓ])[.:]+", " "), r"\b(CP)(?=[0-9])", "$1 "), rf"[:{SPACES}]+", " "), " ")

    def labelled(w: Column, i: Column, held: Column) -> Column:
        one, two = F.get(held, i - 1), F.get(held, i - 2)
        return w.rlike("^[0-9]{5}(?![0-9A-Z])") & ((one == "CP") | ((one == "P") & (two == "C")) | ((one == "POSTAL") & two.isin("CODIGO", "CÓDIGO")))

    marked = let(words, lambda held: F.filter(F.transform(held, lambda w, i: F.when(labelled(w, i, held), F.left(w, F.lit(5)))), lambda x: x.isNotNull()))
    end = F.regexp_extract(F.rtrim(F.regexp_replace(before_town, r"([0-9]{2})[.]([0-9]{3})", "$1$2"), F.lit(" ,-")), r"(?<![0-9])([0-9]{5})\z", 1)
    return F.coalesce(F.get(marked, F.lit(0)), _blank_null(end))


def _people(body: Column) -> Column:
    """array<struct<name, role>>: a sentence of names behind a role, in the order of ROLES."""
    # the full stops of the roles' abbreviations end no sentence
    spelt = F.regexp_replace(F.regexp_replace(body, r"\bAdm\.\s*", "Adm "), r"(Adm (?:Solid|Mancom))\.", "$1")
    parted = lambda x: F.struct(F.regexp_replace(F.rtrim(F.substring_index(x, ":", 1)), r"\s+", " ").alias("head"), F.substring(x, F.instr(x, ":") + 1, F.length(x)).alias("names"))
    said = let(F.split(spelt, r"\."), lambda ended: F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), parted))
    # read once for all roles
    return let(F.filter(said, lambda x: F.length(x["names"]) > 0), lambda held: F.flatten(F.array(*[_named(held, role, title) for role, title in ROLES.items()])))


def _named(held: Column, role: str, title: str) -> Column:
    lists = F.transform(F.filter(held, lambda x: x["head"].endswith(title)), lambda x: F.split(x["names"], ";"))
    names = F.filter(F.transform(F.flatten(lists), lambda n: F.trim(n)), lambda n: n != "")
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(role).alias("role")))


def act_fields(body: Column, keep: Callable[[str, Column], Column] = lambda name, c: c) -> dict[str, Column]:
    """Everything that an act's paragraph says, section by section.

    ``keep`` is asked for each value that several others look at; it may make it
    a column of its own, so that the value is computed once a row.
    """
    plain = keep("_plain", F.concat(F.lit(" "), norm_text(body), F.lit(" ")))
    kinds = {k: plain.contains(f" {words} " if words in WHOLE_WORDS else words) for k, words in ACT_KINDS.items()}
    domicile = keep("_domicile", _after(body, "Domicilio:", "Cambio de domicilio social."))
    said = F.regexp_replace(_until(domicile, AFTER_ADDRESS), r"\s+", " ")
    address = keep("_address", F.coalesce(F.trim(said, F.lit(" .,-")), F.lit("")))
    tail = keep("_tail", F.substring_index(address, "(", -1))
    in_brackets = keep("_brackets", F.substring_index(tail, ")", 1))
    has_town = keep("_town", address.endswith(")") & address.contains("(") & (F.length(in_brackets) + 1 == F.length(tail)) & (in_brackets != ""))
    before_town = F.when(has_town, F.left(address, F.length(address) - F.length(in_brackets) - 2)).otherwise(address)
    capital = keep("_capital", _after(body, "Capital:"))
    amount = keep("_amount", F.trim(F.substring_index(capital, "Euros", 1)))
    purpose = keep("_purpose", _after(body, "Objeto social:"))
    return {
        "kinds": F.array_compact(F.array(*[F.when(said_so, k) for k, said_so in kinds.items()])),
        "address": _blank_null(address),
        "postal_code": F.when(address != "", _postal_code(address, before_town)),
        "municipality": F.when(has_town, F.trim(in_brackets)),
        "sheet": _blank_null(F.replace(F.regexp_extract(body, r"\bH ?([A-Z]{1,2} ?[0-9]+)", 1), F.lit(" "), F.lit(""))),
        "purpose": _blank_null(F.trim(_until(purpose, AFTER_PURPOSE))),
        "capital": F.when(amount.rlike("^[0-9.,]+$") & capital.contains("Euros"), amount),
        "people": _people(body),
    }


def acts(listings: DataFrame, xml: str = "xml") -> DataFrame:
    """One row an act: a paragraph of class ``parrafo`` that directly follows one of class ``articulo``.

    Malformed listings give no acts.
    """
    doc = listings.select(F.from_xml(F.col(xml), LISTING).alias("d"))
    p = F.col("d.texto.p")
    titled = F.transform(p, lambda x, i: F.struct(F.get(p, i - 1).alias("head"), x.alias("body")))
    pairs = F.filter(titled, lambda t: (t["body"]["_class"] == "parrafo") & (t["head"]["_class"] == "articulo"))
    rows = doc.select(F.col("d.metadatos.identificador").alias("issue"), F.col("d.metadatos.fecha_publicacion").alias("published"), F.explode(pairs).alias("t"))
    head = F.trim("t.head._VALUE")
    rows = rows.select("issue", "published", head.alias("head"), F.coalesce("t.body._VALUE", F.lit("")).alias("body"))
    number = _blank_null(F.regexp_extract("head", r"^(\d+)\s*-\s*.+", 1))
    name = F.trim(F.regexp_replace(F.regexp_replace("head", r"^\d+\s*-\s*", ""), r"\.\s*$", ""))

    def keep(kept: str, c: Column) -> Column:
        nonlocal rows
        rows = rows.withColumn(kept, c)
        return F.col(kept)

    fields = act_fields(F.col("body"), keep)
    out = rows.select("issue", "published", number.alias("act_id"), name.alias("name"), *[c.alias(k) for k, c in fields.items()])
    gone = F.arrays_overlap("kinds", F.array(F.lit("extincion"), F.lit("disolucion")))
    return out.withColumn("state", F.when(gone, "disuelta"))


def by_name(index: DataFrame, names: DataFrame, name_key: str = "name_key", newest: int = 5) -> DataFrame:
    """The ``newest`` acts of each normalised name asked for."""
    from pyspark.sql import Window as W

    order = W.partitionBy(name_key).orderBy(F.desc("published"), "act_id")
    found = index.join(names.select(name_key).distinct(), name_key, "left_semi")
    return found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= newest).drop("_at")


def index_path_writer(acts_of_days: DataFrame, path: str) -> None:
    """Append acts to an index that range scans prune by province and day."""
    acts_of_days.write.mode("append").partitionBy("province", "published").parquet(path)
