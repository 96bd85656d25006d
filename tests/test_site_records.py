"""People, records and decided alternatives of sites against plain Python, and odd rows."""

import os
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import alternatives, site_records
from tessera.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(s):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()).strip()


def believed(name, role, body):
    """A model's person, checked one by one."""
    words = plain(name or "").replace(".", " ").split()
    if not name or "\n" in name or re.search(r"[\d@|/]", name) or not 2 <= len(words) <= 5 or set(words) & set(site_records.NO_NAME):
        return False
    if "\n" in (role or ""):
        return False
    page = plain(body or "")
    key = next((w for w in re.findall("[a-z]{4,}", plain(role or "")) if w not in site_records.NO_ROLE), None)
    spots = [m.span() for m in re.finditer(re.escape(plain(name)), page)]
    return bool(spots) and (key is None or any(key in page[max(0, a - 120) : b + 120] for a, b in spots))


def test_people_against_one_by_one(spark):
    pages = {
        1: "Equipo. Ana  Ruiz\nGil, Gerente. " + "x" * 130 + " Eva Sol " + "y" * 118 + "jefa de obra", 2: "Eva Sol " + "-" * 119 + "Gerente", 3: "Eva Sol " + "-" * 112 + "Gerente",
        4: None, 5: "", 6: "Gerente " + "-" * 112 + "Éva Sól y Eva Sol.*", 7: "Ana Ruiz Gil " * 40 + "comercial",
    }
    asked = [("Ana Ruiz Gil", "Gerente"), ("Eva Sol", "Gerente"), ("Eva Sol", "Jefa de obra"), ("Eva Sol", None), ("Eva Sol", "Contacto"), ("Eva", "Gerente"), ("Eva Sol 2", None), ("Gerente Eva", None), ("Eva\nSol", None), ("Eva Sol.*", ""), (None, "Gerente"), ("Ana Ruiz Gil", "Comercial"), ("Eva Sol", "Persona\nde contacto")]
    sites = spark.createDataFrame([(k, t) for k, t in pages.items()], "site long, text string")
    people = spark.createDataFrame([(k, n, r) for k in pages for n, r in asked], "site long, name string, role string")
    found = sorted(map(tuple, site_records.told_people(sites, people).collect()), key=repr)
    wanted = sorted(((k, n, r) for k, t in pages.items() for n, r in asked if believed(n, r, t)), key=repr)
    assert found == wanted and len(wanted) > 10
    assert site_records.told_people(sites.limit(0), people.limit(0)).count() == 0


def test_records_of_odd_sites(spark):
    many = " ".join(f"954 12 34 {n}" for n in range(10, 30))
    rows = [(1, None, None), (2, "", "x.es"), (3, many, "x.es"), (4, "Titular: Universidad de Sol S.L., x", None), (5, "Titular: Hosting Sol S.L., x\nCIF: B-12345674", None), (6, "Titular: Obras Sol S.L., x\nGerente: Ana Ruiz Gil\nGerente: Ana Ruiz Gil", None)]
    found = {r["site"]: r for r in site_records.site_records(spark.createDataFrame(rows, "site long, text string, domain string")).collect()}
    assert set(found) == {1, 2, 5, 6}
    assert found[1]["name"] is None and found[1]["phones"] == [] and found[2]["web"] == "x.es"
    assert found[5]["name"] is None and found[5]["nif"] is None and found[5]["dropped_name"].startswith("Hosting")
    assert [tuple(p) for p in found[6]["people"]] == [("Ana Ruiz Gil", "Gerente")]


def test_record_matches(spark):
    kinds = "n string, p array<string>, m string, q array<string>, a boolean"
    rows = [("b1", [], "B1", [], None), (None, [], None, [], None), ("", [], "", [], False), ("b1", ["+34 600 00 00 01"], "b2", ["600000001"], False), ("b1", ["1"], "b2", ["1"], False), (None, None, None, None, True), (None, [None], None, ["600000001", None], None)]
    df = spark.createDataFrame(rows, kinds).select(site_records.record_matches(*[F.col(c) for c in "npmqa"]).alias("x"))
    assert [r["x"] for r in df.collect()] == [True, False, False, True, False, True, False]


def test_alternatives_against_word_by_word(spark, monkeypatch):
    monkeypatch.setattr(alternatives, "BLOCK_PATTERNS", 2)
    bodies = {1: "Aviso de Obras Sol y Luna SL, B-123 45674", 2: "obrasol", 3: None, 4: "Obras Sol. Obras Luna", 5: "a b c d e f"}
    listed = [
        (10, 1, "nif", ["b12345674", "A1"]), (11, 1, "razon_social", ["Obras Sol SL", "Luna", "Sol y"]), (12, 1, "razon_social", ["Luna", "Marte"]), (13, 2, "razon_social", ["Obras Sol", "sol"]), (14, 3, "nif", ["A1"]),
        (15, 4, "razon_social", ["Obras Sol", "Obras Luna"]), (16, 4, "razon_social", ["Obras Luna", "Obras Luna"]), (17, 1, "web", ["luna"]), (18, 5, "razon_social", ["", None]), (19, 5, "razon_social", None), (20, 9, "nif", ["A1"]),
        (21, 5, "razon_social", [f"{x} {y}" for x in "xyzw" for y in "uvtr"] + ["c d"]),
    ]
    conflicts = spark.createDataFrame(listed, "conflict_id long, site long, field string, alternatives array<string>")
    texts = spark.createDataFrame(list(bodies.items()), "site long, text string")
    norm = {r["v"]: r["n"] for r in conflicts.select(F.explode("alternatives").alias("v")).distinct().select("v", text.norm_name(F.coalesce("v", F.lit(""))).alias("n")).collect()}
    page = {r["site"]: r["t"] for r in texts.select("site", text.norm_text(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    wanted = {}
    for key, site, field, values in listed:
        body = bodies.get(site) or ""
        if field == "nif":
            shown = [v for v in values or [] if v and v.upper() in body.upper().replace("-", "").replace(" ", "")]
        else:
            shown = [v for v in values or [] if field == "razon_social" and norm[v] and f" {norm[v]} " in f" {page.get(site, '')} "]
        if len(shown) == 1:
            wanted[key] = shown[0]
    found = {r["conflict_id"]: r["value"] for r in alternatives.only_alternatives(conflicts, texts).collect()}
    assert found == wanted and {10, 12, 21} <= set(wanted)


def test_alternatives_on_pages_have_one_row_a_page(spark):
    rows = QUERIES["alternatives_on_pages"](spark, SF).collect()
    assert len({r["conflict_id"] for r in rows}) == len(rows) > 0
