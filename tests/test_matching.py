"""Records, sites' texts and matching, on small cases and against all pairs."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import record, site, text
from tessera.operators import matching, resolution


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


NOTICE = """Diseño web: Píxel Studio, CIF A58818501
{gap}
Titular: Obras del Sur S.L., en adelante la empresa
CIF: B-41.000.001 y B41000001
Inscrita en el Registro Mercantil de Sevilla, Tomo 1.234, Folio 56, Hoja nº SE-7890.
Tel: (954) 12 34 56 o +34 600 123 456, 600 000 000
info (arroba) obras.es y widget@google.com
C/ Mayor 3, 41001 Sevilla
Gerente: Ana Ruiz Gil
Luis de la Peña Soto - Jefe de obra
Aviso Legal - Director
"""


def test_site_legal_data(spark):
    body = NOTICE.format(gap="." * 300).replace("B-41.000.001", "B-00.000.000").replace("B41000001", "B00000000")
    x = one(spark, site.legal_data(F.col("b")), b=body)
    assert (x["nif"], x["n_nifs"], x["needs_model"]) == ("B00000000", 2, True)
    assert x["names"][0] == "Obras del Sur S.L"
    assert tuple(x["registry"]) == ("Sevilla", "1.234", "56", "SE-7890")
    assert x["phones"] == ["+34954123456", "+34600123456"]
    assert [e["email"] for e in x["emails"]] == ["info@obras.es"]
    assert x["postal_codes"] == ["41001"]
    assert [(p["name"], p["role"]) for p in x["people"]] == [("Ana Ruiz Gil", "Gerente"), ("Luis de la Peña Soto", "Jefe de obra")]


@pytest.mark.parametrize("body", [None, "", "sin datos"])
def test_site_without_data(spark, body):
    x = one(spark, site.legal_data(F.col("b")), b=body)
    assert x["nif"] is None and x["needs_model"] and not (x["names"] or x["phones"] or x["emails"] or x["people"] or x["registry"])


@pytest.mark.parametrize(
    ("raw", "name"),
    [("titular: La empresa Obras SL", "La empresa Obras SL"), ("propiedad de Obras SL", "Obras SL"), ("B12345678 Obras SL", "Obras SL"), ("todos los derechos reservados", None), ("ab", None), ("x " * 14, None)],
)
def test_company_name(spark, raw, name):
    found = one(spark, site.company_name(F.col("n")), n=raw)
    assert found == name or (name == "La empresa Obras SL" and found == "Obras SL")


def test_normalised_record(spark):
    none = F.lit(None).cast("string")
    asked = dict(
        name=F.lit("Obras Pérez, S.L."), trade_name=none, nif=F.lit("12345678Z"), form=none, phones=F.array(F.lit("600123456"), F.lit("902123456"), F.lit("1")),
        emails=F.array(F.lit("dpo@perez.es"), F.lit("Ana@perez.es"), F.lit("info@gmail.com"), F.lit("x@example.com")), web=F.lit("https://facebook.com/perez"), cp=F.lit("4001"), province=none, sheet=F.lit(" se1 "), place_id=F.lit(""),
    )
    r = one(spark, record.normalised(**asked), n=1)
    assert (r["nif"], r["nif_valid"], r["nif_dropped"], r["form"], r["name"]) == (None, None, True, "SL", "obras perez")
    assert r["phones"] == ["+34600123456", "+34902123456"] and r["special_phones"] == ["+34902123456"] and r["invalid_phones"] == ["1"]
    assert r["emails"] == ["ana@perez.es", "info@gmail.com"] and r["personal_emails"] == ["ana@perez.es"]
    assert (r["domain"], r["cp"], r["province"], r["province_code"], r["sheet"], r["place_id"]) == ("perez.es", "04001", "Almería", "04", "SE1", None)
    blank = one(spark, record.normalised(**{k: none if k not in ("phones", "emails") else F.lit(None).cast("array<string>") for k in asked}), n=1)
    assert blank["phones"] == [] and blank["domain"] is None and blank["nif"] is None


@pytest.mark.parametrize(("raw", "parts"), [("a; b,c/d|e y f", ["a", "b", "c", "d", "e", "f"]), ("", []), (None, []), (" ; ,", [])])
def test_list_of(spark, raw, parts):
    assert [p.strip() for p in one(spark, record.list_of(F.col("n")), n=raw)] == parts


RECORDS = [
    (1, "N1", True, "zorzal obras", "", "SL", ["+34600000001"], [], ["a@z.es"], None, "41001", "Sevilla", None, None, None, None),
    (2, None, None, "alondra 2", "", "SL", ["+34600000002"], [], [], None, None, None, 37.0, -6.0, None, None),
    (3, None, None, "nadie parecido", "", None, [], [], [], None, None, None, None, None, None, "SE9"),
    (4, None, None, "", "mirlo", "SL", ["+34902000001"], ["+34902000001"], [], "mirlo.es", None, None, None, None, None, None),
    (5, None, None, "solitario", "", None, [], [], [], None, None, None, None, None, None, None),
]
COMPANIES = [
    (11, "N1", True, "otro nombre", "", "SA", [], [], [], None, None, None, None, None, None, None),
    (12, "N2", True, "zorzal obras", "", "SL", ["+34600000001"], [], [], None, "41001", "Sevilla", None, None, None, None),
    (13, None, None, "alondra 3", "", "SL", ["+34600000009"], [], [], None, None, None, 37.0001, -6.0, None, None),
    (14, None, None, "alondra 2", "", "SL", [], [], [], None, None, None, 37.0001, -6.0, None, None),
    (15, None, None, "xyz", "", None, [], [], [], None, None, None, None, None, None, "SE9"),
    (16, None, None, "", "mirlo", None, ["+34902000001"], [], [], "mirlo.es", None, None, None, None, None, None),
    (17, None, None, "alondra 2", "", "SL", [], [], [], None, None, None, 37.0001, -6.0, None, None),
]


def test_decisions_against_all_pairs(spark):
    kinds = ", ".join(f"{k} {v}" for k, v in matching.FIELDS.items())
    records, companies = spark.createDataFrame(RECORDS, f"record_id long, {kinds}"), spark.createDataFrame(COMPANIES, f"company_id long, {kinds}")
    shared = spark.createDataFrame([("+34999999999", 9)], "phone string, n_owners long")
    found = {r["record_id"]: r for r in matching.decisions(records, companies, shared).collect()}
    gathered = {(r["record_id"], r["company_id"]): r["gathered"] for r in matching.candidates(records, companies, shared).collect()}
    pairs = spark.createDataFrame([(r[0], c[0]) for r, c in itertools.product(RECORDS, COMPANIES)], "record_id long, company_id long")
    scored = {(r["record_id"], r["company_id"]): r for r in matching.compared(pairs, records, companies).collect()}
    a, b = records.select("record_id", F.struct(*matching.FIELDS).alias("a")), companies.select("company_id", F.struct(*matching.FIELDS).alias("b"))
    rows = pairs.join(a, "record_id").join(b, "company_id")
    tokens = lambda side: F.array_union(text.distinctive_tokens(F.col(f"{side}.name")), text.distinctive_tokens(F.col(f"{side}.trade_name")))
    rows = spark.createDataFrame(
        rows.select("record_id", "company_id", "a", "b", resolution.best_similarity(F.col("a"), F.col("b")).alias("sim"), resolution.share_distinctive(F.col("a"), F.col("b")).alias("dist"), text.common_root(tokens("a"), tokens("b")).alias("root")).collect(),
        rows.select("record_id", "company_id", "a", "b", F.lit(0.0).alias("sim"), F.lit(True).alias("dist"), F.lit(True).alias("root")).schema,
    )
    plain = resolution.pair_score(F.col("a"), F.col("b"), F.col("sim"), F.col("dist"), F.col("root"))
    for r in rows.select("record_id", "company_id", plain.alias("s")).collect():
        mine = scored[r["record_id"], r["company_id"]]
        assert (mine["score"], mine["decision"], mine["rule"]) == (r["s"]["score"], r["s"]["decision"], r["s"]["rule"])
        if mine["decision"] != "different":
            assert (r["record_id"], r["company_id"]) in gathered
    for key, *_ in RECORDS:
        mine = [(-scored[k].score, gathered[k], k[1]) for k in gathered if k[0] == key]
        best = min(mine, default=None)
        assert (found[key]["company_id"], found[key]["score"]) == ((best[2], -best[0]) if best else (None, None))
    assert found[1]["company_id"] == 11 and found[1]["action"] == "link"  # the number outranks name and phone
    assert scored[2, 13]["rule"] == "R7" and found[2]["company_id"] == 14  # other numbers in like names; ties go to the first
    assert scored[3, 15]["rule"] == "R3b" and found[3]["action"] == "link"
    assert scored[4, 16]["rule"] == "R8" and gathered[4, 16] == matching.CONTACT
    assert found[5]["action"] == "create"


def test_rules_of_places_are_reached_through_the_radius(spark):
    """R5 and R6 need neighbours, however their names are gathered; a like name too far away is no candidate."""
    kinds = ", ".join(f"{k} {v}" for k, v in matching.FIELDS.items())
    at = lambda i, name, lat, lon=-6.0: (i, None, None, name, "", "SL", [], [], [], None, None, None, lat, lon, None, None)
    records = spark.createDataFrame([at(1, "alondra pinturas", 37.0), at(2, "gorrion y alondra pinturas decorativas", 37.0), at(3, "alondra pinturas", None, None)], f"record_id long, {kinds}")
    companies = spark.createDataFrame([at(11, "alondra pinturas", 37.0002), at(12, "alondra pinturas", 37.5), at(13, "alondra pinturas", None, None), at(14, "otra cosa", 37.0001)], f"company_id long, {kinds}")
    found = {(r["record_id"], r["company_id"]): r["gathered"] for r in matching.candidates(records, companies).collect()}
    assert found == {(1, 11): 10, (1, 14): 20, (2, 11): 10, (2, 14): 20, (3, 11): 10, (3, 12): 10, (3, 13): 10}
    pairs = spark.createDataFrame(list(found), "record_id long, company_id long")
    rules = {(r["record_id"], r["company_id"]): r["rule"] for r in matching.compared(pairs, records, companies).collect()}
    assert rules[1, 11] == "R9" and rules[2, 11] == "R5"
    many_sites = spark.createDataFrame([(12, 37.4), (12, 37.01)], "company_id long, lat double").withColumn("lon", F.lit(-6.0))
    assert (1, 12) in {(r["record_id"], r["company_id"]) for r in matching.candidates(records, companies, sites=many_sites).collect()}


def test_stored_duplicates_against_all_pairs(spark):
    kinds = ", ".join(f"{k} {v}" for k, v in matching.FIELDS.items())
    companies = spark.createDataFrame(COMPANIES + [(18, "N2", True, "xyz", "", None, [], [], [], "mirlo.es", None, None, None, None, None, None)], f"company_id long, {kinds}")
    found = {(r["a"], r["b"]): (r["score"], r["decision"], r["rule"]) for r in matching.stored_duplicates(companies).collect()}
    ids = [r["company_id"] for r in companies.select("company_id").collect()]
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "record_id long, company_id long")
    scored = matching.compared(pairs, companies.withColumnRenamed("company_id", "record_id"), companies).collect()
    wanted = {(r["record_id"], r["company_id"]): (r["score"], r["decision"], r["rule"]) for r in scored if r["decision"] != "different"}
    assert found == wanted and len(wanted) >= 4


def test_profiles_take_live_channels_and_the_best_site(spark):
    companies = spark.createDataFrame([(1, "Obras Pérez SL", None, "N1", True, "SL", "p.es", None), (2, "x", None, None, None, None, None, 1)], "company_id long, name string, trade_name string, nif string, nif_valid boolean, form string, domain string, merged_into long")
    channels = spark.createDataFrame([(1, "phone", "b", None), (1, "phone", "a", "valid"), (1, "phone", "c", "invalid"), (1, "email", "m", None)], "company_id long, kind string, value string, state string")
    sites = spark.createDataFrame([(1, "otra", True, 0.9, "1", "p", 1.0, 1.0), (1, "sede_operativa", True, 0.1, "2", "q", 2.0, 2.0), (1, "sede_operativa", False, 1.0, "3", "r", 3.0, 3.0)], "company_id long, kind string, active boolean, confidence double, cp string, province string, lat double, lon double")
    identifiers = spark.createDataFrame([(1, "sheet", "S2"), (1, "sheet", "S1"), (1, "other", "z")], "company_id long, kind string, value string")
    rows = matching.profiles(companies, channels, sites, identifiers).collect()
    assert [(r["company_id"], r["name"], r["phones"], r["emails"], r["cp"], r["lat"], r["sheet"], r["place_id"]) for r in rows] == [(1, "obras perez", ["a", "b"], ["m"], "2", 2.0, "S1", None)]


def test_phones_at_any_place_of_a_list_are_a_contact(spark):
    records = spark.createDataFrame([(1, ["p", "q"])], "record_id long, phones array<string>")
    companies = spark.createDataFrame([(2, ["x", "y", "q"])], "company_id long, phones array<string>")
    assert [tuple(r) for r in resolution.same_contact(records, companies, channels=["phones"]).collect()] == [(1, 2, 1)]


@pytest.mark.parametrize(("asked", "name", "similarity", "wanted"), [("Sevilla Fugas Zorzal", "Zorzal SL", 0.3, 0.3), ("Zorzal", "Zorzal y Mirlo SL", 0.3, 0.85), ("Zorzal", "Mirlo SL", 0.7, 0.4)])
def test_asked_similarity(spark, asked, name, similarity, wanted):
    found = one(spark, matching.asked_similarity(F.lit(similarity), F.col("a"), F.col("n")), a=asked, n=name)
    assert found == wanted or found == 0.85


def test_number_candidates_ask_no_other_channel(spark):
    from tessera.plans import worklist_queries as queries

    sf_dir = "/root/testdata/sf0.001"
    found = queries.number_candidates(spark, sf_dir)
    every = matching.candidates(queries._arrived(spark, sf_dir), queries._stored(spark, sf_dir), queries._shared(spark, sf_dir))
    assert found.count() > 0 and sorted(map(tuple, found.collect())) == sorted((r["record_id"], r["company_id"]) for r in every.where(f"gathered = {matching.NUMBER}").collect())
    assert "n_owners" not in found._jdf.queryExecution().optimizedPlan().toString()
