"""Upkeep operators and export functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import export
from tessera.operators import upkeep


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "national", "mobile"),
    [("+34954123456", "954123456", False), ("0034 600 123 456", "600123456", True), ("600123456", "600123456", True), (" +351210000000 ", "+351210000000", False)],
)
def test_national_phone(spark, raw, national, mobile):
    c = export.national_phone(F.col("n"))
    assert one(spark, c, n=raw) == national
    assert one(spark, export.is_mobile(c), n=raw) == mobile


@pytest.mark.parametrize(
    ("raw", "shown"),
    [("ALCALA DE GUADAIRA", "Alcala de Guadaira"), ("(dos hermanas)", "(Dos Hermanas)"), ("La McCoy", "La McCoy"), ("DE LA O", "De la o"), ("", ""), (None, None)],
)
def test_capitalised(spark, raw, shown):
    assert one(spark, export.capitalised(F.col("n")), n=raw) == shown


def test_short_descriptions(spark):
    assert one(spark, export.activity(F.col("n"), 12), n="obras y, más reformas") == "obras y…"
    assert one(spark, export.activity(F.col("n"), 12), n=" a \n b ") == "a b"
    assert one(spark, export.activity(F.col("n")), n=None) == ""


def test_csv_cells(spark):
    assert one(spark, export.csv_line(F.col("a"), F.col("b"), F.col("c")), a='x "y", z', b=None, c=3) == '"x ""y"", z",,3'


def test_codes_without_a_mark(spark):
    assert tuple(one(spark, export.explicit_codes(F.col("n")), n="CNAE 4321 y 43.22 / a")) == (None, [])
    assert tuple(one(spark, export.explicit_codes(F.col("n")), n=None)) == (None, [])


def test_evidence_in_a_sites_text(spark):
    site = "Talleres Ñandú, tel. 954 12 34 56, Info@Nandu.es, CIF b00000000"
    found = lambda phones, emails, nif, name: one(spark, export.evidence_in_text(F.lit(site), F.col("p"), F.col("m"), F.col("n"), F.col("t")), p=phones, m=emails, n=nif, t=name)
    assert found(["+34954123456"], [""], None, None) == "phone"
    assert found(["1"], ["info@nandu.es"], None, None) == "email"
    assert found(["1"], [""], "B00000000", None) == "nif"
    assert found(["1"], [""], "", "Ñandú Talleres, S.L.") == "name"
    assert found(["1"], [""], "", "Otros") is None


def test_lists_of_contacts(spark):
    phones = F.array(F.lit("+351210000000"), F.lit("+34600000001"))
    assert one(spark, export.without_foreign(phones), n=1) == ["+34600000001"]
    assert one(spark, export.directory_page(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("string")), phones), n=1)
    assert not one(spark, export.directory_page(F.array_repeat(F.lit("a"), 20), phones), n=1)


def test_a_decided_conflict_stays_closed_until_its_values_change(spark):
    schema = "entity string, field string, values array<string>"
    found = spark.createDataFrame([("a", "web", ["x", "y"], "r"), ("b", "web", ["x", "y"], "r")], f"{schema}, reason string")
    decided = spark.createDataFrame([("a", "web", ["y", "x"], 1), ("b", "web", ["y", "x"], 1), ("b", "web", ["z"], 2)], f"{schema}, decided_at int")
    held = spark.createDataFrame([], f"{schema}, reason string")
    assert [r["entity"] for r in upkeep.upsert_conflicts(held, found, decided, "auto").collect()] == ["b"]


def test_a_channel_stays_if_the_reading_found_nothing_of_its_kind(spark):
    evidence = spark.createDataFrame([(1, "phone", "a", "web"), (2, "phone", "a", "web"), (2, "phone", "b", "maps")], "company_id long, kind string, value string, source string")
    reread = spark.createDataFrame([(1, "email", "m"), (2, "phone", "c")], "company_id long, kind string, value string")
    assert [tuple(r) for r in upkeep.retired_channels(evidence, reread).collect()] == [(2, "phone", "a")]


def test_reviewed_results_are_never_swept(spark):
    rows = spark.createDataFrame([(1, None, True), (2, None, False), (3, "relevante", False)], "id long, verdict string, reviewed boolean")
    out = upkeep.swept(rows, F.when(F.col("id") == 3, "why"), unseen="dudoso")
    assert {r["id"]: (r["verdict"], r["reason"]) for r in out.collect()} == {1: (None, None), 2: ("dudoso", None), 3: ("descartado", "why")}
