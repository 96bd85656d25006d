"""Steps that must not grow faster than their tables: no table through the driver, none in one task, no pairs of copies."""

import random

from pyspark.sql import functions as F

from tessera.functions import ident, site
from tessera.operators import matching, resolution
from tessera.operators.graph import components
from tessera.operators.joins import tiled_join
from tessera.plans.queries import QUERIES
from tessera.sources import gazette

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_are_merged_and_dealt(spark):
    rows = spark.range(50).select(F.col("id"), (F.col("id") % 5).alias("k"))
    wanted = {(a, b) for a in range(50) for b in range(50) if a % 5 == b % 5}
    for even in (False, True):
        found = tiled_join(rows.toDF("a", "k"), rows.toDF("b", "k"), ["k"], rows=4, even=even)
        assert {(r["a"], r["b"]) for r in found.collect()} == wanted
        assert "strategy=merge" in plan(found)
    assert plan(found).count("RepartitionByExpression") == 2


def test_queries_deal_pairs_and_dear_rows(spark):
    for name in ("pair_scores", "shared_key_pairs", "haversine_band"):
        assert plan(QUERIES[name](spark, SF)).count("RepartitionByExpression") == 2, name
    assert plan(QUERIES["decided_alternatives"](spark, SF)).count("strategy=merge") == 3
    assert "Repartition " in plan(QUERIES["gazette_acts"](spark, SF))


def test_phone_stars_join_what_all_pairs_join(spark):
    rng = random.Random(3)
    cards = [(i, rng.choice([None, f"n{rng.randrange(9)}"]), rng.choice(["ana", "eva", "luz", None]), rng.sample("pqrstuvwxyz", 2)) for i in range(60)]
    alike = {("ana", "ana"), ("eva", "eva"), ("luz", "luz"), ("ana", "eva"), ("eva", "ana")}
    pairs = [(a[0], b[0]) for i, a in enumerate(cards) for b in cards[i + 1 :] if (a[2], b[2]) in alike and set(a[3]) & set(b[3]) and not (a[1] and b[1] and a[1] != b[1])]
    numbers = [(a[0], b[0]) for i, a in enumerate(cards) for b in cards[i + 1 :] if a[1] and a[1] == b[1]]
    table = spark.createDataFrame(cards, "card long, nif string, name string, phones array<string>")
    stars = resolution.phone_stars(table, spark.createDataFrame(list(alike), "a_name string, b_name string"))
    assert {tuple(r) for r in stars.collect()} <= set(pairs)
    parts = lambda links: {tuple(r) for r in components(links).collect()}
    equal = spark.createDataFrame(numbers, "a long, b long")
    assert parts(stars.union(equal)) == parts(spark.createDataFrame(pairs + numbers, "a long, b long"))
    crowd = spark.createDataFrame([(i, None, "ana", ["p"]) for i in range(300)], table.schema)
    assert resolution.phone_stars(crowd, spark.createDataFrame([("ana", "ana")], "a_name string, b_name string")).count() == 299


def test_homonym_classes_expand_to_homonyms(spark):
    rows = [(1, "Obras Perez SL", "S1"), (2, "Obras Perez", "S2"), (3, "Obras Peres SA", "S1"), (4, "Obras Perez", "S1"), (5, "Otra cosa", "S9"), (6, None, "S9"), (7, "Obras Perez", None)]
    companies = spark.createDataFrame(rows, "company_id long, name string, sheet string")
    found = matching.homonym_classes(companies).collect()
    members = [r for r in found if r["kind"] == "member"]
    ratios = {(r["a"], r["b"]): r["ratio"] for r in found if r["kind"] == "pair"}
    expanded = set()
    for x in members:
        for y in members:
            ratio = 100.0 if x["b"] == y["b"] else ratios.get((min(x["b"], y["b"]), max(x["b"], y["b"])))
            if x["a"] < y["a"] and x["sheet"] != y["sheet"] and ratio is not None:
                expanded.add((x["a"], y["a"], ratio))
    assert expanded == {tuple(r) for r in matching.homonyms(companies).collect()} and expanded
    crowd = spark.range(200).select(F.col("id").alias("company_id"), F.lit("Obras").alias("name"), F.col("id").cast("string").alias("sheet"))
    assert matching.homonym_classes(crowd).count() == 200


def test_province_names_are_looked_up_once(spark):
    names = [*ident.PROVINCES, *ident.PROVINCE_ALIASES, "ninguna", "", None]
    found = [r["c"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ident.province_code(F.col("n")).alias("c")).collect()]
    assert found == [f"{i:02d}" for i in range(1, 53)] + list(ident.PROVINCE_ALIASES.values()) + [None] * 3
    assert plan(spark.range(1).select(ident.province_code(F.col("id").cast("string")).alias("x"))).count("translate") <= 1


def test_texts_of_sites_are_read_once(spark):
    assert "registro mercantil" not in plan(QUERIES["records_of_sites"](spark, SF))  # its filters would each read them anew


def test_values_of_lambdas_are_computed_once(spark):
    texts = spark.range(1).select(F.col("id").cast("string").alias("s"))
    mentions = lambda f, mark: plan(texts.select(F.transform(F.array("s"), f).alias("x"))).count(mark)
    for f, mark in ((ident.nif_check, "[^A-Za-z0-9]"), (ident.phone, "[^0-9], "), (ident.email, "arroba"), (ident.domain, "^[a-z]+://"), (ident.postal_code, "[^0-9], ")):
        assert mentions(f, mark) == 1, f.__name__
    spelt = plan(texts.select(ident.privacy_mailbox(F.col("s")).alias("x")))
    assert spelt.count("lower(") == 1


def test_texts_of_sites_are_made_plain_once(spark):
    texts = spark.range(1).select(F.col("id").cast("string").alias("s"))
    assert plan(texts.select(site.mentions_role(F.col("s")).alias("x"))).count("translate(") == 1
    assert plan(texts.select(site.registry_entry(F.col("s")).alias("x"))).count("coalesce(") <= 1


def test_sentences_of_acts_are_read_once(spark):
    said = gazette.act_fields(F.col("body"))["people"]
    assert plan(spark.range(1).select(F.col("id").cast("string").alias("body")).select(said.alias("x"))).count("Adm (?:Solid") == 1
