"""Operators on small cases with stated results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence, graph, resolution, writes
from tessera.sources import gazette, items, tender
from tessera.streaming.ingest import add_batch

NOW = datetime(2024, 3, 1)
OBSERVATION = "entity string, field string, value string, source_group string, confidence double, observed_at timestamp, official boolean, original string"


def consolidated(spark, rows):
    df = spark.createDataFrame([("e", f, v, g, c, NOW - timedelta(days=d), o, v) for f, v, g, c, d, o in rows], OBSERVATION)
    return {r["value"]: r for r in evidence.consolidate(df, F.lit(NOW)).collect()}


def test_independent_groups_combine(spark):
    assert consolidated(spark, [("nif", "v", "a", 0.8, 0, False), ("nif", "v", "b", 0.8, 0, False)])["v"]["effective"] == 0.96


def test_one_group_counts_once(spark):
    row = consolidated(spark, [("nif", "v", "a", 0.5, 0, False), ("nif", "v", "a", 0.4, 0, False)])["v"]
    assert (row["effective"], row["n_groups"], row["n_observations"]) == (0.5, 1, 2)


def test_half_life(spark):
    assert consolidated(spark, [("telefono", "v", "a", 0.8, 365, False)])["v"]["effective"] == 0.4
    assert consolidated(spark, [("nif", "v", "a", 0.95, 3650, False)])["v"]["effective"] == 0.95


def test_official_wins_a_tie(spark):
    found = consolidated(spark, [("razon_social", "x", "a", 0.8, 0, False), ("razon_social", "y", "b", 0.8, 9, True)])
    assert found["y"]["rank"] == 1


def test_conflict_lowers_the_winner_only(spark):
    found = consolidated(spark, [("web", "x", "a", 0.85, 0, False), ("web", "y", "b", 0.80, 0, False)])
    assert found["x"]["conflict"] and found["x"]["rank"] == 1 and found["x"]["effective"] < found["y"]["effective"]


def test_state_rules(spark):
    state = lambda **s: spark.range(1).select(evidence.company_state({k: F.lit(v) for k, v in s.items()}).alias("s")).first()["s"]["state"]
    assert state(extinct=True, web_alive=True) == "extinguida"
    assert state(web_alive=True, negative=1) == "dudosa"
    assert state(web_alive=True, recent_act=True) == "activa"
    assert state() == "desconocida"


def test_global_confidence_is_capped_without_number(spark):
    value = lambda nif: spark.range(1).select(evidence.global_confidence(*[F.lit(1.0)] * 4, F.lit(nif)).alias("v")).first()["v"]
    assert (value(False), value(True)) == (0.6, 1.0)


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 120)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_no_links_no_components(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("a", "b", "value"), [("obras sol", "obras sol", 1.0), ("", "sol", 0.0), ("abc", "xyz", 0.0)])
def test_name_similarity(spark, a, b, value):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(resolution.name_similarity(F.col("a"), F.col("b")).alias("s")).first()["s"] == value


RECORD = "nif string, nif_valid boolean, name string, trade_name string, form string, phones array<string>, special_phones array<string>, emails array<string>, domain string, cp string, province string, lat double, lon double, place_id string, sheet string"


def scored(spark, a, b, sim=0.0, distinctive=False):
    blank = {f.split()[0]: None for f in RECORD.split(", ")}
    rows = [tuple((blank | r).values()) for r in (a, b)]
    df = spark.createDataFrame([(rows[0], rows[1])], f"a struct<{RECORD.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>, b struct<{RECORD.replace(', ', ',').replace(' ', ':')}>")
    return df.select(resolution.pair_score(F.col("a"), F.col("b"), F.lit(sim), F.lit(distinctive), F.lit(False)).alias("s")).first()["s"]


def test_pair_rules(spark):
    nif = lambda n: {"nif": n, "nif_valid": True}
    assert scored(spark, nif("A"), nif("B"), 1.0, True)["rule"] == "R1"
    assert scored(spark, nif("A"), nif("A"))["score"] == 0.7
    assert scored(spark, nif("A") | {"name": "x"}, nif("A") | {"name": "x"}, 1.0, True)["score"] == 1.0
    here = {"name": "a", "lat": 37.0, "lon": -6.0}
    assert scored(spark, here, here, 0.96, True)["rule"] == "R6"
    assert scored(spark, here, here, 0.6, True)["rule"] == "R5"
    assert scored(spark, {"name": "x"}, {"name": "x"}, 0.96, True)["rule"] == "R4"
    assert scored(spark, {"name": "nave 1"}, {"name": "nave 2"}, 0.96, True)["rule"] == "R7"
    far = scored(spark, {"name": "x", "lat": 37.0, "lon": -6.0}, {"name": "x", "lat": 43.0, "lon": -3.0}, 0.9, True)
    assert far["score"] == 0.1


def test_loading_again_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, text string")
    for _ in range(2):
        add_batch(spark, rows, f"file://{tmp_path}/t", ["id"], ["id", "text"])
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2


def test_upsert_keeps_what_is_known(spark):
    held = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, x string, y int")
    new = spark.createDataFrame([(1, "c", None), (3, "d", None)], "k long, x string, y int")
    found = {r["k"]: (r["x"], r["y"]) for r in writes.upsert(held, new, ["k"], keep=["y"]).collect()}
    assert found == {1: ("c", 5), 2: ("b", 6), 3: ("d", None)}


def test_gazette(spark):
    first, second = gazette.acts(spark.createDataFrame([(gazette.EXAMPLE,)], "xml string")).orderBy("act_id").collect()
    assert (first["postal_code"], first["municipality"], first["sheet"], first["state"]) == ("41001", "SEVILLA", "SE12345", None)
    assert [tuple(p) for p in first["people"]] == [("PEREZ ANA", "administrador_unico")]
    assert second["kinds"] == ["disolucion", "extincion"] and second["state"] == "disuelta" and len(second["people"]) == 2


def test_tender_takes_the_number_by_its_scheme(spark):
    (lot,) = tender.lots(spark.createDataFrame([(tender.EXAMPLE,)], "xml string")).collect()
    assert (lot["nif"], lot["external_id"], lot["amount"]) == ("B00000000", "https://example.org/t/1#lote-1", 1000.5)


def test_map_response_that_is_no_json_fails(spark):
    with pytest.raises(Exception, match="bad map response"):
        items.map_elements(spark.createDataFrame([("<html>slow down</html>",)], "json string")).collect()


def test_catalogue_hierarchy(spark):
    sheet = spark.createDataFrame([(1, "A"), (2, "01"), (3, "01.1"), (4, "01.11"), (5, "B"), (6, "5")], "row int, code string")
    found = {r["code"]: (r["level"], r["parent"]) for r in items.code_hierarchy(sheet).collect()}
    assert found == {"A": (1, None), "01": (2, "A"), "011": (3, "01"), "0111": (4, "011"), "B": (1, None), "05": (2, "B")}
