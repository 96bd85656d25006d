"""Merges and golden rows against one-by-one replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import merging
from tessera.streaming.golden import GoldenStore

KEYS = {"sites": [], "identifiers": [], "observations": [], "channels": ["kind", "value"], "roles": ["person_id", "role"], "results": ["search_id"]}
COLUMNS = {
    "sites": "row long, company_id long, address string", "identifiers": "row long, company_id long, value string", "observations": "row long, company_id long, value string",
    "channels": "row long, company_id long, kind string, value string", "roles": "row long, company_id long, person_id long, role string", "results": "row long, company_id long, search_id long",
}


def made(rng, n):
    tables = {"sites": [], "identifiers": [], "observations": [], "channels": [], "roles": [], "results": []}
    for i in range(8 * n):
        c = rng.randrange(n)
        tables["sites"].append((i, c, f"a{i % 5}"))
        tables["identifiers"].append((i, c, f"i{i}"))
        tables["observations"].append((i, rng.choice([c, None]), "v"))
        tables["channels"].append((i, c, rng.choice(["phone", "email"]), rng.choice(["x", "y", "z", None])))
        tables["roles"].append((i, c, rng.randrange(3), rng.choice(["r", "s"])))
        tables["results"].append((i, c, rng.randrange(4)))
    for name, key in KEYS.items():  # one row of a key a company, as the tables' constraints have it
        if key:
            seen, kept = set(), []
            for row in tables[name]:
                if row[1:] not in seen or None in row:
                    seen.add(row[1:])
                    kept.append(row)
            tables[name] = kept
    return tables


def replayed(tables, merges):
    """Merges one by one in the order of seq, each row at its place of the moment."""
    out = {name: [list(r) for r in rows] for name, rows in tables.items()}
    for loser, winner, *_ in sorted(merges, key=lambda m: m[2]):
        for name, rows in out.items():
            for row in rows:
                if row[1] == loser:
                    clash = KEYS[name] and None not in row and any(r[1] == winner and r[2:] == row[2:] for r in rows)
                    if not clash:
                        row[1] = winner
    return {name: {(r[0], r[1]) for r in rows} for name, rows in out.items()}


def frames(spark, tables, n):
    held = {name: spark.createDataFrame(rows, COLUMNS[name]) for name, rows in tables.items()}
    held["companies"] = spark.createDataFrame([(i, f"name {i}", None) for i in range(n)], "company_id long, name string, merged_into long")
    pairs = [(0, 1, "pending", None), (1, 2, "pending", None), (5, 4, "pending", None), (6, 7, "rejected", "ana"), (0, 4, "pending", None), (20, 21, "pending", None)]
    held["pairs"] = spark.createDataFrame(pairs, "a long, b long, state string, decided_by string")
    return held


MERGES = "loser long, winner long, seq long, reason string, score double, decided_by string"


def orders(rng, n):
    """A chain of five, stars and chains of chains, losers always after what has been merged into them."""
    merges = [(i, i + 1, i, "same sheet", 0.9, "rules") for i in range(5)]
    alive, seq = list(range(5, n)), 10
    while len(alive) > n // 3:
        loser, winner = rng.sample(alive, 2)
        alive.remove(loser)
        merges.append((loser, winner, seq, "same number", 1.0, "ana"))
        seq += 1
    return merges


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merges_against_a_replay(spark, seed):
    rng, n = random.Random(seed), 24
    tables, merges = made(rng, n), orders(rng, n)
    held = frames(spark, tables, n)
    out = merging.merged_tables(held, spark.createDataFrame(rng.sample(merges, len(merges)), MERGES))
    wanted, collided = replayed(tables, merges), 0
    for name in KEYS:
        rows = {(r["row"], r["company_id"]) for r in out[name].collect()}
        assert rows == wanted[name], name
        collided += KEYS[name] != [] and any(c in {m[0] for m in merges} for _, c in rows)
    assert collided == 3
    winner = {m[0]: m[1] for m in merges}
    assert {r["company_id"]: r["merged_into"] for r in out["companies"].collect()} == {i: winner.get(i) for i in range(n)}
    log = {r["loser"]: r for r in out["merges"].collect()}
    assert set(log) == set(winner) and '"name":"name 0"' in log[0]["snapshot"]
    back = merging.undone(out)
    for name in (*KEYS, "companies"):
        assert sorted(map(repr, back[name].collect())) == sorted(map(repr, held[name].collect())), name


def test_pairs_of_merged_companies_are_closed(spark):
    rng = random.Random(4)
    merges = [(i, i + 1, i, "same sheet", 0.9, "rules") for i in range(5)]
    out = merging.merged_tables(frames(spark, made(rng, 24), 24), spark.createDataFrame(merges, MERGES))
    found = {(r["a"], r["b"]): (r["state"], r["decided_by"]) for r in out["pairs"].collect()}
    assert found == {(0, 1): ("confirmed", "rules"), (1, 2): ("confirmed", "rules"), (5, 4): ("confirmed", "rules"), (6, 7): ("rejected", "ana"), (0, 4): ("settled", None), (20, 21): ("pending", None)}


@pytest.mark.parametrize("merges", [[(1, 1, 1)], [(1, 2, 1), (2, 1, 2)], [(1, 2, 1), (1, 3, 2)], [(1, 99, 1)], [(None, 2, 1)], [(1, 2, 1), (2, 3, 2), (3, 1, 3)]])
def test_merges_that_cannot_be_are_refused(spark, merges):
    held = {"companies": spark.createDataFrame([(i, None) for i in range(5)], "company_id long, merged_into long")}
    rows = [(*m, "r", 1.0, "x") for m in merges]
    with pytest.raises(ValueError):
        merging.merged_tables(held, spark.createDataFrame(rows, MERGES))


def test_long_chain_needs_few_rounds(spark):
    merges = spark.createDataFrame([(i, i + 1, i, "r", 1.0, "x") for i in range(60)], MERGES)
    rows = merging.resolved(merges).collect()
    assert {r["root"] for r in rows} == {60} and all(r["path"] == list(range(59, r["loser"] - 1, -1)) for r in rows)


def test_versions_are_whole_or_absent(spark, tmp_path):
    held = merging.Versions(spark, f"file://{tmp_path}/v")
    assert held.numbers() == []
    a, b = spark.range(3), spark.range(5)
    assert held.commit({"a": a, "b": b}) == 1
    with pytest.raises(Exception):
        held.commit({"a": b, "b": b.select(F.raise_error(F.lit("lost")).alias("id"))})
    assert held.numbers() == [1] and held.read()["a"].count() == 3
    assert held.commit({"a": b}) == 2 and held.read()["a"].count() == 5 and held.read(1)["b"].count() == 5


# Golden rows


def as_of():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")

SCHEMA = "record_id string, source string, entity string, field string, value string, source_group string, confidence double, observed_at timestamp, official boolean, original string"


def observations(rng, n, first=0):
    day = datetime(2024, 1, 1)
    return [
        (f"r{i}", f"s{i % 4}", f"e{rng.randrange(30)}", rng.choice(["web", "razon_social", "nif"]), f"v{rng.randrange(4)}", f"g{rng.randrange(3)}", rng.randrange(1, 10) / 10, day + timedelta(days=rng.randrange(50)), rng.random() < 0.1, "o")
        for i in range(first, first + n)
    ]


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def store(spark, tmp_path):
    held, rng = GoldenStore(spark, f"file://{tmp_path}/golden", ["web", "razon_social", "nif"], parts=8), random.Random(9)
    batches = [observations(rng, 80, 80 * b) for b in range(3)]
    for b, rows in enumerate(batches):
        held.add(b, spark.createDataFrame(rows, SCHEMA), as_of())
    held.batches = batches
    return held


def test_golden_rows_are_those_of_all_evidence(spark, store):
    assert rows_of(store.golden()) == rows_of(store.recomputed(as_of())) and store.golden().count() > 20
    assert store.evidence().count() == 240


def test_a_batch_again_changes_nothing(spark, store):
    before, n = rows_of(store.golden()), store.evidence().count()
    for again in (2, 0, 1):
        store.add(again, spark.createDataFrame(store.batches[again], SCHEMA), as_of())
    assert rows_of(store.golden()) == before and store.evidence().count() == n
    # the same records under a new id, with other record ids: content is known
    renamed = [(f"again-{r[0]}", *r[1:]) for r in store.batches[0]]
    store.add(7, spark.createDataFrame(renamed, SCHEMA), as_of())
    assert rows_of(store.golden()) == before and store.evidence().count() == n


def test_a_split_changes_its_entities_only(spark, store):
    before = {r["entity"]: r for r in store.golden().collect()}
    wrong = [r for r in store.batches[1] if r[2] == "e3"]
    assert wrong
    moves = spark.createDataFrame([(r[0], "own") for r in wrong], "record_id string, new_entity string")
    store.split(10, moves, as_of())
    after = {r["entity"]: r for r in store.golden().collect()}
    assert rows_of(store.golden()) == rows_of(store.recomputed(as_of()))
    assert {e for e in before.keys() | after.keys() if before.get(e) != after.get(e)} <= {"e3", "own"} and "own" in after
    touched = {r["entity"] for r in store._table("golden", store.golden_schema, "batch").where("batch = 10").collect()}
    assert touched == {"e3", "own"}
    store.split(10, moves, as_of())
    assert rows_of(store.golden()) == rows_of(store.recomputed(as_of())) and store.evidence().count() == 240
    # all records of an entity away: it is gone; and once more away from the new one
    rest = [r[0] for b in store.batches for r in b if r[2] == "e3"]
    store.split(11, spark.createDataFrame([(r, "other") for r in rest], "record_id string, new_entity string"), as_of())
    assert rows_of(store.golden()) == rows_of(store.recomputed(as_of())) and store.golden().where("entity in ('e3', 'own')").count() == 0


def test_a_decision_changes_its_entity_only(spark, store):
    before = {r["entity"]: r for r in store.golden().collect()}
    choice = spark.createDataFrame([("e5", "web", "chosen", datetime(2024, 2, 28))], "entity string, field string, value string, observed_at timestamp")
    store.decide(20, choice, as_of())
    store.decide(20, choice, as_of())
    after = {r["entity"]: r for r in store.golden().collect()}
    assert {e for e in before if before[e] != after[e]} == {"e5"} and after["e5"]["web"] == "chosen"
    assert rows_of(store.golden()) == rows_of(store.recomputed(as_of()))


def test_a_stream_and_odd_batches(spark, tmp_path):
    held, rng = GoldenStore(spark, f"file://{tmp_path}/golden", ["web", "nif"]), random.Random(3)
    assert held.golden().count() == 0 and held.evidence().count() == 0
    rows = observations(rng, 60) + [("x", "s", None, "web", "v", "g", 0.5, datetime(2024, 1, 1), False, "o"), ("y", None, "e1", "web", None, "g", None, None, None, None)]
    for i in range(3):
        spark.createDataFrame(rows[i * 20 :: 3] if i else rows[:20] + rows[:5], SCHEMA).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        held.follow(source, f"file://{tmp_path}/checkpoint", as_of()).awaitTermination()
    assert rows_of(held.golden()) == rows_of(held.recomputed(as_of())) and held.golden().count() > 5
    held.add(500, spark.createDataFrame([], SCHEMA), as_of())
    assert rows_of(held.golden()) == rows_of(held.recomputed(as_of()))


def test_a_batch_reads_the_parts_of_its_entities(spark, store):
    touched = spark.createDataFrame([("e1",)], "entity string")
    plan = store.evidence(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
