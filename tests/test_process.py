"""Raw records to golden rows: idempotence, decisions, doubts and splits."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import matching
from tessera.streaming.process import Processor, profiles, store_of

HEAD = "record_id string, source string, source_group string, confidence double, observed_at timestamp, official boolean"
SCHEMA = f"{HEAD}, " + ", ".join(f"{k} {v}" for k, v in matching.FIELDS.items())


def record(key, nif=None, name=None, phones=(), emails=(), domain=None, form="SL", day=1, place=(None, None)):
    at = datetime(2024, 1, day)
    return (key, "web", f"g{key}", 0.8, at, False, nif, nif is not None or None, name, None, form, list(phones), [], list(emails), domain, None, None, *place, None, None)


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def processor(spark, tmp_path_factory):
    held = Processor(store_of(spark, f"file://{tmp_path_factory.mktemp('process')}/store"))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    held.as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    held.batches = [
        frame([record("a", "B1", "zorzal obras"), record("b", "B1", "zorzal obras", ["+34600000001"]), record("c"), record("d", None, "alondra pinturas", ["+34600000002"], domain="alondra.es")]),
        frame([record("e", None, "alondra pinturas", [], ["x@alondra.es"], "alondra.es", day=2), record("f", None, "mirlo", ["+34600000001"], day=2), record("g", "B1", "zorzal obras", day=2), record("h", None, "zorzal tejados", ["+34600000001"], day=2)]),
    ]
    held.said = [{r["record_id"]: r for r in held.add(i, rows, held.as_of).collect()} for i, rows in enumerate(held.batches)]
    return held


def test_decisions_of_two_batches(processor):
    first, second = processor.said
    assert {k: (r["entity"], r["action"]) for k, r in first.items()} == {"a": ("c:a", "create"), "b": ("c:a", "create"), "c": (None, "discard"), "d": ("c:d", "create")}
    assert (second["e"]["entity"], second["e"]["action"]) == ("c:d", "link")
    assert (second["g"]["entity"], second["g"]["action"]) == ("c:a", "link")
    assert (second["f"]["entity"], second["f"]["action"]) == ("c:f", "create")  # a phone alone proves nothing
    assert (second["h"]["entity"], second["h"]["action"]) == ("c:a", "review")  # a phone and a distinctive word


def test_golden_rows_are_those_of_all_evidence(processor):
    store = processor.store
    assert rows_of(store.golden()) == rows_of(store.recomputed(processor.as_of))
    golden = {r["entity"]: r for r in store.golden().collect()}
    assert set(golden) == {"c:a", "c:d", "c:f"} and golden["c:a"]["nif"] == "B1" and golden["c:d"]["domain"] == "alondra.es"


def test_a_batch_again_changes_nothing(processor):
    store, before = processor.store, rows_of(processor.store.golden())
    evidence, doubts = rows_of(store.evidence()), rows_of(processor.conflicts())
    for i in (1, 1):
        again = {r["record_id"]: r for r in processor.add(i, processor.batches[i], processor.as_of).collect()}
        assert again == processor.said[i]
    assert rows_of(store.golden()) == before and rows_of(store.evidence()) == evidence and rows_of(processor.conflicts()) == doubts


def test_profiles_of_the_evidence(processor):
    found = {r["company_id"]: r for r in profiles(processor.store.evidence(before=1)).collect()}
    assert found["c:a"]["nif_valid"] and found["c:a"]["phones"] == ["+34600000001"] and found["c:d"]["name"] == "alondra pinturas"


def test_a_doubt_is_settled_by_a_split(spark, processor):
    assert [(r["entity"], r["record_id"]) for r in processor.conflicts().collect()] == [("c:a", "h")]
    processor.store.split(5, spark.createDataFrame([("h", "c:h")], "record_id string, new_entity string"), processor.as_of)
    assert processor.conflicts().count() == 0
    golden = {r["entity"]: r for r in processor.store.golden().collect()}
    assert golden["c:h"]["name"] == "zorzal tejados" and rows_of(processor.store.golden()) == rows_of(processor.store.recomputed(processor.as_of))


def test_an_empty_batch(spark, processor):
    before = rows_of(processor.store.golden())
    assert processor.add(9, spark.createDataFrame([], SCHEMA), processor.as_of).count() == 0
    assert rows_of(processor.store.golden()) == before
