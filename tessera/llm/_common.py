"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.storage import new_path, stored  # noqa: F401

#: Rows that a per-row function sees at once; bounds Python memory beside long texts.
SLICE_ROWS = 256
#: Bits of a filter of ids: 8 MB, whatever the number of ids.
FILTER_BITS = 1 << 26


#: Rows of one Arrow batch between the JVM and a Python worker: both sides hold a batch of whole texts and its results.
BATCH_ROWS = 1024
#: What a Python worker has built for the operator that it runs, by name.
_STATES: dict[object, object] = {}
_ASKED: set[object] = set()


def worker_state(name: object, build: Callable[[], object]) -> object:
    """What ``build`` gives, once a Python worker, which serves all tasks that the worker runs for one operator.

    ``text_udf`` drops what its function doesn't ask for, so that a worker never
    holds the tables of an operator that it ran before.
    """
    if name not in _STATES:
        _STATES[name] = build()
    _ASKED.add(name)
    return _STATES[name]


def _made(make: Callable[[], Callable[[list], list]]) -> Callable[[list], list]:
    _ASKED.clear()
    score = make()
    old = _STATES.keys() - _ASKED
    for name in old:
        del _STATES[name]
    if old:
        release()
    return score


def release() -> None:
    """Give memory that nothing uses back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps what it has
        pass


def bounded_batches() -> None:
    """Lower the session's rows an Arrow batch to ``BATCH_ROWS``; a lower setting stays."""
    session, name = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if session is not None and not 0 < int(session.conf.get(name)) <= BATCH_ROWS:
        session.conf.set(name, BATCH_ROWS)


def text_udf(make: Callable[[], Callable[[list], list]], returns: T.DataType, rows: int = SLICE_ROWS) -> Callable[..., Column]:
    """Arrow UDF over one column.

    ``make`` runs once per task and returns a function from a list of values to
    a list of results (dicts for a struct type), called on slices of ``rows``. The
    UDF is marked nondeterministic so that the optimiser never runs it twice.
    """
    bounded_batches()
    kind = to_arrow_type(returns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score, pool = _made(make), pa.default_memory_pool()
        for batch in batches:
            parts = [
                pa.array(score(batch.slice(at, rows).to_pylist()), kind)
                for at in range(0, len(batch), rows)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
            del batch, parts
            pool.release_unused()
        release()  # a worker serves many tasks: what they freed goes back to the machine

    return F.arrow_udf(run, returns).asNondeterministic()


def slices_udf(score: Callable[..., pa.Array], returns: T.DataType) -> Callable[..., Column]:
    """Arrow UDF over several columns; ``score`` gets each as a list, in slices of bounded length."""
    bounded_batches()
    kind = to_arrow_type(returns)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        pool = pa.default_memory_pool()
        for columns in batches:
            cuts = range(0, len(columns[0]), SLICE_ROWS)
            parts = [score(*[c.slice(at, SLICE_ROWS).to_pylist() for c in columns]) for at in cuts]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
            del columns, parts
            pool.release_unused()

    return F.arrow_udf(run, returns).asNondeterministic()


def id_filter(ids: DataFrame, key: str, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """Condition that holds for all ids of ``ids`` and for few others, made of a bitmap of fixed size.

    It tells which rows of a large table need to be looked up in ``ids``: the
    others stay where they are. The more ids, the more rows pass by chance; the
    condition is right at every size.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = ids.select(bit(F.col(key)).alias("b")).groupBy(F.shiftright("b", 3).alias("w"))
    words = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("b") % 8).cast("int"))).cast("short").alias("m")).toArrow()  # bits / 8 rows at most
    bitmap = np.zeros(bits // 8, np.uint8)
    bitmap[words.column("w").to_numpy()] = words.column("m").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    def held(places: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bitmap = shared.value
        for part in places:
            at = part.to_numpy(zero_copy_only=False)
            yield pa.array((bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    udf = F.arrow_udf(held, T.BooleanType())
    return lambda c: udf(bit(c))


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores before it as no column of ``df`` is called."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def unit_hash(*keys: str) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, key: str, at_most: int) -> DataFrame:
    """About ``at_most`` rows, or all where there are fewer, chosen by a hash of the key."""
    return rows.where(unit_hash(key) < at_most / max(rows.count(), 1))


def label_counts(rows: DataFrame, by: str) -> dict:
    """Rows of each value of ``by``, over the whole table; ``by`` has few values, as a model's labels do."""
    return {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}


def sample_of(rows: DataFrame, key: str, at_most: int, by: str, counts: dict) -> DataFrame:
    """``bounded_sample`` of each value of ``by``: the counts are constants of the plan, so that no row is shuffled."""
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), at_most / n).otherwise(share)
    return rows.where(unit_hash(key) < share)
