"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits come from word shingles. Two fingerprints that differ in
at most ``radius`` bits differ in at most ``radius // segments`` bits of one of
the segments: so every fingerprint looks up, in a table per segment, the small
Hamming ball around its own segment, and each match is verified on all 64 bits.
Distinct fingerprints only are linked, so copies cost nothing.

Nulls and edge cases: a null or wordless text has fingerprint zero, which is
linked like any other. A text with fewer words than a shingle is one shingle.
Rows with a null id get a component if their fingerprint has one; the component
id is the smallest non-null id. Repeated rows stay. An empty table gives an
empty result. Only the two named columns are read, so other columns don't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import id_filter, stored, text_udf
from tessera.operators.graph import components

SEED = 42


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of a text: XXH64 of word shingles; a bit is set if it is in over half of the hashes."""
    # bytes.lower() changes A-Z only, bytes.split() splits at \x20 and \x09-\x0D
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_digest  # big-endian bytes
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())])
    rows, ones = np.frombuffer(hashes, np.uint8).reshape(n, 8), np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(rows[at : at + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fp): the signed 64-bit fingerprint of every text."""

    def make():
        return lambda texts: [fingerprint(t, words) for t in texts]

    return docs.select(F.col(key), text_udf(make, T.LongType())(F.col(text)).alias("fp"))


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment."""
    sizes = [64 // count + (i < 64 % count) for i in range(count)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def links(distinct: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """(u, v), u < v: every pair of the distinct fingerprints ``fp`` at ``radius`` or fewer differing bits."""
    fp = F.col("fp")

    def keys(inner: int) -> Column:
        """Key of each segment with each of its ball's changes: the segment's number above its bits."""
        return F.array(
            *[
                F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.lit(flip | i << 40))
                for i, (shift, bits) in enumerate(_segments(segments))
                for flip in _ball(bits, inner)
            ]
        )

    table = distinct.select(fp.alias("v"), F.explode(keys(0)).alias("k"))
    probes = distinct.select(fp.alias("u"), F.explode(keys(radius // segments)).alias("k"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    found = probes.join(table, (probes.k == table.k) & (F.col("u") < F.col("v")) & near)
    return found.select("u", "v").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, segments: int = 3
) -> DataFrame:
    """(key, fp, component_id) of every row: the class is the smallest id that links lead to, its own included."""
    marked = stored(fingerprints(docs, key, text, words), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    rooted = components(links(distinct.select("fp"), radius, segments), "u", "v").withColumnRenamed("node", "fp")
    rooted = distinct.join(rooted, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(classes, "root").select("fp", "component_id"), "classes")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate class: that of the smallest id.

    Rows that repeat that id are copies and one stays. Rows with a null id can't
    be told apart by it and stay.
    """
    return first_rows(docs, near_duplicates(docs, key, text, **options), key)


def first_rows(docs: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` but those whose ``key`` is not its class's ``component_id``; of rows that repeat a key the first as JSON stays, with a null key all.

    Only ids are shuffled to find the rows that go. A bitmap of fixed size over
    their ids tells which rows may go; the others stay in place. Of those that may,
    the ids that its chance hits keep, and the repeated ones, have a bitmap of their
    own: rows that hit both are few and are joined with the ids, with their texts.
    """
    own = F.col(key) == F.col("component_id")
    ids = classes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(own).alias("own"), F.count(F.lit(1)).alias("n"))
    ids = stored(ids.where("not own or n > 1").select(key, "own"), "ids")
    may_go = F.col(key).isNotNull() & id_filter(ids, key)(F.col(key))
    by_chance = docs.select(key).where(may_go).join(ids.select(key), key, "left_anti")
    look = stored(by_chance.unionByName(ids.where("own").select(key)).distinct(), "look")
    asked = docs.where(may_go & id_filter(look, key)(F.col(key)))
    known = asked.join(ids.select(key), key, "left_anti").select(*docs.columns)
    again = asked.join(ids.where("own").select(key), key, "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    again = again.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return docs.where(~may_go).unionByName(known).unionByName(again)
