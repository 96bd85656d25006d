"""Near copies by the Jaccard similarity of word shingles: MinHash bands, verified exactly.

Texts with one set of shingles are one node, named by 64 bits of XXH3. Each node has a key per band, made
of ``ROWS`` MinHashes; nodes that share a key are candidates, and those whose
whole sets have a similarity of ``least`` or more are linked. A pair at
similarity s shares none of the bands with probability (1 - s^ROWS)^BANDS:
0.0004 at 0.8. Buckets of the same nodes are compared once. Keys that one node
alone has are dropped before the others are joined. Sets travel as packed words,
a third of their hashes' bytes, and are hashed anew where they are compared.

Only classes matter, so two nodes that links lead to already need no comparison.
First each node is compared with the smallest node of its buckets, its hub, unless
their sizes alone keep them below ``least``: a crowd of near copies becomes one
class in time that grows with the crowd. Of a bucket whose other nodes still are of
several classes, those outside the largest class are then compared with all but the
hub, in tiles of bounded size, each as one matrix product; so no link between
different classes is lost and no row is made for a pair.

Nulls and edge cases: null and wordless texts are copies of each other and of
nothing else. A text with fewer words than a shingle is one shingle. Rows with a
null id take no part. Repeated rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.llm._common import id_filter, stored, text_udf
from tessera.operators.graph import components

SEED = 42
WORDS, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
#: Nodes of a tile, about.
TILE = 256
#: Shingles whose MinHashes are computed at once, and columns of a matrix product.
BLOCK, COLUMNS = 256, 4096

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of the word shingles, ascending; words as in ``simhash``."""
    return _hashed((text or "").encode().lower().split(), words)


def _packed(text: str | None) -> bytes:
    return zlib.compress(b" ".join((text or "").encode().lower().split()), 1)


def _unpacked(packed: bytes, words: int) -> np.ndarray:
    """The ``shingles`` of a packed text."""
    return _hashed(zlib.decompress(packed).split(), words)


def _hashed(found: list[bytes], words: int) -> np.ndarray:
    if not found:
        return np.zeros(0, np.uint64)
    digest, joined, at, places = xxhash.xxh64_intdigest, b" ".join(found), 0, []
    for word in found:
        places.append((at, at + len(word)))
        at += len(word) + 1
    last = min(words, len(found)) - 1
    return np.unique(np.array([digest(joined[a:b], SEED) for (a, _), (_, b) in zip(places, places[last:])], np.uint64))


def _marks(text: str | None, words: int) -> dict:
    found = shingles(text, words)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        hashes = found[at : at + BLOCK, None] * _TIMES
        hashes += _PLUS
        np.minimum(least, hashes.min(0), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), i) - 2**63 for i, b in enumerate(bands)] if len(found) else []
    return {"node": _node(found), "size": len(found), "bands": keys}


def _node(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def _compared(least: float, words: int):
    """Links of a group of nodes, as a star for each connected part."""

    def group(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        sets = [_unpacked(s, words) for s in table.column("packed").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = uses > 1  # the others are in no intersection
        place = np.cumsum(shared) - 1
        owner, column = owner[shared[column]], place[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)))
        for at in range(0, shared.sum(), COLUMNS):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            held = np.zeros((len(sets), COLUMNS), np.float32)
            held[owner[lo:hi], column[lo:hi] - at] = 1
            common += held @ held.T
        near = common >= least * (sizes[:, None] + sizes - common) - 1e-9
        np.fill_diagonal(near, True)
        part, before = np.arange(len(sets)), None
        while before is None or (part != before).any():
            before, part = part, np.where(near, part, len(sets)).min(1)
        links = [(nodes[p], nodes[i]) for i, p in enumerate(part) if p != i]
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return group


def _with_hub(least: float, words: int):
    """Links of a hub, whose words stand in the table too, to the nodes of a tile."""

    def group(table: pa.Table) -> pa.Table:
        name, nodes, packed = table.column("hub")[0].as_py(), table.column("node").to_pylist(), table.column("packed")
        near = []
        hub = _unpacked(packed[nodes.index(name)].as_py(), words)
        for node, held in zip(nodes, packed):
            if node != name:
                own = _unpacked(held.as_py(), words)
                at = np.minimum(np.searchsorted(hub, own), max(len(hub) - 1, 0))
                common = int((hub[at] == own).sum()) if len(hub) else 0
                if common >= least * (len(hub) + len(own) - common) - 1e-9:
                    near.append(node)
        return pa.table({"u": pa.array([name] * len(near), pa.int64()), "v": pa.array(near, pa.int64())})

    return group


def _followers(members: DataFrame) -> DataFrame:
    """(k, node, size, hub, hub_size): the nodes of each bucket but the smallest, its hub."""
    hubs = members.groupBy("k").agg(F.min("node").alias("hub"), F.min_by("size", "node").alias("hub_size"))
    return members.select("k", "node", "size").join(hubs, "k").where("node <> hub")


def _hub_links(followers: DataFrame, sets: DataFrame, least: float, words: int) -> DataFrame:
    """(u, v): links of each node to the hubs of its buckets; a hub's words go to each tile of its nodes once."""
    # the similarity of two sets is that of their sizes at most
    alike = F.least("size", "hub_size") >= least * F.greatest("size", "hub_size") - 1e-9
    pairs = stored(followers.where(alike).select("hub", "node").distinct(), "hub-pairs")
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    placed = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"), "node")
    tile = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile")
    asked = placed.unionByName(sizes.select("hub", tile, F.col("hub").alias("node")))
    rows = asked.join(sets, "node").select("hub", "tile", "node", "packed")
    return rows.groupBy("hub", "tile").applyInArrow(_with_hub(least, words), "u long, v long")


def _mixed(followers: DataFrame, classes: DataFrame) -> DataFrame:
    """(k, lo, hi, node): tiles of the buckets whose followers are of several classes; lo deals those outside the largest one, hi all.

    Hubs take no part: each was compared with all its bucket.
    """
    placed = stored(followers.join(classes, "node", "left").select("k", "node", F.coalesce("root", "node").alias("root")), "placed")
    sizes = placed.groupBy("k", "root").agg(F.count(F.lit(1)).alias("c"))
    buckets = sizes.groupBy("k").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    tiles = lambda c: F.ceil(c / TILE)
    buckets = buckets.select("k", F.col("most.root").alias("major"), tiles(F.col("n") - F.col("most.c")).alias("los"), tiles(F.col("n")).alias("his"))
    rows = placed.join(buckets, "k")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c))
    few = rows.where("root <> major").select("k", dealt("los", 2).alias("lo"), "his", "node").select("k", "lo", upto("his").alias("hi"), "node")
    every = rows.select("k", dealt("his", 3).alias("hi"), "los", "node").select("k", upto("los").alias("lo"), "hi", "node")
    return few.unionByName(every).distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(key, component_id) of every row with an id: the smallest id that links lead to, its own included."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind = T.StructType([T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    marks = text_udf(lambda: lambda texts: [_marks(t, words) for t in texts], kind)
    marked = stored(rows.select("_id", marks(F.col("_text")).alias("m")).select("_id", "m.*"), "marked")
    distinct = stored(marked.groupBy("node").agg(F.min("_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")), "distinct")

    members = distinct.select("node", "least", "size", F.explode("bands").alias("k"))
    # most keys have one node: only the keys themselves are shuffled to find the others
    repeated = stored(members.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"), "repeated")
    members = stored(members.where(id_filter(repeated, "k")(F.col("k"))), "members")
    # two hashes of a bucket's nodes tell whether another bucket has the same
    buckets = members.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = buckets.where("n > 1").groupBy("n", "x", "y").agg(F.min("k").alias("k"))
    crowded = stored(members.join(buckets.select("k"), "k"), "crowded")

    # one row has a node's text: its smallest id; where ids repeat, a set may come twice, which changes no link
    wanted = stored(crowded.select(F.col("least").alias("_id")).distinct(), "wanted")
    # a bitmap picks them, so no text is shuffled; the sets of its chance hits meet no pair
    picked = stored(rows.where(id_filter(wanted, "_id")(F.col("_id"))).select("_text"), "picked")
    kind = T.StructType([T.StructField("node", T.LongType()), T.StructField("packed", T.BinaryType())])
    pack = text_udf(lambda: lambda texts: [{"node": _node(shingles(t, words)), "packed": _packed(t)} for t in texts], kind)
    sets = stored(picked.select(pack(F.col("_text")).alias("s")).select("s.*"), "sets")

    followers = stored(_followers(crowded), "followers")
    with_hubs = stored(_hub_links(followers, sets, least, words), "hub-links")
    mixed = _mixed(followers, stored(components(with_hubs, "u", "v"), "hub-classes"))
    others = mixed.join(sets, "node").groupBy("k", "lo", "hi").applyInArrow(_compared(least, words), "u long, v long")
    links = stored(with_hubs.unionByName(others), "near")

    rooted = components(links, "u", "v")
    rooted = stored(distinct.select("node", "least").join(rooted, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(classes, "root").select("node", "component_id"), "classes")
    return marked.join(named, "node").select(F.col("_id").alias(key), "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row of each class of near copies: that of the smallest id. Rows with a null id stay."""
    return simhash.first_rows(docs, near_copies(docs, key, text, **options), key)
