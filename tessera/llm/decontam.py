"""Benchmark decontamination by the q-gram lemma.

A passage that matches an item of m characters with at most k edits keeps all
but k * q of the item's m - q + 1 places of q-grams, within k + 1 adjacent
diagonals. An edit spoils only one of several places that don't overlap, so of
any n such places n - k are kept: each item is found by its rarest ones, and a
stem that many items share doesn't crowd the search. Diagonals are cut into bands of width 2(k + 1) that overlap by half, so any k + 1 of them lie in
one band. In each band that enough rare places lead to, all shared places of the
item are counted; a region that keeps the lemma's count, m - q + 1 - k * q, is
verified by an edit-distance alignment inside its band. Texts and items are
brought to one form first (lower case, single spaces, UTF-8): lengths,
positions and edits count bytes of that form.

A match is the best place of an item in a region, fewest edits first, then the
earliest; of places of one item that overlap, only the best is a match.

The items go to the tasks as an index of bounded size: the table is cut into
blocks of at most ``BLOCK_CHARS`` of text, and each block is one pass over the
documents, whatever the table's size. Items of one text share an entry.

Nulls and edge cases: null or empty texts match nothing, and null or empty items
are not searched. Items shorter than a q-gram are looked for exactly. Repeated
rows each give their matches; repeated items too. Empty tables give an empty
result. Only the named columns are read. An item key named like the document's
key comes out as ``item_`` and that name.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import text_udf, worker_state

Q = 8
#: Edits allowed, as a part of the item's length.
EDIT_RATE = 0.05
#: Characters of the items that one pass holds in a task.
BLOCK_CHARS = 4 << 20
FILTER_BITS = 22
#: Places of an item that so many items have, or fewer, may be looked for beyond those that are needed.
FEW = 4
#: Hits of rare places that are held at once, about, and places of a text that are looked up at once.
HITS, PLACES = 1 << 20, 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def letters(data: str) -> np.ndarray:
    """The characters as numbers: one byte each where all are below 256, else four."""
    try:
        return np.frombuffer(data.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(data.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(data: str) -> np.ndarray:
    """Every window of 8 characters as a number: the sum of the characters, each 8 bits above the one before.

    Windows of characters below 256 are their bytes, in a narrow and in a wide
    text alike. Others may share a number, which can only add places to verify.
    """
    found, n = letters(data), len(data) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    if found.dtype == np.uint8:
        return np.ndarray((n,), "<u8", found, strides=(1,)).astype(np.uint64)
    wide, out = found.astype(np.uint64), np.zeros(n, np.uint64)
    for i in range(Q):
        out += wide[i : i + n] << np.uint64(8 * i)
    return out


def budget(length: int, rate: float) -> int:
    """Edits allowed for an item; a rate above 1 / Q is held where the lemma still leaves one place."""
    return min(int(length * rate), max(0, (length - Q) // Q))


class ItemIndex:
    """The rarest q-grams of each of a block's items, and a bit filter over them."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        names: dict[str, list] = {}
        for key, data in items:
            names.setdefault(data, []).append(key)
        self.texts, self.names = list(names), list(names.values())
        self.edits = np.array([budget(len(t), rate) for t in self.texts], np.int64)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        found = [grams(t) for t in self.texts]
        item = np.repeat(np.arange(len(found), dtype=np.int32), [len(g) for g in found])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in found] or [np.zeros(0, np.int32)])
        keys = np.concatenate(found or [np.zeros(0, np.uint64)])
        _, which, uses = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.lexsort((place, uses[which], item))
        bounds = np.searchsorted(item[order], np.arange(len(found) + 1))
        chosen, enough = [np.zeros(0, np.int64)], []
        for a, b, k in zip(bounds, bounds[1:], self.edits.tolist()):
            which_, least = _rarest(place[order[a:b]], uses[which[order[a:b]]], k)
            chosen.append(order[a + which_])
            enough.append(least)
        self.enough = np.array(enough, np.int64)
        rare = np.concatenate(chosen)
        rare = rare[np.argsort(keys[rare], kind="stable")]
        self.keys, self.item, self.place = keys[rare], item[rare], place[rare]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> np.uint64(64 - FILTER_BITS)

    def bands(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item and shift as 2 * item + shift, band), ascending: the bands of a text's diagonals that enough rare places of an item lead to."""
        seen, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for base in range(0, len(keys), PLACES):
            part = keys[base : base + PLACES]
            at = np.flatnonzero(self.filter[self._slot(part)])
            low = np.searchsorted(self.keys, part[at], "left")
            n = np.searchsorted(self.keys, part[at], "right") - low
            at, low, n = at[n > 0] + base, low[n > 0], n[n > 0]
            total = np.cumsum(n)
            cuts = np.r_[0, np.searchsorted(total, np.arange(HITS, int(total[-1]) + HITS, HITS), "left") + 1] if len(n) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                size = n[a:b]
                slot = np.repeat(low[a:b], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                item = self.item[slot].astype(np.int64)
                diagonal = np.repeat(at[a:b], size) - self.place[slot] + self.lengths[item]
                step = self.edits[item] + 1
                codes = [(2 * item + s << 32) | (diagonal + s * step) // (2 * step) for s in (0, 1)]
                fresh, m = np.unique(np.concatenate(codes), return_counts=True)
                seen, back = np.unique(np.concatenate([seen, fresh]), return_inverse=True)
                counts = np.bincount(back, np.r_[counts, m], len(seen)).astype(np.int64)
        # a place that repeats counts more than once here: the exact count follows
        seen = seen[counts >= self.enough[seen >> 33]]
        return seen >> 32, seen & 0xFFFFFFFF

    def matches(self, data: str) -> list[tuple[object, int, int, int]]:
        """(item, start, end, edits) of every place that matches an item within its budget."""
        keys = grams(data)
        if not len(keys) or not len(self.keys):
            return []
        shifted, bands = self.bands(keys)
        item = shifted >> 1
        out = []
        starts = np.flatnonzero(np.r_[True, np.diff(item) != 0, True]) if len(item) else []
        for a, b in zip(starts[:-1], starts[1:]):
            which = int(item[a])
            for m in self._places(data, keys, which, list(zip((shifted[a:b] & 1).tolist(), bands[a:b].tolist()))):
                out += [(name, *m) for name in self.names[which]]
        return out

    def _places(self, data: str, keys: np.ndarray, which: int, bands: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        target, k = self.texts[which], int(self.edits[which])
        own, step = grams(target), k + 1
        need = max(1, len(own) - k * Q)
        found = set()
        for shift, band in bands:
            low = band * 2 * step - shift * step - len(target)
            if _shared(own, keys, low, 2 * step, need) < need:
                continue
            start = max(0, low - k)
            best = align(target, data[start : low + 2 * step + len(target) + k], 2 * step + 3 * k + 1, k)
            if best is not None and best[2] <= k:
                found.add((best[2], start + best[0], start + best[1]))
        return _apart(sorted(found))


def _rarest(places: np.ndarray, uses: np.ndarray, edits: int) -> tuple[np.ndarray, int]:
    """Which of an item's places, the rarest first, it is found by, and how many of them any match keeps.

    An edit spoils at most one of several places that don't overlap: edits + 1 of
    them, and as many more as hardly any other item has. Where an item is too short
    for so many, an edit spoils at most Q of any places.
    """
    taken, chosen = np.zeros(len(places) + 2 * Q, bool), []
    for i, (place, n) in enumerate(zip(places.tolist(), uses.tolist())):
        if len(chosen) > edits and (n > FEW or len(chosen) > 2 * edits + 1):
            break
        if not (taken[place] or taken[place + Q - 1]):
            taken[place : place + Q] = True
            chosen.append(i)
    if len(chosen) > edits:
        return np.array(chosen), len(chosen) - edits
    return np.arange(min(len(places), edits * Q + 1)), 1


def _shared(own: np.ndarray, keys: np.ndarray, low: int, width: int, enough: int) -> int:
    """Places of the item whose q-gram stands in the text on one of ``width`` diagonals from ``low`` on; stops at ``enough``."""
    held = np.zeros(len(own), bool)
    n = 0
    for start in range(low, low + width):
        a, b = max(0, -start), min(len(own), len(keys) - start)
        if a < b:
            held[a:b] |= own[a:b] == keys[start + a : start + b]
            n = int(np.count_nonzero(held))
            if n >= enough:
                break
    return n


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the best places that don't overlap, in order; ``found`` is (edits, start, end), best first."""
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for edits, start, end in found:
        at = bisect_left(starts, start)
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            starts.insert(at, start)
            kept.insert(at, (start, end, edits))
    return kept


def align(item: str, text: str, width: int, below: int = 0) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of ``item`` in ``text``, within ``width`` diagonals.

    Cell (i, d) is the item's first i characters against the text up to i + d: a band
    of diagonals from ``-below`` on, one numpy row for each character of the item.
    Diagonals under 0 serve places at the text's start that lack characters of the item.
    """
    at = text.find(item)
    if at >= 0:
        return at, at + len(item), 0
    n = len(item)
    if not text:
        return None
    far = n + len(text) + width + 1
    own, there = letters(item), letters(text)
    places, diagonals = np.arange(width), np.arange(width) - below
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    start = diagonals.copy()
    for i in range(1, n + 1):
        end = i + diagonals
        inside = (end >= 0) & (end <= len(text))
        same = np.zeros(width, bool)
        on = inside & (end >= 1)
        same[on] = there[end[on] - 1] == own[i - 1]
        swap = np.where(end >= 1, cost + ~same, far)
        over = np.r_[cost[1:], far] + 1  # a character of the item without a partner
        value = np.where(inside, np.minimum(swap, over), far)
        begin = np.where(swap <= over, start, np.r_[start[1:], 0])
        # a character of the text without a partner: a running minimum along the row
        ranked = value - diagonals
        least = np.minimum.accumulate(ranked)
        source = np.maximum.accumulate(np.where(ranked == least, places, 0))
        cost, start = np.where(inside, least + diagonals, far), begin[source]
    best = int(np.argmin(cost))
    return (int(start[best]), n + int(diagonals[best]), int(cost[best])) if cost[best] < far else None


def _blocks(items: DataFrame, item_key: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, one block in the driver at a time."""
    held, size = [], 0
    for row in items.select(item_key, text).toLocalIterator():
        data = plain(row[1])
        if data:
            if held and size + len(data) > BLOCK_CHARS:
                yield held
                held, size = [], 0
            held.append((row[0], data))
            size += len(data)
    if held:
        yield held


def _index_of(block: list[tuple[object, str]], rate: float) -> tuple[ItemIndex, list[tuple[object, str]]]:
    return ItemIndex([x for x in block if len(x[1]) >= Q], rate), [x for x in block if len(x[1]) < Q]


def _make(shared, rate: float, render):
    name = uuid.uuid4().hex

    def make():
        index, tiny = worker_state(name, lambda: _index_of(shared.value, rate))

        def one(text):
            data = plain(text)
            found = index.matches(data)
            for key, item in tiny:
                at = data.find(item)
                while at >= 0:
                    found.append((key, at, at + len(item), 0))
                    at = data.find(item, at + 1)
            return render(found)

        return lambda texts: [one(t) for t in texts]

    return make


def matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE
) -> DataFrame:
    """(key, item key, start, end, edits): every region of a text that matches an item within its edit budget."""
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType
    item_out = f"item_{item_key}" if item_key == key else item_key
    match = T.StructType(
        [T.StructField("item", kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())]
    )
    render = lambda found: [dict(zip(("item", "start", "end", "edits"), m)) for m in found]
    out = None
    for block in _blocks(items, item_key, item_text):
        udf = text_udf(_make(spark.sparkContext.broadcast(block), rate, render), T.ArrayType(match))
        rows = docs.select(F.col(key).alias("_key"), F.explode(udf(F.col(text))).alias("m"))
        rows = rows.select(F.col("_key").alias(key), F.col("m.item").alias(item_out), "m.start", "m.end", "m.edits")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        fields = [T.StructField(key, docs.schema[key].dataType), T.StructField(item_out, kind), *match.fields[1:]]
        out = spark.createDataFrame([], T.StructType(fields))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """The documents that hold no item, all columns and repeated rows as they are."""
    for block in _blocks(items, item_key, item_text):
        udf = text_udf(_make(docs.sparkSession.sparkContext.broadcast(block), rate, bool), T.BooleanType())
        docs = docs.where(~udf(F.col(text)))
    return docs
