"""Alignment of two tokenizers' ids over the same texts.

A byte-level BPE file (A) encodes a space and the text, a sentencepiece model
with byte fallback (B) the text, before which it puts that space itself. After
full tokenisation the bytes of either side's tokens are joined and compared with
the space and the text; a row where they differ has no tokens. Where both sides end
a token at one byte and both next tokens begin with a space, the document is cut:
these anchors leave windows of a word or so. A window's alignment depends on its
ids only, and words come back, so it is kept in a memo under the tuple of its ids (found by a hash,
compared id by id).
Inside a window, bytes at which both sides end a token cut it into groups; an A
and a B token are linked if their byte ranges overlap.

``weighed`` holds each document's links against the corpus: the number of
documents that hold a pair of ids linked, counted in each task before the
shuffle. The counts come back to the documents in blocks of whole A ids of at
most ``BLOCK_PAIRS`` pairs and one A id's partners; each block is a broadcast of
bounded size and one pass over the stored links, whatever the corpus's size.

Texts are cut for encoding before single spaces between ASCII letters or digits,
where a token of either side always ends (no piece holds a space behind another
character; a model with such pieces is refused). A text without such places is
encoded as one.

Nulls and edge cases: null and empty texts, and texts that the two sides don't
give back byte for byte, have no tokens: zeros, and groups ''. Strings of special
tokens inside texts are plain text. Repeated rows are documents of their own. A null
key stays null. An empty table gives an empty result. Only the two named columns
are read, so other columns don't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import slices_udf, stored, text_udf, worker_state
from tessera.llm.bpe import byte_alphabet
from tessera.llm.tokenfile import ChunkEncoder

#: Pairs of ids that one broadcast holds, about; and that a task counts before it hands them on.
BLOCK_PAIRS = 1 << 21
#: Windows that a generation of the memo holds, and tokens of the longest window in it.
MEMO_LIMIT, MEMO_TOKENS = 100_000, 32
#: Tokens of A whose windows are looked up at once, about.
RUN = 1 << 18

ALIGNMENT = T.StructType(
    [
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("n_links", T.LongType()),
        T.StructField("groups", T.StringType()),
        T.StructField("pairs", T.BinaryType()),
        T.StructField("times", T.BinaryType()),
    ]
)


class PlainEncoder(ChunkEncoder):
    """``ChunkEncoder`` to which strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, 4)
        self.tokenizer.encode_special_tokens = True
        self._special = re.compile("(?!)")


class Side:
    """Bytes of each id of a tokenizer, their lengths, and which begin with a space."""

    def __init__(self, names: dict[int, bytes]):
        size = max(names, default=-1) + 1
        self.bytes = [names.get(i, b"") for i in range(size)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.spaced = np.array([b.startswith(b" ") for b in self.bytes])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of ranges of an array, one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Windows:
    """Id tuples one after the other: A's ids, then the complements ~id of B's; the hash of each tuple."""

    _rng = np.random.default_rng(11)
    _times = _rng.integers(0, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, hashes: np.ndarray | None = None):
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.hashes = self._hash() if hashes is None else hashes

    def _hash(self) -> np.ndarray:
        place = np.arange(len(self.flat)) - np.repeat(self.starts, self.sizes)
        mixed = (self.flat + (1 << 32)).astype(np.uint64) * self._times[place & 4095]
        return np.add.reduceat(mixed, self.starts) if len(self.flat) else np.zeros(0, np.uint64)

    def take(self, which: np.ndarray) -> Windows:
        sizes = self.sizes[which]
        return Windows(self.flat[ragged(self.starts[which], sizes)], sizes, self.hashes[which])

    def same(self, which: np.ndarray, other: Windows, there: np.ndarray) -> np.ndarray:
        """Whether each of these tuples is that of ``other``."""
        equal = self.sizes[which] == other.sizes[there]
        sizes = np.where(equal, self.sizes[which], 0)
        differ = self.flat[ragged(self.starts[which], sizes)] != other.flat[ragged(other.starts[there], sizes)]
        owner = np.repeat(np.arange(len(which)), sizes)
        equal[owner[differ]] = False
        return equal

    def joined(self, other: Windows) -> Windows:
        return Windows(*[np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("flat", "sizes", "hashes")])


class Aligned:
    """Alignments of windows, in their order: groups as text, their number, and links as codes one window after the other."""

    def __init__(self, texts: np.ndarray, groups: np.ndarray, codes: np.ndarray, links: np.ndarray):
        self.texts, self.groups, self.codes, self.links = texts, groups, codes, links
        self.starts = np.cumsum(links) - links

    def take(self, which: np.ndarray) -> Aligned:
        links = self.links[which]
        return Aligned(self.texts[which], self.groups[which], self.codes[ragged(self.starts[which], links)], links)

    def joined(self, other: Aligned) -> Aligned:
        return Aligned(*[np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("texts", "groups", "codes", "links")])


class Memo:
    """Alignments of windows under their id tuples, found by hash and compared id by id; those used last stay."""

    def __init__(self, code: np.dtype):
        none = np.zeros(0, np.int64)
        self.windows, self.values, self.used = Windows(none, none), Aligned(np.zeros(0, object), none, np.zeros(0, code), none), none

    def find(self, asked: Windows, now: int) -> np.ndarray:
        """The slot of each window, -1 for those that aren't here."""
        held = self.windows.hashes
        if not len(held):
            return np.full(len(asked.sizes), -1)
        slot = np.minimum(np.searchsorted(held, asked.hashes), len(held) - 1)
        met = np.flatnonzero(held[slot] == asked.hashes)
        met = met[asked.same(met, self.windows, slot[met])]
        out = np.full(len(slot), -1)
        out[met] = slot[met]
        self.used[slot[met]] = now
        return out

    def add(self, windows: Windows, values: Aligned, now: int) -> None:
        """Take in windows that aren't here; beyond the limit the half that was used last stays."""
        short = np.flatnonzero(windows.sizes <= MEMO_TOKENS)
        every, known = self.windows.joined(windows.take(short)), self.values.joined(values.take(short))
        used = np.r_[self.used, np.full(len(short), now)]
        order = np.argsort(every.hashes, kind="stable")
        if len(order) > MEMO_LIMIT:
            late = np.sort(np.argsort(used[order], kind="stable")[-MEMO_LIMIT // 2 :])
            order = order[late]
        self.windows, self.values, self.used = every.take(order), known.take(order), used[order]


class Aligner:
    """Alignments of texts under two tokenizer files."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a_of = PlainEncoder(path_a)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: i for i, c in enumerate(byte_alphabet())}
        self.a = Side({i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)})
        self.b_of = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b_of.id_to_piece(i) for i in range(self.b_of.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space behind another character: texts can't be cut before spaces")
        self.b = Side({i: bytes([int(p[3:5], 16)]) if self.b_of.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)})
        # codes are A's id and B's id in one number, as narrow as the vocabularies allow
        self.shift = max(1, (len(pieces) - 1).bit_length())
        self.code = np.dtype("uint32" if (len(self.a.bytes) << self.shift) <= 1 << 32 else "uint64")
        #: ids as text, with the mark that follows: within a part, after A's part, after a group
        self.n_shown = max(len(self.a.bytes), len(pieces))
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(self.n_shown)]
        self.memo, self.now = Memo(self.code), 0

    def ids(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Both sides' ids of a text's blocks in turn; None for a block that a side doesn't give back.

        Each block begins with a space, which B puts before a text itself.
        """
        for block in self.a_of.blocks(" " + text):
            data, a, b = block.encode(), self.a_of.block(block), self.b_of.encode(block[1:], num_threads=1)
            same = b"".join(map(self.a.bytes.__getitem__, a)) == data and b"".join(map(self.b.bytes.__getitem__, b)) == data
            yield (np.array(a), np.array(b)) if same else None

    def cut(self, a: np.ndarray, b: np.ndarray) -> tuple[Windows, np.ndarray]:
        """The windows of ids that stand for the same bytes on both sides, and the places in A's ids where they begin.

        They are cut at anchors: shared ends before tokens that begin with a space on both sides.
        """
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        marks = np.zeros((2, int(ends_a[-1]) + 1), bool)
        marks[0, ends_a] = marks[1, ends_b] = True
        # the next token of each shared end, but for the last one's
        next_a, next_b = np.flatnonzero(marks[1, ends_a])[:-1] + 1, np.flatnonzero(marks[0, ends_b])[:-1] + 1
        anchor = self.a.spaced[a[next_a]] & self.b.spaced[b[next_b]]
        next_a, next_b = next_a[anchor], next_b[anchor]
        window = np.zeros(len(a) + len(b), np.int64)
        window[next_a] = window[next_b + len(a)] = 1
        window[len(a)] = -len(next_a)  # B's windows are counted from 0 again
        order = np.argsort(np.cumsum(window), kind="stable")
        flat = np.concatenate([a, ~b])[order]
        return Windows(flat, np.diff(np.r_[0, next_a + next_b, len(flat)])), np.r_[0, next_a]

    def align(self, windows: Windows) -> Aligned:
        """The alignment of each window, all at once."""
        of_a = windows.flat >= 0
        ids_a, ids_b = windows.flat[of_a], ~windows.flat[~of_a]
        size = np.cumsum(windows.sizes)
        ends_a, ends_b = np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b])
        # between two ends of either side one A and one B token overlap: a link
        every = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)
        codes = (ids_a[at_a] << self.shift | ids_b[at_b]).astype(self.code)
        shared = every[(ends_a[at_a] == every) & (ends_b[at_b] == every)]
        # the text has a group's A ids, then its B ids
        part = np.concatenate([2 * np.searchsorted(shared, ends_a), 2 * np.searchsorted(shared, ends_b) + 1])
        order = np.argsort(part, kind="stable")
        part = part[order]
        mark = np.where(np.diff(part, append=-1) == 0, 0, 1 + part % 2)
        shown = list(map(self.shown.__getitem__, (np.concatenate([ids_a, ids_b])[order] + mark * self.n_shown).tolist()))
        last = ends_a[np.cumsum(of_a)[size - 1] - 1]
        texts = np.empty(len(size), object)
        texts[:] = ["".join(shown[i:j])[:-1] for i, j in zip([0, *size.tolist()], size.tolist())]
        count = lambda ends: np.diff(np.searchsorted(ends, last, "right"), prepend=0)
        return Aligned(texts, count(shared), codes, count(every))

    def known(self, windows: Windows) -> tuple[Aligned, np.ndarray]:
        """Alignments of the distinct windows, and which of them each window has: from the memo, or made and kept."""
        _, first, which = np.unique(windows.hashes, return_index=True, return_inverse=True)
        if not windows.same(np.arange(len(which)), windows, first[which]).all():  # two tuples of one hash
            return self.align(windows), np.arange(len(windows.sizes))
        asked, self.now = windows.take(first), self.now + 1
        slot = self.memo.find(asked, self.now)
        new, old = np.flatnonzero(slot < 0), np.flatnonzero(slot >= 0)
        values = self.memo.values.take(slot[old])
        if len(new):
            made = self.align(asked.take(new))
            self.memo.add(asked.take(new), made, self.now)
            values = values.joined(made)
        place = np.empty(len(first), np.int64)
        place[np.r_[old, new]] = np.arange(len(first))
        return values, place[which]

    def alignments(self, texts: list[str | None]) -> list[dict]:
        """The alignment of each text; blocks of several texts are aligned together, about ``RUN`` tokens at a time."""
        n_a, n_b, groups = ([0] * len(texts) for _ in range(3))
        shown, codes = ([[] for _ in texts] for _ in range(2))
        whole, held, size = [True] * len(texts), [], 0

        def resolve() -> None:
            a, b = (np.concatenate(side) for side in zip(*[ids for _, ids in held]))
            windows, begin = self.cut(a, b)
            values, which = self.known(windows)
            ends = np.searchsorted(begin, np.cumsum([len(ids[0]) for _, ids in held]), "left").tolist()
            links = np.cumsum(values.links[which])
            every, counts = values.codes[ragged(values.starts[which], values.links[which])], np.cumsum(values.groups[which])
            said, at, link, group = values.texts[which].tolist(), 0, 0, 0
            for (k, _), to in zip(held, ends):
                shown[k].append(";".join(said[at:to]))
                codes[k].append(every[link : links[to - 1]])
                groups[k] += int(counts[to - 1]) - group
                at, link, group = to, int(links[to - 1]), int(counts[to - 1])

        for k, text in enumerate(texts):
            for ids in self.ids(text) if text else ():
                if ids is None:
                    whole[k] = False
                    break
                held.append((k, ids))
                n_a[k], n_b[k], size = n_a[k] + len(ids[0]), n_b[k] + len(ids[1]), size + len(ids[0])
                if size >= RUN:
                    resolve()
                    held, size = [], 0
        if held:
            resolve()
        out = []
        for k, found in enumerate(codes):
            links = np.concatenate(found) if found and whole[k] else np.zeros(0, self.code)
            pairs, times = np.unique(links, return_counts=True)
            values = (n_a[k], n_b[k], groups[k], len(links), ";".join(shown[k])) if whole[k] else (0, 0, 0, 0, "")
            out.append(dict(zip(ALIGNMENT.fieldNames(), (*values, pairs.tobytes(), times.astype("<u4").tobytes()))))
        return out


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row.

    ``groups`` lists the ids of both sides by group, as ``a1,a2|b1;a3|b2,b3``.
    ``pairs`` and ``times`` are the distinct linked pairs and how often each is
    linked, as little-endian numbers; ``weighed`` and ``linked`` read them.
    """

    def make():
        return worker_state(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b)).alignments

    return docs.select(F.col(key), text_udf(make, ALIGNMENT)(F.col(text)).alias("_alignment")).select(key, "_alignment.*")


def _codes(pairs: bytes, times: bytes) -> np.ndarray:
    """The codes of a row; their width follows from the number of times."""
    return np.frombuffer(pairs, "<u4" if len(pairs) == len(times) else "<u8")


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, n): the number of rows that hold each pair of ids linked; a task hands on its own sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def batch_of(c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n)], ["code", "n"])

        for batch in batches:
            for pairs, times in zip(batch.column(0), batch.column(1)):
                codes.append(_codes(pairs.as_py(), times.as_py()))
                counts.append(np.ones(len(codes[-1])))
                held += len(codes[-1])
                if held > BLOCK_PAIRS:
                    one, n = _merged(codes, counts)
                    if len(one) > BLOCK_PAIRS // 2:
                        yield batch_of(one, n)
                        codes, counts, held = [], [], 0
                    else:
                        codes, counts, held = [one], [n], len(one)
        if codes:
            yield batch_of(*_merged(codes, counts))

    return rows.select("pairs", "times").mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _ranges(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of A ids, each of at most ``BLOCK_PAIRS`` pairs and one id's partners."""
    out, first, held = [], None, 0
    for a, n in sizes:
        first, held = a if first is None else first, held + n
        if held >= BLOCK_PAIRS:
            out.append((first, a))
            first, held = None, 0
    return out + ([(first, sizes[-1][0])] if first is not None else [])


def weighed(rows: DataFrame, shift: int = 15) -> DataFrame:
    """Adds n_best and count_sum to what ``aligned`` gives; ``pairs`` and ``times`` go.

    n_best counts the links whose pair is held by as many documents as any pair of
    its A id; count_sum adds up the documents of each link's pair. ``shift`` is the
    number of bits of a B id in a code.
    """
    rows = stored(rows, "aligned")
    counts = stored(pair_counts(rows).withColumn("a", F.shiftrightunsigned("code", shift)), "pair-counts")
    sizes = counts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each A id at most
    ranges = _ranges(sorted((r["a"], r["n"]) for r in sizes))
    kind = T.StructType([T.StructField("best", T.LongType()), T.StructField("sum", T.LongType())])
    out = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k, (low, high) in enumerate(ranges):
        if k:
            out = stored(out, "weighed")
        held = rows.sparkSession.sparkContext.broadcast(_block(counts.where(F.col("a").between(low, high)), shift))

        def score(pairs: list, times: list, held=held) -> pa.Array:
            codes, n, best = held.value
            sizes = [len(t) // 4 for t in times]
            found = np.concatenate([_codes(p, t) for p, t in zip(pairs, times)])
            often = np.frombuffer(b"".join(times), "<u4").astype(np.int64)
            slot = np.minimum(np.searchsorted(codes, found.astype(codes.dtype)), len(codes) - 1)
            often[codes[slot] != found] = 0
            ends = np.cumsum(sizes)
            sums = [np.diff(np.r_[0, np.cumsum(often * v)][np.r_[0, ends]]) for v in (best[slot], n[slot])]
            return pa.StructArray.from_arrays([pa.array(s, pa.int64()) for s in sums], names=["best", "sum"])

        out = out.withColumn("_held", slices_udf(score, kind)(F.col("pairs"), F.col("times")))
        out = out.withColumns({"n_best": F.col("n_best") + F.col("_held.best"), "count_sum": F.col("count_sum") + F.col("_held.sum")})
        out = out.drop("_held")
    return out.drop("pairs", "times")


def _block(counts: DataFrame, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending codes of some A ids with all their partners, their counts, and whether each is its A id's highest."""
    table = counts.select("code", "n").toArrow()
    codes, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.r_[True, np.diff(codes >> shift) != 0])
    most = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.r_[starts, len(n)]))
    return codes, n, n == most
