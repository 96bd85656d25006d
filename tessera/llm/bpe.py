"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The merge list fixes how far to the right a merge decision can depend on text
not seen yet (``MergeTable.lookahead``). The encoder keeps that many symbols of
an unfinished word, and emits every token that ends before them: no later text
can change it. So a text, or one endless word, is encoded in blocks with memory
that depends on the merge list only. In a word that is no longer than the
lookahead nothing is stable before its end: the transducer finishes all such
words of a slice of texts at once (``MergeTable.finish_many``). The decoder is a
state machine (``TextMachine``) that takes one id at a time and holds at most
one incomplete UTF-8 sequence and whether a space is due.

Why a cut is safe: BPE merges never cross a final token boundary, so both sides
of one are encoded independently; and a boundary is final once all merges that
could span it are decided, which the lookahead bounds.

Nulls: a null text is encoded as the empty text. Empty texts give no ids.
Repeated rows give repeated results; other columns are left as they are.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import text_udf, worker_state

#: Characters of a text that the encoder takes at once.
BLOCK = 1 << 16
#: Runs longer than this many characters are streamed, not kept in the memo.
MEMO_RUN = 48
#: Entries that a generation of a memo holds; a Python worker keeps two generations.
MEMO_LIMIT = 250_000

# White space of the Unicode property White_Space, and the
# patterns and byte alphabet that tokenizer files of this kind refer to.
WHITE = "\t\n\v\f\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_WHITE_RUN = re.compile(f"[{WHITE}]+")
_SPLIT_DIFFERS = re.compile("[\x1c-\x1f]")
_WORD = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    spare = iter(range(0x100, 0x200))
    shown = set(PRINTABLE)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Ranks, ids and sufficient lookahead of a word-end BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + suffix] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.suffix = suffix
        length = {i: len(t.removesuffix(suffix) if suffix else t) for t, i in vocab.items()}
        self.length = length
        #: Rank of a pair of ids, and the token that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        # reach[t]: symbols, counted from where t starts, that decide whether t is formed.
        # A merge (u, v) needs u and v, and no earlier merge may take v away to the right.
        reach = {i: 1 for i, n in length.items() if n == 1}
        taken: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            self.ranks.setdefault(u << 20 | v, rank)
            self.made.append(t)
            need = max(reach[u], length[u] + reach[v], length[u] + taken.get(v, 0))
            reach[t] = max(reach.get(t, 0), need)
            taken[u] = max(taken.get(u, 0), reach[t])
        self.lookahead = max(reach.values(), default=1)
        pairs = sorted(self.ranks.items()) or [(-1, 0)]
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs))
        self.made_at = np.array(self.made, np.int64)
        self.inner_at, self.last_at = np.array(self.inner, np.int64), np.array(self.last, np.int64)

    def merged(self, ids: list[int]) -> list[int]:
        """Apply the merges to a list of symbols: the earliest rule first, then the leftmost place."""
        rank_of, none = self.ranks.get, len(self.made)
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            at = ranks.index(rank)
            ids[at : at + 2] = [self.made[rank]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(ids[at] << 20 | ids[at + 1], none)
            if at:
                ranks[at - 1] = rank_of(ids[at - 1] << 20 | ids[at], none)
        return ids

    def finish_many(self, words: list[bytes]) -> list[list[int]]:
        """What the transducer emits at the ends of many words, each no longer than the lookahead.

        ``merged`` of all of them at once: every round applies each word's earliest rule, in numpy.
        """
        if len(words) < 100:
            return [self.merged([self.inner[b] for b in w[:-1]] + [self.last[w[-1]]]) for w in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        ids = self.inner_at[flat]
        ids[ends] = self.last_at[flat[ends]]
        out: list[list[int]] = [[]] * len(words)
        which = np.arange(len(words))
        owner = np.repeat(which, sizes)
        none = len(self.made)
        while len(ids):
            # ranks[i] is that of the pair (i, i + 1); a pair over a word's end has none
            ranks = np.full(len(ids), none, np.int64)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            ranks[inside] = self._rank(ids[inside] << 20 | ids[inside + 1])
            while True:
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                least = np.minimum.reduceat(ranks, starts)
                if (least == none).any():
                    break
                at = self._leftmost(ranks, least, starts)
                ids, ranks, owner = self._apply(ids, ranks, owner, at, least)
            # words without a rule left are done; the others go on
            over = least == none
            bounds = np.r_[starts, len(ids)]
            listed = ids.tolist()
            for k in np.flatnonzero(over):
                out[owner[starts[k]]] = listed[bounds[k] : bounds[k + 1]]
            live = ~np.repeat(over, np.diff(bounds))
            ids, owner = ids[live], owner[live]
        return out

    @staticmethod
    def _leftmost(ranks: np.ndarray, least: np.ndarray, starts: np.ndarray) -> np.ndarray:
        hits = np.flatnonzero(ranks == np.repeat(least, np.diff(np.r_[starts, len(ranks)])))
        group = np.searchsorted(starts, hits, "right")
        return hits[np.r_[True, group[1:] != group[:-1]]]

    def _apply(self, ids, ranks, owner, at, rank):
        """Merge the pairs that begin at ``at``, one of each word, and rank their new neighbours."""
        none = len(self.made)
        ids[at] = self.made_at[rank]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        new_at = at - np.arange(len(at))
        ids, ranks, owner = ids[keep], ranks[keep], owner[keep]
        for left in (new_at, new_at - 1):
            left = left[(left >= 0) & (left < len(ids) - 1)]
            same = owner[left] == owner[left + 1]
            ranks[left] = none
            left = left[same]
            ranks[left] = self._rank(ids[left] << 20 | ids[left + 1])
        if len(ids):
            ranks[-1] = none
        return ids, ranks, owner

    def _rank(self, pairs: np.ndarray) -> np.ndarray:
        slot = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[slot] == pairs, self.pair_ranks[slot], len(self.made))


def table_of(path: str) -> MergeTable:
    return worker_state(("merges", path), lambda: MergeTable(path))


class WordTransducer:
    """Encodes one word that arrives in parts, emitting each token once it is stable."""

    def __init__(self, table: MergeTable):
        self.table, self.held, self.window = table, bytearray(), 4 * table.lookahead + 64

    def feed(self, part: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(part), self.window):
            self.held += part[at : at + self.window]
            if len(self.held) > self.window:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        table, known = self.table, self.held[:-1]  # the last byte may end the word
        end, out = 0, []
        for token in table.merged([table.inner[b] for b in known]):
            if end + table.length[token] > len(known) - table.lookahead:
                break
            end += table.length[token]
            out.append(token)
        del self.held[:end]
        return out

    def finish(self) -> list[int]:
        table, held = self.table, bytes(self.held)
        self.held.clear()
        return table.merged([table.inner[b] for b in held[:-1]] + [table.last[held[-1]]]) if held else []


def lowered(text: str) -> str:
    """NFC, then lower case character by character (no context rule for sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def composition_cut(text: str, most: int) -> int:
    """A place up to ``most`` where NFC of both sides is NFC of the whole; 0 if there is none."""
    for at in range(min(most, len(text) - 1), 0, -1):
        c = text[at]
        if c < "\x80" or not (unicodedata.category(c)[0] == "M" or "ᄀ" <= c <= "ᇿ"):
            return at
    return 0


class Encoder:
    """Texts to ids, as a stream of lists of tokens that nothing later can change."""

    def __init__(self, path: str):
        self.table = table_of(path)
        self.words: dict[str, list[int]] = {}
        self._special = re.compile("|".join(map(re.escape, self.table.special)) or r"(?!)")

    def word(self, word: str) -> list[int]:
        """Ids of a word of bounded length."""
        ids = self.words.get(word)
        if ids is None:
            data = word.encode("utf-8", "surrogatepass")
            machine = WordTransducer(self.table)
            ids = machine.feed(data) + machine.finish()
            if len(word) <= MEMO_RUN:
                if len(self.words) >= MEMO_LIMIT:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def stream(self, run: str) -> Iterator[list[int]]:
        """Tokens of a run without white space, specials included, as soon as they are stable."""
        at = 0
        for m in self._special.finditer(run) if "<" in run else ():
            yield from self._plain(run[at : m.start()])
            yield [self.table.special[m[0]]]
            at = m.end()
        yield from self._plain(run[at:] if at else run)

    def run(self, run: str) -> list[int]:
        return [i for part in self.stream(run) for i in part]

    def _plain(self, run: str) -> Iterator[list[int]]:
        if len(run) <= BLOCK:
            for word in self.simple_words(run) if run else ():
                yield self.word(word)
            return
        # An endless run: cut into blocks for NFC; the last match of a block may
        # go on in the next, as letters, as other characters or as a contraction.
        rest, at, open_word, kind = "", 0, None, ""
        while at < len(run):
            step = composition_cut(run[at : at + BLOCK + 1], BLOCK) if at + BLOCK < len(run) else len(run) - at
            step = step or len(run) - at
            rest += lowered(run[at : at + step])
            at += step
            over = at >= len(run)
            if open_word is not None:
                cut = regex.match(r"\p{L}*" if kind == "L" else r"[^\p{L}\p{N}]*", rest).end()
                yield open_word.feed(rest[:cut].encode("utf-8", "surrogatepass"))
                rest = rest[cut:]
                if not rest and not over:
                    continue
                yield open_word.finish()
                open_word = None
            found = _WORD.findall(rest)
            keep = 0 if over else min(len(found), 2 if len(found) > 1 and len(found[-1]) <= 2 else 1)
            for word in found[: len(found) - keep]:
                yield self.word(word)
            rest = "".join(found[len(found) - keep :])
            if keep == 1 and len(rest) > 4 * self.table.lookahead:
                kind = "L" if regex.match(r"\p{L}", rest) else "P"
                open_word = WordTransducer(self.table)
                yield open_word.feed(rest.encode("utf-8", "surrogatepass"))
                rest = ""
        if open_word is not None:
            yield open_word.finish()

    @staticmethod
    def simple_words(run: str) -> list[str]:
        """The words of a short run without specials."""
        run = lowered(run)
        if run.isalpha():
            return [run]
        if run[-1] in ".,;:?!" and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return _WORD.findall(run)

    @staticmethod
    def blocks(text: str) -> Iterator[list[str]]:
        """Runs without white space, in blocks of bounded size (a longer run stays whole)."""
        at, n = 0, len(text)
        while at < n:
            end = min(n, at + BLOCK)
            if end < n and (m := _WHITE_RUN.search(text, end)):
                end = m.start()
            elif end < n:
                end = n
            part = text[at:end]
            yield [r for r in _WHITE_RUN.split(part) if r] if _SPLIT_DIFFERS.search(part) else part.split()
            at = end

    def encode(self, text: str | None) -> list[int]:
        return [i for block in self.blocks(text or "") for run in block for i in self.run(run)]


class TextMachine:
    """Ids to text, one at a time.

    With ``written`` the text is the tokens' written forms, one space between two,
    as the library gives it for a file without decoder. Otherwise the tokens'
    bytes pass an incremental UTF-8 decoder, and the end of a word becomes a space
    before the next token.
    """

    def __init__(self, decoder: Decoder, written: bool):
        self.decoder, self.written, self.due = decoder, written, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, i: int) -> str:
        gap = " " if self.due else ""
        if self.written:
            self.due = True
            return gap + self.decoder.names[i]
        special, data, ends = self.decoder.bytes_of[i]
        if special is not None:
            self.due = True
            return self.finish() + gap + special
        self.due = ends
        return gap + self.utf8.decode(data)

    def push_all(self, ids: list[int]) -> str:
        """``push`` of each id in turn."""
        if not self.written:
            return "".join(map(self.push, ids))
        gap, self.due = " " if self.due and ids else "", self.due or bool(ids)
        names = self.decoder.names
        return gap + " ".join([names[i] for i in ids])

    def finish(self) -> str:
        """What an incomplete sequence of bytes stands for; the machine is at a start again, but for a due space."""
        left = self.utf8.decode(b"", True)
        self.utf8.reset()
        return left


class Decoder:
    """The tokens of a file, and machines that turn their ids into text."""

    def __init__(self, path: str):
        table = table_of(path)
        self.names = table.shown
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        specials = set(table.special.values())
        #: Of each id: the special token's text or None, its bytes, and whether a word ends with it.
        self.bytes_of: dict[int, tuple[str | None, bytes, bool]] = {}
        for i, name in self.names.items():
            ends = bool(table.suffix) and name.endswith(table.suffix)
            plain = "" if i in specials else name.removesuffix(table.suffix) if ends else name
            self.bytes_of[i] = (name if i in specials else None, bytes(byte_of[c] for c in plain), ends)

    def machine(self, written: bool) -> TextMachine:
        return TextMachine(self, written)

    def _all(self, ids: Iterable[int], written: bool) -> str:
        machine = self.machine(written)
        return machine.push_all(list(ids)) + machine.finish()

    def shown(self, ids: Iterable[int]) -> str:
        return self._all(ids, True)

    def text(self, ids: Iterable[int]) -> str:
        return self._all(ids, False)


class RunMemo:
    """Ids and decoded text of short runs, in two generations: runs not met again since the older one began go with it."""

    def __init__(self, encoder: Encoder, decoder: Decoder, limit: int = MEMO_LIMIT):
        self.encoder, self.decoder, self.limit = encoder, decoder, limit
        self.written = [str(i) for i in range(max(encoder.table.shown) + 1)]
        self.ids_of: dict[str, str] = {}
        self.shown_of: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def hold(self, runs: set[str]) -> None:
        """Take in all runs that aren't too long."""
        fresh = runs.difference(self.ids_of)
        if fresh and len(self.ids_of) + len(fresh) > self.limit:
            self.older, self.ids_of, self.shown_of, fresh = (self.ids_of, self.shown_of), {}, {}, runs
        ids_of, shown_of, new = *self.older, []
        for run in fresh:
            if run in ids_of:
                self.ids_of[run], self.shown_of[run] = ids_of[run], shown_of[run]
            elif len(run) <= MEMO_RUN:
                new.append(run)
        self._learn(new)

    def _learn(self, runs: list[str]) -> None:
        encoder, written = self.encoder, self.written
        simple = [None if "<" in r else Encoder.simple_words(r) for r in runs]
        words = sorted({w for found in simple if found for w in found})
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        if max(map(len, data), default=0) > encoder.table.lookahead:  # a word of MEMO_RUN characters may have so many bytes
            ids_of = {w: encoder.word(w) for w in words}
        else:
            ids_of = dict(zip(words, encoder.table.finish_many(data)))
        machine = self.decoder.machine(True)
        for run, found in zip(runs, simple):
            ids = encoder.run(run) if found is None else ids_of[found[0]] if len(found) == 1 else [i for w in found for i in ids_of[w]]
            self.ids_of[run] = " ".join([written[i] for i in ids])
            self.shown_of[run] = machine.push_all(ids)
            machine.due = False  # the next run's text is kept for itself


class Digests:
    """Count and digests of the ids and the decoded text of one text, without holding either whole."""

    def __init__(self, memo: RunMemo):
        self.memo, self.n, self.gap = memo, 0, b""
        self.ids, self.text = hashlib.sha256(), hashlib.sha256()

    def _add(self, n: int, ids: str, text: str) -> None:
        self.n += n
        self.ids.update(self.gap + ids.encode())
        self.text.update(self.gap + text.encode())
        self.gap = b" "

    def block(self, runs: list[str]) -> None:
        memo = self.memo
        try:
            ids, text = " ".join(map(memo.ids_of.__getitem__, runs)), " ".join(map(memo.shown_of.__getitem__, runs))
        except KeyError:  # runs of a long text, or one too long for the memo
            memo.hold(set(runs))
            for run in runs:
                if run in memo.ids_of:
                    self._add(memo.ids_of[run].count(" ") + 1, memo.ids_of[run], memo.shown_of[run])
                else:
                    self._long(run)
            return
        if runs:
            self._add(ids.count(" ") + 1, ids, text)

    def _long(self, run: str) -> None:
        machine = self.memo.decoder.machine(True)
        for ids in self.memo.encoder.stream(run):
            for i in ids:
                text = machine.push(i)
                self._add(1, self.memo.written[i], text.removeprefix(" "))

    def row(self) -> dict:
        return {"n_tokens": self.n, "ids_sha256": self.ids.hexdigest(), "decoded_sha256": self.text.hexdigest()}


def _digest_function(path: str, limit: int):
    memo = RunMemo(Encoder(path), Decoder(path), limit)

    def one(text: str) -> dict:
        out = Digests(memo)
        for runs in Encoder.blocks(text):
            out.block(runs)
        return out.row()

    def slice_of(texts: list) -> list[dict]:
        short = [t.split() for t in texts if t and len(t) <= BLOCK and not _SPLIT_DIFFERS.search(t)]
        memo.hold(set().union(*short))  # learnt together: fewer, larger numpy calls
        return [one(t or "") for t in texts]

    return slice_of


DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the array of token ids of each text."""

    def make():
        encoder = Encoder(path)
        return lambda texts: [encoder.encode(t) for t in texts]

    return df.withColumn(out, text_udf(make, T.ArrayType(T.IntegerType()))(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", shown: bool = False) -> DataFrame:
    """Adds ``out``, the text of each array of ids; ``shown`` as in Decoder. Null ids give null."""

    def make():
        decoder = Decoder(path)
        one = decoder.shown if shown else decoder.text
        return lambda rows: [None if r is None else one(r) for r in rows]

    return df.withColumn(out, text_udf(make, T.StringType())(F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text", out: str = "bpe", limit: int = MEMO_LIMIT) -> DataFrame:
    """Adds the struct ``out``: n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256.

    Both digests are taken while tokens stream by, so neither the ids nor the
    decoded text of a row is ever held whole. ``limit`` bounds the runs that a
    generation of a worker's memo holds; it changes memory and time only.
    """
    return df.withColumn(out, text_udf(lambda: worker_state(("digests", path, limit), lambda: _digest_function(path, limit)), DIGESTS)(F.col(text)))
