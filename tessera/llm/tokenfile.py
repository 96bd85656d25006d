"""Token files: concatenated ids with Elias-Fano encoded document boundaries.

A file is a Parquet folder of segments, partitioned in the order of the key.
One segment is one binary value: a header, the boundaries (the running ends of
the documents, as Elias-Fano low bits and a unary high part with sampled select
positions), and the ids of all its documents, two bytes each where the
vocabulary allows it. The boundaries take about 2 + log2(tokens / documents)
bits a document; no table of 64-bit offsets is kept. ``Boundaries.select``
returns any end from the sampled positions in constant space.

Rows are dealt to buckets by ranges of the key and sorted within each, so
segments in (bucket, seq) order hold the keys in ascending order, nulls first.
A null text is encoded as the empty text; every document has at least the end
id. Repeated keys stay, in the order of the input. An empty table gives an empty
file. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm._common import SLICE_ROWS
from tessera.llm.bpe import byte_alphabet

#: Ids after which a segment is closed; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 20
#: Every how many documents the select structure keeps a position.
SAMPLE = 256
#: Characters of a text that are encoded at once, and that a run without a space may have for tiktoken's core.
BLOCK, LONGEST = 1 << 16, 1 << 20
#: From this character on, classes of characters may differ between Unicode versions.
FIRST_OTHER = "\u0250"

# Fixed value: the pattern of words that byte-level BPE files of this kind use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed values of the file format.
MAGIC = b"TEF1"
HEADER = struct.Struct("<4sBBHIIII")  # magic, id bytes, low bits, unused, documents, ids, high bytes, samples


class Boundaries:
    """Elias-Fano code of the non-decreasing ends of the documents of one segment."""

    def __init__(self, n: int, total: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.total, self.low_bits = n, total, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, ends: np.ndarray) -> Boundaries:
        n, total = len(ends), int(ends[-1]) if len(ends) else 0
        low_bits = max(0, (total // max(n, 1)).bit_length() - 1)
        ends = ends.astype(np.int64)
        low = np.packbits((ends[:, None] >> np.arange(low_bits) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (ends >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, total, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (ones - np.arange(self.n) << self.low_bits) | self._low(np.arange(self.n))

    def select(self, i: int) -> int:
        """End of document i: from the sampled position at or before it, scanning high bits on."""
        byte = int(self.samples[i // SAMPLE]) // 8
        before = int(self.samples[i // SAMPLE]) % 8
        need, at = i % SAMPLE, byte
        bits = int(self.high[at]) >> before << before
        while (found := bits.bit_count()) <= need:
            need, at = need - found, at + 1
            bits = int(self.high[at])
        for _ in range(need):
            bits &= bits - 1
        one = 8 * at + (bits & -bits).bit_length() - 1
        return (one - i << self.low_bits) | int(self._low(np.array([i]))[0])

    def _low(self, which: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(which), np.int64)
        places = which[:, None] * self.low_bits + np.arange(self.low_bits)
        return ((self.low[places >> 3] >> (places & 7) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)


def pack(sizes: np.ndarray, ids: bytes | bytearray, width: int) -> bytes:
    """One segment from the documents' counts and the concatenated ids of ``width`` bytes."""
    code = Boundaries.of(np.cumsum(sizes))
    head = HEADER.pack(MAGIC, width, code.low_bits, 0, code.n, code.total, len(code.high), len(code.samples))
    return b"".join([head, code.low.tobytes(), code.high.tobytes(), code.samples.tobytes(), ids])


def unpack(blob: bytes) -> tuple[Boundaries, np.ndarray]:
    """Boundaries and ids of one segment."""
    magic, width, low_bits, _, n, total, high, samples = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token file segment")
    at, parts = HEADER.size, []
    for size in ((n * low_bits + 7) // 8, high, 4 * samples):
        parts.append(blob[at : at + size])
        at += size
    low, high_bits = (np.frombuffer(p, np.uint8) for p in parts[:2])
    code = Boundaries(n, total, low_bits, low, high_bits, np.frombuffer(parts[2], "<u4"))
    return code, np.frombuffer(blob, f"<u{width}", offset=at)


class ChunkEncoder:
    """Ids of a text as bytes, equal to those of the tokenizers library for a byte-level BPE file.

    Texts of Latin letters, digits and marks are encoded by tiktoken's core, made
    from the same file's vocabulary and pattern, which needs a fifth of the
    library's time and keeps no memo. Everything else goes to the tokenizers
    library itself: other scripts, whose character classes may differ between
    the two, files whose ids don't follow their merges, and runs without any
    space. A long text is cut before single spaces between ASCII letters or
    digits, where a token always ends, so memory is bounded by ``BLOCK``.
    """

    _cut = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype(f"<u{width}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else re.compile("(?!)")
        self.core = self._core(spec)

    def _core(self, spec: dict):
        """tiktoken's encoder of the file, or None if the file is of another kind."""
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) or any(" " in t for t in self.special)
        marked = any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        if not plain or odd or marked or made != sorted(set(made)):
            return None
        byte_of = {c: i for i, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def blocks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > BLOCK and (m := self._cut.search(text, at + BLOCK)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def block(self, text: str) -> list[int]:
        if self.core is None or len(text) > LONGEST or not (text.isascii() or max(text) < FIRST_OTHER):
            return self.whole(text)
        if not self._special.search(text):
            return self.core.encode_ordinary(text)
        parts = [[self.special[p]] if p in self.special else self.core.encode_ordinary(p) for p in self._special.split(text)]
        return [i for part in parts for i in part]

    def text(self, text: str) -> bytes:
        if len(text) <= BLOCK:
            return np.array(self.block(text), self.kind).tobytes()
        return b"".join([np.array(self.block(b), self.kind).tobytes() for b in self.blocks(text)])

    def texts(self, texts: list[str]) -> list[bytes]:
        return [self.text(t) for t in texts]


@lru_cache(maxsize=1)
def chunk_encoder(path: str, width: int) -> ChunkEncoder:
    """One a Python worker, which serves all tasks that the worker runs."""
    return ChunkEncoder(path, width)


def write(
    docs: DataFrame, out: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", vocabulary: int = 1 << 16
) -> None:
    """Encode all texts and write the token file ``out`` in ascending key order.

    The texts are dealt by ranges of the key and, among equal keys, of their
    place in the input, so that one frequent key spreads over many tasks. A task
    encodes its sorted texts and closes a segment after ``SEGMENT_IDS`` ids.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    schema = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("seq", T.IntegerType()),
            T.StructField("n_docs", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("keys", T.ArrayType(docs.schema[key].dataType)),
            T.StructField("segment", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = chunk_encoder(path, width), np.array([end_id], f"<u{width}").tobytes()
        bucket, seq, keys, sizes, held = TaskContext.get().partitionId(), 0, [], [], bytearray()

        def close() -> pa.RecordBatch:
            counts = np.array(sizes, np.int64)
            row = [[bucket], [seq], [len(sizes)], [int(counts.sum())], [keys], [pack(counts, held, width)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, arrow.types)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder.text(t or "")
                    keys.append(k)
                    sizes.append(len(ids) // width + 1)
                    held += ids
                    held += end
                    if len(held) >= SEGMENT_IDS * width:
                        yield close()
                        seq, keys, sizes, held = seq + 1, [], [], bytearray()
        if sizes:
            yield close()

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(F.asc_nulls_first("k"), "place").sortWithinPartitions(F.asc_nulls_first("k"), "place")
    dealt.select("k", "t").mapInArrow(segments, schema).write.parquet(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the file ``out`` alone.

    ``start`` counts the ids of all documents before it; the crc is that of its ids
    as little-endian unsigned 32-bit integers.
    """
    stored = spark.read.parquet(out)
    kind = stored.schema["keys"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("seq", T.IntegerType()),
            T.StructField("key", kind),
            T.StructField("local", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, seq, keys, blob = (batch.column(c)[i].as_py() for c in range(4))
                code, ids = unpack(blob)
                ends = np.fromiter(map(code.select, range(code.n)), np.int64, code.n)
                starts = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                columns = [[bucket] * code.n, [seq] * code.n, keys, starts, ends - starts, crc]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, arrow.types)], schema=arrow)

    from pyspark.sql import Window as W

    sizes = stored.select("bucket", "seq", "n_ids")
    totals = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("total"))  # as many rows as buckets
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("bucket").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.join(totals, "bucket").select(
        "bucket", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("offset")
    )
    rows = stored.select("bucket", "seq", "keys", "segment").mapInArrow(documents, schema)
    return rows.join(offsets, ["bucket", "seq"]).select(
        "key", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
