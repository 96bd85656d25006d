"""Fill-in-the-middle examples over a sparse index of multibyte characters.

A text is cut into prefix, middle and suffix, and written in the order prefix,
suffix, middle (psm) or suffix, prefix, middle (spm), each part behind its mark.
Texts stay UTF-8 bytes throughout. ``ExceptionIndex`` records only the multibyte
characters: the place of each, and how many bytes all up to it have beyond one a
character. A cut in characters becomes one in bytes, or the other way, by one
binary search among these exceptions; a text or span of ASCII needs no index, since its
cuts are the same number in both.

Units are lines (a line feed ends one; the last may lack it) or characters. The
cuts and the order of a row depend on its key and the seed only, through the
first four groups of eight hex digits of sha256("seed:key"): the first two give
the cuts, the third whether the row is cut at all, the fourth the order.

Nulls and edge cases: a null text is the empty text; a null key counts as an
empty one. Empty texts, texts that contain a mark, and rows beyond the rate stay
plain: their output is the text, their part sizes are null. Repeated rows give
repeated results. Texts of any length are cut whole; memory is a few times one
text. An empty table gives an empty result. Other columns stay as they are; one
named like ``out`` is replaced only if the caller names it so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm._common import slices_udf

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7

EXAMPLE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


class ExceptionIndex:
    """Places of a text's multibyte characters and the excess bytes up to each."""

    def __init__(self, data: bytes):
        self.size = len(data)
        if data.isascii():
            self.places = self.chars = self.excess = np.zeros(0, np.int64)
            return
        held = np.frombuffer(data, np.uint8)
        self.places = np.flatnonzero(held >= 0xC0)
        lead = held[self.places]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        #: excess[i]: bytes beyond one a character of the first i + 1 exceptions
        self.excess = np.cumsum(more)
        self.chars = self.places - (self.excess - more)

    @property
    def n_chars(self) -> int:
        return self.size - (int(self.excess[-1]) if len(self.excess) else 0)

    def _before(self, marks: np.ndarray, cut: int) -> int:
        found = int(np.searchsorted(marks, cut, "left"))
        return int(self.excess[found - 1]) if found else 0

    def byte_at(self, char: int) -> int:
        """Byte cut of a character cut."""
        return char + self._before(self.chars, char)

    def char_at(self, byte: int) -> int:
        """Character cut of a byte cut that splits no character."""
        return byte - self._before(self.places, byte)


class Cutter:
    """Cuts UTF-8 texts at units and writes them in the order of their form."""

    def __init__(self, units: str, rate: int, spm_rate: int, marks: tuple[str, str, str]):
        if units not in ("lines", "chars"):
            raise ValueError(f"units are lines or chars, not {units}")
        self.lines, self.rate, self.spm_rate = units == "lines", rate, spm_rate
        self.prefix, self.suffix, self.middle = (m.encode() for m in marks)

    def example(self, data: bytes, h: tuple[int, int, int, int]) -> tuple:
        """(n, form, prefix_chars, middle_chars, output) of a text and its four hashes."""
        index = None if self.lines else ExceptionIndex(data)
        ends = self._line_ends(data) if self.lines else None
        n = len(ends) if self.lines else index.n_chars
        if not data or h[2] % 100 >= self.rate or self.prefix in data or self.suffix in data or self.middle in data:
            return n, "plain", None, None, data
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if self.lines:
            index = ExceptionIndex(data[: int(ends[high - 1]) if high else 0])
            low, high = (int(ends[k - 1]) if k else 0 for k in (low, high))
            chars = index.char_at(low), index.char_at(high)
        else:
            chars, (low, high) = (low, high), (index.byte_at(low), index.byte_at(high))
        before, within, after = data[:low], data[low:high], data[high:]
        spm = h[3] % 100 < self.spm_rate
        parts = (self.suffix, after, self.prefix, before) if spm else (self.prefix, before, self.suffix, after)
        return n, "spm" if spm else "psm", chars[0], chars[1] - chars[0], b"".join([*parts, self.middle, within])

    @staticmethod
    def _line_ends(data: bytes) -> np.ndarray:
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        return ends if not data or data.endswith(b"\n") else np.append(ends, len(data))

    def restored(self, output: bytes, form: str) -> bytes:
        """The text of an output; its marks are the first of each kind, as no part contains one."""
        if form == "plain":
            return output
        first, second = (self.suffix, self.prefix) if form == "spm" else (self.prefix, self.suffix)
        if not output.startswith(first):
            raise ValueError("the output is not of this form")
        one, _, rest = output[len(first) :].partition(second)
        two, _, within = rest.partition(self.middle)
        return two + within + one if form == "spm" else one + within + two


def hashes(key: str, seed: int = SEED) -> Column:
    """The first four groups of eight hex digits of sha256("seed:key"), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)])


def examples(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    out: str = "fim",
    units: str = "lines",
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = SEED,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """Adds the struct ``out``: n units, form, prefix_chars, middle_chars, output.

    ``rate`` and ``spm_rate`` are percents: of rows that are cut, and of those
    that are written suffix first. ``marks`` are those of prefix, suffix and middle.
    """
    cutter, kind = Cutter(units, rate, spm_rate, marks), to_arrow_type(EXAMPLE)
    names = EXAMPLE.fieldNames()

    def cut(texts: list, found: list) -> pa.Array:
        columns = list(zip(*[cutter.example(d or b"", h) for d, h in zip(texts, found)]))
        arrays = [pa.array(c, pa.binary() if n == "output" else kind.field(n).type) for n, c in zip(names, columns)]
        arrays[-1] = arrays[-1].cast(pa.string())
        return pa.StructArray.from_arrays(arrays, fields=[kind.field(n) for n in names])

    return docs.withColumn(out, slices_udf(cut, EXAMPLE)(F.col(text).cast("binary"), hashes(key, seed)))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output and its form stand for; null where either is null."""
    cutter = Cutter("lines", 100, 50, marks)

    def back(outputs: list, forms: list) -> pa.Array:
        rows = [None if o is None or f is None else cutter.restored(o, f) for o, f in zip(outputs, forms)]
        return pa.array(rows, pa.binary()).cast(pa.string())

    return slices_udf(back, T.StringType())(output.cast("binary"), form)
