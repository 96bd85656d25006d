"""Personal data: spans of four kinds, and terms that reveal them by the corpus's statistics.

Base spans are e-mail addresses, IPv4 addresses, card numbers and telephone
numbers, leftmost and non-overlapping within each kind. They are the protected
entities: an entity is a kind and a value in one form (lower case, digits only).

A term may give an entity away though the entity itself is masked: whoever knows
that the two stand together can tell it. How much a term t says about an entity e
is their pointwise mutual information, estimated from the corpus,

    PMI(e; t) = log2(N n(e, t) / (n(e) n(t))),

with n(e), n(t) the documents that hold e, or t, n(e, t) those in which t stands
within ``window`` words of e, and N all documents. e itself carries
IC(e) = log2(N / n(e)) bits. A term that says at least the share ``disclosure``
of them, in at least ``support`` documents, is a span of kind ``term`` wherever it
stands in a document in which it stands near e. It is generalised to its class, the words
of its first three letters, if that class says less than that share of all the
entities that the term reveals there; otherwise it is removed.

Work is in proportion to the text: an entity is paired with the words of its
window only, never with all words of its document. Terms are counted in the whole
corpus after a filter of fixed size, made of the pairs that have the support, so
that few words are shuffled. Joins on pairs are salted.

Nulls and edge cases: a null text is the empty text and has no spans. Repeated
rows count as documents and give repeated results; a null key stays null. Words
inside base spans are no terms. Endless runs of one class of characters are read
in linear time. An empty table gives an empty result. ``spans`` reads the two named
columns only, so other columns don't clash; ``sanitised`` returns (key, text) only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm._common import SLICE_ROWS, slices_udf, stored

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that are its company.
WINDOW = 10
#: Documents in which an entity and a term must stand together at least.
SUPPORT = 3
#: Share of an entity's information that a term may not reach.
DISCLOSURE = 0.9
#: Letters of a term's class, and of the shortest term.
CLASS_LETTERS = 3
#: Bits of the filter of terms, and distinct words that a task counts before it hands them on.
FILTER_BITS, HELD_WORDS = 1 << 20, 1 << 18
#: Parts into which the rows of one pair are dealt in a join.
SALTS = 8

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"\w{3,}")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address is a domain after an @ with all the characters of a local part before it."""
    free = 0
    for m in _DOMAIN.finditer(text):
        low = max(free, text.rfind("@", free, m.start()) + 1)
        start = low + len(text[low : m.start()].rstrip(_LOCAL))
        if start < m.start():
            yield start, m.end()
            free = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every base span, by kind and start, in characters."""
    found = zip(KINDS, (_emails, _ips, _cards, _phones))
    return [(kind, a, b) for kind, finder in found for a, b in finder(text)]


def entity(kind: str, value: str) -> int:
    """Number of a protected entity: equal for the forms of one value."""
    if kind == "email":
        form = value.lower()
    elif kind == "ip":
        form = ".".join(p.lstrip("0") for p in value.split("."))
    else:
        form = _NO_DIGIT.sub("", value)
    return _number(f"{kind}:{form}")


def _number(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) - 2**63


def class_of(term: str) -> str:
    return term[:CLASS_LETTERS] + "*"


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words of three characters or more that touch no base span."""
    words = [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text)]
    taken, out, k = sorted((a, b) for _, a, b in spans), [], 0
    for start, end, word in words:
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        # spans of different kinds may overlap: look at all that begin before the word's end
        if not any(a < end and b > start for a, b in _from(taken, k, end)):
            out.append((start, end, word))
    return out


def _from(taken: list[tuple[int, int]], k: int, end: int) -> Iterator[tuple[int, int]]:
    while k < len(taken) and taken[k][0] < end:
        yield taken[k]
        k += 1


def company(text: str, spans: list[tuple[str, int, int]], window: int) -> tuple[list[tuple], list[tuple]]:
    """Pairs (entity, term, class) of each entity and its window's words, and places (term, class, start, end) of those words."""
    words = terms_of(text, spans)
    starts, pairs = [w[0] for w in words], set()
    for kind, a, b in spans:
        at = int(np.searchsorted(starts, a))
        e = entity(kind, text[a:b])
        pairs.update((e, w[2]) for w in words[max(0, at - window) : at + window])
    near = {t for _, t in pairs}
    number = {t: (_number(t), _number(class_of(t))) for t in near}
    places = [(*number[w], a, b) for a, b, w in words if w in near]
    return [(e, *number[t]) for e, t in pairs], places


_PAIR = T.StructType([T.StructField(n, T.LongType()) for n in ("e", "t", "c")])
_PLACE = T.StructType([T.StructField("t", T.LongType()), T.StructField("c", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def marked(docs: DataFrame, key: str, text: str, window: int, keep_text: bool) -> DataFrame:
    """One row a document: id, key, base spans, and of its entities the numbers, the pairs and the places."""
    fields = [("id", T.LongType()), ("key", docs.schema[key].dataType), *[(f"n_{k}", T.LongType()) for k in KINDS], ("base", T.StringType())]
    fields += [("entities", T.ArrayType(T.LongType())), ("pairs", T.ArrayType(_PAIR)), ("places", T.ArrayType(_PLACE))]
    fields += [("text", T.StringType())] if keep_text else []
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pool = TaskContext.get().partitionId() << 33, pa.default_memory_pool()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                columns = [list(range(first, first + part.num_rows)), part.column(0), *[[] for _ in range(len(KINDS) + 4)]]
                first += part.num_rows
                for t in part.column(1).to_pylist():
                    spans = base_spans(t or "")
                    pairs, places = company(t, spans, window) if spans else ([], [])
                    counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                    numbers = sorted({entity(k, t[a:b]) for k, a, b in spans})
                    made = [*counts, joined, numbers, [dict(zip("etc", p)) for p in pairs], [dict(zip(("t", "c", "start", "end"), p)) for p in places]]
                    for column, value in zip(columns[2:], made):
                        column.append(value)
                columns += [part.column(1)] if keep_text else []
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c.cast(k) for c, k in zip(columns, arrow.types)], schema=arrow)
            del batch
            pool.release_unused()

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(rows, schema)


def term_counts(docs: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """(t, n): documents that hold each term or class of the filter ``wanted``; a task hands on its own sums."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, numbers, counts = held.value, {}, {}

        def number(term: str) -> int | None:
            """The term's number if the filter has it; kept for as long as the words met are few."""
            n = numbers.get(term, 0)
            if n == 0:
                n = _number(term)
                if len(numbers) > HELD_WORDS:
                    numbers.clear()
                n = numbers[term] = n if passes[n % FILTER_BITS] else None
            return n

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"t": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for t in batch.column(0):
                words = set(map(str.lower, set(_TERM.findall(t.as_py() or ""))))
                words.update([class_of(w) for w in words])
                for n in filter(None, map(number, words)):
                    counts[n] = counts.get(n, 0) + 1
            if len(counts) > HELD_WORDS:
                yield batch_of()
                counts.clear()
        if counts:
            yield batch_of()

    return docs.select(text).mapInArrow(counted, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def disclosing(rows: DataFrame, docs: DataFrame, text: str, support: int, disclosure: float) -> DataFrame:
    """(e, t, generalised): pairs of ``rows`` whose term says too much of the entity; whether its class doesn't."""
    entities = rows.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support)
    pairs = rows.select("id", F.explode("pairs").alias("p")).select("id", "p.*")
    with_term = pairs.groupBy("e", "t", "c").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    # a row has each term of an entity once, its class once for each of the class's terms
    with_class = pairs.select("id", "e", "c").distinct().groupBy("e", "c").agg(F.count(F.lit(1)).alias("n_ec"))
    near = stored(with_term.join(with_class, ["e", "c"]).join(entities, "e"), "pii-pairs")
    bit = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS))
    wanted = np.zeros(FILTER_BITS, bool)
    for c in ("t", "c"):  # at most FILTER_BITS numbers
        wanted[near.select(bit(c).alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    counts = stored(term_counts(docs, text, wanted), "pii-terms")
    total = docs.count()
    ic = F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))
    says = lambda both, own: ic + F.log2(F.col(both) / F.col(own)) >= F.lit(disclosure) * ic - F.lit(1e-9)
    near = near.join(counts.withColumnRenamed("n", "n_t"), "t").join(counts.select(F.col("t").alias("c"), F.col("n").alias("n_c")), "c")
    return near.where(says("n_et", "n_t")).select("e", "t", (~says("n_ec", "n_c")).alias("generalised"))


def found(docs: DataFrame, key: str, text: str, window: int, support: int, disclosure: float, keep_text: bool) -> DataFrame:
    """``marked`` rows with ``revealing``: start, end and generalised of each term span, by start."""
    rows = stored(marked(docs, key, text, window, keep_text), "pii-rows")
    flagged = stored(disclosing(rows.where(F.size("entities") > 0), docs, text, support, disclosure), "pii-flagged")
    salted = flagged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = rows.select("id", F.explode("pairs").alias("p")).select("id", "p.e", "p.t", F.pmod("id", F.lit(SALTS)).cast("int").alias("salt"))
    # a term that gives several entities of a document away is generalised only if its class gives none of them away
    terms = pairs.join(salted, ["e", "t", "salt"]).groupBy("id", "t").agg(F.min("generalised").alias("generalised"))
    terms = terms.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "generalised"))).alias("terms"))  # of one document's windows
    kind = "array<struct<start:int,end:int,generalised:boolean>>"
    spans = F.transform(F.filter("places", lambda p: F.map_contains_key("terms", p["t"])), lambda p: F.struct(p["start"], p["end"], F.col("terms")[p["t"]].alias("generalised")))
    with_entities = rows.where(F.size("pairs") > 0).join(terms, "id", "left")
    with_entities = with_entities.withColumn("revealing", F.coalesce(F.sort_array(spans), F.array().cast(kind))).drop("terms")
    return with_entities.unionByName(rows.where(F.size("pairs") == 0).withColumn("revealing", F.array().cast(kind))).drop("id", "entities", "pairs", "places")


def spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE
) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, terms): of every row the base spans and the spans of revealing terms.

    Spans are ``kind:start:end``, joined by commas, in characters of the text, the end exclusive.
    """
    rows = found(docs, key, text, window, support, disclosure, keep_text=False)
    shown = F.array_join(F.transform("revealing", lambda s: F.format_string("term:%d:%d", s["start"], s["end"])), ",")
    return rows.select(F.col("key").alias(key), *[f"n_{k}" for k in KINDS], "base", shown.alias("terms"))


def sanitised(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE
) -> DataFrame:
    """(key, text) of every row: base spans as [EMAIL] and so on, revealing terms as their class or left out. A null text stays null."""
    rows = found(docs, key, text, window, support, disclosure, keep_text=True)
    return rows.select(F.col("key").alias(key), _rewritten(F.col("text"), F.col("base"), F.col("revealing")).alias(text))


def rewrite(text: str, base: str, revealing: list[dict]) -> str:
    """A text with its spans replaced; of base spans that overlap, the first to begin covers both."""
    edits = []
    for kind, a, b in (s.split(":") for s in base.split(",") if s):
        edits.append((int(a), int(b), f"[{kind.upper()}]"))
    for s in revealing:
        edits.append((s["start"], s["end"], class_of(text[s["start"] : s["end"]].lower()) if s["generalised"] else ""))
    out, at, covered = [], 0, 0
    for a, b, shown in sorted(edits):
        if a >= covered:
            out += [text[at:a], shown]
        at = covered = max(covered, b)
    return "".join([*out, text[at:]])


def _rewritten(text: Column, base: Column, revealing: Column) -> Column:
    def score(texts: list, bases: list, found: list) -> pa.Array:
        return pa.array([None if t is None else rewrite(t, b, r) for t, b, r in zip(texts, bases, found)], pa.string())

    return slices_udf(score, T.StringType())(text, base, revealing)
