"""Alignment of tokenizers, fill-in-the-middle and personal data against plain recomputation."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import align, fim, pii, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside.
ODD = [(1, None, 0, 0), (2, "", 0, 0), (3, "a b", 0, 0), (3, "a b", 0, 0), (None, "a\nb", 1, 0), (4, "x" * 300_000, 0, 0), (5, "word é " * 30_000, 0, 0), (6, "\n \t", 0, 0), (7, "¡Señal! 漢字 😀", 0, 0), (8, "▁ odd", 0, 0), (9, "<|endoftext|> <s> a", 0, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, pairs int, id int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Alignment


class Plain:
    """Tokens by the libraries, links by comparing all byte ranges."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.byte_of = {c: i for i, c in enumerate(align.byte_alphabet())}

    def sides(self, text):
        found = self.a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(self.byte_of[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
        ids = self.b.encode(text)
        two = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in ids]
        data = (" " + text).encode()
        if not text or any(b"".join(t for _, t in side) != data for side in (one, two)):
            return [], []
        out = []
        for side in (one, two):
            at, placed = 0, []
            for i, t in side:
                placed.append((i, at, at + len(t)))
                at += len(t)
            out.append(placed)
        return out

    def row(self, text):
        one, two = self.sides(text or "")
        links = [(i, k) for i, a, b in one for k, c, d in two if a < d and c < b]
        groups, at = [], 0
        for end in sorted({b for _, _, b in one} & {d for _, _, d in two}):
            groups.append(",".join(str(i) for i, a, _ in one if at <= a < end) + "|" + ",".join(str(k) for k, c, _ in two if at <= c < end))
            at = end
        return len(one), len(two), groups, links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def random_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["the", " ", "  ", "qu", "é", "ing", "\n", "漢字", "😀", "Straße", "12", ".", "▁", "\t", "<s>", "<|endoftext|>", "'s", "ﬁ", "\x00", "a", "Zx"]
    return ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize(("run", "mixed"), [(7, True), (300, True), (1 << 18, True), (300, False)])
def test_alignment_against_all_byte_ranges(plain, monkeypatch, run, mixed):
    monkeypatch.setattr(align, "RUN", run)
    monkeypatch.setattr(align, "MEMO_LIMIT", 50)
    if not mixed:  # tuples that differ have one hash
        monkeypatch.setattr(align.Windows, "_times", align.Windows._times * np.uint64(0) + np.uint64(1 << 60))
    aligner = align.Aligner(A, B)
    texts = random_texts(600)
    for text, found in zip(texts, aligner.alignments(texts)):
        n_a, n_b, groups, links = plain.row(text)
        assert (found["n_a"], found["n_b"], found["n_groups"], found["n_links"]) == (n_a, n_b, len(groups), len(links)), text
        assert found["groups"] == ";".join(groups)
        codes = align._codes(found["pairs"], found["times"]).tolist()
        assert {(c >> 15, c & 0x7FFF): t for c, t in zip(codes, memoryview(found["times"]).cast("I"))} == Counter(links)


def test_texts_are_cut_where_tokens_end(monkeypatch):
    """The ids of the blocks of long texts are those of the libraries for the whole text."""
    import tessera.llm.tokenfile as tokenfile

    monkeypatch.setattr(tokenfile, "BLOCK", 50)
    aligner = align.Aligner(A, B)
    for text in [*random_texts(400, 5), *[(t + " abc de ") * 9 for t in random_texts(60, 6)], "the cat sat on the mat 12 3 a b", "don't cut 's here", "x" * 200 + " y"]:
        wanted = aligner.a_of.whole(" " + text), aligner.b_of.encode(text)
        blocks = list(aligner.ids(text))
        kept = [[], []] if None in blocks else [sum((b[side].tolist() for b in blocks), []) for side in (0, 1)]
        same = all(b"".join(side.bytes[i] for i in ids) == (" " + text).encode() for side, ids in zip((aligner.a, aligner.b), wanted))
        assert kept == (list(map(list, wanted)) if same else [[], []]), text


@pytest.mark.parametrize("block", [1 << 21, 40])
def test_weights_against_plain_counts(spark, plain, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK_PAIRS", block)
    texts = [*random_texts(60, 9), None, "", "the the", "the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    links = [plain.row(t)[3] for t in texts]
    held = Counter(p for found in links for p in set(found))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    for row in align.weighed(align.aligned(docs, A, B)).collect():
        found = links[row["doc_id"]]
        assert row["count_sum"] == sum(held[p] for p in found)
        assert row["n_best"] == sum(held[p] == most[p[0]] for p in found)
        assert row["n_links"] == len(found)


def test_alignment_odd_rows(spark, odd, empty, plain):
    rows = align.weighed(align.aligned(odd, A, B)).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[k]["n_links"] == 0 and by_id[k]["groups"] == "" for k in (1, 2, 8))
    assert by_id[7]["groups"] == ";".join(plain.row(ODD[8][1])[2]) and by_id[9]["n_a"] == plain.row(ODD[10][1])[0]
    assert by_id[5]["n_a"] > 30_000 and by_id[4]["n_groups"] > 0
    assert [r["n_links"] for r in rows if r["doc_id"] == 3] == [2, 2]
    assert align.weighed(align.aligned(empty, A, B)).collect() == []


def test_alignment_query_against_plain(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.length("text")).limit(25).collect()
    found = {r["doc_id"]: r for r in queries.op11_alignment(spark, SF).collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d in docs:
        groups = ";".join(plain.row(d["text"])[2])
        assert found[d["doc_id"]]["groups_sha256"] == (sha(groups) if groups else "")


# Fill in the middle


def test_index_converts_cuts_both_ways():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abé漢😀\n ") for _ in range(rng.randint(0, 40)))
        index = fim.ExceptionIndex(text.encode())
        assert index.n_chars == len(text)
        for cut in range(len(text) + 1):
            byte = len(text[:cut].encode())
            assert index.byte_at(cut) == byte and index.char_at(byte) == cut


def plain_example(key, text, lines, rate=100, spm_rate=50, seed=7):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if lines else list(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units,rate", [("lines", 100), ("chars", 100), ("lines", 40)])
def test_examples_against_plain_cuts(spark, odd, units, rate):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "é", "漢", "😀", "\n", " ", "<P", "S>", "<M>" if i % 9 == 0 else "<"]) for _ in range(rng.randint(0, 30))) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    made = fim.examples(docs, units=units, rate=rate)
    rows = made.select("doc_id", "text", "fim.*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(rows) == len(texts) + len(ODD)
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_example(r["doc_id"], r["text"], units == "lines", rate)
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}


def test_examples_of_an_empty_table_and_clashing_names(spark, odd, empty):
    assert fim.examples(empty).count() == 0
    assert fim.examples(odd.withColumn("n", F.lit(1)), out="made").columns == ["doc_id", "text", "pairs", "id", "n", "made"]
    with pytest.raises(ValueError):
        fim.examples(odd, units="words")


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rng, seen = random.Random(4), Counter()
    bits = ["a", "Z.", "@", "b-c", ".", "12", "255", "256.", "1.2.3.4", "+1", " ", "-", "(", ")", "4111111111111111", "4111 1111-1111 1111", "é", "%", "0004.", "+1 (555) 555-0100", "x@y.zz", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        found = pii.base_spans(text)
        assert found == plain_base(text), text
        seen.update(k for k, _, _ in found)
    assert min(seen[k] for k in pii.KINDS) > 100


def test_base_spans_of_endless_runs():
    n = 2_000_000
    for text in ("a" * n, "@" * n, "a@" * n, "1" * n, "1." * n, "1 " * n, "+1" * n, "+1" + " " * n, "a." * n + "@", "9" * n + ".1.1.1"):
        pii.base_spans(text)


def test_terms_that_touch_a_span_are_none():
    text = "mail jo@ex.org and abc"
    assert [t for _, _, t in pii.terms_of(text, pii.base_spans(text))] == ["mail", "and", "abc"]


def plain_terms(docs, window, support, disclosure):
    """Spans of terms by counting everything in plain dictionaries."""
    holds, n_e, n_t, n_et, n_ec = [], Counter(), Counter(), Counter(), Counter()
    for text in docs:
        text = text or ""
        spans = pii.base_spans(text)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w{3,}", text)]
        n_t.update({w for _, _, w in words} | {w[:3] + "*" for _, _, w in words})
        free = [w for w in words if not any(w[0] < b and w[1] > a for _, a, b in spans)]
        pairs = set()
        for kind, a, b in spans:
            before, after = [w for w in free if w[0] < a], [w for w in free if w[0] >= a]
            value = text[a:b].lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else "[^0-9]", "", text[a:b])
            pairs |= {((kind, value), w) for _, _, w in before[-window:] + after[:window]}
        n_e.update({(k, text[a:b].lower() if k == "email" else re.sub(r"[^0-9.]" if k == "ip" else "[^0-9]", "", text[a:b])) for k, a, b in spans})
        n_et.update(pairs)
        n_ec.update({(e, w[:3] + "*") for e, w in pairs})
        holds.append((pairs, free))
    def says(both, own, e):
        ic = math.log2(len(docs) / n_e[e])
        return ic + math.log2(both / own) >= disclosure * ic - 1e-9

    out = []
    for pairs, free in holds:
        flagged = defaultdict(list)
        for e, w in pairs:
            if n_e[e] >= support and n_et[e, w] >= support and says(n_et[e, w], n_t[w], e):
                flagged[w].append(not says(n_ec[e, w[:3] + "*"], n_t[w[:3] + "*"], e))
        out.append([(a, b, min(flagged[w])) for a, b, w in free if w in flagged])
    return out


def fixture_texts():
    rng = random.Random(8)
    common = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)] + 9 * ["abcd"]
    texts = []
    for i in range(240):
        words = [rng.choice(common) for _ in range(30)]
        if i % 12 == 0:  # a rare word and a rare class beside one person's address
            words[10:13] = ["abcqueue", "write", "jo@example.org", "zzkettle"]
        elif i % 12 == 1:
            words[20:21] = ["+1 (555) 555-0100", "shared"]
        elif i % 12 == 2:
            words[5:6] = ["shared", f"u{i}@example.org"]
        texts.append(" ".join(words))
    return [*texts, None, "", "jo@example.org"]


@pytest.mark.parametrize("disclosure", [0.9, 0.5])
def test_terms_against_plain_counts(spark, disclosure):
    texts = fixture_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = plain_terms(texts, 10, 3, disclosure)
    for row in pii.spans(docs, disclosure=disclosure).collect():
        assert row["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(texts[row["doc_id"]] or ""))
        assert row["terms"] == ",".join(f"term:{a}:{b}" for a, b, _ in wanted[row["doc_id"]]), texts[row["doc_id"]]
    flagged = [texts[i][a:b] for i, spans in enumerate(wanted) for a, b, _ in spans]
    assert {"abcqueue", "zzkettle"} <= set(flagged)
    assert all(not spans for text, spans in zip(texts, wanted) if not text or not plain_base(text))


def test_sanitised_texts(spark):
    texts = fixture_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert made[240] is None and made[241] == "" and made[242] == "[EMAIL]" and made[3] == texts[3]
    assert "[EMAIL]" in made[0] and "kettle" not in made[0] and "abc*" in made[0] and "queue" not in made[0]
    assert pii.rewrite("ab 4111111111111111 cd", "card:3:19", [{"start": 20, "end": 22, "generalised": False}]) == "ab [CARD] "


def test_personal_data_odd_rows(odd, empty):
    rows = pii.spans(odd).collect()
    assert len(rows) == len(ODD) and all(r["base"] == "" and r["terms"] == "" for r in rows)
    assert pii.spans(empty).collect() == [] and pii.sanitised(empty).collect() == []
    assert pii.spans(odd.select("id", "text"), key="id").columns[:2] == ["id", "n_email"]
    assert [r["text"] for r in pii.sanitised(odd.where("doc_id = 3")).collect()] == ["a b", "a b"]
