"""Training-data operators against brute force, the libraries, and held-out labels."""

import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontam, langid, nearcopies, quality, queries, rollup, simhash, tokenfile, toxicity, vptree

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
#: Nulls, empty and long texts, ties, repeated rows, and a column whose name operators use inside.
ODD = [(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "a b", 1), (4, "x" * 300_000, 0), (5, "word " * 30_000, 0), (6, "\n \t", 0), (7, "¡Señal! 漢字 😀", 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, fp int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, fp int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# BPE


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def test_bpe_same_as_library_on_random_texts(word_tokenizer):
    rng, encoder, decoder = random.Random(1), bpe.Encoder(WORD), bpe.Decoder(WORD)
    letters = "abcdeéüßÀÑñ 'sStTrReEvV\n\t12٣²½!?#$<|>.,Σςİ́̈漢字가한😀\x1c\x85ﬁ"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x"])
        ids = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert decoder.shown(ids) == word_tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_streams_endless_words(word_tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 64)
    rng, encoder = random.Random(2), bpe.Encoder(WORD)
    for pieces in (["in", "the", "qu", "é", "ing"], ["!", "?", "<"], ["a", "'s", "t!", "́", "1"]):
        for _ in range(60):
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(200, 900)))
            assert encoder.encode(text) == word_tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_many_words_at_once_is_one_by_one():
    table, rng = bpe.table_of(WORD), random.Random(4)
    words = [bytes(rng.choice(b"thequingaronse") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    assert table.finish_many(words) == [table.merged([table.inner[b] for b in w[:-1]] + [table.last[w[-1]]]) for w in words]


def test_bpe_odd_rows(odd, empty, word_tokenizer):
    for row in bpe.round_trip(odd, WORD).collect():
        ids = word_tokenizer.encode(row["text"] or "", add_special_tokens=False).ids
        shown = word_tokenizer.decode(ids, skip_special_tokens=False)
        assert row["bpe"]["n_tokens"] == len(ids)
        assert row["bpe"]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["bpe"]["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
    assert bpe.round_trip(empty, WORD).count() == 0


def test_bpe_decodes_to_plain_text(spark):
    df = spark.createDataFrame([("hello world, 漢字 it's",)], "text string")
    assert bpe.decode(bpe.encode(df, WORD), WORD).first()["decoded"] == "hello world , 漢字 it 's"


# SimHash


def _fingerprint(text, words):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_against_all_pairs(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = {r["doc_id"]: _fingerprint(r["text"], 4) for r in rows}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert all(found[d]["fp"] % (1 << 64) == prints[d] and found[d]["component_id"] == find(d) for d in ids)


@pytest.mark.parametrize("segments", [2, 3, 5])
def test_simhash_links_against_all_pairs(spark, segments):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 25)
    prints = sorted({int(b ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, rng.integers(1, 7)))) for b in base for _ in range(8)} | {0, -1})
    wanted = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 4}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    assert {tuple(r) for r in simhash.links(df, 4, segments).collect()} == wanted


def test_simhash_odd_rows(odd, empty):
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (6, 1), (3, 3), (None, 3)} <= found
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 7]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


# Near copies


def _jaccard_classes(texts, words=5, least=0.8):
    """{id: smallest id of its class} by all pairs of exact shingle sets."""
    sets = {}
    for d, text in texts.items():
        found = (text or "").encode().lower().split()
        sets[d] = frozenset(b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            one, two = sets[a], sets[b]
            if one == two or (one and two and len(one & two) >= least * len(one | two)):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def test_near_copies_against_all_pairs(spark, docs, monkeypatch):
    rng, texts = random.Random(8), {r["doc_id"]: r["text"] for r in docs.limit(60).collect()}
    for d in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 300))]
        for copy in range(5):
            words = list(base)
            for at in rng.sample(range(len(words)), copy * len(words) // 100):
                words[at] = "edited"
            texts[10_000 + 10 * d + copy] = " ".join(words)
    wanted = _jaccard_classes(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows, SF).collect()}
    assert kept == set(wanted.values())
    assert simhash.deduplicated(rows).count() > len(kept)  # a small radius misses near copies
    monkeypatch.setattr(nearcopies, "TILE", 2)  # most buckets are dealt into tiles
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(rows).collect()} == wanted


def test_near_copies_move_few_bytes(spark):
    """Texts that share bands and are no near copies: each is compared with its hub, and only packed words move."""
    rng, texts = random.Random(9), []
    for _ in range(150):
        base = [f"w{rng.randrange(4000)}" for _ in range(400)]
        texts += [" ".join(base[: 300 + 10 * copy] + [f"v{rng.randrange(4000)}" for _ in range(100 - 10 * copy)]) for copy in range(4)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).cache()
    rows.count()
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: (lambda x: sum(x.apply(i).totalShuffleWrite() for i in range(x.size())))(store.executorList(True))
    before = moved()
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(rows).collect()}
    assert found == _jaccard_classes(dict(enumerate(texts)))
    assert moved() - before < 2 * sum(map(len, texts))  # 4.3 when hashes of whole sets moved


def test_near_copies_odd_rows(odd, empty):
    kept = nearcopies.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 7]
    assert kept.where("doc_id is null").count() == 1
    assert nearcopies.near_copies(empty).count() == 0 and nearcopies.deduplicated(empty).count() == 0


# Decontamination


def test_decontamination_finds_edited_passages_and_spares_clean_ones(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulrstn") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(20)] + [(20, None), (21, ""), (22, "tiny"), (23, "a short item")]
    rows, planted = [], set()
    for i in range(60):
        body = text(300)
        if i < 20:
            passage = list(items[i][1])
            for _ in range(int(len(passage) * 0.04)):
                at = rng.randrange(len(passage))
                passage[at] = rng.choice(["z", "", passage[at] + "y"])
            body = body[:400] + " " + "".join(passage).upper() + "\n" + body[400:]
            planted.add((i, i))
        rows.append((i, body, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    items = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect()}
    assert found == planted
    assert sorted(r["doc_id"] for r in decontam.clean(docs, items).collect()) == list(range(20, 60))


def test_decontamination_in_blocks_is_the_same(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(tuple(r) for r in decontam.matches(docs, items).collect())
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1500)
    assert sorted(tuple(r) for r in decontam.matches(docs, items).collect()) == whole
    texts = {r["item_id"]: decontam.plain(r["text"]) for r in items.collect()}
    exact = {(d["doc_id"], i) for d in docs.collect() for i, t in texts.items() if t in decontam.plain(d["text"])}
    assert exact and exact <= {(r[0], r[1]) for r in whole}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _semi_global(item, text):
    """Least edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return min(row)


def test_decontamination_against_full_tables():
    """Items of every length from a q-gram on, with fewer and more edits than their budgets, and stems that many share."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    stem = word(30).strip()
    items = [(i, decontam.plain(word(8 + 3 * i))) for i in range(24)] + [(100 + i, decontam.plain(f"{stem} {word(25)}")) for i in range(12)] + [(5, "abcdefgh abcdefgh abcdefgh")]
    index = decontam.ItemIndex([x for x in items if len(x[1]) >= decontam.Q], decontam.EDIT_RATE)
    hits = 0
    for n in range(120):
        body = list(items[n % len(items)][1])
        for _ in range(rng.randint(0, 1 + decontam.budget(len(body), decontam.EDIT_RATE))):
            at = rng.randrange(len(body))
            body[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "z", "yz", "’"])
        text = decontam.plain(word(rng.randint(0, 60)) + "".join(body) + word(rng.randint(0, 60)))
        least = {(k, t): _semi_global(t, text) for k, t in items if len(t) >= decontam.Q}
        wanted = {k for (k, t), e in least.items() if e <= decontam.budget(len(t), decontam.EDIT_RATE)}
        found = index.matches(text)
        assert {m[0] for m in found} == wanted
        for key in wanted:
            mine = [m for m in found if m[0] == key]
            texts = [t for k, t in items if k == key]
            assert min(e for *_, e in mine) == min(least[key, t] for t in texts if len(t) >= decontam.Q)
            assert all(any(_distance(t, text[a:b]) == e for t in texts) for _, a, b, e in mine)
        hits += len(wanted)
    assert hits > 60


@pytest.mark.parametrize("letters", ["abcdefghij ", "abçdéf’ ", "漢字かな😀’ab "])
def test_decontamination_counts_characters(letters):
    """Random items and edits of one and of several bytes a character, against full tables of characters."""
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, t) for i in range(16) if len(t := decontam.plain(word(12 + 5 * i))) >= decontam.Q]
    index, hits = decontam.ItemIndex(items, decontam.EDIT_RATE), 0
    for n in range(60):
        body = list(items[n % len(items)][1])
        for _ in range(rng.randint(0, 1 + decontam.budget(len(body), decontam.EDIT_RATE))):
            body[rng.randrange(len(body))] = rng.choice(["", "z", "’", "é", "漢"])
        text = decontam.plain(word(20) + "".join(body) + word(20))
        wanted = {k for k, t in items if _semi_global(t, text) <= decontam.budget(len(t), decontam.EDIT_RATE)}
        assert {m[0] for m in index.matches(text)} == wanted
        hits += len(wanted)
    assert hits > 20


def test_decontamination_typographic_quote_is_one_edit():
    item = decontam.plain("what's the capital city of the country named in line?")
    index = decontam.ItemIndex([(1, item)], decontam.EDIT_RATE)
    found = index.matches(decontam.plain("so: " + item.replace("'", "’") + " he asked"))
    assert [(m[0], m[3]) for m in found] == [(1, 1)] and found[0][1] == 4


def test_decontamination_stem_that_many_items_share():
    rng = random.Random(22)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    stem = word(100)
    items = [(i, f"{stem} {word(120)}") for i in range(20_000)]
    index = decontam.ItemIndex(items, decontam.EDIT_RATE)
    text = decontam.plain(" ".join([stem] * 5) + " " + items[77][1] + " " + word(50))
    assert len(index.bands(decontam.grams(text))[0]) < 100  # the stem leads nowhere
    assert [m[0] for m in index.matches(text)] == [77]


def test_decontamination_item_key_named_like_the_document_key(spark):
    rows = spark.createDataFrame([(1, "x" * 100)], "id long, text string")
    assert decontam.matches(rows, rows, key="id", item_key="id").columns == ["id", "item_id", "start", "end", "edits"]


def test_banded_alignment_against_full_table():
    rng = random.Random(7)
    for _ in range(80):
        letters = rng.choice(["abc", "abé", "a漢😀"])
        item = "".join(rng.choice(letters) for _ in range(rng.randint(5, 25)))
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) + item[: rng.randint(3, 25)] + "".join(rng.choice(letters) for _ in range(6))
        start, end, edits = decontam.align(item, text, len(text) + len(item) + 1, len(item))
        assert edits == min(_distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        assert _distance(item, text[start:end]) == edits


def test_decontamination_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "x" * 100), (1, "x" * 100)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.matches(odd, some).collect()} == {4}
    assert decontam.matches(odd, none).count() == 0 and decontam.clean(odd, none).count() == len(ODD)
    assert decontam.matches(empty, some).count() == 0


# Models


def test_language_on_held_out_rows(spark):
    rows = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_is_the_posterior_of_a_dense_model(spark):
    """The registered model against sums over a plain count table; languages of very different shares."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null")
    rows = [r for r in docs.select("doc_id", "lang", "text").collect() if r["lang"] == "en" or r["doc_id"] % 5 == 0]
    model = langid.fit(spark.createDataFrame(rows))
    names = sorted({r["lang"] for r in rows})
    counts = {n: {} for n in names}
    for r in rows:
        for b in langid.hashed(r["text"]).tolist():
            counts[r["lang"]][b] = counts[r["lang"]].get(b, 0) + 1
    totals = {n: sum(c.values()) + 0.5 * langid.BUCKETS for n, c in counts.items()}
    share = {n: np.log(sum(r["lang"] == n for r in rows) / len(rows)) for n in names}
    for text in [r["text"] for r in rows[:40]] + ["a", "de la", "the", "und"]:
        buckets = langid.hashed(text).tolist()
        log = np.array([share[n] + sum(np.log((counts[n].get(b, 0) + 0.5) / totals[n]) for b in buckets) for n in names])
        lang, score = model.predict([text])[0]
        tempered = log / np.sqrt(len(buckets))
        assert lang == names[int(log.argmax())]
        assert abs(score - 1 / np.exp(tempered - tempered.max()).sum()) < 1e-4


def test_language_odd_rows(odd, empty):
    model = langid.Model(["de", "en"], np.zeros((langid.BUCKETS, 2), np.float32), np.log([0.5, 0.5]))
    found = [(r["doc_id"], r["language"]["lang_pred"]) for r in langid.predicted(odd, model).collect()]
    assert {d for d, lang in found if lang == "und"} == {1, 2, 6} and ("en" not in {lang for _, lang in found})
    assert langid.predicted(empty, model).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["language"]["lang_pred"] for r in langid.predicted(odd, langid.fit(unlabelled)).collect()} == {"und"}


def test_quality_separates_and_ignores_unlabelled(spark, odd, empty):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(40)) if i % 4 else "BUY!! NOW!! " * 15, int(i % 4 > 0)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    scores = {r["doc_id"]: r["score"] for r in quality.scored(table, model).collect()}
    assert all((scores[i] >= 0.5) == bool(q) for i, _, q in rows)
    assert all(0 <= r["score"] <= 1 for r in quality.scored(odd, model).collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.scored(odd, quality.fit(odd, none)).collect()} == {0.5}
    assert quality.scored(empty, model).count() == 0


def test_quality_model_is_the_least_loss_of_its_pairs():
    """The fitted weights against a plain loop over the same pairs, and a document with repeated rows."""
    rng = np.random.default_rng(23)
    rows = np.c_[rng.normal(size=(90, 3)), np.ones(90)].astype(np.float32)
    good = rows[:, 0] + 1.5 * rng.normal(size=90) > -0.5
    model = quality.solve(rows, good)
    z = np.clip((rows - model.mean) / model.scale, -6, 6)
    draw = np.random.default_rng(7)
    bad = np.flatnonzero(~good)
    loser, winner = np.repeat(bad, quality.PAIRS), draw.choice(np.flatnonzero(good), len(bad) * quality.PAIRS)
    loss = lambda w: np.mean([np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in zip(winner, loser)]) + 0.5e-3 * w @ w
    least = loss(model.weights)
    for step in np.eye(4)[:3] * 0.1:
        assert loss(model.weights + step) > least - 1e-5 and loss(model.weights - step) > least - 1e-5
    assert model.cut == np.quantile(z @ model.weights, 1 - good.mean())
    assert ((model.score(rows) >= 0.5) == (z @ model.weights >= model.cut)).all()


def test_quality_repeated_rows_of_one_document(spark):
    rows = [(1, "bad!! !!", 0)] * 40 + [(i, f"good words {i} of text", 1) for i in range(2, 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    once = quality.fit(table.dropDuplicates(), table)
    assert np.allclose(quality.fit(table, table).weights, once.weights)


def test_toxicity_learns_from_one_toxic_row(spark):
    rows = [(i, f"plain words number{i} here", 0) for i in range(60)] + [(60, "plain vile words here", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table, table)
    asked = spark.createDataFrame([(1, "such vile things"), (2, "such plain things")], "doc_id long, text string")
    assert [r["toxicity"]["toxic"] for r in toxicity.scored(asked, model).orderBy("doc_id").collect()] == [True, False]


def test_toxicity_score_against_plain_sums():
    model = toxicity.Model({b"vile": 2.0, b"blut ": 0.5, b"bluth ": 1.5}, [1.0, 3.0])
    for text, x in [(None, 0.0), ("", 0.0), ("Vile! vile", 2 * np.log1p(2)), ("bluthe a blute", 0.5 * np.log1p(2) + 1.5 * np.log1p(1))]:
        p = [1 / (1 + np.exp(t - x)) for t in model.thresholds]
        found = model.score(text)
        assert abs(found["severity"] - sum(p)) < 1e-12 and abs(found["p_toxic"] - p[0]) < 1e-12
        assert found["grade"] == sum(q >= 0.5 for q in p) and found["toxic"] == (found["grade"] > 0)
    loud = [[(0, 1.0)], [(0, 2.0)], [(1, 1.0)], []]
    assert toxicity.solve(loud, np.array([1, 2, 0, 0]), 2)[0][0] > 0


def test_toxicity_finds_marked_words_and_stems(spark, odd, empty):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        if i % 5 == 0:
            for _ in range(rng.randint(2, 8)):
                words[rng.randrange(60)] = rng.choice(["Vile,", "bluth" + rng.choice("abcdef")])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(table, model).collect()}
    assert all(found[i]["toxic"] == bool(t) for i, _, t in rows)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    assert toxicity.scored(odd, model).where("toxicity.toxic").count() == 0
    assert toxicity.scored(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(odd, toxicity.fit(odd, none)).where("toxicity.severity <> 0").count() == 0


def test_ordinal_gradient_fits_ordered_grades():
    rng = np.random.default_rng(9)
    n = rng.integers(0, 12, 600)
    grades = np.digitize(n, [3, 7, 10])
    w, t = toxicity.solve([[(0, float(k))] for k in n], grades, 1)
    assert (np.digitize(n * w[0], t) == grades).mean() > 0.99 and (np.diff(t) > 0).all()


# Rollups


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    image = rollup.image(F.col("s"), F.col("l"), F.lit("v1"), F.col("n"))
    rows = spark.createDataFrame([("a", "en", 3), ("a", None, 5), (None, "en", None), ("a", "en", 3)], "s string, l string, n int")
    kept = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert kept.totals().count() == 0
    assert kept.commit("one", rows.select(*rollup.inserted(image))) and not kept.commit("one", rows.select(*rollup.inserted(image)))
    after = rollup.image(F.col("s"), F.col("l"), F.lit("v1"), F.col("n") + 1)
    kept.commit("two", rows.select(*rollup.revised(image, after)))
    kept.commit("three", rows.where("s is null").select(*rollup.deleted(after)))
    kept.commit("four", rows.where("false").select(*rollup.inserted(image)))
    assert {tuple(r) for r in kept.totals().collect()} == {("a", "en", "v1", 2, 8), ("a", None, "v1", 1, 6)}


# Vantage-point trees


def _nearest(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 4 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = set()
    for q, v in usable:
        if q % 5 == 0:
            best = sorted((-float(np.einsum("ij,ij->i", v[None], x[None])[0]), i) for i, x in usable if i != q)[:k]
            out |= {(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(best, 1)}
    return out


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(150)]
    rows += [(i, [1.0, 2.0, 0.0, 0.5]) for i in range(150, 200)]  # copies: ties go to smaller ids
    rows += [(200, None), (205, [0.0] * 4), (210, [1.0, None, 0.0, 0.0]), (215, [float("nan"), 1.0, 0.0, 0.0]), (220, [float("inf"), 1.0, 0.0, 0.0]), (225, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vptree.nearest(df, F.col("vec_id") % 5 == 0, k=7, factor=1.0, shard_rows=60)
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect()} == _nearest(rows, 7)
    relaxed = vptree.nearest(df, F.col("vec_id") % 5 == 0, k=7, factor=1.2, shard_rows=60)
    exact = {x[:1] + x[2:3] for x in _nearest(rows, 7)}
    assert len(exact & {(r["query_id"], r["vec_id"]) for r in relaxed.collect()}) >= 0.9 * len(exact)


def test_nearest_where_query_ids_repeat(monkeypatch):
    """A query's own rows neither tighten its bound nor hide tied ids."""
    monkeypatch.setattr(vptree, "LEAF", 4)
    rng, k = np.random.default_rng(11), 5
    vectors = rng.normal(size=(80, 3)).astype(np.float32)
    # id 0 has 12 differing vectors near the query and 9 rows of one that other ids have too
    ids = np.r_[np.zeros(12, np.int64), np.arange(1, 69)]
    vectors[:12] = np.float32([3.0, 3.0, 3.0]) + vectors[:12] / 10
    ids, vectors = np.r_[ids, np.zeros(9, np.int64), np.arange(100, 108)], np.r_[vectors, np.tile(np.float32([2.9, 2.9, 2.9]), (17, 1))]
    top = float((vectors.astype(np.float64) ** 2).sum(1).max()) * (1 + 1e-12)
    found = [f[1:] for f in vptree.Tree(ids, vectors, top).search(np.array([0]), vectors[:1], k, 1.0, top)]
    scores = vectors.astype(np.float64) @ vectors[0].astype(np.float64)
    wanted = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i)[:k]
    assert [i for i, _ in found] == [i for _, i in wanted] == [100, 101, 102, 103, 104]


def test_nearest_of_a_repeated_query_is_that_of_its_smallest_vector(spark):
    rows = [(0, [5.0, 0.0]), (0, [0.0, 5.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    for parts in (1, 4):
        df = spark.createDataFrame(rows if parts == 1 else rows[::-1], "vec_id long, embedding array<float>").repartition(parts)
        found = vptree.nearest(df, F.col("vec_id") % 20 == 0, k=1)
        assert [tuple(r)[:3] for r in found.collect()] == [(0, 1, 2)]


def test_nearest_of_vectors_of_each_length(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (5, [1.0, 1.0, 1.0]), (6, [0.0, 2.0, 0.0]), (7, [0.0, 1.0, 0.0]), (10, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 5 == 0).collect()]
    assert sorted(found) == [(0, 1, 1, 0.5), (5, 1, 6, 2.0), (5, 2, 7, 1.0)]


def test_nearest_small_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(empty, F.col("vec_id") % 5 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vptree.nearest(few, F.col("vec_id") % 5 == 0).collect()] == [(0, 1, 1, 0.5), (0, 2, 1, 0.5)]


# Chat


def test_chat_reads_back_any_text(spark):
    rng, letters = random.Random(11), "\\#<>:/ ln\nbhc### </turn>é😀"
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a: b#<"]), None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for c in range(40) for t in range(rng.randint(1, 7))]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    f = F.col("formatted")
    read = made.select("conv_id", "example", chat.turns_of(f).alias("turns"), chat.trainable(f, F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    by = {}
    for c, _, role, text in rows:
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        mine = sorted((r for r in read if r["conv_id"] == c), key=lambda r: r["example"])
        ends = [i for i, (role, _) in enumerate(turns, 1) if role == "assistant" or i == len(turns)]
        assert [[tuple(t) for t in r["turns"]] for r in mine] == [turns[:e] for e in ends]
        assert [r["loss"] for r in mine] == [turns[e - 1][1] if turns[e - 1][0] == "assistant" else "" for e in ends]


def test_chat_empty_table(spark):
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# Token files


def test_boundaries_select_and_decode():
    rng = random.Random(12)
    for _ in range(60):
        ends = np.cumsum([rng.choice([0, 1, 7, 400, 9000]) for _ in range(rng.randint(1, 900))])
        code = tokenfile.Boundaries.of(ends)
        assert (code.all() == ends).all()
        assert all(code.select(i) == ends[i] for i in range(0, len(ends), 41))


def test_pieces_same_as_library():
    from tokenizers import Tokenizer

    whole, encoder, rng = Tokenizer.from_file(BYTE), tokenfile.ChunkEncoder(BYTE, 2), random.Random(13)
    parts = ["the", " cat,", ". ", ".\n", "\n\n", "  ", "é", "3.5", "'s", "THE!!", "<|endoftext|>", "\t", "x", " ", "-", "漢字", ",", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [" ".join(rng.choice(parts) for _ in range(20)) for _ in range(500)]
    for text, ids in zip(texts, encoder.texts(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_file_round_trip(spark, odd, empty, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 50)
    whole = Tokenizer.from_file(BYTE)
    out = f"file://{tmp_path}/tokens"
    tokenfile.write(odd, out, BYTE, 2, vocabulary=50_257)
    found = sorted((tuple(r) for r in tokenfile.read(spark, out).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, 1, 2, 3, 3, 4, 5, 6, 7]
    start, texts = 0, dict((k, t) for k, t, _ in ODD)
    for key, at, n, crc in found:
        ids = [*whole.encode(texts[key] or "", add_special_tokens=False).ids, 2]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    tokenfile.write(empty, f"file://{tmp_path}/none", BYTE, 2)
    assert tokenfile.read(spark, f"file://{tmp_path}/none").count() == 0


# Registered queries and the pipeline


def test_pipeline_keeps_what_every_stage_keeps(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = {r["doc_id"]: r["toxic"] for r in queries.op1_toxicity(spark, SF).collect()}
    out = corpus_pipeline.run(spark, SF)
    kept = {r["doc_id"] for r in out.collect()}
    assert kept and not any(marks[d] for d in kept)
    leaks = {r["doc_id"] for r in queries.op3_decontamination(spark, SF).collect()}
    assert not kept & leaks
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len({texts[d] for d in kept}) == len(kept)
