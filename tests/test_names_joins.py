"""Names inside names, letter ratios and tiled joins against plain Python."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, matching, names


def grams(name):
    return [f"  {w} "[i : i + 3] for w in name.split() for i in range(len(w) + 1)]


def windows(asked, name):
    """Greatest similarity over all runs of the name's grams."""
    want, have = set(grams(asked)), grams(name)
    runs = (set(have[i:j]) for i in range(len(have)) for j in range(i + 1, len(have) + 1))
    return max((len(want & r) / len(want | r) for r in runs), default=0.0)


def random_names(rng, n, letters="abcd"):
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))
    return sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(n)})


def test_word_in_two_words():
    assert names.best_window(sorted(set(grams("word"))), grams("two words")) == pytest.approx(0.8)
    assert names.best_window([], grams("x")) == 0.0 and names.best_window(["a"], []) == 0.0


def test_best_window_against_all_windows():
    rng = random.Random(1)
    some = random_names(rng, 150)
    for _ in range(1500):
        a, b = rng.choice(some), rng.choice(some)
        assert names.best_window(sorted(set(grams(a))), grams(b)) == pytest.approx(windows(a, b)), (a, b)


@pytest.mark.parametrize("over", [0.3, 0.5, 0.8])
def test_inside_against_all_pairs(spark, over):
    rng = random.Random(2)
    asked, held = random_names(rng, 40), random_names(rng, 80)
    l, r = (spark.createDataFrame([(n, n) for n in x] + [("none", None), ("empty", "")], "k string, n string") for x in (asked, held))
    found = {(x["l_key"], x["r_key"]): x["similarity"] for x in names.inside(l, r, "k", "n", over).collect()}
    wanted = {(a, b): s for a in asked for b in held if (s := windows(a, b)) > over}
    assert found == pytest.approx(wanted) and wanted


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_letters_against_the_table():
    rng = random.Random(3)
    for _ in range(800):
        a, b = ("".join(rng.choice("abñ漢 ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert names.common_letters(a, b) == lcs(a, b)
    assert names.letter_ratio("", "") == 100.0 and names.letter_ratio("", "a") == 0.0
    assert names.letter_ratio("abcd", "abed") == 75.0 and names.letter_ratio("abcd", "abed", 76) == 0.0
    assert names.letter_ratio("ab", "abcdefgh", 50) == 0.0


@pytest.mark.parametrize("least", [76, 88, 95])
def test_alike_against_all_pairs(spark, least):
    rng = random.Random(4)
    some = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 24))) for _ in range(60)]
    for n in list(some):
        at = rng.randrange(len(n))
        some += [n[:at] + n[at + 1 :], n[:at] + "d" + n[at:], n + "x"]
    some = sorted({n for n in some if n})
    found = {(r["a"], r["b"]): r["ratio"] for r in names.alike(spark.createDataFrame([(n,) for n in some] + [(None,), ("",)], "name string"), "name", least).collect()}
    wanted = {(a, b): 200 * lcs(a, b) / (len(a) + len(b)) for a in some for b in some if a < b and 200 * lcs(a, b) >= least * (len(a) + len(b))}
    assert found == pytest.approx(wanted) and len(wanted) > 20
    with pytest.raises(ValueError):
        names.alike(spark.createDataFrame([("a",)], "name string"), "name", 70)


def test_core_names(spark):
    rows = [("Obras Peña, S.L.", "OBRAS PENA, S.L."), ("Obras Pérez SL", "OBRAS PEREZ"), ("X SOCIEDAD LIMITADA en liquidacion", "X SOCIEDAD LIMITADA"), ("COSTA", "COSTA"), (None, ""), ("SL", "")]
    df = spark.createDataFrame(rows, "n string, w string").select(names.core_name(F.col("n")).alias("n"), "w")
    assert [r["n"] for r in df.collect()] == [w for _, w in rows]


def test_tiled_join_is_the_join_and_cuts_a_hot_key(spark):
    left = spark.range(12_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select((F.col("id") % 60).alias("k"), F.col("id").alias("b")).union(spark.range(700, 1200).select(F.lit(0), "id"))
    left = left.union(spark.createDataFrame([(None, 1)], "k long, a long"))
    found, plain = joins.tiled_join(left, right, ["k"], rows=200), left.join(right, "k")
    assert found.columns == plain.columns
    hashed = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("k", "a", "b").cast("decimal(38,0)"))).first())
    assert hashed(found) == hashed(plain)
    l, r = joins.tiles(left, right, ["k"], rows=200)
    sizes = l.groupBy("k", "_l", "_r").count().join(r.groupBy("k", "_l", "_r").agg(F.count(F.lit(1)).alias("m")), ["k", "_l", "_r"])
    worst = sizes.agg(F.max("count"), F.max("m"), F.max(F.col("count") * F.col("m")), F.sum(F.col("count") * F.col("m"))).first()
    assert worst[0] < 300 and worst[1] < 300 and worst[2] < 0.05 * worst[3]


def test_homonyms_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        base = "".join(rng.choice("abcde ") for _ in range(14)).strip() or "x"
        for j in range(3):
            name = base[: 12 - j % 2] + rng.choice(["", "x"])
            rows.append((3 * i + j, name + rng.choice(["", " SL", " SOCIEDAD LIMITADA"]), rng.choice(["s1", "s2", f"s{i}", None])))
    df = spark.createDataFrame(rows, "company_id long, name string, sheet string")
    core = {r["company_id"]: r["c"] for r in df.select("company_id", names.core_name(F.col("name")).alias("c")).collect()}
    wanted = {
        (a, b)
        for a, _, sa in rows
        for b, _, sb in rows
        if a < b and sa and sb and sa != sb and core[a] and core[b] and names.letter_ratio(core[a], core[b]) >= 88
    }
    found = {(r["a"], r["b"]) for r in matching.homonyms(df).collect()}
    assert found == wanted and len(wanted) > 30


def test_sequence_ratio_is_another_measure():
    assert names.letter_ratio("abcd", "dabc") == 75.0 and round(SequenceMatcher(None, "abcd", "dabc").ratio(), 2) == 0.75
