"""Names inside names, and names letter by letter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.joins import tiled_join

# The least similarity of a name inside another, and of two names letter by letter (0 to 100).
INSIDE_OVER, LETTERS_FROM = 0.5, 88
# Legal forms at a name's end that don't count, taken off one after the other.
FORM_ENDINGS = [
    "SOCIEDAD LIMITADA UNIPERSONAL", "SOCIEDAD LIMITADA", "SOCIEDAD ANONIMA", "SOCIEDAD COOPERATIVA", "SOCIEDAD CIVIL",
    "SLU", "SL", "SA", "SAU", "SCOOP", "CB", "EN LIQUIDACION",
]


# A name inside another


def best_window(asked: list[str], grams: list[str]) -> float:
    """Greatest similarity of a set of 3-grams and any run of another name's 3-grams, in order.

    The similarity of a run is the number of asked grams in it over that of the
    grams in either. A run that begins or ends with a gram that isn't asked is no better than
    the shorter one without it.
    """
    wanted, best = set(asked), 0.0
    if not wanted:
        return 0.0
    hits = [i for i, g in enumerate(grams) if g in wanted]
    for start in hits:
        seen, shared = set(), 0
        for i in range(start, len(grams)):
            gram = grams[i]
            if gram not in seen:
                seen.add(gram)
                shared += gram in wanted
            if gram in wanted:
                best = max(best, shared / (len(wanted) + len(seen) - shared))
        if shared <= best * len(wanted):  # runs that begin later hold no more asked grams
            break
    return best


def window_similarity(asked: Column, grams: Column) -> Column:
    """``best_window`` of two columns of 3-grams. Apply it to blocked, distinct pairs only."""

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([best_window(x, y) for x, y in zip(a, b)])

    return scored.asNondeterministic()(asked, grams)  # not to be moved into a join's condition, nor computed twice


def inside(asked: DataFrame, names: DataFrame, key: str, name: str, over: float = INSIDE_OVER) -> DataFrame:
    """(l_key, r_key, similarity): asked names, each with the names that it is found in with a similarity over ``over``.

    A pair needs more than ``over`` of the asked name's grams in the other name, so
    it shares one of the asked name's n - floor(over * n) rarest ones. Only these
    meet the inverted index of the names; a longer name costs nothing more. A frequent
    gram's entries are cut into tiles. Names are compared once each: join the result
    back on the name where ids are needed.
    """
    l = asked.select(F.col(key).alias("l_key"), text.trigrams(F.col(name)).alias("l_grams")).where(F.size("l_grams") > 0)
    r = names.select(F.col(key).alias("r_key"), text.ordered_trigrams(F.col(name)).alias("r_grams"))
    places = r.select("r_key", F.explode(F.array_distinct("r_grams")).alias("g"))
    frequency = places.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    own = l.select("l_key", F.size("l_grams").alias("size"), F.explode("l_grams").alias("g")).join(frequency, "g", "left")
    rank = F.row_number().over(W.partitionBy("l_key").orderBy(F.coalesce("n", F.lit(0)), "g"))
    rare = own.withColumn("at", rank).where(F.col("at") <= F.col("size") - F.floor(F.lit(over) * F.col("size"))).select("l_key", "g")
    pairs = tiled_join(rare, places, ["g"]).select("l_key", "r_key").distinct()
    found = pairs.join(l, "l_key").join(r, "r_key")
    return found.select("l_key", "r_key", window_similarity(F.col("l_grams"), F.col("r_grams")).alias("similarity")).where(F.col("similarity") > over)


# Names letter by letter


def core_name(name: Column) -> Column:
    """Upper case without accents, without the legal forms at its end."""
    plain = F.upper(F.trim(F.translate(F.coalesce(name, F.lit("")), "áéíóúÁÉÍÓÚñÑ", "aeiouAEIOUnN")))
    for form in FORM_ENDINGS:
        plain = F.trim(F.regexp_replace(plain, rf"(?<![\p{{L}}\p{{N}}_]){form}\.?\s*$", ""))
    return plain


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine step for each letter of ``b``: a bit for each place of ``a``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every  # places of a that no common subsequence so far ends at
    for letter in b:
        met = free & places.get(letter, 0)
        free = (free + met | free - met) & every
    return len(a) - free.bit_count()


def letter_ratio(a: str, b: str, least: float = 0.0) -> float:
    """0 to 100: twice the common letters over all letters; 0 if below ``least``, 100 for two empty names."""
    n = len(a) + len(b)
    if not n:
        return 100.0
    if 200 * min(len(a), len(b)) < least * n:  # even if the shorter one is whole in the longer one
        return 0.0
    ratio = 200 * common_letters(a, b) / n
    return ratio if ratio >= least else 0.0


def fuzzy_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """``letter_ratio`` of two names; each pair of a batch once. Null names are empty."""

    @F.pandas_udf("double")
    def scored(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = list(zip(left.fillna(""), right.fillna("")))
        known = {pair: letter_ratio(*pair, least) for pair in set(pairs)}
        return pd.Series([known[pair] for pair in pairs])

    return scored.asNondeterministic()(a, b)


def _numbered_pairs_of_letters(name: Column) -> Column:
    """Pairs of neighbouring letters, the ends marked, each with the number of times it came before."""
    marked = F.concat(F.lit("\u0002"), name, F.lit("\u0003"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2)))
    held = F.array(pairs)
    earlier = lambda found, g, i: F.size(F.filter(F.slice(found, F.lit(1), i + 1), lambda x: x == g))
    number = lambda found: F.transform(found, lambda g, i: F.concat(g, earlier(found, g, i).cast("string")))
    return F.get(F.transform(held, number), F.lit(0))


def alike(names: DataFrame, name: str = "name", least: float = LETTERS_FROM) -> DataFrame:
    """(a, b, ratio), a < b: distinct names whose letter ratio is ``least`` or more.

    Two names of that ratio differ by at most x = 1 - least / 100 of all their letters,
    and a letter spoils two pairs of neighbouring letters; so of a name of n letters
    at least n + 1 - 4 x n pairs, each counted as often as it comes, are in the other,
    and one of the rest's number and one more of the rarest is: a prefix filter that
    loses nothing. Above x = 1 / 4 it would keep everything and is refused.
    """
    x = 1 - least / 100
    if x >= 0.25:
        raise ValueError("names of a ratio of 75 or less need not share a pair of letters")
    every = names.select(F.col(name).alias("k")).where(F.col(name) != "").distinct()
    grams = every.select("k", F.length("k").alias("n"), F.explode(_numbered_pairs_of_letters(F.col("k"))).alias("g"))
    frequency = grams.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    rank = F.row_number().over(W.partitionBy("k").orderBy("f", "g"))
    kept = F.col("n") + 1 - F.ceil(F.col("n") + 1 - F.lit(4 * x) * F.col("n") - F.lit(1e-9)) + 1
    rare = grams.join(frequency, "g").withColumn("at", rank).where(F.col("at") <= kept).select("k", "n", "g")
    l, r = rare.select(F.col("k").alias("a"), F.col("n").alias("n_a"), "g"), rare.select(F.col("k").alias("b"), F.col("n").alias("n_b"), "g")
    near = (F.col("a") < F.col("b")) & (F.lit(200) * F.least("n_a", "n_b") >= F.lit(least) * (F.col("n_a") + F.col("n_b")))
    pairs = tiled_join(l, r, ["g"]).where(near).select("a", "b").distinct()
    return pairs.withColumn("ratio", fuzzy_ratio(F.col("a"), F.col("b"), least)).where(F.col("ratio") >= least)
