"""Terms matched to a catalogue of foods: candidates by an inverted index, similarity of token sets, rerank, resolution.

Terms and foods are distinct names, so tables are small against recipe lines; still nothing is crossed: candidates meet
by a shared word, by a piece of a name, or by equality.
"""

from __future__ import annotations

import difflib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from platewise.functions.names import synonym_forms
from platewise.functions.text import jaccard, tokens


def indel(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / both lengths): twice the longest common subsequence, bit-parallel."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = row = (1 << len(a)) - 1
    for c in b:
        u = row & places.get(c, 0)
        row = (row + u | row - u) & mask
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """The best of: shared words against each side's words, and both sides; 100 if one side's words are all shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 100.0
    one, two = (f"{shared} {left}".strip(), f"{shared} {right}".strip())
    return max(indel(one, two), *([indel(shared, one), indel(shared, two)] if shared else []))


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def candidates(terms: DataFrame, foods: DataFrame, term: str, food: str, name: str, most: int | None = None, generic: list[str] | None = None) -> DataFrame:
    """Pairs (term, food) that share a word (generic words do not count), at most `most` for a term and word if given: those of the smallest food.

    The cap belongs to the operator as it is known; None keeps all."""
    words = F.filter(tokens(F.col(name)), lambda w: ~w.isin(generic)) if generic else tokens(F.col(name))
    own = F.filter(tokens(F.col(term)), lambda w: ~w.isin(generic)) if generic else tokens(F.col(term))
    met = terms.select(term, F.explode(own).alias("word")).join(foods.select(food, F.explode(words).alias("word")), "word")
    if most:
        met = met.withColumn("place", F.row_number().over(Window.partitionBy(term, "word").orderBy(food))).where(F.col("place") <= most)
    return met.select(term, food).distinct()


def capped_union(parts: list[DataFrame], term: str, food: str, most: int) -> DataFrame:
    """Candidates of several sources, once each, at most `most` a term: earlier sources first."""
    every = None
    for i, part in enumerate(parts):
        own = part.select(term, food, F.lit(i).alias("source"))
        every = own if every is None else every.unionByName(own)
    every = every.groupBy(term, food).agg(F.min("source").alias("source"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy(term).orderBy("source", food))).where(F.col("place") <= most).drop("place")


#: Weights of the rerank: similarity, word Jaccard, embedding, quality; coverage's share of the quality.
WEIGHTS = {"fuzz": 0.75, "jaccard": 0.1, "embed": 0.0, "quality": 0.15, "coverage": 0.7}


def reranked(pairs: DataFrame, term: str, food: str, name: str, coverage: str, bonus: str, embed: str | None = None, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """pairs with fuzz, jaccard, score and rank: similarity and quality, coverage and bonus relative to a term's best candidates."""
    best = pairs.groupBy(term).agg(F.greatest(F.lit(1.0), F.max(coverage)).alias("best_coverage"), F.greatest(F.lit(1.0), F.max(bonus)).alias("best_bonus"))
    out = pairs.join(best, term).withColumn("fuzz", token_set_ratio(F.col(term), F.col(name))).withColumn("jaccard", jaccard(tokens(F.col(term)), tokens(F.col(name))))
    share = weights["coverage"]
    quality = 100 * (share * F.col(coverage) / F.col("best_coverage") + (1 - share) * F.col(bonus) / F.col("best_bonus"))
    near = F.coalesce(F.col(embed), F.lit(0.0)) if embed else F.lit(0.0)
    score = weights["fuzz"] * F.col("fuzz") + weights["jaccard"] * 100 * F.col("jaccard") + weights["embed"] * 100 * near + weights["quality"] * quality
    out = out.withColumn("score", score).drop("best_coverage", "best_bonus")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(term).orderBy(F.desc("score"), food)))


def accepted(ranked: DataFrame, coverage: str, least: Column | float) -> DataFrame:
    """The best of each term if it is similar enough: 5 less (60 at least) is asked of foods with 8 nutrients or more."""
    least = least if isinstance(least, Column) else F.lit(float(least))
    limit = F.when(F.col(coverage) >= 8, F.greatest(least - 5, F.lit(60.0))).otherwise(least)
    return ranked.where((F.col("rank") == 1) & (F.col("fuzz") >= limit))


def adaptive_least(matched: DataFrame) -> DataFrame:
    """One row, least_fuzz: 5 below the mean similarity of what is matched, 75 at least."""
    return matched.agg(F.greatest(F.lit(75.0), F.bround(F.avg("fuzz") - 5)).alias("least_fuzz"))


def rescued(terms: DataFrame, done: DataFrame, term: str, again) -> DataFrame:
    """done, and what `again` (a matcher) finds for the terms that are not in it."""
    return done.unionByName(again(terms.join(done.select(term), term, "left_anti")), allowMissingColumns=True)


def best_name(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.6) -> DataFrame:
    """For each name its best counterpart: 1 if equal, 0.9 if one holds the other, else word Jaccard; a, b, score.

    Names meet by a shared word, or by a name that is a run of the other's words; a name that holds another only inside
    its words is found by neither, as in `Kornflake` and `corn`."""
    x, y = left.select(a).distinct(), right.select(b).distinct()
    met = x.select(a, F.explode(tokens(F.col(a))).alias("word")).join(y.select(b, F.explode(tokens(F.col(b))).alias("word")), "word").select(a, b).distinct()
    holds = F.col(a).contains(F.col(b)) | F.col(b).contains(F.col(a))
    score = F.when(F.col(a) == F.col(b), 1.0).when(holds, F.greatest(F.lit(0.9), jaccard(tokens(F.col(a)), tokens(F.col(b))))).otherwise(jaccard(tokens(F.col(a)), tokens(F.col(b))))
    return met.select(a, b, score.alias("score")).where(F.col("score") >= least).withColumn("place", F.row_number().over(Window.partitionBy(a).orderBy(F.desc("score"), b))).where("place = 1").drop("place")


def grams_of(name: Column, width: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - width + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(width))))


def holding(small: DataFrame, large: DataFrame, a: str, b: str, width: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct names where b holds a as a substring, equality included. None is lost.

    Names meet by the first `width` letters of a, which b must have somewhere; shorter names meet by what they have."""
    x = small.select(a).distinct().where(F.length(a) > 0).select(a, F.least(F.length(a), F.lit(width)).alias("w"), F.substring(a, 1, width).alias("gram"))
    y = large.select(b).distinct()
    parts = [y.select(b, F.lit(w).alias("w"), F.explode(grams_of(F.col(b), w)).alias("gram")) for w in range(1, width + 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return x.join(every, ["w", "gram"]).where(F.col(b).contains(F.col(a))).select(a, b)


def two_way(queries: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """For each query the name that is equal, else that it holds (the longest), else that holds it (the shortest); a, b, way."""
    up = holding(queries, names, a, b).select(a, b, F.when(F.col(a) == F.col(b), 0).otherwise(2).alias("way"))
    down = holding(names, queries, b, a).where(F.col(a) != F.col(b)).select(a, b, F.lit(1).alias("way"))
    size = F.when(F.col("way") == 1, -F.length(b)).otherwise(F.length(b))
    order = Window.partitionBy(a).orderBy("way", size, b)
    return up.unionByName(down).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def resolved(names: DataFrame, foods: DataFrame, a: str, b: str, synonyms: Mapping[str, str], least: float = 0.75, width: int = 2) -> DataFrame:
    """Each name's food, score and method: exact (1), a food that holds it (share of its length), a word of it (0.7), or similar.

    Synonyms of a name count as it. Similar pairs are those that share enough pieces of `width` letters to be able to reach
    `least`: the matching blocks of a ratio r hold r * (both lengths) / 2 letters, which must be shared letters."""
    forms = names.select(a).distinct().select(a, F.explode(synonym_forms(F.col(a), synonyms)).alias("form"))
    foods = foods.select(b).distinct()
    exact = forms.join(foods, F.col("form") == F.col(b)).select(a, b, F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    held = holding(forms, foods, "form", b).where(F.col("form") != F.col(b)).join(forms, "form")
    held = held.select(a, b, (F.length("form") / F.length(b)).alias("score"), F.lit("contains").alias("method"))
    word = forms.select(a, F.explode(F.split("form", " ")).alias("word")).where(F.length("word") > 3).join(foods, F.col("word") == F.col(b))
    word = word.select(a, b, F.lit(0.7).alias("score"), F.lit("word").alias("method"))
    found = exact.unionByName(held).unionByName(word)
    settled = found.where("score >= 0.85").select(a).distinct()
    open_ = forms.join(settled, a, "left_anti")
    grams = lambda c: grams_of(F.col(c), 1)  # noqa: E731  letters: what blocks are made of
    x = open_.select(a, "form", F.length("form").alias("n"), grams("form").alias("g"), F.explode(grams_of(F.col("form"), width)).alias("gram"))
    y = foods.select(b, F.length(b).alias("m"), grams(b).alias("h"), F.explode(grams_of(F.col(b), width)).alias("gram"))
    fits = (2 * F.least("n", "m") >= least * (F.col("n") + F.col("m")))
    met = x.join(y, "gram").where(fits).select(a, "form", b).distinct()
    similar = met.withColumn("score", sequence_ratio(F.col("form"), F.col(b))).where(F.col("score") >= least).select(a, b, "score", F.lit("similar").alias("method"))
    order = Window.partitionBy(a).orderBy(F.desc("score"), "method", b)
    best = found.unionByName(similar).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return names.select(a).distinct().join(best, a, "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("method", F.coalesce("method", F.lit("unmatched")))
