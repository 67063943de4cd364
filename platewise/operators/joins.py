"""Joins by similarity, blocked so that no cross join arises."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.text import jaccard, tokens


def fuzzy_best(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str, least: float = 0.6) -> DataFrame:
    """For each left row the right row with the largest word Jaccard, by an inverted index of words; no match is left out."""
    a = left.select(left_key, tokens(F.col(left_text)).alias("_a"))
    b = right.select(right_key, tokens(F.col(right_text)).alias("_b"))
    postings = b.select(right_key, "_b", F.explode("_b").alias("_t"))
    met = a.select(left_key, "_a", F.explode("_a").alias("_t")).join(postings, "_t").dropDuplicates([left_key, right_key])
    score = met.select(left_key, right_key, jaccard(F.col("_a"), F.col("_b")).alias("score")).where(F.col("score") >= least)
    return score.groupBy(left_key).agg(F.max_by(right_key, F.struct("score", -F.col(right_key))).alias(right_key), F.max("score").alias("score"))


def item_pairs(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Unordered pairs (a < b) of distinct items in each basket."""
    own = df.select(basket, item).distinct()
    return own.select(basket, F.col(item).alias("a")).join(own.select(basket, F.col(item).alias("b")), basket).where("a < b")


def levenshtein_pairs(names: DataFrame, column: str, k: int) -> DataFrame:
    """All pairs a < b of distinct names within an edit distance of k, and it: a, b, d. None is lost.

    The shorter name is cut in k + 1 pieces; k edits leave one of them whole, and shift it by k places at most, so pairs
    meet by (length of the shorter, piece, text). Names too short for k + 1 pieces meet all names of a length within k."""
    names = names.select(F.col(column).alias("w"), F.length(column).alias("size")).where("w IS NOT NULL")
    whole = "array(named_struct('i', 0, 'g', ''))"
    at, long = f"CAST(i * n DIV {k + 1} AS INT)", f"CAST((i + 1) * n DIV {k + 1} - i * n DIV {k + 1} AS INT)"
    own = f"IF(n <= {k}, {whole}, transform(sequence(0, {k}), i -> named_struct('i', i, 'g', substring(w, {at} + 1, {long}))))"
    places = f"filter(sequence(greatest({at} - {k}, 0), {at} + {k}), p -> p + {long} <= size)"
    other = f"IF(n <= {k}, {whole}, array_distinct(flatten(transform(sequence(0, {k}), i -> transform({places}, p -> named_struct('i', i, 'g', substring(w, p + 1, {long})))))))"
    short = names.withColumn("n", F.col("size")).select(F.col("w").alias("x"), "n", F.expr(f"inline({own})"))
    probe = names.withColumn("n", F.explode(F.sequence(F.greatest(F.col("size") - k, F.lit(0)), "size"))).select(F.col("w").alias("y"), "n", F.expr(f"inline({other})"))
    met = short.join(probe, ["n", "i", "g"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return met.select("a", "b", F.levenshtein("a", "b").alias("d")).where(F.col("d") <= k)


#: Pairs of items up to which their table is broadcast.
PAIRS = 200_000


def two_hop(likes: DataFrame, holds: DataFrame, most: int) -> DataFrame:
    """Of each user (likes: u, i) the `most` best items (u, i, s) that lead from the user's own ones over a common holder
    (holds: t, i) and are not the user's: s sums, over own items and holders, the product of how often a holder has each.

    Weights are added up by pair of items before any user meets them, and all of a user's items stay where the user is."""
    c = holds.groupBy("t", "i").agg(F.count("*").alias("c"))
    other = c.select("t", F.col("i").alias("to"), F.col("c").alias("d"))
    pairs = c.join(other, "t").where("i <> to").groupBy("i", "to").agg(F.sum(F.col("c") * F.col("d")).alias("w"))
    if pairs.count() <= PAIRS:
        pairs = F.broadcast(pairs)
    own = likes.groupBy("u").agg(F.collect_set("i").alias("own"))
    met = own.select("u", "own", F.explode("own").alias("i")).join(pairs, "i").where(F.col("u").isNull() | ~F.array_contains("own", F.col("to")))
    best = Window.partitionBy("u").orderBy(F.col("s").desc(), "i")
    found = met.groupBy("u", F.col("to").alias("i")).agg(F.sum("w").alias("s")).withColumn("r", F.row_number().over(best))
    return found.where(F.col("r") <= most).select("u", "i", "s")
