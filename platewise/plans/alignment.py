"""Queries over the alignment operators: part names as terms and foods."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import alignment as A
from platewise.plans.catalogue import query
from platewise.sources.tables import read


def _terms(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()


def _foods(spark, sf_dir):
    """A food for each name and type; what its type is worth and in how many sizes it is there stand for bonus and coverage."""
    part = read(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("food"), F.countDistinct("p_size").alias("coverage"))
    return part.select("food", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), F.col("coverage").cast("double").alias("coverage"), F.length("p_type").cast("double").alias("bonus"))


_FOODS = "SELECT min(p_partkey) AS food, p_name || ' ' || lower(p_type) AS name FROM part GROUP BY p_name, p_type"


@query("candidate_pairs", f"WITH f AS ({_FOODS}), t AS (SELECT DISTINCT p_name AS term FROM part) SELECT term, food FROM t JOIN f ON len(list_intersect(string_split(lower(term), ' '), regexp_split_to_array(lower(name), '[^a-z0-9]+'))) > 0")
def candidate_pairs(spark, sf_dir):
    return A.candidates(_terms(spark, sf_dir), _foods(spark, sf_dir), "term", "food", "name")


@query("token_set_ratio_topk", None)
def token_set_ratio_topk(spark, sf_dir):
    """The three best foods of each term by the rerank."""
    terms, foods = _terms(spark, sf_dir), _foods(spark, sf_dir)
    pairs = A.candidates(terms, foods, "term", "food", "name", most=200).join(foods, "food")
    return A.reranked(pairs, "term", "food", "name", "coverage", "bonus").where("rank <= 3").select("term", "food", F.round("fuzz", 4).alias("fuzz"), F.round("score", 4).alias("score"), "rank")


@query("aligned_terms", None)
def aligned_terms(spark, sf_dir):
    """The accepted food of each term, at a limit taken from a first pass."""
    terms, foods = _terms(spark, sf_dir), _foods(spark, sf_dir)
    ranked = A.reranked(A.candidates(terms, foods, "term", "food", "name", most=200).join(foods, "food"), "term", "food", "name", "coverage", "bonus")
    least = A.adaptive_least(A.accepted(ranked, "coverage", 75.0))
    return A.accepted(ranked.crossJoin(F.broadcast(least)), "coverage", F.col("least_fuzz")).select("term", "food", F.round("fuzz", 4).alias("fuzz"))


@query("names_holding_names", "WITH a AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a FROM part), b AS (SELECT DISTINCT p_name AS b FROM part) SELECT a, b FROM a JOIN b ON contains(b, a)")
def names_holding_names(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return A.holding(part.select(F.split("p_name", " ")[0].alias("a")), part.select(F.col("p_name").alias("b")), "a", "b")


@query("two_way_match", """WITH q AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a FROM part UNION SELECT DISTINCT 'old ' || p_name FROM part UNION SELECT DISTINCT p_name FROM part), n AS (SELECT DISTINCT p_name AS b FROM part),
m AS (SELECT a, b, CASE WHEN a = b THEN 0 WHEN contains(a, b) THEN 1 ELSE 2 END AS way FROM q JOIN n ON contains(a, b) OR contains(b, a))
SELECT a, b, way FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY way, CASE WHEN way = 1 THEN -length(b) ELSE length(b) END, b) AS r FROM m) t WHERE r = 1""")
def two_way_match(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("b")).distinct()
    queries = names.select(F.split("b", " ")[0].alias("a")).union(names.select(F.concat(F.lit("old "), "b"))).union(names.select("b")).distinct()
    return A.two_way(queries, names, "a", "b")


@query("best_names", """WITH a AS (SELECT DISTINCT 'old ' || p_name AS a FROM part), b AS (SELECT DISTINCT p_name AS b FROM part),
s AS (SELECT a, b, CASE WHEN contains(a, b) THEN greatest(0.9, j) ELSE j END AS score FROM (SELECT a, b, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) * 1.0::DOUBLE / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS j FROM a, b) x)
SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE score >= 0.6) t WHERE r = 1""")
def best_names(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("b")).distinct()
    return A.best_name(names.select(F.concat(F.lit("old "), "b").alias("a")), names, "a", "b")


@query("resolved_names", None)
def resolved_names(spark, sf_dir):
    """Part names, some misspelt or with a synonym, as foods."""
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("food")).distinct()
    spoilt = names.select(F.regexp_replace("food", "a(.)", "$1a").alias("name")).union(names.select(F.replace("food", F.lit("blue"), F.lit("azure")))).distinct()
    return A.resolved(spoilt, names, "name", "food", {"azure": "blue"}).withColumn("score", F.round("score", 6))
