"""Queries over nutrition, profile and graph operators: parts as foods and ingredients, orders as recipes, customers as users."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import nutrition as N
from platewise.operators import tables as T
from platewise.plans.catalogue import query
from platewise.plans.tables import u
from platewise.sources import files
from platewise.sources.tables import read


def _lines(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


_JOINED = "lineitem JOIN part ON p_partkey = l_partkey"


@query("backpropagated_nutrition", f"""WITH i AS (SELECT DISTINCT l_orderkey, p_name FROM {_JOINED}), n AS (SELECT l_orderkey, count(*) AS n FROM i GROUP BY 1)
SELECT p_name, count(*) AS recipes, round(median(o_totalprice / CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 4 END / n), 6) AS energy FROM i JOIN n ON n.l_orderkey = i.l_orderkey JOIN orders ON o_orderkey = i.l_orderkey GROUP BY 1 HAVING count(*) >= 5""")
def backpropagated_nutrition(spark, sf_dir):
    recipes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("energy"), (F.col("o_orderkey") % 4).alias("servings"))
    return N.backpropagated(_lines(spark, sf_dir), recipes, "l_orderkey", "p_name", ["energy"], "servings").withColumn("energy", F.round("energy", 6))


@query("nutrition_calculator", """WITH f AS (SELECT p_name, avg(p_retailprice) / 10 AS energy, avg(p_size) AS protein FROM part WHERE p_name NOT LIKE 'blue%' GROUP BY 1)
SELECT l_orderkey, round(coalesce(sum(energy * l_quantity / 100) / 2, 0) + 1e-7, 4) AS energy, round(coalesce(sum(protein * l_quantity / 100) / 2, 0) + 1e-7, 4) AS protein, round(avg(CASE WHEN f.p_name IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage,
 coalesce(array_to_string(list_sort(list(DISTINCT p.p_name) FILTER (WHERE f.p_name IS NULL)), ','), '') AS missing FROM lineitem JOIN part p ON p_partkey = l_partkey LEFT JOIN f ON f.p_name = p.p_name GROUP BY 1""")
def nutrition_calculator(spark, sf_dir):
    foods = read(spark, sf_dir, "part").where("p_name NOT LIKE 'blue%'").groupBy("p_name").agg((F.avg("p_retailprice") / 10).alias("energy"), F.avg("p_size").alias("protein"))
    out = N.calculated(_lines(spark, sf_dir), foods, "l_orderkey", "p_name", "l_quantity", ["energy", "protein"], 2)
    return out.select("l_orderkey", F.round(F.col("energy") + 1e-7, 4).alias("energy"), F.round(F.col("protein") + 1e-7, 4).alias("protein"), F.round("coverage", 6).alias("coverage"), F.array_join("missing", ",").alias("missing"))


@query("food_catalogue", """WITH a AS (SELECT p_name, p_type, p_retailprice, p_partkey, CASE WHEN starts_with(p_type, 'ECO') THEN 0 WHEN starts_with(p_type, 'S') THEN 1 END AS r FROM part)
SELECT p_name, arg_min(p_retailprice, r * 1000000000 + p_partkey) FILTER (WHERE r IS NOT NULL) AS first_kind, arg_min(p_retailprice, p_partkey) FILTER (WHERE starts_with(p_type, 'P')) AS second_kind FROM a GROUP BY 1""")
def food_catalogue(spark, sf_dir):
    return N.catalogue(read(spark, sf_dir, "part"), "p_name", "p_type", F.col("p_retailprice"), F.col("p_partkey"), {"first_kind": ["ECO", "S"], "second_kind": ["P"]})


@query("food_coverage", "SELECT s_suppkey, coalesce(n, 0) AS coverage, CASE s_suppkey % 4 WHEN 0 THEN 10.0 WHEN 1 THEN 8.0 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS bonus FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) x ON l_suppkey = s_suppkey")
def food_coverage(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("foundation_food", "survey_fndds_food", "branded_food", "other"))), (F.col("s_suppkey") % 4).cast("int"))
    amounts = read(spark, sf_dir, "lineitem").where("l_quantity > 45").withColumnRenamed("l_suppkey", "s_suppkey")
    return N.coverage(read(spark, sf_dir, "supplier").select("s_suppkey"), amounts, "s_suppkey", "l_partkey").withColumn("bonus", N.type_bonus(kind))


_LAYERS = {"fdc": ["l_partkey", "l_returnflag"], "category": ["p_brand", "l_returnflag"], "unit": ["l_returnflag"]}


@query("layered_weights", f"""WITH x AS (SELECT * FROM {_JOINED} WHERE l_linenumber < 3), a AS (SELECT l_partkey::VARCHAR || '|' || l_returnflag AS k, median(l_quantity) AS v FROM x GROUP BY 1 HAVING count(*) >= 5), b AS (SELECT p_brand || '|' || l_returnflag AS k, median(l_quantity) AS v FROM x GROUP BY 1 HAVING count(*) >= 5),
c AS (SELECT l_returnflag AS k, median(l_quantity) AS v FROM x GROUP BY 1 HAVING count(*) >= 5)
SELECT CASE WHEN a.v IS NOT NULL THEN 'fdc' WHEN b.v IS NOT NULL THEN 'category' ELSE 'unit' END AS path, count(*) AS n, round(sum(coalesce(a.v, b.v, c.v)), 2) AS total FROM {_JOINED} LEFT JOIN a ON a.k = l_partkey::VARCHAR || '|' || l_returnflag LEFT JOIN b ON b.k = p_brand || '|' || l_returnflag LEFT JOIN c ON c.k = l_returnflag GROUP BY 1""")
def layered_weights(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    medians = N.layered(lines.where("l_linenumber < 3"), "l_quantity", _LAYERS, 5)
    found = N.best_layer(lines, medians, _LAYERS, "grams")
    return found.groupBy(F.col("grams_path").alias("path")).agg(F.count("*").alias("n"), F.round(F.sum("grams"), 2).alias("total"))


@query("energy_tier", "SELECT l_orderkey, l_returnflag, l_quantity FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END AS t, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) x WHERE t IS NULL OR t = best")
def energy_tier(spark, sf_dir):
    return N.one_energy(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), "l_orderkey", "l_returnflag", ["R", "A"])


@query("user_intake", """WITH t AS (SELECT c_nationkey AS g, c_mktsegment AS s, avg(c_acctbal) AS v FROM customer WHERE c_nationkey < 20 AND (c_mktsegment <> 'MACHINERY' OR c_nationkey % 2 = 0) GROUP BY 1, 2)
SELECT c_custkey, round(coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE a.v END, b.v), 4) AS energy FROM customer LEFT JOIN t a ON a.g = c_nationkey AND a.s = c_mktsegment LEFT JOIN t b ON b.g = c_nationkey AND b.s = 'AUTOMOBILE'""")
def user_intake(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    table = customer.where("c_nationkey < 20 AND (c_mktsegment <> 'MACHINERY' OR c_nationkey % 2 = 0)").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("v"))
    table = table.select("c_nationkey", "c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "-").otherwise(F.col("v").cast("string")).alias("energy"))
    out = N.intake(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), table, ["c_nationkey"], "c_mktsegment", ["energy"], "AUTOMOBILE")
    return out.select("c_custkey", F.round("energy", 4).alias("energy"))


@query("merged_profiles", """SELECT coalesce(c_custkey, o_custkey) AS user_id, c_acctbal, n, concat_ws(',', CASE WHEN c_custkey IS NOT NULL THEN 'targets' END, CASE WHEN o_custkey IS NOT NULL THEN 'likes' END) AS sources FROM
 (SELECT * FROM customer WHERE c_custkey % 2 = 0) c FULL OUTER JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def merged_profiles(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    b = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"))
    return N.merged(a, b, "user_id").withColumn("sources", F.array_join("sources", ","))


def _edges(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("recipe:"), "l_orderkey").alias("src"), F.concat(F.lit("ingredient:"), "l_partkey").alias("dst"), F.lit("recipe_ingredient").alias("edge_type"))
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("user:"), "o_custkey").alias("src"), F.concat(F.lit("recipe:"), "o_orderkey").alias("dst"), F.lit("user_recipe").alias("edge_type"))
    return lines.unionByName(orders).distinct()


@query("graph_neighbours", "SELECT c_custkey, count(DISTINCT o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY 1")
def graph_neighbours(spark, sf_dir):
    start = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey", F.concat(F.lit("user:"), "c_custkey").alias("node"))
    met = N.neighbours(_edges(spark, sf_dir), start, "node", "user_recipe")
    return start.join(met, "node").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("graph_lookup", "SELECT 'user' AS node_type, c_custkey::VARCHAR AS node_id, c_name AS node_name FROM customer WHERE c_custkey = 7")
def graph_lookup(spark, sf_dir):
    nodes = T.nodes_of((read(spark, sf_dir, "customer"), "user", "c_custkey", "c_name"), (read(spark, sf_dir, "part"), "ingredient", "p_partkey", "p_name"))
    return N.looked_up(nodes, "user", "7")


@query("graph_sample", f"""WITH c AS (SELECT c_custkey FROM customer ORDER BY {u("'user|' || c_custkey")}, c_custkey::VARCHAR LIMIT 100), o AS (SELECT DISTINCT o_orderkey FROM orders ORDER BY {u("'recipe|' || o_orderkey")}, o_orderkey::VARCHAR LIMIT 2000)
SELECT count(*) AS edges, count(DISTINCT o_custkey) AS users FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c) AND o_orderkey IN (SELECT o_orderkey FROM o)) x""")
def graph_sample(spark, sf_dir):
    nodes = T.nodes_of((read(spark, sf_dir, "customer"), "user", "c_custkey", "c_name"), (read(spark, sf_dir, "orders"), "recipe", "o_orderkey", None))
    _, edges = N.subgraph(_edges(spark, sf_dir), nodes, {"user": 100, "recipe": 2000}, T.uniform(F.col("node_type"), F.col("node_id")))
    return edges.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("users"))


@query("type_counts", "SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def type_counts(spark, sf_dir):
    n = read(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("p_type", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("size_histogram", "SELECT least(greatest(floor((p_size - 0) / 5.0), 0), 9)::BIGINT AS bucket, count(*) AS n FROM part GROUP BY 1")
def size_histogram(spark, sf_dir):
    return files.histogram(read(spark, sf_dir, "part"), "p_size", 0, 50, 10)


@query("nested_rules", "SELECT p_type, count(*) AS n, round(sum(s), 4) AS total FROM (SELECT p_type, p_brand, avg(p_size) AS s FROM part GROUP BY 1, 2) x GROUP BY 1")
def nested_rules(spark, sf_dir):
    scores = read(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.avg("p_size").alias("s"))
    out = files.nested(scores, "p_type", "p_brand", "s")
    return out.select("p_type", F.size("values").alias("n"), F.round(F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
