"""Queries over the table operators; what they equal is written apart, in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import tables as T
from platewise.plans.catalogue import query
from platewise.sources.tables import read

#: The same draw in SQL.
U = "(('0x' || substr(md5({x} || '|{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def u(x: str, seed: int = 42) -> str:
    return U.format(x=x, seed=seed)


@query("filter_with_minimum", "SELECT p_partkey, p_size FROM part WHERE p_size > 45 OR (SELECT count(*) FROM part WHERE p_size > 45) < 10")
def filter_with_minimum(spark, sf_dir):
    return T.with_minimum(read(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size") > 45, 10)


@query("filter_fallback_all", "SELECT p_partkey FROM part")
def filter_fallback_all(spark, sf_dir):
    return T.with_minimum(read(spark, sf_dir, "part").select("p_partkey"), F.col("p_partkey") < 0, 10)


@query("candidates_strict_or_loose", """WITH n AS (SELECT o_custkey, count(*) FILTER (WHERE o_totalprice BETWEEN 100000 AND 200000) AS n FROM orders GROUP BY 1)
SELECT o.o_custkey, o_orderkey FROM orders o JOIN n ON n.o_custkey = o.o_custkey WHERE CASE WHEN n >= 3 THEN o_totalprice BETWEEN 100000 AND 200000 ELSE o_orderstatus = 'F' END""")
def candidates_strict_or_loose(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return T.with_group_minimum(orders, ["o_custkey"], F.col("o_totalprice").between(100000, 200000), F.col("o_orderstatus") == "F", 3).select("o_custkey", "o_orderkey")


_WIDE = "SELECT l_orderkey, nullif(sum(l_quantity) FILTER (WHERE l_linenumber <= 2), 0) AS energy, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS protein, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS fat, sum(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_linenumber > 2) AS carbs FROM lineitem GROUP BY 1"


def wide(spark, sf_dir):
    q = F.col("l_quantity")
    when = lambda c: F.sum(F.when(c, q))
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.nullif(when(line <= 2), F.lit(0.0)).alias("energy"), when(flag == "A").alias("protein"), when(flag == "N").alias("fat"), when((flag == "R") & (line > 2)).alias("carbs"))


@query("nutrition_filters", f"""WITH w AS ({_WIDE}) SELECT l_orderkey,
 (energy IS NULL OR energy BETWEEN 10 AND 60) AND (protein IS NULL OR protein BETWEEN 0 AND 50) AND (fat IS NULL OR fat BETWEEN 5 AND 300) AS valid,
 energy IS NOT NULL AND energy BETWEEN 50 AND 1500 AS valid_meal, energy IS NOT NULL OR (protein IS NOT NULL)::INT + (fat IS NOT NULL)::INT + (carbs IS NOT NULL)::INT >= 2 AS enough FROM w""")
def nutrition_filters(spark, sf_dir):
    tests = {"valid": T.within({"energy": (10, 60), "protein": (0, 50), "fat": (5, 300)}), "valid_meal": T.within({"energy": (50, 1500)}, ["energy"]), "enough": T.enough("energy", ["protein", "fat", "carbs"])}
    return wide(spark, sf_dir).select("l_orderkey", *[t.alias(n) for n, t in tests.items()])


@query("blocked_names", "SELECT DISTINCT p_name, regexp_matches(lower(p_name), 'blue .*|anvil') OR list_has_any(string_split(lower(p_name), ' '), ['red', 'lamp']) AS blocked FROM part")
def blocked_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_name").distinct().select("p_name", T.blocked(F.col("p_name"), ["blue .*", "anvil"], ["red", "lamp"]).alias("blocked"))


@query("liked_in_text", """WITH l AS (SELECT o_custkey, list(DISTINCT p_name) AS liked FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 46 GROUP BY 1)
SELECT o_custkey, len(list_filter(liked, lambda n: NOT (length(string_split(lower(n), ' ')[1]) > 2 AND contains('a blue box, red lamp and old stone', string_split(lower(n), ' ')[1])
 OR length(string_split(lower(n), ' ')[2]) > 2 AND contains('a blue box, red lamp and old stone', string_split(lower(n), ' ')[2])))) = 0 AS passes FROM l""")
def liked_in_text(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 46").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("o_custkey").agg(F.collect_set("p_name").alias("liked")).select("o_custkey", T.all_liked_in(F.col("liked"), F.lit("A blue box, red lamp and old stone")).alias("passes"))


@query("pivot_first_mean", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem)
SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A' AND r = 1) AS first_a, max(l_quantity) FILTER (WHERE l_returnflag = 'N' AND r = 1) AS first_n,
 round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS mean_a, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS mean_n FROM r GROUP BY 1""")
def pivot_first_mean(spark, sf_dir):
    lines, q = read(spark, sf_dir, "lineitem"), F.col("l_quantity")
    first = T.pivoted(lines, "l_orderkey", "l_returnflag", ["A", "N"], q, T.first_value(q, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    mean = T.pivoted(lines, "l_orderkey", "l_returnflag", ["A", "N"], q, lambda c: F.round(F.avg(c), 6))
    return first.select("l_orderkey", F.col("A").alias("first_a"), F.col("N").alias("first_n")).join(mean.select("l_orderkey", F.col("A").alias("mean_a"), F.col("N").alias("mean_n")), "l_orderkey")


@query("guarded_pivot", "SELECT o_custkey, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS f, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS o, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 2) AS p FROM orders GROUP BY 1")
def guarded_pivot(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.lower("o_orderstatus").alias("unit"), "o_totalprice")
    out = T.guarded_pivot(orders, "o_custkey", "o_orderstatus", "unit", "o_totalprice")
    return out.select("o_custkey", *[F.round(c, 2).alias(c.lower()) for c in ("F", "O", "P")])


@query("unit_conflict_lists", "SELECT p_name, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS units FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def unit_conflict_lists(spark, sf_dir):
    return T.conflicts(read(spark, sf_dir, "part"), "p_name", "p_type").select("p_name", F.array_join("units", ",").alias("units"))


@query("wide_to_long", f"WITH w AS ({_WIDE}) SELECT l_orderkey, name, value FROM (SELECT l_orderkey, unnest(['energy', 'protein', 'fat']) AS name, unnest([energy, protein, fat]) AS value FROM w) x WHERE value > 0")
def wide_to_long(spark, sf_dir):
    return T.unpivoted(wide(spark, sf_dir), "l_orderkey", ["energy", "protein", "fat"])


@query("symmetric_edges", "WITH e AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part) SELECT a, b FROM e UNION SELECT b, a FROM e")
def symmetric_edges(spark, sf_dir):
    return T.symmetric(read(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).distinct(), "a", "b")


@query("graph_nodes", "SELECT 'user' AS node_type, c_custkey::VARCHAR AS node_id, c_name AS node_name FROM customer UNION ALL SELECT DISTINCT 'ingredient', p_name, p_name FROM part UNION ALL SELECT 'nutrient_tag', p_type, p_type FROM part GROUP BY p_type")
def graph_nodes(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return T.nodes_of((read(spark, sf_dir, "customer"), "user", "c_custkey", "c_name"), (part, "ingredient", "p_name", None), (part, "nutrient_tag", "p_type", None))


@query("sample_without_replacement", f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {u('o_orderkey::VARCHAR')}, o_orderkey) AS r FROM orders) t WHERE r <= 2")
def sample_without_replacement(spark, sf_dir):
    return T.sampled(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", 2, by=["o_custkey"])


@query("global_sample", f"SELECT p_partkey FROM part ORDER BY {u('p_partkey::VARCHAR', 7)}, p_partkey LIMIT 50")
def global_sample(spark, sf_dir):
    return T.sampled(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 50, seed=7)


@query("shuffle_head", f"SELECT p_partkey FROM part ORDER BY {u('p_partkey::VARCHAR')}, p_partkey LIMIT 20")
def shuffle_head(spark, sf_dir):
    return T.shuffled(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").limit(20)


@query("oversample", f"SELECT s_suppkey FROM supplier, range(250 // (SELECT count(*) FROM supplier)::INT) UNION ALL (SELECT s_suppkey FROM supplier ORDER BY {u('s_suppkey::VARCHAR')}, s_suppkey LIMIT (SELECT 250 % count(*) FROM supplier))")
def oversample(spark, sf_dir):
    return T.oversampled(read(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 250)


@query("topk_with_minimum", """WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, o_totalprice > 350000 AS ok FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, ok ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) FILTER (WHERE ok) OVER (PARTITION BY o_custkey) AS n FROM s)
SELECT o_custkey, o_orderkey, CASE WHEN ok THEN r ELSE n + r END AS rank FROM r WHERE (ok AND r <= 5) OR (NOT ok AND n + r <= 3)""")
def topk_with_minimum(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return T.top_with_minimum(orders, ["o_custkey"], F.col("o_totalprice"), F.col("o_totalprice") > 350000, 5, 3, "o_orderkey").drop("o_totalprice")


@query("topk_global", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topk_global(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


_DRAW = u("o_orderkey::VARCHAR")


@query("balanced_negatives", f"""WITH k AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1),
r AS (SELECT o.o_custkey, o_orderkey, {_DRAW} AS d, row_number() OVER (PARTITION BY o.o_custkey, o_orderstatus ORDER BY {_DRAW}, o_orderkey) AS r, kinds FROM orders o JOIN k ON k.o_custkey = o.o_custkey),
c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN r <= 4 // kinds THEN 0 ELSE 1 END, d, o_orderkey) AS c FROM r) SELECT o_custkey, o_orderkey FROM c WHERE c <= 4""")
def balanced_negatives(spark, sf_dir):
    return T.balanced(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", 4, "o_orderkey").select("o_custkey", "o_orderkey")


@query("weighted_draws", f"SELECT c_custkey, CASE WHEN {u('c_custkey::VARCHAR')} < 0.5 THEN 'healthy' WHEN {u('c_custkey::VARCHAR')} < 0.8 THEN 'lactating' ELSE 'pregnant' END AS state, round(1200 + 2300 * {u('c_custkey::VARCHAR', 1)}, 4) AS energy FROM customer")
def weighted_draws(spark, sf_dir):
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", T.drawn({"healthy": 5, "lactating": 3, "pregnant": 2}, key).alias("state"), F.round(T.in_range(1200, 3500, key, seed=1), 4).alias("energy"))


@query("option_grid", "SELECT a, b FROM (VALUES (1), (2), (3)) x(a), (VALUES ('s'), ('t')) y(b)")
def option_grid(spark, sf_dir):
    return T.grid(spark, a=[1, 2, 3], b=["s", "t"]).select(F.col("a").cast("int").alias("a"), "b")


@query("bootstrap_mean", None)
def bootstrap_mean(spark, sf_dir):
    """The mean size of a part and its interval over 200 resamples."""
    return T.bootstrap(read(spark, sf_dir, "part"), "p_partkey", "p_size", times=200)


@query("meal_level", f"WITH w AS ({_WIDE}) SELECT l_orderkey, round(energy * 20 * s, 6) AS energy, round(protein * s, 6) AS protein FROM (SELECT *, CASE WHEN energy * 20 < 200 THEN 3.0 WHEN energy * 20 < 900 THEN 1 WHEN energy * 20 < 1500 THEN 0.5 ELSE 1.0::DOUBLE / 3 END AS s FROM w WHERE energy IS NOT NULL) x")
def meal_level(spark, sf_dir):
    energy = F.col("energy") * 20
    scale = T.meal_scale(energy)
    return wide(spark, sf_dir).where("energy IS NOT NULL").select("l_orderkey", F.round(energy * scale, 6).alias("energy"), F.round(F.col("protein") * scale, 6).alias("protein"))


@query("per_serving_values", "SELECT l_orderkey, l_linenumber, round(l_quantity / CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE l_linenumber % 4 END, 6) AS l_quantity FROM lineitem")
def per_serving_values(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") % 4).alias("servings"))
    return T.per_serving(lines, ["l_quantity"], "servings").drop("servings").withColumn("l_quantity", F.round("l_quantity", 6))
