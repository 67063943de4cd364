"""Nutrients per recipe and what feeds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.plans.catalogue import query
from platewise.sources.tables import read


@query(
    "recipe_nutrition_core",
    """
WITH h AS (SELECT l_partkey, l_returnflag, median(l_extendedprice / l_quantity) AS g FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
g AS (SELECT l.l_orderkey, p.p_size, p.p_retailprice, coalesce(h.g * l.l_quantity, l.l_quantity * 100) AS grams
      FROM lineitem l LEFT JOIN h USING (l_partkey, l_returnflag) LEFT JOIN part p ON p.p_partkey = l.l_partkey)
SELECT l_orderkey AS recipe_id, round(sum(p_size * grams / 100) + 1e-6, 4) AS energy, round(sum(p_retailprice * grams / 100) + 1e-6, 4) AS protein,
       count(*) AS n_ingredients FROM g GROUP BY 1
""",
)
def recipe_nutrition_core(spark, sf_dir):
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    unit = lines.where("l_quantity > 0").groupBy("l_partkey", "l_returnflag").agg(F.median(F.col("l_extendedprice") / F.col("l_quantity")).alias("g"))
    grams = lines.join(unit, ["l_partkey", "l_returnflag"], "left").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    grams = grams.withColumn("grams", F.coalesce(F.col("g") * F.col("l_quantity"), F.col("l_quantity") * 100))
    return grams.groupBy(F.col("l_orderkey").alias("recipe_id")).agg(
        F.round(F.sum(F.col("p_size") * F.col("grams") / 100) + 1e-6, 4).alias("energy"),
        F.round(F.sum(F.col("p_retailprice") * F.col("grams") / 100) + 1e-6, 4).alias("protein"),
        F.count("*").alias("n_ingredients"),
    )
