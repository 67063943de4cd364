"""Queries over edited recipes, personas and diversity: orders as recipes, parts as ten sample foods, customers as users."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import diversity, editing, personas
from platewise.plans.catalogue import query
from platewise.sources.tables import read

#: Ten sample foods, by NUTRIENTS, rounded.
FOODS = {
    "salt": [0, 0, 0, 0, 0, 38758, 0, 0],
    "chicken breast": [165, 31, 3.6, 0, 0, 74, 1, 0],
    "olive oil": [884, 0, 100, 0, 0, 2, 13.8, 0],
    "rice": [130, 2.7, 0.3, 28, 0.4, 1, 0.1, 0.1],
    "broccoli": [34, 2.8, 0.4, 6.6, 2.6, 33, 0.1, 1.7],
    "butter": [717, 0.9, 81, 0.1, 0, 643, 51, 0.1],
    "honey": [304, 0.3, 0, 82, 0.2, 4, 0, 82],
    "tofu": [76, 8, 4.8, 1.9, 0.3, 7, 0.7, 0.6],
    "carrot": [41, 0.9, 0.2, 9.6, 2.8, 69, 0, 4.7],
    "lentils": [116, 9, 0.4, 20, 7.9, 2, 0.1, 1.8],
}
SERVINGS = 4


def recipes(spark, sf_dir):
    """o_orderkey, lines, liked, disliked: a line's food is told by its part's key, its grams by the quantity (salt a hundredth)."""
    names = F.array(*map(F.lit, FOODS))
    name = lambda c: F.get(names, (c % len(FOODS)).cast("int"))

    def line(x):
        grams = lambda item: F.when(item == "salt", x["l_quantity"] / 10).otherwise(x["l_quantity"] * 10)
        return editing.let(name(x["l_partkey"]), lambda item: editing.line(item, grams(item), F.try_element_at(editing.food_map(FOODS), item)))

    # what is dealt out are numbers; a line's name and nutrients are put in after the join
    parts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("parts"))
    user = F.col("o_custkey")
    some = lambda share, *keys: F.when(user % share != 0, F.array(*map(name, keys))).otherwise(F.array().cast("array<string>"))
    own = read(spark, sf_dir, "orders").select("o_orderkey", some(5, user, user + 3).alias("liked"), some(4, user + 1, user + 6).alias("disliked"))
    return parts.join(own, "o_orderkey").select("o_orderkey", F.transform("parts", line).alias("lines"), "liked", "disliked")


def _told(c):
    return F.array_join(F.transform(c, lambda v: F.coalesce(v["field"], v["item"])), ",")


@query("edited_recipes")
def edited_recipes(spark, sf_dir):
    done = editing.violated(recipes(spark, sf_dir), "o_orderkey", "lines", "liked", "disliked", {}, FOODS, SERVINGS)
    first = F.get("violations", F.lit(0))
    grams = F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["grams"])
    return done.select("o_orderkey", _told(F.col("violations")).alias("fields"), first["severity"].alias("severity"), F.round(first["actual"], 5).alias("actual"), F.size("lines").alias("n_lines"), F.round(grams, 5).alias("grams"))


@query("corrected_recipes")
def corrected_recipes(spark, sf_dir):
    done = editing.violated(recipes(spark, sf_dir), "o_orderkey", "lines", "liked", "disliked", {}, FOODS, SERVINGS)
    done = done.withColumn("fixes", editing.corrections(F.col("lines"), F.col("violations"), F.col("o_orderkey"), FOODS))
    done = done.withColumn("mended", editing.corrected(F.col("lines"), F.col("fixes"), FOODS))
    actions = F.array_join(F.transform("fixes", lambda c: c["action"]), ",")
    grams = F.aggregate("mended", F.lit(0.0), lambda s, x: s + x["grams"])
    energy = F.get(editing.nutrition(F.col("mended"), SERVINGS), F.lit(0))
    return done.select("o_orderkey", actions.alias("actions"), F.size("mended").alias("n_lines"), F.round(grams, 5).alias("grams"), F.round(energy, 5).alias("energy_kcal"))


def _u(salt: str) -> str:
    return f"(('0x' || substr(md5(c_custkey::VARCHAR || '|{salt}'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


_MACROS = ", ".join(f"({i}, '{n}', {', '.join(f'{x}.0' for r in rs for x in r)})" for i, (n, rs) in enumerate(personas.AMDR.items()))
_SPAN = f"(floor({_u('bucket')} * 3)::INT)"


@query("persona_targets", f"""WITH t AS (SELECT c_custkey, floor({_u('tag')} * 108)::INT AS t, {_u('energy')} AS e, {_SPAN} AS b, {_u('carb')} AS c, {_u('protein')} AS p, {_u('fat')} AS f FROM customer),
 m(i, macro, c0, c1, p0, p1, f0, f1) AS (VALUES {_MACROS}),
 x AS (SELECT *, [1600.0, 1800, 2200][b + 1] + [200.0, 400, 400][b + 1] * e AS kcal, c0 + (c1 - c0) * c AS cd, p0 + (p1 - p0) * p AS pd, f0 + (f1 - f0) * f AS fd FROM t JOIN m ON i = t // 18)
SELECT c_custkey, macro || '+' || ['dga_2300', 'who_2000', 'aha_1500'][t // 6 % 3 + 1] || '+' || ['added_10', 'free_10', 'free_5'][t // 2 % 3 + 1] || '+' || ['sfa_10', 'sfa_6'][t % 2 + 1] AS tag,
 round(kcal)::DOUBLE AS energy_kcal_target, round(100.0::DOUBLE * cd / (cd + pd + fd), 2)::DOUBLE AS carb_pct, round(100.0::DOUBLE * pd / (cd + pd + fd), 2)::DOUBLE AS protein_pct, round(100.0::DOUBLE * fd / (cd + pd + fd), 2)::DOUBLE AS fat_pct,
 [2300.0, 2000, 1500][t // 6 % 3 + 1]::DOUBLE AS sodium_mg_max, CASE t // 2 % 3 WHEN 0 THEN 'added' ELSE 'free' END AS sugar_type, (CASE t // 2 % 3 WHEN 2 THEN 5 ELSE 10 END)::DOUBLE AS sugar_pct_max,
 (CASE t % 2 WHEN 0 THEN 10 ELSE 6 END)::DOUBLE AS sat_fat_pct_max, round(14 * kcal / 1000, 1)::DOUBLE AS fiber_g_min FROM x""")
def persona_targets(spark, sf_dir):
    found = personas.persona_targets(read(spark, sf_dir, "customer"), "c_custkey")
    pct = [F.col(f"amdr.{n}.target_pct").alias(f"{n}_pct") for n in ("carb", "protein", "fat")]
    return found.select("c_custkey", "tag", "energy_kcal_target", *pct, "sodium_mg_max", F.col("sugars.type").alias("sugar_type"), F.col("sugars.pct_max").alias("sugar_pct_max"), "sat_fat_pct_max", "fiber_g_min")


_SPLIT = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')"
_GRAM = " UNION ALL ".join(f"SELECT item_id, {n} AS n, unnest(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM w" for n in diversity.ORDERS)
_LOGS = " + ".join(f"ln(CASE WHEN m{n} > 0 THEN m{n}::DOUBLE ELSE 0.1 END / greatest(h - {n - 1}, 1))" for n in diversity.ORDERS)


@query("self_bleu", f"""WITH w AS (SELECT item_id, {_SPLIT} AS w FROM benchmark), c AS (SELECT item_id, n, g, count(*) AS c FROM ({_GRAM}) x GROUP BY 1, 2, 3),
 p AS (SELECT a.item_id, a.n, a.g, least(max(a.c), max(b.c)) AS m FROM c a JOIN c b ON a.n = b.n AND a.g = b.g AND a.item_id <> b.item_id GROUP BY 1, 2, 3),
 s AS (SELECT item_id, {', '.join(f'coalesce(sum(m) FILTER (WHERE n = {n}), 0) AS m{n}' for n in diversity.ORDERS)} FROM p GROUP BY 1),
 l AS (SELECT a.item_id, len(a.w) AS h, min_by(len(b.w), abs(len(a.w) - len(b.w)) * 1000000 + len(b.w)) AS r FROM w a JOIN w b ON a.item_id <> b.item_id GROUP BY 1, 2)
SELECT w.item_id, round(CASE WHEN coalesce(m1, 0) = 0 THEN 0.0 ELSE exp(({_LOGS}) / 4) * CASE WHEN h > r THEN 1.0 ELSE exp(1 - r::DOUBLE / h) END END, 6)::DOUBLE AS self_bleu FROM w LEFT JOIN l USING (item_id) LEFT JOIN s USING (item_id)""")
def self_bleu(spark, sf_dir):
    return diversity.self_bleu(read(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("self_bleu", F.round("self_bleu", 6))
