"""Queries over scores and metrics: orders as recipes, customers as users, part names as ingredients, sizes and prices as amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import scoring as S
from platewise.plans.catalogue import query
from platewise.sources.tables import read

_NUTRIENTS = {"energy_kcal": "sum(l_quantity) * 10", "protein_g": "sum(l_quantity) FILTER (WHERE l_returnflag = 'A')", "sodium_mg": "sum(l_quantity) FILTER (WHERE l_returnflag = 'N') * 20"}
_RECIPES = "SELECT l_orderkey, " + ", ".join(f"{v} AS {n}" for n, v in _NUTRIENTS.items()) + " FROM lineitem GROUP BY 1"
_DAILY = {"energy_kcal": 2000.0, "protein_g": 60.0, "sodium_mg": 2000.0}


def recipes(spark, sf_dir):
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum(q) * 10).alias("energy_kcal"), F.sum(F.when(flag == "A", q)).alias("protein_g"), (F.sum(F.when(flag == "N", q)) * 20).alias("sodium_mg"))


def _band(n: str, share: float) -> str:
    far = f"abs(coalesce({n}, 0) / {_DAILY[n]} - {share}) / {share}"
    return f"CASE WHEN coalesce({n}, 0) = 0 THEN 0.0 WHEN {far} <= 0.3 THEN 1.0 WHEN {far} <= 0.5 THEN 0.7 WHEN {far} <= 0.8 THEN 0.4 ELSE 0.2 END"


_OVER = "sodium_mg / 2000.0::DOUBLE"
_SODIUM = f"CASE WHEN coalesce(sodium_mg, 0) = 0 OR {_OVER} <= 0.3::DOUBLE THEN 1.0 WHEN {_OVER} <= 0.3::DOUBLE * 1.2::DOUBLE THEN 0.6 WHEN {_OVER} <= 0.3::DOUBLE * 1.5::DOUBLE THEN 0.3 ELSE greatest(0.0, 1 - {_OVER} / 0.3::DOUBLE * 0.5) END"
_MATCH = f"({_band('energy_kcal', 0.33)} + {_band('protein_g', 0.33)} + {_SODIUM}) / 3"


@query("nutrition_match", f"WITH r AS ({_RECIPES}) SELECT l_orderkey, round({_MATCH}, 6) AS score FROM r")
def nutrition_match(spark, sf_dir):
    score = S.nutrition_match({n: F.col(n) for n in _DAILY}, {n: F.lit(v) for n, v in _DAILY.items()})
    return recipes(spark, sf_dir).select("l_orderkey", F.round(score, 6).alias("score"))


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name", "p_type").distinct()


_ITEMS = "SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey"
_RULES = "SELECT least(a, b) AS a, greatest(a, b) AS b, max(s) AS s FROM (SELECT p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b, p_size / 50.0::DOUBLE AS s FROM (SELECT * FROM part WHERE p_partkey <= 400) p) x WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2"


def rules(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_partkey <= 401")
    after = part.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("b"))
    return part.where("p_partkey <= 400").join(after, F.col("p_partkey") == F.col("k")).where("k < 400 AND p_name <> b").select(F.col("p_name").alias("a"), "b", (F.col("p_size") / 50.0).alias("s"))


@query("pair_rule_scores", f"WITH i AS ({_ITEMS}), r AS ({_RULES}) SELECT x.l_orderkey, count(*) AS pairs, round(avg(s), 6) AS score FROM i x JOIN i y ON x.l_orderkey = y.l_orderkey AND x.p_name < y.p_name JOIN r ON r.a = x.p_name AND r.b = y.p_name GROUP BY 1")
def pair_rule_scores(spark, sf_dir):
    return S.pair_score(_lines(spark, sf_dir), rules(spark, sf_dir), "l_orderkey", "p_name", "a", "b", F.col("s")).withColumn("score", F.round("score", 6))


@query("cooccurrence_scores", f"WITH i AS ({_ITEMS}), r AS (SELECT a, b, max(least(s * 20 / 10, 1.0)) AS s FROM ({_RULES}) q GROUP BY 1, 2) SELECT x.l_orderkey, count(*) AS pairs, round(avg(s), 6) AS score FROM i x JOIN i y ON x.l_orderkey = y.l_orderkey AND x.p_name < y.p_name JOIN r ON r.a = x.p_name AND r.b = y.p_name GROUP BY 1")
def cooccurrence_scores(spark, sf_dir):
    return S.pair_score(_lines(spark, sf_dir), rules(spark, sf_dir), "l_orderkey", "p_name", "a", "b", F.least(F.col("s") * 20 / 10, F.lit(1.0))).withColumn("score", F.round("score", 6))


def tags(spark, sf_dir):
    """Each name's tags: its types, two of which count as positive."""
    named = F.when(F.col("p_size") % 3 == 0, "high_protein").when(F.col("p_size") % 3 == 1, "low_fat").otherwise("high_sodium")
    return read(spark, sf_dir, "part").where("p_partkey <= 40").select("p_name", named.alias("tag")).distinct()


_TAGS = "SELECT DISTINCT p_name, CASE p_size % 3 WHEN 0 THEN 'high_protein' WHEN 1 THEN 'low_fat' ELSE 'high_sodium' END AS tag FROM part WHERE p_partkey <= 40"
_BALANCE = f"""SELECT i.l_orderkey, coalesce(b.balance, 0.5) AS balance FROM (SELECT DISTINCT l_orderkey FROM lineitem) i LEFT JOIN (SELECT l_orderkey, 0.5 * -sum(n / t * log2(n / t)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END + 0.5 * sum(CASE WHEN tag <> 'high_sodium' THEN n ELSE 0 END) / max(t) AS balance
 FROM (SELECT l_orderkey, tag, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY l_orderkey)::DOUBLE AS t FROM ({_ITEMS}) x JOIN ({_TAGS}) g USING (p_name) GROUP BY 1, 2) y GROUP BY 1) b ON b.l_orderkey = i.l_orderkey"""


@query("balance_scores", f"SELECT l_orderkey, round(balance + 1e-9, 6) AS balance FROM ({_BALANCE}) q")
def balance_scores(spark, sf_dir):
    return S.balance(_lines(spark, sf_dir).select("l_orderkey", "p_name").distinct(), tags(spark, sf_dir), "l_orderkey", "p_name", "tag").withColumn("balance", F.round(F.col("balance") + 1e-9, 6))


_LIKED, _DISLIKED = ["blue anvil", "cold anvil", "red lamp"], ["old stone"]


@query("preference_scores", f"""SELECT l_orderkey, CASE WHEN dis > 0 THEN 0.1 WHEN lik > 0 THEN least(0.7 + lik * 0.1, 1.0) ELSE 0.5 END::DOUBLE AS score FROM
 (SELECT l_orderkey, count(*) FILTER (WHERE p_name IN ('{"', '".join(_LIKED)}')) AS lik, count(*) FILTER (WHERE p_name IN ('{"', '".join(_DISLIKED)}')) AS dis FROM ({_ITEMS}) i GROUP BY 1) x""")
def preference_scores(spark, sf_dir):
    items = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set("p_name").alias("items"))
    of = lambda xs: F.array(*map(F.lit, xs))
    return items.select("l_orderkey", F.round(S.preference_match(F.col("items"), of(_LIKED), of(_DISLIKED)), 6).alias("score"))


@query("ranked_recipes", f"""WITH r AS ({_RECIPES}), b AS ({_BALANCE}), s AS (SELECT o_custkey, o_orderkey, 0.5 * {_MATCH} + 0.1 * balance AS s FROM orders JOIN r ON r.l_orderkey = o_orderkey JOIN b ON b.l_orderkey = o_orderkey),
t AS (SELECT o_custkey, o_orderkey, round_even(s, 3) AS s FROM s) SELECT o_custkey, rank, o_orderkey AS recipe, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey) AS rank FROM t) q WHERE rank <= 3""")
def ranked_recipes(spark, sf_dir):
    match = S.nutrition_match({n: F.col(n) for n in _DAILY}, {n: F.lit(v) for n, v in _DAILY.items()})
    lines = _lines(spark, sf_dir).select("l_orderkey", "p_name").distinct()
    scored = recipes(spark, sf_dir).join(S.balance(lines, tags(spark, sf_dir), "l_orderkey", "p_name", "tag"), "l_orderkey").withColumn("match", match)
    scored = scored.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("score", S.composite(nutrition_match=F.col("match"), balance=F.col("balance")))
    out = S.ranked_sample(scored.select("o_custkey", "o_orderkey", "score", "match", "balance"), "o_custkey", "o_orderkey", "score", ["match", "balance"])
    return out.select("o_custkey", F.inline("ranked")).select("o_custkey", "rank", "recipe", "score")


def _evaluated(spark, sf_dir):
    """Each recipe's nutrients as a map, with targets: energy between 400 and 900, protein 20 at least, sodium 800 at most."""
    target = lambda kind, value=None, low=None, high=None: F.struct(F.lit(kind).alias("type"), F.lit(value).cast("double").alias("value"), F.lit(low).cast("double").alias("min"), F.lit(high).cast("double").alias("max"))
    targets = F.create_map(F.lit("energy_kcal"), target("range", None, 400, 900), F.lit("protein_g"), target("min", 20), F.lit("sodium_mg"), target("max", 800))
    names = F.array(*map(F.lit, _DAILY))
    nutrition = F.map_filter(F.map_from_arrays(names, F.array(*[F.col(n) for n in _DAILY])), lambda k, v: v.isNotNull())
    return recipes(spark, sf_dir).select("l_orderkey", targets.alias("targets"), nutrition.alias("nutrition"))


_OK = ["energy_kcal BETWEEN 360 AND 990.0000000000001", "coalesce(protein_g >= 18, false)", "coalesce(sodium_mg <= 880.0000000000001, false)"]


@query("constraint_recall", f"WITH r AS ({_RECIPES}) SELECT l_orderkey, round(({' + '.join(f'({t})::INT' for t in _OK)}) / 3.0::DOUBLE, 6) AS sncr, 3 - ({' + '.join(f'({t})::INT' for t in _OK)}) AS violations FROM r")
def constraint_recall(spark, sf_dir):
    none = F.array().cast("array<string>")
    recall = S.constraint_recall(F.col("targets"), F.col("nutrition"))
    return _evaluated(spark, sf_dir).select("l_orderkey", F.round(recall, 6).alias("sncr"), S.violations(F.col("targets"), F.col("nutrition"), none, none, none, none).alias("violations"))


@query("nutrition_similarity", f"""WITH r AS ({_RECIPES}) SELECT l_orderkey, round((greatest(0.0, 1 - abs(energy_kcal - 600) / 600) + coalesce(greatest(0.0, 1 - abs(protein_g - 30) / 30), 0)) / 2, 6) AS similarity,
 round(((abs(energy_kcal - 600) <= 90)::INT + coalesce((abs(protein_g - 30) <= 4.5)::INT, 0)) / (1.0::DOUBLE + (protein_g IS NOT NULL)::INT), 6) AS accuracy FROM r""")
def nutrition_similarity(spark, sf_dir):
    wanted = F.create_map(F.lit("energy_kcal"), F.lit(600.0), F.lit("protein_g"), F.lit(30.0))
    return _evaluated(spark, sf_dir).select("l_orderkey", F.round(S.nutrition_similarity(wanted, F.col("nutrition")), 6).alias("similarity"), F.round(S.nutrition_accuracy(wanted, F.col("nutrition")), 6).alias("accuracy"))


@query("sample_classes", """WITH s AS (SELECT o_orderkey, o_totalprice < 120000 AS strict, o_totalprice < 180000 AS loose, o_custkey % 5 AS likes, o_orderkey % 2 AS hits, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS misses FROM orders)
SELECT o_orderkey, CASE WHEN misses > 0 THEN 'negative' WHEN strict AND coalesce(hits / nullif(likes, 0), 0) >= CASE WHEN likes >= 3 THEN 0.3 WHEN likes >= 1 THEN 0.18 ELSE 0 END THEN 'positive' WHEN NOT strict AND loose THEN 'hard_neg_boundary' WHEN strict THEN 'hard_neg_pref' ELSE 'negative' END AS class FROM s""")
def sample_classes(spark, sf_dir):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    kind = S.sample_class(price < 120000, price < 180000, F.col("o_custkey") % 5, key % 2, F.when(key % 7 == 0, 1).otherwise(0))
    return read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("class"))
