"""Scores of recipes for users, and metrics of generated recipes. Recipes and users are rows with arrays and maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: nutrient, share of a day that a meal should have, whether it is a limit
MEAL = [("energy_kcal", 0.33, False), ("protein_g", 0.33, False), ("carbohydrate_g", 0.33, False), ("fat_g", 0.33, False), ("fiber_g", 0.33, False),
        ("sodium_mg", 0.30, True), ("added_sugar_g", 0.25, True), ("saturated_fat_g", 0.30, True)]
POSITIVE = ["high_protein", "high_fiber", "high_vitamin_c", "high_calcium", "high_iron", "low_sodium", "low_fat"]
COMPOSITE = {"nutrition_match": 0.50, "preference_match": 0.20, "complementarity": 0.20, "balance": 0.10}


def mean_of(scores: list[Column], none: float) -> Column:
    """The mean of the scores that are not null; `none` without any."""
    kept = F.array_compact(F.array(*scores))
    return F.when(F.size(kept) == 0, F.lit(none)).otherwise(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def nutrient_score(actual: Column, daily: Column, share: float, limit: bool) -> Column:
    """How near a meal's nutrient is to its share of the daily amount, in bands; null without a daily amount."""
    actual = F.coalesce(actual, F.lit(0.0))
    ratio = actual / daily
    if limit:
        over = ratio / share
        score = F.when(actual == 0, 1.0).when(ratio <= share, 1.0).when(ratio <= share * 1.2, 0.6).when(ratio <= share * 1.5, 0.3).otherwise(F.greatest(F.lit(0.0), 1 - over * 0.5))
    else:
        far = F.abs(ratio - share) / share
        score = F.when(actual == 0, 0.0).when(far <= 0.3, 1.0).when(far <= 0.5, 0.7).when(far <= 0.8, 0.4).otherwise(0.2)
    return F.when(F.coalesce(daily, F.lit(0.0)) != 0, score)


def nutrition_match(recipe: Mapping[str, Column], daily: Mapping[str, Column]) -> Column:
    """Mean of the nutrients' scores; 0.5 without any daily amount."""
    return mean_of([nutrient_score(recipe[n], F.nullif(daily[n], F.lit(0.0)), share, limit) for n, share, limit in MEAL if n in recipe and n in daily], 0.5)


def preference_match(ingredients: Column, liked: Column, disliked: Column) -> Column:
    hits, misses = F.size(F.array_intersect(ingredients, liked)), F.size(F.array_intersect(ingredients, disliked))
    return F.when(misses > 0, 0.1).when(hits > 0, F.least(0.7 + hits * 0.1, F.lit(1.0))).otherwise(0.5)


def pair_score(lines: DataFrame, rules: DataFrame, recipe: str, item: str, a: str, b: str, score: Column) -> DataFrame:
    """Per recipe: the mean score of rules between two of its ingredients (either way about), or none: recipe, pairs, score.

    Rules meet lines by one ingredient first, so pairs without a rule are never made."""
    own = lines.select(recipe, F.col(item).alias("x")).distinct()
    both = rules.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), score.alias("s")).groupBy("x", "y").agg(F.max("s").alias("s"))
    met = own.join(both, "x").join(own.select(recipe, F.col("x").alias("y")), [recipe, "y"])
    return met.groupBy(recipe).agg(F.count("*").alias("pairs"), F.avg("s").alias("score"))


def balance(lines: DataFrame, tags: DataFrame, recipe: str, item: str, tag: str) -> DataFrame:
    """Per recipe: half the entropy of its tags (over the most there can be), half the share of positive ones: recipe, balance."""
    n = lines.select(recipe, item).join(tags.select(item, tag), item).groupBy(recipe, tag).agg(F.count("*").alias("n"))
    sums = n.groupBy(recipe).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.count("*").alias("kinds"), F.sum(F.when(F.col(tag).isin(POSITIVE), F.col("n")).otherwise(0)).alias("good"))
    entropy = F.log2("all") - F.col("nlogn") / F.col("all")
    most = F.when(F.col("kinds") > 1, F.log2("kinds")).otherwise(1.0)
    found = sums.select(recipe, (0.5 * entropy / most + 0.5 * F.col("good") / F.col("all")).alias("balance"))
    return lines.select(recipe).distinct().join(found, recipe, "left").withColumn("balance", F.coalesce("balance", F.lit(0.5)))


def composite(**scores: Column) -> Column:
    return F.bround(sum((COMPOSITE[n] * s for n, s in scores.items()), F.lit(0.0)), 3)


def ranked_sample(scored: DataFrame, user: str, recipe: str, score: str, detail: list[str], k: int = 3) -> DataFrame:
    """Per user: an array of the k best recipes (rank, recipe, score, breakdown)."""
    order = Window.partitionBy(user).orderBy(F.desc(score), recipe)
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    row = F.struct("rank", F.col(recipe).alias("recipe"), F.col(score).alias("score"), F.struct(*[F.bround(c, 3).alias(c) for c in detail]).alias("breakdown"))
    return top.groupBy(user).agg(F.array_sort(F.collect_list(row)).alias("ranked"))


# --- metrics; targets are a map of nutrient to struct (type, value, min, max), nutrition a map of nutrient to amount

def _met(target: Column, actual: Column, tolerance: float) -> Column:
    low, high = F.coalesce(target["min"], F.lit(0.0)), F.coalesce(target["max"], F.lit(float("inf")))
    return (
        F.when(target["type"] == "min", actual >= target["value"] * (1 - tolerance))
        .when(target["type"] == "range", (actual >= low * (1 - tolerance)) & (actual <= high * (1 + tolerance)))
        .otherwise(actual <= target["value"] * (1 + tolerance))
    )


def constraint_recall(targets: Column, nutrition: Column, tolerance: float = 0.1) -> Column:
    """The share of targets that are met; a missing nutrient meets none; 1 without targets."""
    each = F.map_entries(targets)
    met = F.filter(each, lambda e: F.coalesce(_met(e["value"], F.try_element_at(nutrition, e["key"]), tolerance), F.lit(False)))
    return F.when(F.coalesce(F.size(each), F.lit(0)) <= 0, 1.0).otherwise(F.size(met) / F.size(each))


def violations(targets: Column, nutrition: Column, allergies: Column, ingredients: Column, diets: Column, tags: Column, tolerance: float = 0.1) -> Column:
    """How many targets are not met, allergens are among the ingredients and diets are not among the tags."""
    missed = F.filter(F.map_entries(targets), lambda e: ~F.coalesce(_met(e["value"], F.try_element_at(nutrition, e["key"]), tolerance), F.lit(False)))
    low = lambda xs: F.transform(xs, lambda x: F.lower(x))
    count = lambda xs: F.greatest(F.coalesce(F.size(xs), F.lit(0)), F.lit(0))
    return count(missed) + count(F.array_intersect(low(allergies), low(ingredients))) + count(F.array_except(low(diets), low(tags)))


def preference_metric(liked: Column, disliked: Column, ingredients: Column, cuisine: Column, wanted: Column, minutes: Column, most: Column, diets: Column, tags: Column) -> Column:
    """Mean of up to five scores; a null preference is not scored; 0.5 without any."""
    size = lambda xs: F.size(xs).cast("double")
    own = [
        F.when(wanted.isNotNull(), F.lower(cuisine).contains(F.lower(wanted)).cast("double")),
        F.when(liked.isNotNull(), F.when(F.size(liked) == 0, 1.0).otherwise(size(F.array_intersect(liked, ingredients)) / size(F.array_distinct(liked)))),
        F.when(disliked.isNotNull(), F.when(F.size(ingredients) == 0, 1.0).otherwise(1 - size(F.array_intersect(disliked, ingredients)) / size(F.array_distinct(ingredients)))),
        F.when(most.isNotNull(), F.when(minutes <= most, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (minutes - most) / most))),
        F.when(diets.isNotNull(), F.when(F.size(diets) == 0, 1.0).otherwise(1 - size(F.array_except(diets, tags)) / size(F.array_distinct(diets)))),
    ]
    return mean_of(own, 0.5)


def faithfulness(facts: Column, ingredients: Column, steps: Column, nutrition: Column) -> Column:
    """Mean over facts (struct type, a, b, rule, relation): pairs used together 1, one of them 0.5; rules with a word in the steps 1, else 0;
    nutrients that are both there 1 if they should help each other, else 0.5. Facts that say nothing are left out; 1 without any."""
    text = F.lower(F.array_join(steps, " "))

    def score(f: Column) -> Column:
        a, b = F.array_contains(ingredients, f["a"]), F.array_contains(ingredients, f["b"])
        x, y = F.try_element_at(nutrition, f["a"]), F.try_element_at(nutrition, f["b"])
        said = F.exists(F.split(F.lower(f["rule"]), r"\s+"), lambda w: (w != "") & text.contains(w))
        return (
            F.when(f["type"] == "ingredient_compatibility", F.when(a & b, 1.0).when(a | b, 0.5))
            .when(f["type"] == "cooking_rule", F.when(said, 1.0).otherwise(0.0))
            .when(f["type"] == "nutrition_rule", F.when(x.isNotNull() & y.isNotNull(), F.when((F.coalesce(f["relation"], F.lit("synergy")) == "synergy") & (x > 0) & (y > 0), 1.0).otherwise(0.5)))
        )

    scores = F.array_compact(F.transform(facts, score))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, 1.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores))


def nutrition_similarity(targets: Column, nutrition: Column) -> Column:
    """Mean over targets (a map of nutrient to amount) of 1 - relative error, 0 at least; a missing nutrient counts 0; 1 without targets."""
    each = F.map_entries(targets)

    def one(e: Column) -> Column:
        actual, target = F.try_element_at(nutrition, e["key"]), e["value"]
        return F.when(actual.isNull(), 0.0).when(target == 0, (actual == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(actual - target) / F.nullif(target, F.lit(0.0))))

    return F.when(F.coalesce(F.size(each), F.lit(0)) <= 0, 1.0).otherwise(F.aggregate(F.transform(each, one), F.lit(0.0), lambda s, x: s + x) / F.size(each))


def user_similarity(targets: Column, nutrition: Column, liked: Column, ingredients: Column, diets: Column, tags: Column, cuisine: Column, wanted: Column) -> Column:
    """0.6 of the nutrition's similarity and 0.4 of the mean of preferences."""
    share = lambda want, have: F.when(want.isNotNull(), F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, have)) / F.size(F.array_distinct(want))))
    likes = mean_of([F.when(wanted.isNotNull(), F.lower(cuisine).contains(F.lower(wanted)).cast("double")), share(liked, ingredients), share(diets, tags)], 0.5)
    return 0.6 * nutrition_similarity(targets, nutrition) + 0.4 * likes


def nutrition_accuracy(targets: Column, nutrition: Column, within: float = 0.15) -> Column:
    """The share of nutrients that are there on both sides and differ by at most this share; 0 must be met by 0; null without any."""
    each = F.filter(F.map_entries(targets), lambda e: F.try_element_at(nutrition, e["key"]).isNotNull())

    def near(e: Column) -> Column:
        actual = F.try_element_at(nutrition, e["key"])
        return F.when(e["value"] == 0, actual == 0).otherwise(F.abs(actual - e["value"]) <= within * F.abs(e["value"]))

    return F.size(F.filter(each, near)) / F.nullif(F.size(each), F.lit(0))


def sample_class(strict: Column, loose: Column, likes: Column, hits: Column, misses: Column, threshold: float = 0.3) -> Column:
    """positive, hard_neg_boundary, hard_neg_pref or negative; fewer known likes ask for a lower preference score."""
    asked = F.when(likes >= 3, threshold).when(likes >= 1, threshold * 0.6).otherwise(0.0)
    score = F.coalesce(hits / F.nullif(likes, F.lit(0)), F.lit(0.0))
    return F.when(misses > 0, "negative").when(strict & (score >= asked), "positive").when(~strict & loose, "hard_neg_boundary").when(strict, "hard_neg_pref").otherwise("negative")
