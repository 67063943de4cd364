"""Nutrients of foods, ingredients and recipes: catalogue, back-propagation, overlays, a calculator, profiles of users."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a source's kind of data is worth.
TYPE_BONUS = [("foundation", 10.0), ("survey", 8.0), ("sr legacy", 7.0), ("sr_legacy", 7.0), ("branded", 1.0), ("sample", 3.0), ("experimental", 4.0)]


def imputed(amount: str, median: str, low: str, high: str) -> Column:
    """The amount, else the median, else the middle of the bounds."""
    return F.coalesce(amount, median, (F.col(low) + F.col(high)) / 2)


def variants(*columns: str) -> Column:
    """The first variant of a nutrient that is there, as energy by general, specific and basic factors."""
    return F.coalesce(*columns)


def type_bonus(kind: Column) -> Column:
    out = F.lit(0.0)
    for word, value in reversed(TYPE_BONUS):
        out = F.when(F.lower(kind).contains(word), F.lit(value)).otherwise(out)
    return out


def coverage(foods: DataFrame, amounts: DataFrame, food: str, nutrient: str) -> DataFrame:
    """foods with coverage, the number of distinct nutrients known; 0 without any."""
    n = amounts.groupBy(food).agg(F.countDistinct(nutrient).alias("coverage"))
    return foods.join(n, food, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))


def catalogue(amounts: DataFrame, food: str, nutrient: str, amount: Column, order: Column, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row for each food with a column for each wanted nutrient: of names that equal or begin with one of its patterns, the
    earliest pattern counts, then the smallest by `order`."""
    out = []
    for column, patterns in wanted.items():
        rank = F.lit(None).cast("int")
        for i, p in reversed(list(enumerate(patterns))):
            rank = F.when(F.col(nutrient).startswith(p), F.lit(i)).otherwise(rank)
        out.append(F.min_by(amount, F.when(rank.isNotNull() & amount.isNotNull(), F.struct(rank, order))).alias(column))
    return amounts.groupBy(food).agg(*out)


def backpropagated(lines: DataFrame, recipes: DataFrame, recipe: str, item: str, nutrients: Sequence[str], servings: str, least: int = 5) -> DataFrame:
    """Per ingredient the median over recipes of a serving's nutrient over the number of ingredients; `least` recipes are needed."""
    n = lines.select(recipe, item).distinct().groupBy(recipe).agg(F.count("*").alias("items"))
    by = F.coalesce(F.nullif(F.col(servings).cast("double"), F.lit(0.0)), F.lit(1.0)) * F.col("items")
    each = recipes.join(n, recipe).select(recipe, *[(F.col(c) / by).alias(c) for c in nutrients])
    return lines.select(recipe, item).distinct().join(each, recipe).groupBy(item).agg(F.count("*").alias("recipes"), *[F.median(c).alias(c) for c in nutrients]).where(F.col("recipes") >= least)


def overlaid(rows: DataFrame, more: DataFrame, key: str, values: Sequence[str], method: str, score: float) -> DataFrame:
    """rows whose first value is missing take those of more, with the method's name and score; others stay."""
    put = more.select(key, *[F.col(c).alias(f"new_{c}") for c in values])
    joined = rows.join(put, key, "left")
    filled = F.col(values[0]).isNull() & F.col(f"new_{values[0]}").isNotNull()
    out = joined.withColumn("match_method", F.when(filled, F.lit(method)).otherwise(F.col("match_method"))).withColumn("match_score", F.when(filled, F.lit(score)).otherwise(F.col("match_score")))
    return out.select(*[F.coalesce(c, f"new_{c}").alias(c) if c in values else F.col(c) for c in rows.columns])


def calculated(lines: DataFrame, foods: DataFrame, recipe: str, item: str, grams: str, nutrients: Sequence[str], servings: int = 1) -> DataFrame:
    """Per recipe: nutrients a serving from amounts per 100 g, coverage (share of lines whose ingredient is known), missing ones in order."""
    met = lines.select(recipe, item, grams).join(foods.select(item, *nutrients, F.lit(True).alias("known")), item, "left")
    sums = [F.coalesce(F.sum(F.col(c) * F.col(grams) / 100) / servings, F.lit(0.0)).alias(c) for c in nutrients]
    return met.groupBy(recipe).agg(*sums, F.avg(F.col("known").isNotNull().cast("double")).alias("coverage"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col(item)))).alias("missing"))


def layered(rows: DataFrame, value: str, layers: Mapping[str, Sequence[str]], least: int = 3) -> DataFrame:
    """Medians for each layer of keys (key_type, k, value, n) with `least` rows; keys are joined by |."""
    every = None
    for name, keys in layers.items():
        own = rows.groupBy(F.concat_ws("|", *keys).alias("k")).agg(F.median(value).alias("value"), F.count(value).alias("n")).where(F.col("n") >= least)
        own = own.select(F.lit(name).alias("key_type"), "k", "value", "n")
        every = own if every is None else every.unionByName(own)
    return every


def best_layer(rows: DataFrame, medians: DataFrame, layers: Mapping[str, Sequence[str]], out: str) -> DataFrame:
    """rows with the value of the first layer that has one, and that layer's name (out, out_path)."""
    for name, keys in layers.items():
        own = medians.where(F.col("key_type") == name).select(F.col("k").alias(f"{out}_k"), F.col("value").alias(f"{out}_{name}"))
        rows = rows.join(own, F.concat_ws("|", *keys) == F.col(f"{out}_k"), "left").drop(f"{out}_k")
    found = [f"{out}_{n}" for n in layers]
    path = F.coalesce(*[F.when(F.col(f"{out}_{n}").isNotNull(), F.lit(n)) for n in layers])
    return rows.withColumn(f"{out}_path", path).withColumn(out, F.coalesce(*found)).drop(*found)


def one_energy(rows: DataFrame, recipe: str, name: str, order: Sequence[str]) -> DataFrame:
    """Of a recipe's energy rows the one whose name comes first in `order`; other rows stay."""
    rank = F.lit(None).cast("int")
    for i, n in enumerate(order):
        rank = F.when(F.col(name) == n, F.lit(i)).otherwise(rank)
    marked = rows.withColumn("energy_rank", rank)
    best = marked.where("energy_rank IS NOT NULL").groupBy(recipe).agg(F.min("energy_rank").alias("best_rank"))
    return marked.join(best, recipe, "left").where("energy_rank IS NULL OR energy_rank = best_rank").drop("energy_rank", "best_rank")


def intake(users: DataFrame, table: DataFrame, keys: Sequence[str], state: str, values: Sequence[str], healthy: str = "healthy") -> DataFrame:
    """users with the intake of their group and state, else of the healthy ones of their group; `-` is missing."""
    clean = table.select(*keys, state, *[F.nullif(F.col(v).cast("string"), F.lit("-")).try_cast("double").alias(v) for v in values])
    own = clean.select(*keys, state, *[F.col(v).alias(f"own_{v}") for v in values])
    base = clean.where(F.col(state) == healthy).drop(state).select(*keys, *[F.col(v).alias(f"base_{v}") for v in values])
    joined = users.join(F.broadcast(own), [*keys, state], "left").join(F.broadcast(base), list(keys), "left")
    return joined.select(*users.columns, *[F.coalesce(f"own_{v}", f"base_{v}").alias(v) for v in values])


def merged(targets: DataFrame, likes: DataFrame, user: str) -> DataFrame:
    """Profiles of users who are in either; which sources they are from."""
    a, b = targets.withColumn("in_targets", F.lit(True)), likes.withColumn("in_likes", F.lit(True))
    source = F.array_compact(F.array(F.when(F.col("in_targets"), "targets"), F.when(F.col("in_likes"), "likes")))
    return a.join(b, user, "full_outer").withColumn("sources", source).drop("in_targets", "in_likes")


# --- graph: edges (src, dst, edge_type, ...) and nodes (node_type, node_id, node_name)

def neighbours(edges: DataFrame, start: DataFrame, node: str, edge_type: str) -> DataFrame:
    """start's nodes with what their edges of a type lead to."""
    return start.select(node).join(edges.where(F.col("edge_type") == edge_type), F.col(node) == F.col("src")).drop("src")


def looked_up(nodes: DataFrame, node_type: str | None = None, node_id: str | None = None, name: str | None = None) -> DataFrame:
    """Nodes by type, id or name; filters reach the scan."""
    for column, value in (("node_type", node_type), ("node_id", node_id), ("node_name", name)):
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    return nodes


def subgraph(edges: DataFrame, nodes: DataFrame, caps: Mapping[str, int], draw: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes of each type, at most caps[type] by the draw (the cap is the feature), and the edges (src, dst as type:id) between them."""
    ranked = nodes.withColumn("place", F.row_number().over(Window.partitionBy("node_type").orderBy(draw, "node_id")))
    cap = F.lit(None).cast("int")
    for kind, n in caps.items():
        cap = F.when(F.col("node_type") == kind, F.lit(n)).otherwise(cap)
    kept = ranked.where(cap.isNull() | (F.col("place") <= cap)).drop("place")
    ids = kept.select(F.concat_ws(":", "node_type", "node_id").alias("id"))
    return kept, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
