"""Recipes edited on purpose: a violation put in, corrections found for it and applied; all as column expressions.

A recipe's lines are an array of structs (item, grams, n); n has what 100 g hold of each of NUTRIENTS, a null counts 0.
Draws are hashes of the recipe's key, so a run gives the same edits again on any number of executors. `foods` is the
table of known foods, at most MOST of them: a mapping of lower-case names to n, which goes into the plan as one literal.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: nutrients by place; words that name a kind of food
NUTRIENTS = ["energy_kcal", "protein_g", "fat_g", "carbohydrate_g", "fiber_g", "sodium_mg", "saturated_fat_g", "sugars_g"]
PROTEIN = ["chicken", "beef", "pork", "fish", "salmon", "tuna", "tofu", "egg", "turkey"]
CARB = ["rice", "pasta", "bread", "potato", "oat", "quinoa", "corn", "noodle"]
VEGETABLE = ["broccoli", "spinach", "kale", "carrot", "tomato", "pepper", "onion"]
FAT = ["oil", "butter", "cheese", "nuts", "avocado"]
SUGAR = ["honey", "syrup", "sugar", "jam"]
# fixed values: field, words of the line that changes, item and grams of the line put in if there is none, range of the factor,
# whether too much is the violation, share of the limit from which it is one
KINDS = [
    ("sodium_mg", ["salt"], "salt", 2.0, 2.5, 3.5, True, 1.0),
    ("protein_amdr", PROTEIN, "chicken breast", 200.0, 0.3, 0.5, False, 0.8),
    ("fat_amdr", FAT, "olive oil", 10.0, 2.5, 4.0, True, 1.25),
    ("carb_amdr", CARB, "rice", 370.0, 0.3, 0.5, False, 0.75),
    ("energy_kcal", ["oil", *CARB], "olive oil", 40.0, 1.4, 1.7, True, 1.25),
    ("fiber_g", VEGETABLE, "broccoli", 200.0, 0.2, 0.4, False, 0.8),
    ("saturated_fat_g", ["butter", "cheese"], "butter", 15.0, 2.5, 3.5, True, 1.2),
    ("sugars_g", SUGAR, "honey", 20.0, 2.0, 3.0, True, 1.5),
]
# fixed values, in the order of KINDS: the nutrient's place, energy of a gram if the measure is a share of energy, whether it is all servings'
MEASURES = [(5, None, True), (1, 4.0, False), (2, 9.0, False), (3, 4.0, False), (0, None, False), (4, None, True), (6, 9.0, False), (7, 4.0, False)]
# fixed values: field, words, reason; then the least factor and how much of the excess goes, or the range of a drawn factor
FIXES = [
    ("sodium_mg", ["salt"], "reduce_sodium_to_meet_limit", 0.3, 1.2, None),
    ("protein_amdr", PROTEIN, "increase_protein_to_meet_amdr", 1.4, 1.6, "drawn"),
    ("fat_amdr", FAT, "reduce_fat_to_meet_amdr", 0.4, 0.6, "drawn"),
    ("carb_amdr", CARB, "increase_carb_to_meet_amdr", 1.5, 1.8, "drawn"),
    ("energy_kcal", ["oil", "rice", "pasta", "bread"], "reduce_energy_to_meet_target", 0.6, 1.2, None),
    ("fiber_g", VEGETABLE, "increase_fiber_to_meet_minimum", 1.5, 2.0, "drawn"),
    ("saturated_fat_g", ["butter", "cheese"], "reduce_saturated_fat_to_meet_limit", 0.2, 1.3, None),
    ("sugars_g", SUGAR, "reduce_sugars_to_meet_limit", 0.2, 1.3, None),
]
LIMITS = {"sodium_mg": 2300.0, "protein_amdr": 20.0, "fat_amdr": 30.0, "carb_amdr": 50.0, "energy_kcal": 2000.0, "fiber_g": 25.0, "saturated_fat_g": 10.0, "sugars_g": 10.0}
TOGETHER, GREENS = ["sodium_mg", "energy_kcal", "fat_amdr"], ["broccoli", "spinach", "kale"]

MOST = 10_000
LINES = "array<struct<item:string,grams:double,n:array<double>>>"
VIOLATION = "struct<type:string,field:string,item:string,actual:double,limit:double,severity:string>"


def uniform(key: Column, *salt: Column | str) -> Column:
    """A draw in [0, 1) from a hash of key and salt."""
    text = F.concat_ws("|", key.cast("string"), *[F.lit(s) if isinstance(s, str) else s for s in salt])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def food_map(foods: Mapping[str, Sequence[float]]) -> Column:
    if len(foods) > MOST:
        raise ValueError(f"more than {MOST} foods")
    return F.from_json(F.lit(json.dumps({k: list(map(float, foods[k])) for k in sorted(foods)})), "map<string,array<double>>")


def best_match(name: Column, foods: Column) -> Column:
    """The food of this name, else the first that the name holds, else the first that holds the name; else null."""
    keys, low = F.map_keys(foods), F.lower(name)
    held = F.get(F.filter(keys, lambda k: low.contains(k)), F.lit(0))
    return F.when(F.array_contains(keys, low), low).otherwise(F.coalesce(held, F.get(F.filter(keys, lambda k: k.contains(low)), F.lit(0))))


def line(item: Column, grams: Column, n: Column) -> Column:
    return F.struct(item.alias("item"), grams.cast("double").alias("grams"), n.alias("n"))


def nutrition(lines: Column, servings: float) -> Column:
    """Of each of NUTRIENTS, what a serving has."""
    of = lambda x, i: F.coalesce(x["grams"] * F.get(x["n"], i) / 100, F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(len(NUTRIENTS) - 1)), lambda i: F.aggregate(lines, F.lit(0.0), lambda s, x: s + of(x, i)) / float(servings))


def measure(lines: Column, kind: Column, servings: float) -> Column:
    """What the violation of a kind (one of KINDS with its MEASURES) is told by: a total, a percentage of energy (null without
    energy), or energy of a serving. Only the nutrients it takes are summed."""
    of = lambda x, i: F.coalesce(x["grams"] * F.get(x["n"], i) / 100, F.lit(0.0))
    serving = lambda i: F.aggregate(lines, F.lit(0.0), lambda s, x: s + of(x, i)) / float(servings)
    share = let(serving(F.lit(0)), lambda energy: F.when(energy > 0, serving(kind["n"]) * kind["kcal"] / energy * 100))
    return F.when(kind["kcal"].isNotNull(), share).when(kind["whole"], serving(kind["n"]) * float(servings)).otherwise(serving(kind["n"]))


def first_named(lines: Column, words: Column) -> Column:
    """The place, from 1, of the first line whose item holds one of the words; 0 without any."""
    return F.array_position(F.transform(lines, lambda x: let(F.lower(x["item"]), lambda low: F.coalesce(F.exists(words, lambda w: low.contains(w)), F.lit(False)))), True)


def _structs(names: str, rows: Sequence[Sequence]) -> Column:
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v).cast("double") if v is None else F.lit(v)
    return F.array(*[F.struct(*[value(v).alias(n) for n, v in zip(names.split(), (i, *row), strict=True)]) for i, row in enumerate(rows)])


def limits_of(limits: Mapping[str, Column], servings: float) -> Column:
    """The limits in the order of KINDS; what is not given, or null, is LIMITS' value; energy is a day's and counts by serving."""
    each = [F.coalesce(limits.get(f, F.lit(None)).cast("double"), F.lit(LIMITS[f])) for f in LIMITS]
    return F.array(*[v / float(servings) if f == "energy_kcal" else v for f, v in zip(LIMITS, each, strict=True)])


EDIT = "struct<field:string,violated:boolean,actual:double,limit:double,severity:string,lines:array<struct<item:string,grams:double,n:array<double>>>>"


def attempt(lines: Column, key: Column, k: Column, limits: Column, foods: Column, servings: float) -> Column:
    """The edit (EDIT) of a kind; its lines are those given if it does not violate."""
    factor = k["low"] + (k["high"] - k["low"]) * uniform(key, "factor", k["field"])
    limit = F.get(limits, k["i"])

    def told(new: Column) -> Column:
        def result(actual: Column) -> Column:
            violated = F.coalesce(F.when(k["raised"], actual > limit * k["edge"]).otherwise(actual < limit * k["edge"]), F.lit(False))
            severity = F.when((k["field"] == "sodium_mg") & (actual > limit * 1.5), "critical").otherwise("major")
            told = {"field": k["field"], "violated": violated, "actual": actual, "limit": limit, "severity": severity, "lines": F.when(violated, new).otherwise(lines)}
            return F.struct(*[c.alias(n) for n, c in told.items()]).cast(EDIT)

        return let(measure(new, k, servings), result)

    def changed(at: Column) -> Column:
        more = F.concat(lines, F.array(line(k["item"], k["grams"] * factor, F.try_element_at(foods, k["item"]))))
        return let(factor, lambda f: F.when(at > 0, F.transform(lines, lambda x, i: F.when(i == at - 1, line(x["item"], x["grams"] * f, x["n"])).otherwise(x))).otherwise(more))

    return let(let(first_named(lines, k["words"]), changed), told)


def attempts(lines: Column, key: Column, limits: Column, foods: Column, servings: float) -> Column:
    """Each kind's edit with its draw (its place among the tries) before it."""
    return F.transform(all_kinds(), lambda k: let(attempt(lines, key, k, limits, foods, servings), lambda e: F.struct(uniform(key, "order", k["field"]).alias("draw"), *[e[n].alias(n) for n in ("field", "violated", "actual", "limit", "severity", "lines")])))


def violating(edit: Column) -> Column:
    """The edit if it violates, else null."""
    return let(edit, lambda e: F.when(e["violated"], e))


def all_kinds() -> Column:
    return _structs("i field words item grams low high raised edge n kcal whole", [(*a, *b) for a, b in zip(KINDS, MEASURES, strict=True)])


def first_edit(lines: Column, key: Column, kinds: Column, limits: Column, foods: Column, servings: float) -> Column:
    """The edit of the first kind in drawn order that violates; none after it is tried. Null if none does."""
    order = F.array_sort(F.transform(kinds, lambda k: F.struct(uniform(key, "order", k["field"]).alias("draw"), k["field"].alias("field"), k["i"].alias("i"))))
    tried = lambda x: let(F.get(kinds, x["i"]), lambda k: violating(attempt(lines, key, k, limits, foods, servings)))
    return F.aggregate(order, F.lit(None).cast(EDIT), lambda found, x: F.when(found.isNotNull(), found).otherwise(tried(x)))


def violation(kind: str, field: Column, item: Column, actual: Column, limit: Column, severity: Column) -> Column:
    names = ["type", "field", "item", "actual", "limit", "severity"]
    return F.struct(*[c.alias(n) for n, c in zip(names, (F.lit(kind), field, item, actual, limit, severity), strict=True)]).cast(VIOLATION)


def against_preference(lines: Column, key: Column, liked: Column, disliked: Column, foods: Column) -> Column:
    """Lines and the violation (null without one): six times in ten a known disliked food comes in, else four in ten a liked one goes."""
    known = F.array_compact(F.transform(F.coalesce(disliked, F.array().cast("array<string>")), lambda d: best_match(d, foods)))
    none, none_of = F.lit(None), F.lit(None).cast("double")
    adds = (F.coalesce(F.size(disliked), F.lit(0)) > 0) & (uniform(key, "dislike") < 0.6)
    drops = ~adds & (F.coalesce(F.size(liked), F.lit(0)) > 0) & (uniform(key, "like") < 0.4)

    def both_ways(x: Column) -> Column:
        low = F.lower(x["item"])
        return F.coalesce(F.exists(liked, lambda w: low.contains(F.lower(w)) | F.lower(w).contains(low)), F.lit(False))

    def added(item: Column) -> Column:
        more = F.concat(lines, F.array(line(item, 50 + 50 * uniform(key, "grams"), F.try_element_at(foods, item))))
        told = violation("preference_violation", F.lit("disliked_ingredient_added"), item, none_of, none_of, F.lit("critical"))
        return F.when(item.isNotNull(), F.struct(more.alias("lines"), told.alias("violation")))

    def dropped(at: Column) -> Column:
        fewer = F.filter(lines, lambda x, i: i != at - 1)
        told = violation("preference_violation", F.lit("liked_ingredient_removed"), F.get(lines, (at - 1).cast("int"))["item"], none_of, none_of, F.lit("major"))
        return F.when(at > 0, F.struct(fewer.alias("lines"), told.alias("violation")))

    chosen = let(known, lambda k: F.get(k, F.floor(uniform(key, "which") * F.size(k)).cast("int")))
    found = F.when(adds, let(chosen, added)).when(drops, let(F.array_position(F.transform(lines, both_ways), True), dropped))
    return F.coalesce(found, F.struct(lines.alias("lines"), none.cast(VIOLATION).alias("violation")))


def violated(recipes: DataFrame, key: str, lines: str, liked: str, disliked: str, limits: Mapping[str, Column], foods: Mapping[str, Sequence[float]], servings: float = 4) -> DataFrame:
    """Recipes with a violation put in: their columns, `lines` edited, and violations, an array of structs (VIOLATION).

    60 % get one of KINDS, tried in drawn order until one violates; 25 % one against preference; the others one of
    TOGETHER and one against preference. Recipes where none comes about are left out, as are those without lines."""
    known, k, own = food_map(foods), F.col(key), F.col(lines)
    kinds = all_kinds()
    bounds = limits_of(limits, servings)
    field = F.get(F.array(*map(F.lit, TOGETHER)), F.floor(uniform(k, "together") * len(TOGETHER)).cast("int"))
    mixed = let(F.get(F.filter(kinds, lambda x: x["field"] == field), F.lit(0)), lambda x: violating(attempt(own, k, x, bounds, known, servings)))

    def drawn(task: Column) -> Column:
        def edited(t: Column) -> Column:
            base = F.coalesce(t["lines"], own.cast(LINES))
            plain = F.struct(base.alias("lines"), F.lit(None).cast(VIOLATION).alias("violation"))
            second = F.when(task < 0.6, plain).otherwise(against_preference(base, k, F.col(liked), F.col(disliked), known))
            first = F.when(t.isNotNull(), violation("nutrition_violation", t["field"], F.lit(None), t["actual"], t["limit"], t["severity"]))
            return let(second, lambda s: F.struct(s["lines"].alias("lines"), F.array_compact(F.array(first, s["violation"])).alias("violations")))

        return let(F.when(task < 0.6, first_edit(own, k, kinds, bounds, known, servings)).when(task >= 0.85, mixed), edited)

    # a generator, for a filter on violations would go down to the columns they come from and compute all of it again
    done = F.filter(F.transform(F.array(uniform(k, "task")), drawn), lambda x: F.size(x["violations"]) > 0)
    out = recipes.select("*", F.explode(F.when(F.size(own) > 0, done)).alias("_done"))
    return out.select(*[F.col("_done.lines").alias(c) if c == lines else F.col(c) for c in recipes.columns], "_done.violations")


def corrections(lines: Column, violations: Column, key: Column, foods: Mapping[str, Sequence[float]]) -> Column:
    """Of each violation that can be mended: struct (action, at (place from 0), item, grams, reason)."""
    known = food_map(foods)

    def made(action: Column | str, at: Column, item: Column, grams: Column, reason: Column | str) -> Column:
        as_column = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(as_column(action).alias("action"), at.cast("int").alias("at"), item.alias("item"), grams.cast("double").alias("grams"), as_column(reason).alias("reason"))

    none = F.lit(None)
    greens = F.array_compact(F.transform(F.array(*map(F.lit, GREENS)), lambda g: best_match(g, known)))
    green = let(F.get(greens, F.lit(0)), lambda g: F.when(g.isNotNull(), made("add_ingredient", none, g, F.lit(100.0), "add_high_fiber_vegetable")))
    fixes = _structs("i field words reason a b how", [(f, w, r, a, b, how or "") for f, w, r, a, b, how in FIXES])

    def nutritional(v: Column, fix: Column) -> Column:
        drawn = fix["a"] + (fix["b"] - fix["a"]) * uniform(key, "fix", fix["field"])
        factor = F.when(fix["how"] == "drawn", drawn).otherwise(F.greatest(fix["a"], 1 - (v["actual"] - v["limit"]) / v["actual"] * fix["b"]))

        def at_line(at: Column) -> Column:
            x = F.get(lines, (at - 1).cast("int"))
            change = made(F.when(factor < 1, "reduce_quantity").otherwise("increase_quantity"), at - 1, x["item"], x["grams"] * factor, fix["reason"])
            return F.when(at > 0, change).when(v["field"] == "fiber_g", green)

        return let(first_named(lines, fix["words"]), at_line)

    def preferred(v: Column) -> Column:
        met = F.transform(lines, lambda x: F.coalesce(F.lower(x["item"]).contains(v["item"]) | v["item"].contains(F.lower(x["item"])), F.lit(False)))
        removed = let(F.array_position(met, True), lambda at: F.when(at > 0, made("remove_ingredient", at - 1, F.get(lines, (at - 1).cast("int"))["item"], none, "remove_disliked_ingredient")))
        restored = let(best_match(v["item"], known), lambda m: F.when(m.isNotNull(), made("add_ingredient", none, m, F.lit(100.0), "restore_liked_ingredient")))
        return F.when(v["field"] == "disliked_ingredient_added", removed).otherwise(restored)

    def one(v: Column) -> Column:
        fix = F.get(F.filter(fixes, lambda f: f["field"] == v["field"]), F.lit(0))
        return F.when(v["type"] == "nutrition_violation", let(fix, lambda f: nutritional(v, f))).otherwise(preferred(v))

    return F.array_compact(F.transform(violations, one))


def corrected(lines: Column, fixes: Column, foods: Mapping[str, Sequence[float]]) -> Column:
    """Lines after the corrections: amounts changed (the last correction of a line holds), lines removed, lines put in at the end."""
    known = food_map(foods)

    def kept(x: Column, i: Column) -> Column:
        return ~F.exists(fixes, lambda c: (c["action"] == "remove_ingredient") & (c["at"] == i))

    def changed(x: Column, i: Column) -> Column:
        grams = F.transform(F.filter(fixes, lambda c: c["action"].isin("reduce_quantity", "increase_quantity") & (c["at"] == i)), lambda c: c["grams"])
        return line(x["item"], F.coalesce(F.try_element_at(grams, F.lit(-1)), x["grams"]), x["n"])

    # places are those before any line goes, so amounts change first
    edited = let(F.transform(lines, changed), lambda xs: F.filter(xs, kept))
    more = F.transform(F.filter(fixes, lambda c: c["action"] == "add_ingredient"), lambda c: line(c["item"], c["grams"], F.try_element_at(known, c["item"])))
    return F.concat(edited, more)
