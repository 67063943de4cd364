"""Golden cases of names, quantities and lines."""

import pytest
from pyspark.sql import functions as F

from platewise.functions import names, quantity

NAMES = {"red snapper fillet": "snapper", "boneless skinless chicken breasts": "chicken", "fresh ground black pepper": "pepper", "plain cornmeal": "cornmeal", "cooked white rice": "rice", "frozen chopped spinach": "spinach", "large eggs": "eggs", "organic grass-fed beef": "beef", "wild-caught salmon": "salmon", "extra virgin olive oil": "olive oil"}
GRAMS = {(1, "cup", "flour"): 125, (1, "cup", "sugar"): 200, (1, "cup", "butter"): 227, (1, "tablespoon", "butter"): 14, (1, "oz", "x"): 28.35, (1, "pound", "x"): 453.592, (100, "gram", "x"): 100, (1, "teaspoon", "salt"): 6, (2, "Tbsps", "olive oil"): 26, (3, "item", "egg"): 300, (1, "qt", "milk"): 946}
LINES = {"500g chicken breast": (500, "chicken breast"), "2 cups rice": (370, "rice"), "1/2 tsp salt": (3, "salt"), "245g kale": (245, "kale"), "1 3/4 cups cornmeal": (420, "cornmeal"), "3 large eggs": (150, "eggs"), "1 1/2 Tbsps olive oil": (20.25, "olive oil")}
RECIPE = {"1 cup butter": (1, "cup", "butter"), "100g flour": (100, "g", "flour"), "1/2 teaspoon salt": (0.5, "teaspoon", "salt"), "eggs": (1, "item", "eggs"), "3 eggs": (3, "item", "eggs")}


def one(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_plain_names(spark):
    assert one(spark, NAMES, names.plain_name(F.col("t"))) == list(NAMES.values())


def test_normal_forms(spark):
    texts = ["Fresh Tomatoes (diced), salted", "2 (14 oz) cans Berries, to taste", None, "glass dishes onions"]
    assert one(spark, texts, names.match_name(F.col("t"))) == ["tomatoe", "2 cans berry to taste", "", "glass dish onion"]
    assert one(spark, texts, names.term_name(F.col("t"))) == ["tomato", "2 can berry", "", "glas dishe onion"]
    assert one(spark, texts, names.line_name(F.col("t"))) == ["tomatoe salted", "berrie", "", "glas dishe onion"]
    assert one(spark, ["fresh berries", "red onions"], names.dedup_key(F.col("t"))) == ["berry", "red onion"]
    assert one(spark, ["onions", "leek"], names.same_ingredient(F.col("t"), F.array(F.lit("red onion")))) == [True, False]
    assert one(spark, ["2 cups fresh basil", "10 G salt"], names.bare_name(F.col("t"))) == ["cups fresh basil", "salt"]
    assert one(spark, ["berries", "heroes", "wedges", "lemons", "leaves", "a1", None], names.singular(F.col("t"))) == ["berry", "hero", "wedg", "lemon", "leaf", None, None]


def test_lists(spark):
    texts = ["a (b, c), d; e", 'c("x", NA, "y, z")', '["p", "q"]', "['p', 'q']", "(1, 2)", None, " "]
    assert one(spark, texts, names.listed(F.col("t"))) == [["a (b, c)", "d", "e"], ["x", None, "y, z"], ["p", "q"], ["p", "q"], ["1", "2"], [], []]
    pair = names.aligned(F.split(F.substring_index("t", "|", 1), ","), F.split(F.substring_index("t", "|", -1), ","))
    got = one(spark, ["a,b|1,2", "a|1,2", "a,b|1", "a,b,c|1,2"], pair)
    assert [(r["parts"], r["amounts"], r["policy"]) for r in got] == [(["a", "b"], ["1", "2"], "ok"), (["a", "a"], ["1", "2"], "broadcast_parts"), (["a", "b"], ["1", "1"], "broadcast_qty"), (["a", "b"], ["1", "2"], "truncate")]


def test_fractions_and_templates(spark):
    assert one(spark, ["1.5", "0.25", "2", "0", "1.34", "1"], names.fraction_text(F.col("t").cast("double"), "cup")) == ["1 1/2 cups", "1/4 cup", "2 cups", "0 cup", "1 1/3 cups", "1 cup"]
    assert one(spark, ["1½ cups"], names.plain_fractions(F.col("t"))) == ["1 1/2 cups"]
    assert one(spark, ["so {\"a\": {\"b\": 1}} it is", "none"], names.json_body(F.col("t"))) == ['{"a": {"b": 1}}', None]
    assert one(spark, ["a,b"], names.numbered(F.split("t", ","))) == ["1. a\n2. b"]
    assert one(spark, ["x", None], names.filled("<{t}>!", t=F.col("t"))) == ["<x>!", "<>!"]


@pytest.mark.parametrize("case", list(GRAMS))
def test_grams(spark, case):
    n, unit, name = case
    assert one(spark, [name], quantity.grams(F.lit(float(n)), F.lit(unit), F.col("t")))[0] == pytest.approx(GRAMS[case])


def test_lines(spark):
    assert [(round(r["grams"], 4), r["name"]) for r in one(spark, LINES, quantity.line(F.col("t")))] == list(LINES.values())
    assert [tuple(r) for r in one(spark, RECIPE, quantity.recipe_line(F.col("t")))] == list(RECIPE.values())
    lead = one(spark, ["1-2 tbsp oil", "½ cup x", "1 to 2 cups", "salt", "250 g y"], quantity.leading(F.col("t")))
    assert [tuple(r) for r in lead] == [(1.5, "tbsp"), (0.5, "cup"), (1.5, "cups"), (None, None), (250.0, "g")]
    assert one(spark, ["2 oz", "1 lb", "3 cups"], quantity.mass_grams(F.col("t"))) == [56.69904625, 453.59237, None]


def test_quantities(spark):
    texts = ["1 1/2", "1/2", "½", "1-2", "half", "dozen", "abc", "1/0"]
    assert one(spark, texts, quantity.parsed(F.col("t"))) == [1.5, 0.5, 0.5, 2.0, 0.5, 12.0, None, None]
    assert one(spark, ["1-2"], quantity.parsed(F.col("t"), upper=False)) == [1.5]
    got = one(spark, ["2 (14 ounce) cans", "2 x 400 g", "14-ounce can"], quantity.pack(F.col("t")))
    assert [r["amount"] for r in got] == [28.0, 800.0, 14.0]


def test_lanes(spark):
    got = one(spark, ["fdc_density", "global_piece", "other"], quantity.lane(F.col("t"), F.lit(0)))
    assert [(r["lane"], r["confidence"]) for r in got] == [("volume", 0.95), ("piece", 0.65), ("fallback", 0.5)]
    layers = lambda unit: quantity.layered_grams(F.lit(2.0), F.lit(unit), [(F.lit(None).cast("double"), "fdc_density"), (F.lit(0.5), "cat_density")], [])
    assert [tuple(one(spark, ["x"], layers(u))[0]) for u in ("kg", "cup", "piece", "pinch")] == [(2000.0, "global_other"), (236.588, "cat_density"), (100.0, "global_piece"), (None, "no_match")]
    assert one(spark, ["olive oil", "garlic clove", "leek"], quantity.inferred_unit(F.col("t"))) == ["tbsp", "clove", None]
    assert tuple(one(spark, ["Energy"], quantity.nutrient_unit(F.col("t"), F.lit("kJ"), F.lit(1000.0)))[0]) == ("kcal", pytest.approx(239.005736))
    flags = one(spark, ["2 cups flour, optional", "salt to taste"], quantity.audited(F.col("t"), F.lit(None).cast("string")))
    assert [(r["amount"], r["unit"], r["flags"]) for r in flags] == [(2.0, "cups", ["qty_from_text", "optional"]), (None, None, ["no_qty", "no_unit", "to_taste"])]
