from pyspark.sql import functions as F
from platewise.functions import quantity, text
from platewise.operators import joins, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_quantities(spark):
    cases = {"1 1/2": 1.5, "1/2": 0.5, "½": 0.5, "1-2": 2.0, "half": 0.5, "dozen": 12.0, "abc": None, "1/0": None, "1½": 1.5}
    assert {t: one(spark, quantity.parsed(F.lit(t))) for t in cases} == cases
    assert one(spark, quantity.parsed(F.lit("1-2"), upper=False)) == 1.5


def test_packs_and_grams(spark):
    assert tuple(one(spark, quantity.pack(F.lit("2 (14 ounce) cans")))) == (28.0, "ounce")
    assert tuple(one(spark, quantity.pack(F.lit("2 x 400 g")))) == (800.0, "g")
    assert tuple(one(spark, quantity.pack(F.lit("14-ounce can")))) == (14.0, "ounce")
    grams = lambda n, u, i: one(spark, quantity.grams(F.lit(n), F.lit(u), F.lit(i)))
    assert [grams(1.0, "cup", "flour"), grams(1.0, "cups", "sugar"), grams(1.0, "tablespoon", "butter"), grams(1.0, "pound", "x"), grams(1.0, "teaspoon", "salt")] == [125.0, 200.0, 14.0, 453.592, 6.0]


def test_text(spark):
    assert one(spark, text.r_vector(F.lit('c("1", NA, "2")'))) == ["1", None, "2"]
    assert one(spark, text.r_vector(F.lit('c("salt", "olive oil, extra")'))) == ["salt", "olive oil, extra"]
    assert [one(spark, text.canonical_id(F.lit(t))) for t in ("38.0", "38.000", "3.4e+02")] == ["38", "38", "340"]
    assert one(spark, text.ngrams(F.array(F.lit("a")), 2)) == []


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 3.0), (1, 10.0, 1.0)], "k int, v double, w double")
    assert abs(stats.weighted_median(df, ["k"], "v", "w").first()["median"] - 1.5) < 1e-9


def test_fuzzy(spark):
    a = spark.createDataFrame([(1, "red apple"), (2, "zzz")], "i int, t string")
    b = spark.createDataFrame([(7, "apple red"), (8, "green apple")], "j int, u string")
    assert [tuple(r) for r in joins.fuzzy_best(a, b, "i", "t", "j", "u").collect()] == [(1, 7, 1.0)]
