"""Similarities against plain definitions; matchers against all pairs."""

import difflib
import itertools
import random

from pyspark.sql import functions as F

from platewise.operators import alignment as A
from platewise.operators import scoring as S
from platewise.operators import tables as T


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_indel_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 90))) for _ in range(2))
        assert abs(A.indel(a, b) - (100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b)))) < 1e-9


def test_token_set():
    assert A.token_set("olive oil extra", "oil olive") == 100.0 and A.token_set("", "a") == 0.0
    assert A.token_set("fuzzy was a bear", "wuzzy was a bear") == max(A.indel("a bear was fuzzy", "a bear was wuzzy"), A.indel("a bear was", "a bear was fuzzy"), A.indel("a bear was", "a bear was wuzzy"))


def test_matchers_lose_no_pair(spark):
    rng = random.Random(2)
    names = sorted({" ".join(rng.choices(["salt", "sea salt", "pepper", "oil", "olive", "o", "peppers", "saltine"], k=rng.randint(1, 3))) for _ in range(60)})
    left = spark.createDataFrame([(n,) for n in names], "a string")
    right = left.withColumnRenamed("a", "b")
    held = {(a, b) for a, b in itertools.product(names, names) if a in b}
    assert {tuple(r) for r in A.holding(left, right, "a", "b").collect()} == held
    spoilt = sorted({n.replace("pp", "p") + "x" * (i % 3) for i, n in enumerate(names)})
    frame = spark.createDataFrame([(n,) for n in spoilt], "a string")
    got = {r["a"]: (r["b"], r["score"]) for r in A.resolved(frame, right, "a", "b", {"salt": "oil"}).collect()}
    for a in spoilt:
        forms, best = {a, a.replace("salt", "oil") if "salt" in a else a}, 0.0
        for f, b in itertools.product(forms, names):
            own = 1.0 if f == b else len(f) / len(b) if f in b else 0.0
            if b in f.split(" ") and len(b) > 3:
                own = max(own, 0.7)
            best = max(best, own)
        if best < 0.85:
            for f, b in itertools.product(forms, names):
                r = difflib.SequenceMatcher(None, f, b).ratio()
                best = max(best, r if r >= 0.75 else 0.0)
        assert abs(got[a][1] - best) < 1e-9, a


def test_rerank_and_rescue(spark):
    foods = spark.createDataFrame([(1, "olive oil", 9.0, 10.0), (2, "oil of olives", 3.0, 1.0), (3, "sunflower oil", 9.0, 8.0)], "food long, name string, coverage double, bonus double")
    terms = spark.createDataFrame([("olive oil",), ("sun oil",), ("zzz",)], "term string")
    ranked = A.reranked(A.candidates(terms, foods, "term", "food", "name").join(foods, "food"), "term", "food", "name", "coverage", "bonus")
    top = {r["term"]: (r["food"], round(r["score"], 3)) for r in ranked.where("rank = 1").collect()}
    assert top["olive oil"] == (1, round(0.75 * 100 + 0.1 * 100 + 0.15 * 100, 3)) and "zzz" not in top
    done = A.accepted(ranked, "coverage", 90.0).select("term", "food")
    more = A.rescued(terms, done, "term", lambda rest: rest.withColumn("food", F.lit(0).cast("long")))
    assert {r["term"]: r["food"] for r in more.collect()}["zzz"] == 0 and more.count() == 3
    both = A.capped_union([terms.crossJoin(foods.select("food")), terms.crossJoin(foods.select((F.col("food") + 1).alias("food")))], "term", "food", 2)
    assert sorted((r["term"], r["food"]) for r in both.where("term = 'zzz'").collect()) == [("zzz", 1), ("zzz", 2)]


def test_metrics(spark):
    one = spark.range(1)
    of = lambda *xs: F.array(*map(F.lit, xs))
    target = lambda kind, v: F.struct(F.lit(kind).alias("type"), F.lit(v).alias("value"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    targets = F.create_map(F.lit("calories"), target("max", 400.0), F.lit("sodium"), target("max", 500.0))
    actual = F.create_map(F.lit("calories"), F.lit(350.0), F.lit("sodium"), F.lit(450.0))
    fact = lambda kind, a=None, b=None, rule=None, rel=None: F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("type", "a", "b", "rule", "relation"), (kind, a, b, rule, rel), strict=True)])
    facts = F.array(fact("ingredient_compatibility", "salt", "oil"), fact("ingredient_compatibility", "salt", "none"), fact("cooking_rule", rule="boil slowly"), fact("nutrition_rule", "calories", "sodium"), fact("other"))
    null = F.lit(None)
    values = one.select(
        S.constraint_recall(targets, actual), S.violations(targets, actual, of("Nuts"), of("nuts", "salt"), of("vegan"), of("VEGAN")), S.faithfulness(facts, of("salt", "oil"), of("Boil it"), actual),
        S.preference_metric(of("salt", "x"), of("oil"), of("salt", "oil"), F.lit("Thai food"), F.lit("thai"), F.lit(40), F.lit(30), null.cast("array<string>"), of("a")),
        S.user_similarity(F.create_map(F.lit("calories"), F.lit(700.0)), actual, of("salt"), of("salt"), null.cast("array<string>"), of("a"), null.cast("string"), null.cast("string")),
        S.preference_match(of("a", "b"), of("a", "b", "c", "d"), of("z")), S.preference_match(of("z"), of("a"), of("z")), S.preference_match(of("q"), of("a"), of("z")),
    ).first()
    expected = [1.0, 1, (1 + 0.5 + 1 + 1) / 4, (1 + 0.5 + 0.5 + 2 / 3) / 4, 0.6 * 0.5 + 0.4 * 1.0, 0.9, 0.1, 0.5]
    assert all(abs(a - b) < 1e-9 for a, b in zip(values, expected, strict=True))


def test_draws(spark):
    df = spark.range(4000)
    shares = {r["x"]: r["count"] / 4000 for r in df.select(T.drawn({"a": 1, "b": 3}, F.col("id")).alias("x")).groupBy("x").count().collect()}
    assert abs(shares["b"] - 0.75) < 0.03
    row = T.bootstrap(df.withColumn("v", F.col("id") % 10), "id", "v", times=100).first()
    assert row["mean"] == 4.5 and 4.3 < row["low"] < 4.5 < row["high"] < 4.7
    assert T.oversampled(df.limit(3), "id", 8).groupBy("id").count().agg(F.min("count"), F.max("count"), F.sum("count")).first()[:] == (2, 3, 8)
    assert T.guarded_pivot(spark.createDataFrame([(1, "a", "g", 1.0), (1, "a", "mg", 2.0)], "k int, n string, u string, v double"), "k", "n", "u", "v") is None
