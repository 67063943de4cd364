"""Edited and corrected recipes, personas and self-BLEU, each against plain Python."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from platewise.operators import diversity, editing, personas
from platewise.plans.generation import FOODS

LINES = "array<struct<item:string,grams:double,n:array<double>>>"


def u(key, *salt):
    return int(hashlib.md5("|".join(map(str, (key, *salt))).encode()).hexdigest()[:12], 16) / (1 << 48)


def told(lines, servings=4):
    n = [sum(g * (v[i] if v else 0) / 100 for _, g, v in lines) / servings for i in range(8)]
    kcal, protein, fat, carb, fiber, sodium, saturated, sugars = n
    share = lambda x, per: x * per / kcal * 100 if kcal > 0 else None
    return [sodium * servings, share(protein, 4), share(fat, 9), share(carb, 4), kcal, fiber * servings, share(saturated, 9), share(sugars, 4)]


def match(name):
    if name in FOODS:
        return name
    return next((f for f in sorted(FOODS) if f in name), None) or next((f for f in sorted(FOODS) if name in f), None)


def put_in(key, lines, kind, servings=4):
    i = [k[0] for k in editing.KINDS].index(kind)
    field, words, item, grams, low, high, raised, edge = editing.KINDS[i]
    new = list(lines)
    at = next((j for j, x in enumerate(new) if any(w in x[0].lower() for w in words)), None)
    if at is None:
        new.append((item, grams, FOODS[item]))
        at = len(new) - 1
    new[at] = (new[at][0], new[at][1] * (low + (high - low) * u(key, "factor", field)), new[at][2])
    actual, limit = told(new, servings)[i], editing.LIMITS[field] / (servings if field == "energy_kcal" else 1)
    if actual is None or not (actual > limit * edge if raised else actual < limit * edge):
        return None
    return new, (field, actual, limit, "critical" if field == "sodium_mg" and actual > limit * 1.5 else "major")


def disturb(key, lines, liked, disliked):
    if disliked and u(key, "dislike") < 0.6:
        known = [m for m in map(match, disliked) if m]
        if known:
            item = known[math.floor(u(key, "which") * len(known))]
            return [*lines, (item, 50 + 50 * u(key, "grams"), FOODS[item])], ("disliked_ingredient_added", item)
    elif liked and u(key, "like") < 0.4:
        for i, x in enumerate(lines):
            if any(w in x[0] or x[0] in w for w in liked):
                return lines[:i] + lines[i + 1 :], ("liked_ingredient_removed", x[0])
    return lines, None


def brute(key, lines, liked, disliked):
    task, found = u(key, "task"), []
    if task < 0.6:
        for kind in sorted(editing.LIMITS, key=lambda f: u(key, "order", f)):
            if done := put_in(key, lines, kind):
                return done[0], [done[1]]
        return None
    if task >= 0.85 and (done := put_in(key, lines, editing.TOGETHER[math.floor(u(key, "together") * 3)])):
        lines, found = done[0], [done[1]]
    lines, other = disturb(key, lines, liked, disliked)
    found += [other] if other else []
    return (lines, found) if found else None


def mend(key, lines, violations):
    amounts, gone, more, actions = {}, set(), [], []
    for v in violations:
        if v[0] == "disliked_ingredient_added":
            at = next((i for i, x in enumerate(lines) if v[1] in x[0] or x[0] in v[1]), None)
            if at is not None:
                gone.add(at)
                actions.append("remove_ingredient")
        elif v[0] == "liked_ingredient_removed":
            if item := match(v[1]):
                more.append((item, 100.0))
                actions.append("add_ingredient")
        else:
            _, words, _, a, b, how = next(f for f in editing.FIXES if f[0] == v[0])
            at = next((i for i, x in enumerate(lines) if any(w in x[0] for w in words)), None)
            factor = a + (b - a) * u(key, "fix", v[0]) if how else max(a, 1 - (v[1] - v[2]) / v[1] * b)
            if at is not None:
                amounts[at] = lines[at][1] * factor
                actions.append("reduce_quantity" if factor < 1 else "increase_quantity")
            elif v[0] == "fiber_g":
                more.append((match("broccoli"), 100.0))
                actions.append("add_ingredient")
    return [(x[0], amounts.get(i, x[1])) for i, x in enumerate(lines) if i not in gone] + more, actions


def made():
    names, rows = list(FOODS), []
    for key in range(240):
        lines = [(names[int(u(key, "item", i) * 10)], 5 + 300 * u(key, "amount", i), None) for i in range(1 + key % 6)]
        lines = [(n, g / 100 if n == "salt" else g, [float(x) for x in FOODS[n]]) for n, g, _ in lines]
        liked = [] if key % 5 == 0 else [names[key % 10], "fresh carrot"]
        disliked = [] if key % 4 == 0 else [names[(key + 3) % 10], "no such food", "smoked tofu"]
        rows.append((key, lines, liked, disliked))
    return rows


def test_edited_recipes(spark):
    rows = made()
    df = spark.createDataFrame([*rows, (1000, [], ["rice"], ["salt"]), (1001, None, None, None)], f"k long, lines {LINES}, liked array<string>, disliked array<string>")
    done = editing.violated(df, "k", "lines", "liked", "disliked", {}, FOODS)
    done = done.withColumn("fixes", editing.corrections(F.col("lines"), F.col("violations"), F.col("k"), FOODS))
    done = done.withColumn("mended", editing.corrected(F.col("lines"), F.col("fixes"), FOODS)).collect()
    wanted = {key: b for key, *rest in rows if (b := brute(key, *rest))}
    assert {r["k"] for r in done} == set(wanted)
    seen = Counter()
    for r in done:
        lines, violations = wanted[r["k"]]
        assert [(x["item"], pytest.approx(x["grams"])) for x in r["lines"]] == [(n, g) for n, g, _ in lines]
        got = [(v["field"], v["item"]) if v["type"] == "preference_violation" else (v["field"], pytest.approx(v["actual"]), pytest.approx(v["limit"]), v["severity"]) for v in r["violations"]]
        assert got == violations
        mended, actions = mend(r["k"], lines, violations)
        assert [c["action"] for c in r["fixes"]] == actions
        assert [(x["item"], pytest.approx(x["grams"])) for x in r["mended"]] == mended
        seen.update([v[0] for v in violations] + actions)
    assert len(seen) >= 10  # most kinds and actions come about


def test_limits_of_a_recipe_hold(spark):
    lines = [("salt", 2.0, FOODS["salt"]), ("rice", 300.0, FOODS["rice"])]
    df = spark.createDataFrame([(1, [(n, g, [float(x) for x in v]) for n, g, v in lines], 500.0), (1, [(n, g, [float(x) for x in v]) for n, g, v in lines], 1e9)], f"k long, lines {LINES}, most double")
    tries = editing.attempts(F.col("lines"), F.col("k"), editing.limits_of({"sodium_mg": F.col("most")}, 4), editing.food_map(FOODS), 4)
    got = [r["t"]["violated"] for r in df.select(F.get(tries, F.lit(0)).alias("t")).collect()]
    assert got == [True, False]


def test_personas(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "user string")
    rows = {r["user"]: r for r in personas.persona_targets(df, "user").collect()}
    assert set(rows) == {"a", "b"} and len(personas.TAGS) == 108
    for key, r in rows.items():
        macro, sodium, sugars, saturated = r["tag"].split("+")
        assert r["tag"] == personas.TAGS[int(u(key, "tag") * 108)]
        low, high = list(personas.ENERGY.values())[int(u(key, "bucket") * 3)]
        kcal = low + (high - low) * u(key, "energy")
        assert r["energy_kcal_target"] == round(kcal) and r["fiber_g_min"] == pytest.approx(14 * kcal / 1000, abs=0.051)
        drawn = [a + (b - a) * u(key, n) for n, (a, b) in zip(("carb", "protein", "fat"), personas.AMDR[macro], strict=True)]
        assert [r["amdr"][n]["target_pct"] for n in ("carb", "protein", "fat")] == [pytest.approx(100 * x / sum(drawn), abs=0.0051) for x in drawn]
        assert (r["sodium_mg_max"], r["sat_fat_pct_max"], tuple(r["sugars"])) == (personas.SODIUM[sodium], personas.SATURATED[saturated], personas.SUGARS[sugars])
    only = personas.persona_targets(df, "user", weights={personas.TAGS[5]: 2.0}, energy="low", sugar_type="free").collect()
    assert {r["tag"] for r in only} == {personas.TAGS[5]} and all(1600 <= r["energy_kcal_target"] <= 1800 and r["sugars"]["type"] == "free" for r in only)
    with pytest.raises(ValueError):
        personas.persona_targets(df, "user", weights={"no tag": 1.0})


def bleu(own, others):
    logs = 0.0
    for n in range(1, 5):
        grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))  # noqa: B023, E731
        mine, rest = grams(own), [grams(o) for o in others]
        hit = sum(min(c, max((r[g] for r in rest), default=0)) for g, c in mine.items())
        if n == 1 and not hit:
            return 0.0
        logs += math.log((hit or 0.1) / max(1, len(own) - n + 1)) / 4
    near = min((len(o) for o in others), key=lambda x: (abs(x - len(own)), x))
    return math.exp(logs) * (1 if len(own) > near else math.exp(1 - near / len(own)))


def test_self_bleu(spark):
    texts = ["a b c d e f", "a b c d e f", "A B c x y", "q", "", None, "a a a a b", "c d e f g h i j", "z q z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r["self_bleu"] for r in diversity.self_bleu(df, "id", "t").collect()}
    words = [(t or "").lower().split() for t in texts]
    assert got == {i: pytest.approx(bleu(w, words[:i] + words[i + 1 :])) for i, w in enumerate(words)}
    assert [tuple(r) for r in diversity.self_bleu(df.where("id = 0"), "id", "t").collect()] == [(0, 0.0)]
    assert diversity.self_bleu(df.where("id < 0"), "id", "t").count() == 0


def test_edits_are_made_once(spark):
    """A filter on violations would go down and compute the edits again; a generator is not passed."""
    from platewise.plans import generation

    plan = generation.edited_recipes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 12 and plan.count("Generate explode") == 1
