"""Daily targets of users by a drawn policy: macronutrient ranges, caps of sodium, sugars and saturated fat."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.editing import uniform

# fixed values: percentages of energy (carbohydrate, protein, fat) by preset; caps by name; ranges of energy
AMDR = {
    "balanced": ((45, 65), (10, 35), (20, 35)),
    "higher_protein": ((45, 55), (20, 30), (20, 30)),
    "lower_fat": ((50, 60), (15, 25), (20, 25)),
    "higher_carb_endurance": ((55, 65), (10, 20), (20, 30)),
    "med_style": ((45, 60), (15, 25), (25, 35)),
    "plant_forward": ((50, 60), (15, 25), (20, 30)),
}
SODIUM = {"dga_2300": 2300.0, "who_2000": 2000.0, "aha_1500": 1500.0}
SUGARS = {"added_10": ("added", 10.0), "free_10": ("free", 10.0), "free_5": ("free", 5.0)}
SATURATED = {"sfa_10": 10.0, "sfa_6": 6.0}
ENERGY = {"low": (1600, 1800), "mid": (1800, 2200), "high": (2200, 2600)}
FIBER_PER_1000_KCAL = 14.0

TAGS = ["+".join(t) for t in product(AMDR, SODIUM, SUGARS, SATURATED)]


def drawn(u: Column, weights: Mapping[str, float] | None, names: list[str]) -> Column:
    """One of names by its weight (alike without weights; a name without one is never drawn). u is in [0, 1)."""
    own = [1.0 if weights is None else float(weights.get(n, 0.0)) for n in names]
    if sum(own) <= 0:
        raise ValueError("the weights' sum is 0")
    ends = [(n, end / sum(own)) for n, w, end in zip(names, own, accumulate(own), strict=True) if w > 0]
    if len(ends) == 1:
        return F.lit(ends[0][0])
    at = F.size(F.filter(F.array(*[F.lit(e) for _, e in ends[:-1]]), lambda e: e <= u))
    return F.get(F.array(*[F.lit(n) for n, _ in ends]), at)


def persona_targets(users: DataFrame, user: str, weights: Mapping[str, float] | None = None, energy: str = "mix", sugar_type: str = "tag") -> DataFrame:
    """Per distinct user (nulls left out): tag, energy_kcal_target, amdr (struct of carb, protein, fat: target_pct, min_pct, max_pct), sodium_mg_max,
    sugars (type, pct_max), sat_fat_pct_max, fiber_g_min. Draws are hashes of the user, so targets come out the same in any run.

    weights: of TAGS. energy: low, mid, high, or mix for one of them. sugar_type: added or free for all, or tag for the policy's."""
    k = F.col(user)
    chosen = users.select(user).where(k.isNotNull()).distinct().withColumn("tag", drawn(uniform(k, "tag"), weights, TAGS))
    part = lambda i: F.get(F.split("tag", r"\+"), F.lit(i))
    preset = F.create_map(*[x for n, r in AMDR.items() for x in (F.lit(n), F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in r]))])
    bucket = drawn(uniform(k, "bucket"), {energy: 1.0} if energy != "mix" else None, list(ENERGY))
    span = F.create_map(*[x for n, (a, b) in ENERGY.items() for x in (F.lit(n), F.array(F.lit(float(a)), F.lit(float(b))))])
    between = lambda r, salt: r[0] + (r[1] - r[0]) * uniform(k, salt)
    named = lambda table: F.create_map(*[x for n, v in table.items() for x in (F.lit(n), F.lit(v))])
    out = chosen.withColumn("ranges", preset[part(0)]).withColumn("kcal", between(span[bucket], "energy"))
    names = ["carb", "protein", "fat"]
    out = out.withColumn("drawn", F.array(*[between(F.col("ranges")[i], n) for i, n in enumerate(names)]))
    total = F.aggregate("drawn", F.lit(0.0), lambda s, x: s + x)
    amdr = [F.struct(F.round(F.col("drawn")[i] * 100 / total, 2).alias("target_pct"), F.col("ranges")[i][0].alias("min_pct"), F.col("ranges")[i][1].alias("max_pct")).alias(n) for i, n in enumerate(names)]
    kind = named({n: t for n, (t, _) in SUGARS.items()})[part(2)] if sugar_type == "tag" else F.lit(sugar_type)
    sugars = F.struct(kind.alias("type"), named({n: p for n, (_, p) in SUGARS.items()})[part(2)].alias("pct_max"))
    return out.select(
        user, "tag", F.round("kcal").alias("energy_kcal_target"), F.struct(*amdr).alias("amdr"), named(SODIUM)[part(1)].alias("sodium_mg_max"),
        sugars.alias("sugars"), named(SATURATED)[part(3)].alias("sat_fat_pct_max"), F.round(F.lit(FIBER_PER_1000_KCAL) * F.col("kcal") / 1000, 1).alias("fiber_g_min"),
    )
