"""Quantities, pack sizes, units and grams as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
WORDS = {"half": 0.5, "quarter": 0.25, "dozen": 12.0, "a": 1.0, "an": 1.0, "one": 1.0, "two": 2.0, "three": 3.0}
UNICODE = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8"}
WEIGHT = {"g": 1.0, "gram": 1.0, "kg": 1000.0, "kilogram": 1000.0, "oz": 28.35, "ounce": 28.35, "lb": 453.592, "pound": 453.592, "ml": 1.0, "milliliter": 1.0, "l": 1000.0, "liter": 1000.0}
BULK = {"pint": 473.0, "pt": 473.0, "quart": 946.0, "qt": 946.0, "gallon": 3785.0, "gal": 3785.0}
ALIASES = {"c": "cup", "tbsp": "tablespoon", "tbs": "tablespoon", "tb": "tablespoon", "tsp": "teaspoon", "ts": "teaspoon"}
#: Grams of a volume unit by category of ingredient; the first category whose words are in the name counts.
VOLUME = {
    "cup": {"flour": 125.0, "sugar": 200.0, "brown sugar": 220.0, "butter": 227.0, "oil": 218.0, "rice": 185.0, "cheese": 113.0, "nuts": 125.0, "liquid": 236.0, "default": 236.0},
    "tablespoon": {"butter": 14.0, "oil": 13.0, "sugar": 12.0, "flour": 8.0, "salt": 18.0, "liquid": 15.0, "default": 15.0},
    "teaspoon": {"salt": 6.0, "sugar": 4.0, "oil": 4.5, "liquid": 5.0, "default": 5.0},
}
CATEGORIES = {
    "flour": ["flour"], "sugar": ["sugar"], "butter": ["butter"], "oil": ["oil"], "liquid": ["water", "milk", "cream", "broth", "stock", "juice", "wine", "sauce"],
    "nuts": ["nuts", "almonds", "walnuts", "pecans", "cashews"], "cheese": ["cheese", "cheddar", "mozzarella", "parmesan"], "rice": ["rice"], "salt": ["salt"],
}
ITEM, UNKNOWN = 100.0, 100.0
#: Grams of one piece, and of spoons and cups, in an ingredient line.
PIECES = {"egg": 50.0, "onion": 150.0, "carrot": 61.0, "tomato": 123.0, "potato": 150.0, "lemon": 58.0, "lime": 44.0}
LINE = {
    "tbsp": {"salt": 18.0, "pepper": 6.9, "oil": 13.5, "default": 15.0},
    "tsp": {"salt": 6.0, "pepper": 2.3, "oil": 4.5, "default": 5.0},
    "cup": {"rice": 185.0, "flour": 125.0, "oats": 80.0, "default": 240.0},
}
SIZES = ["extra-large", "large", "medium", "small", "jumbo"]
MASS = {"g": 1.0, "oz": 28.349523125, "kg": 1000.0, "mg": 0.001, "lb": 453.59237}
INFERRED = [("tbsp", "oil milk cream vinegar sauce"), ("cup", "flour sugar powder starch cornmeal"), ("clove", "garlic"), ("piece", "onion tomato apple banana potato egg")]
LANES = {
    "volume": {"fdc_density": 0.95, "token_density": 0.85, "cat_density": 0.80, "global_volume": 0.70},
    "piece": {"fdc_piece": 0.93, "token_piece": 0.85, "cat_piece": 0.80, "global_piece": 0.65, "a_table_piece": 0.92},
    "weight": {"global_other": 0.90},
    "fallback": {"impute_packsize": 0.80, "infer_unit": 0.60, "alias_fix": 0.55, "global_default": 0.50, "no_match": 0.0},
}
ML_PER = {"tsp": 4.92892, "tbsp": 14.7868, "cup": 236.588}
KJ, OTHER_LANE = 0.239005736, 0.5


def number(text: Column) -> Column:
    """1 1/2, 3/4, 2.5, or null; a zero denominator gives null."""
    mixed, fraction = r"^(\d+)\s+(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
    part = lambda p, i: F.regexp_extract(text, p, i).try_cast("double")
    return (
        F.when(text.rlike(mixed), part(mixed, 1) + F.try_divide(part(mixed, 2), part(mixed, 3)))
        .when(text.rlike(fraction), F.try_divide(part(fraction, 1), part(fraction, 2)))
        .when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    )


def parsed(text: Column, upper: bool = True) -> Column:
    """The number a quantity stands for; of a range the upper end, or the middle."""
    t = F.trim(F.lower(text))
    for char, plain in UNICODE.items():
        t = F.replace(t, F.lit(char), F.lit(" " + plain))
    t = F.trim(t)
    ends = [number(F.trim(F.regexp_extract(t, r"^(.+?)\s*(?:-|–|to)\s*(.+)$", i))) for i in (1, 2)]
    word = F.lit(None).cast("double")
    for w, v in WORDS.items():
        word = F.when(t == w, F.lit(v)).otherwise(word)
    return F.coalesce(number(t), ends[1] if upper else (ends[0] + ends[1]) / 2, word)


def pack(text: Column) -> Column:
    """(amount, unit) of `2 (14 ounce) cans`, `2 x 400 g`, `14-ounce can`: count times size."""
    out = F.lit(None).cast("struct<amount:double,unit:string>")
    for pattern in (r"(?i)^(\d+)-?()(ounce|oz|g|gram)\b", r"(?i)^(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*(g|kg|oz|ounce)\b", r"(?i)^(\d+)\s*\((\d+(?:\.\d+)?)[ -]*(ounce|oz|g|gram)s?\)"):
        count, size = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2).try_cast("double")
        own = F.struct((count * F.coalesce(size, F.lit(1.0))).alias("amount"), F.lower(F.regexp_extract(text, pattern, 3)).alias("unit"))
        out = F.when(text.rlike(pattern), own).otherwise(out)
    return out


def first_of(pairs: list[tuple[Column, Column]], other: Column) -> Column:
    """The value of the first test that holds."""
    out = other
    for test, value in reversed(pairs):
        out = F.when(test, value).otherwise(out)
    return out


def has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def category(name: Column) -> Column:
    """The kind of ingredient that decides what a cup or a spoon of it weighs."""
    n = F.lower(name)
    return first_of([(has_any(n, words), F.lit(kind)) for kind, words in CATEGORIES.items()], F.lit("default"))


def grams(amount: Column, unit: Column, name: Column) -> Column:
    """Grams of an amount; a plural unit is read as its singular; an item and an unknown unit count 100 grams."""
    u = F.regexp_replace(F.lower(F.trim(unit)), "s+$", "")
    kind, per = category(name), []
    for volume, sizes in VOLUME.items():
        names = [volume, *(a for a, b in ALIASES.items() if b == volume)]
        own = first_of([(kind == k, F.lit(g)) for k, g in sizes.items() if k != "default"], F.lit(sizes["default"]))
        per.append((u.isin(names), own))
    per += [(u == w, F.lit(g)) for w, g in (WEIGHT | BULK).items()]
    return amount * first_of(per, F.lit(UNKNOWN))


def leading(text: Column) -> Column:
    """Struct (amount, unit) at the start of a line; a range counts its middle; nulls where there is none."""
    t = F.trim(F.lower(text))
    for char, plain in UNICODE.items():
        t = F.replace(t, F.lit(char), F.lit(" " + plain))
    t, n = F.trim(t), r"(\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"
    spread, plain = rf"^{n}\s*(?:to|–|-)\s*{n}\s*([a-z]+)?", rf"^{n}\s*([a-z]+)?"
    part = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    middle = (number(part(spread, 1)) + number(part(spread, 2))) / 2
    pair = lambda a, u: F.struct(a.alias("amount"), u.alias("unit"))
    return F.when(t.rlike(spread), pair(middle, part(spread, 3))).otherwise(pair(number(part(plain, 1)), part(plain, 2)))


def line(text: Column) -> Column:
    """Struct (grams, name) of an ingredient line; plurals of units and size words are understood, a bare number counts pieces."""
    t = F.trim(F.coalesce(text, F.lit("")))
    pattern = r"^(\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)\s*(.*)$"
    amount, rest = number(F.regexp_extract(t, pattern, 1)), F.trim(F.regexp_extract(t, pattern, 2))
    rest = F.regexp_replace(rest, r"(?i)^(" + "|".join(SIZES) + r")\s+", "")
    first = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([A-Za-z]+)\s+\S", 1)), "s+$", "")
    first = F.when(first == "tablespoon", "tbsp").when(first == "teaspoon", "tsp").otherwise(first)
    after, low = F.regexp_extract(rest, r"^[A-Za-z]+\s+(.+)$", 1), F.lower(rest)
    units = [(first == "g", F.struct(amount.alias("grams"), after.alias("name")))]
    for unit, sizes in LINE.items():
        own = first_of([(low.contains(k), F.lit(g)) for k, g in sizes.items() if k != "default"], F.lit(sizes["default"]))
        units.append((first == unit, F.struct((amount * own).alias("grams"), after.alias("name"))))
    units += [(first == u, F.struct((amount * g).alias("grams"), after.alias("name"))) for u, g in (WEIGHT | BULK).items() if u != "g"]
    piece = first_of([(low.rlike(rf"^{p}(s|es)?\b"), F.lit(g)) for p, g in PIECES.items()], F.lit(1.0))
    return F.when(amount.isNotNull() & (rest != ""), first_of(units, F.struct((amount * piece).alias("grams"), rest.alias("name"))))


def recipe_line(text: Column) -> Column:
    """Struct (amount, unit, name) of a recipe line: two words count items, one word is one item."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = r"(\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"
    full, two = rf"^{n}\s*([A-Za-z]+)\s+(.+)$", rf"^{n}\s+(\S+)$"
    made = lambda a, u, w: F.struct(a.alias("amount"), u.alias("unit"), w.alias("name"))
    return (
        F.when(t.rlike(two), made(number(F.regexp_extract(t, two, 1)), F.lit("item"), F.regexp_extract(t, two, 2)))
        .when(t.rlike(full), made(number(F.regexp_extract(t, full, 1)), F.lower(F.regexp_extract(t, full, 2)), F.regexp_extract(t, full, 3)))
        .otherwise(made(F.lit(1.0), F.lit("item"), t))
    )


def mass_grams(text: Column) -> Column:
    """Grams of `2 oz`, `250 g`; null for what is no mass."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(oz|g|kg|mg|lb)\s*$"
    t = F.lower(text)
    per = first_of([(F.regexp_extract(t, pattern, 2) == u, F.lit(g)) for u, g in MASS.items()], F.lit(None).cast("double"))
    return F.regexp_extract(t, pattern, 1).try_cast("double") * per


def inferred_unit(name: Column) -> Column:
    """The unit that a name suggests where a line has none."""
    n = F.lower(name)
    return first_of([(has_any(n, words.split()), F.lit(unit)) for unit, words in INFERRED], F.lit(None).cast("string"))


def lane(path: Column, samples: Column) -> Column:
    """Struct (lane, confidence) of the way by which grams were found; more samples raise the confidence up to 0.1."""
    lanes = [(path.isin(list(paths)), F.lit(name)) for name, paths in LANES.items()]
    base = first_of([(path == p, F.lit(c)) for paths in LANES.values() for p, c in paths.items()], F.lit(OTHER_LANE))
    bonus = 0.02 * F.least(F.lit(5.0), F.log1p(samples.cast("double")))
    raised = F.when(F.coalesce(samples, F.lit(0)) > 0, F.least(F.lit(1.0), base + bonus)).otherwise(base)
    return F.struct(first_of(lanes, F.lit("fallback")).alias("lane"), raised.alias("confidence"))


def layered_grams(amount: Column, unit: Column, densities: list[tuple[Column, str]], pieces: list[tuple[Column, str]]) -> Column:
    """Struct (grams, path): weights by table, volumes by the first density (g/ml) that is there, pieces by the first weight.

    densities and pieces are columns from the most to the least specific, with the name of their path; without any a
    volume has density 1 (global_volume) and a piece 50 g (global_piece)."""
    u = F.lower(unit)
    pick = lambda layers, value, path: (F.coalesce(*[c for c, _ in layers], F.lit(value)), F.coalesce(*[F.when(c.isNotNull(), F.lit(p)) for c, p in layers], F.lit(path)))
    density, dense = pick(densities, 1.0, "global_volume")
    piece, by = pick(pieces, 50.0, "global_piece")
    made = lambda g, p: F.struct((amount * g).alias("grams"), p.alias("path"))
    ways = [(u == w, made(F.lit(g), F.lit("global_other"))) for w, g in WEIGHT.items()]
    ways += [(u == v, made(density * ml, dense)) for v, ml in ML_PER.items()]
    return first_of([*ways, (u == "piece", made(piece, by))], F.struct(F.lit(None).cast("double").alias("grams"), F.lit("no_match").alias("path")))


def nutrient_unit(name: Column, unit: Column, value: Column) -> Column:
    """Struct (unit, value) with energy in kcal and masses of other nutrients in mg."""
    u = F.lower(unit)
    made = lambda to, v: F.struct(F.lit(to).alias("unit"), v.alias("value"))
    return (
        F.when((u == "kj") & F.lower(name).contains("energy"), made("kcal", value * KJ)).when(u == "g", made("mg", value * 1000.0))
        .when(u.isin("µg", "ug", "mcg"), made("mg", value / 1000.0)).otherwise(F.struct(u.alias("unit"), value.alias("value")))
    )


def audited(part: Column, amount: Column) -> Column:
    """Struct (amount, unit, flags): the amount cell first, else the number at the start of the part; flags say what was done."""
    given, led = parsed(amount), leading(part)
    low = F.lower(F.coalesce(part, F.lit("")))
    flags = [(given.isNull() & led["amount"].isNotNull(), "qty_from_text"), (given.isNull() & led["amount"].isNull(), "no_qty"), (led["unit"].isNull(), "no_unit"),
             (F.coalesce(amount, F.lit("")).rlike(r"\d\s*(-|–|to)\s*\d"), "range"), (low.contains("to taste"), "to_taste"), (low.contains("optional"), "optional")]
    return F.struct(F.coalesce(given, led["amount"]).alias("amount"), led["unit"].alias("unit"), F.array_compact(F.array(*[F.when(t, F.lit(f)) for t, f in flags])).alias("flags"))


def without_remarks(text: Column) -> Column:
    """Without `to taste`, `optional` and `divided`."""
    return F.trim(F.regexp_replace(text, "to taste|optional|divided", ""))


def household(g: Column) -> Column:
    """Grams as cups (quarters), tablespoons (halves) or grams (to 5 or 10)."""
    return (
        F.when(g >= 60, F.concat((F.bround(g / 240 * 4) / 4).cast("string"), F.lit(" cup")))
        .when(g >= 15, F.concat((F.bround(g / 15 * 2) / 2).cast("string"), F.lit(" tbsp")))
        .otherwise(F.concat((F.bround(g / 5) * 5).cast("string"), F.lit(" g")))
    )
