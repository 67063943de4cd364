"""Ingredient names as columns: normal forms for matching, lists in cells, plurals, fractions, templates.

Null text counts as empty unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
MODIFIERS = {
    "color": "red green yellow white black orange purple brown pink golden",
    "preparation": "fresh frozen dried canned cooked raw roasted grilled baked fried steamed boiled smoked pickled marinated",
    "cuts": "boneless skinless bone-in skin-on fillet filet breast breasts thigh thighs leg legs wing wings chunk chunks piece pieces slice slices strip strips cube cubes",
    "texture": "whole half halved quartered chopped diced minced sliced shredded grated ground crushed mashed pureed peeled unpeeled",
    "quality": "extra premium organic free-range grass-fed wild-caught farm-raised imported domestic virgin",
    "size": "large medium small jumbo baby mini giant extra-large extra-small",
    "descriptive": "plain simple basic regular standard classic traditional authentic homemade store-bought",
    "style": "italian chinese mexican french japanese thai indian greek spanish korean american",
}
MATCH_MODIFIERS = "fresh dried frozen canned raw cooked chopped minced sliced diced ground whole organic unsalted salted plain boneless skinless".split()
TERM_MODIFIERS = "fresh organic large small medium ripe peeled seeded freshly ground minced chopped sliced diced grated optional divided to taste room temperature unsalted salted".split()
STOP_ADJECTIVES = "fresh organic large small medium extra-virgin extra virgin boneless skinless ripe raw cooked finely coarsely".split()
KEY_MODIFIERS = "fresh frozen dried canned raw cooked chopped diced sliced minced crushed large medium small baby italian-style greek-style mexican-style".split()
PREFIX_WORDS = "fresh dried frozen chopped minced sliced".split()
UNIT_WORDS = "cup tbsp tsp oz lb g kg ml l".split()
IRREGULAR = {"tomatoes": "tomato", "potatoes": "potato", "cherries": "cherry", "leaves": "leaf", "knives": "knife", "loaves": "loaf", "children": "child"}
FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8"}
NEAREST = {0.25: "1/4", 0.33: "1/3", 0.5: "1/2", 0.67: "2/3", 0.75: "3/4"}


def _plain(text: Column) -> Column:
    return F.trim(F.lower(F.coalesce(text, F.lit(""))))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _without(words: Column, drop: list[str]) -> Column:
    """Words that are not in drop: a constant set, looked up in compiled code."""
    return F.filter(words, lambda w: ~w.isin(drop))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def plain_name(text: Column, classes: tuple[str, ...] = tuple(MODIFIERS)) -> Column:
    """Lower case, punctuation (but hyphens) as spaces, without the modifiers of these classes."""
    drop = [w for c in classes for w in MODIFIERS[c].split()]
    return _joined(_without(_words(F.regexp_replace(_plain(text), r"[^\w\s-]", " ")), drop))


def match_name(text: Column) -> Column:
    """For matching: without parentheses, punctuation and modifiers; words longer than four letters in the singular."""
    t = F.regexp_replace(F.regexp_replace(_plain(text), r"\([^)]*\)", ""), "[,;:.]", " ")
    t = F.regexp_replace(t, r"\b(" + "|".join(MATCH_MODIFIERS) + r")\b\s*", "")

    def singular(w: Column) -> Column:
        return (
            F.when(F.length(w) <= 4, w).when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
            .when(w.endswith("es") & ~w.endswith("oes"), F.regexp_replace(w, "es$", ""))
            .when(w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)
        )

    return _joined(F.transform(_words(t), singular))


def term_name(text: Column) -> Column:
    """A term: letters and digits only, without modifiers, words in the singular (ies, oes, ses, s)."""
    words = F.filter(F.split(F.regexp_replace(_plain(text), r"\(.*?\)", " "), "[^a-z0-9]+"), lambda w: w != "")

    def singular(w: Column) -> Column:
        out = F.regexp_replace(w, "s$", "")
        for end, put in (("ses", "s"), ("oes", "o"), ("ies", "y")):
            out = F.when(w.endswith(end), F.regexp_replace(w, f"{end}$", put)).otherwise(out)
        return out

    return _joined(F.transform(_without(words, TERM_MODIFIERS), singular))


def line_name(text: Column) -> Column:
    """The name in a recipe line: no pack sizes, parentheses, remarks or adjectives; an s at the end of longer words goes."""
    units = r"(?:oz|ounces?|g|grams?|ml|milliliters?|l|liters?)"
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (rf"\b\d+\s*\([\d\.]+\s*{units}\)\s*(?:cans?|packages?|pkgs?|tins?|bottles?|bags?)\b", r"\b\d+\s*(?:x|\*)\s*[\d\.]+\s*(?:oz|g|ml|l)\b", r"\([^)]*\)", r"\b(to taste|divided|optional)\b", r"[^a-z0-9\s\-]"):
        t = F.regexp_replace(t, pattern, " ")
    words = _without(_words(t), STOP_ADJECTIVES)
    return _joined(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w)))


def dedup_key(text: Column) -> Column:
    """What names are compared by when a list must not hold one ingredient twice."""
    t = _plain(text)
    for w in KEY_MODIFIERS:
        t = F.replace(F.replace(t, F.lit(w + " "), F.lit("")), F.lit(" " + w), F.lit(""))
    t = (
        F.when(t.endswith("ies"), F.regexp_replace(t, "ies$", "y")).when(t.endswith("es") & ~t.endswith("ses"), F.regexp_replace(t, "es$", ""))
        .when(t.endswith("s") & (F.length(t) > 3), F.regexp_replace(t, "s$", "")).otherwise(t)
    )
    return F.trim(t)


def same_ingredient(name: Column, others: Column) -> Column:
    """Whether the key of name equals, holds or is held by that of one of the others (an array of names)."""
    own = dedup_key(name)
    return F.exists(F.transform(others, dedup_key), lambda o: (o == own) | o.contains(own) | own.contains(o))


def without_prefixes(text: Column) -> Column:
    """Every occurrence of the prefix words removed."""
    t = _plain(text)
    for w in PREFIX_WORDS:
        t = F.replace(t, F.lit(w + " "), F.lit(""))
    return t


def bare_name(text: Column) -> Column:
    """Without digits and unit words, as metrics compare names."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\d+", "")
    return F.lower(_joined(_words(F.regexp_replace(t, r"(?i)\b(" + "|".join(UNIT_WORDS) + r")\b", ""))))


def singular(word: Column) -> Column:
    """The singular, by a table and suffixes; null if the word has other characters than letters and hyphens."""
    w = F.lower(word)
    out = (
        F.when(~w.rlike(r"^[a-z\-]+$"), None).when(w.endswith("ies") & (F.length(w) > 3), F.regexp_replace(w, "ies$", "y"))
        .when(w.endswith("oes") & (F.length(w) > 3), F.regexp_replace(w, "es$", "")).when(w.endswith("es") & (F.length(w) > 2), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s") & (F.length(w) > 1), F.regexp_replace(w, "s$", "")).otherwise(w)
    )
    for many, one in IRREGULAR.items():
        out = F.when(w == many, F.lit(one)).otherwise(out)
    return out


def with_synonyms(text: Column, synonyms: Mapping[str, str]) -> Column:
    """The whole text's synonym, or each word's; what has none stays. The table is a constant map."""
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.coalesce(F.try_element_at(table, text), _joined(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w))))


def synonym_forms(text: Column, synonyms: Mapping[str, str]) -> Column:
    """The text and, for each synonym in it, the text with that one replaced; distinct, in order."""
    forms = [F.when(text.contains(a), F.replace(text, F.lit(a), F.lit(b))) for a, b in synonyms.items()]
    return F.array_distinct(F.array_compact(F.array(text, *forms)))


def split_outside(text: Column) -> Column:
    """Parts between commas and semicolons that are not in parentheses (of one level)."""
    return F.filter(F.transform(F.split(text, r"[,;](?![^()]*\))"), lambda p: F.trim(p)), lambda p: p != "")


def listed(text: Column) -> Column:
    """The items of a cell: an R vector, a JSON or Python list, or parts outside parentheses; null or blank is empty."""
    t = F.trim(text)
    r = F.transform(F.regexp_extract_all(t, F.lit(r'("[^"]*"|\bNA\b)'), F.lit(1)), lambda x: F.when(x != "NA", F.regexp_replace(x, '^"|"$', "")))
    literal = F.coalesce(F.from_json(t, "array<string>"), F.from_json(F.translate(F.regexp_replace(t, r"^\((.*)\)$", "[$1]"), "'", '"'), "array<string>"))
    none = F.array().cast("array<string>")
    return F.when(t.isNull() | (t == ""), none).when(t.rlike(r"^c\("), r).when(t.rlike(r"^\[.*\]$|^\(.*\)$"), F.coalesce(literal, split_outside(t))).otherwise(split_outside(t))


def aligned(parts: Column, amounts: Column) -> Column:
    """Struct of parts and amounts of one length, and the policy: ok, broadcast_parts, broadcast_qty, truncate or empty."""
    p, q = F.size(parts), F.size(amounts)
    none, least = F.array().cast("array<string>"), F.least(p, q)
    shape = lambda a, b, how: F.struct(a.alias("parts"), b.alias("amounts"), F.lit(how).alias("policy"))
    repeat = lambda xs, n: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda _: F.get(xs, F.lit(0)))
    return (
        F.when(F.coalesce(least, F.lit(0)) <= 0, shape(none, none, "empty")).when(p == q, shape(parts, amounts, "ok"))
        .when(p == 1, shape(repeat(parts, q), amounts, "broadcast_parts")).when(q == 1, shape(parts, repeat(amounts, p), "broadcast_qty"))
        .otherwise(shape(F.slice(parts, 1, least), F.slice(amounts, 1, least), "truncate"))
    )


def plain_fractions(text: Column) -> Column:
    """Unicode fractions as 1/2 and so on, apart from a digit before them."""
    for sign, plain in FRACTIONS.items():
        text = F.replace(text, F.lit(sign), F.lit(" " + plain))
    return F.trim(text)


def fraction_text(value: Column, unit: str) -> Column:
    """1.5 cup as `1 1/2 cups`: the nearest of 1/4, 1/3, 1/2, 2/3, 3/4 within 0.1, else one decimal."""
    whole = F.floor(value)
    rest = value - whole
    nearest, far = F.lit(None).cast("string"), F.lit(9.0)
    for f, shown in NEAREST.items():
        near = F.abs(rest - f)
        nearest, far = F.when(near < far, F.lit(shown)).otherwise(nearest), F.least(near, far)
    lead = F.when(whole > 0, whole.cast("string")).otherwise("")
    number = F.when(rest <= 0.1, lead).when(far < 0.1, F.trim(F.concat_ws(" ", lead, nearest))).otherwise(F.format_string("%.1f", value))
    plural = F.when(value > 1, F.lit(unit + "s")).otherwise(unit) if unit in ("cup", "tsp", "Tbsp") else F.lit(unit)
    return F.when(value == 0, F.lit(f"0 {unit}")).otherwise(F.concat_ws(" ", number, plural))


def numbers_before(text: Column, unit: str) -> Column:
    """All whole numbers that stand before a unit word."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(\d+)\s*{re.escape(unit)}"), F.lit(1)), lambda n: n.try_cast("long"))


def json_body(text: Column) -> Column:
    """From the first brace to the last, as generated text may have words about its JSON; null without one."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.nullif(body, F.lit(""))


def numbered(items: Column) -> Column:
    """An array as lines `1. first`, `2. second`."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def filled(template: str, **values: Column) -> Column:
    """A template with {name} replaced by columns; a null value reads as nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts)])


def messages(system: str, user: Column, assistant: Column) -> Column:
    """A chat record: array of struct (role, content)."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", F.lit(system)), say("user", user), say("assistant", assistant))


def is_missing(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")
