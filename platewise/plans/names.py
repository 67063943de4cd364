"""Queries over names, cells, quantities and lanes; the SQL they equal is written apart, with list functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions import names as N
from platewise.functions import quantity as Q
from platewise.plans.catalogue import query
from platewise.sources.tables import read

_LABEL = "'Fresh Large ' || p_name || 's (' || p_size || ' oz), chopped; to taste'"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _keep(text: str, drop, cut: str = r"\s+") -> str:
    return f"list_filter(regexp_split_to_array({text}, '{cut}'), lambda w: w <> '' AND NOT list_contains({_list(drop)}, w))"


_PLAIN = _keep(r"regexp_replace(lower(trim(t)), '[^\w\s-]', ' ', 'g')", [w for c in N.MODIFIERS.values() for w in c.split()])
_TERM = _keep(r"regexp_replace(lower(trim(t)), '\(.*?\)', ' ', 'g')", N.TERM_MODIFIERS, "[^a-z0-9]+")
_LINE = _keep(r"regexp_replace(regexp_replace(regexp_replace(lower(t), '\([^)]*\)', ' ', 'g'), '\b(to taste|divided|optional)\b', ' ', 'g'), '[^a-z0-9\s\-]', ' ', 'g')", N.STOP_ADJECTIVES)


@query("name_forms", rf"""WITH x AS (SELECT p_partkey, {_LABEL} AS t FROM part)
SELECT p_partkey, array_to_string({_PLAIN}, ' ') AS plain,
 array_to_string(list_transform({_TERM}, lambda w: CASE WHEN ends_with(w, 'ies') THEN w[:-4] || 'y' WHEN ends_with(w, 'oes') OR ends_with(w, 'ses') THEN w[:-3] WHEN ends_with(w, 's') THEN w[:-2] ELSE w END), ' ') AS term,
 array_to_string(list_transform({_LINE}, lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN w[:-2] ELSE w END), ' ') AS line,
 replace(replace(lower(trim(t)), 'fresh ', ''), 'chopped ', '') AS unprefixed,
 trim(regexp_replace(lower(regexp_replace(regexp_replace(t, '\d+', '', 'g'), '(?i)\b(cup|tbsp|tsp|oz|lb|g|kg|ml|l)\b', '', 'g')), '\s+', ' ', 'g')) AS bare FROM x""")
def name_forms(spark, sf_dir):
    t = F.concat(F.lit("Fresh Large "), "p_name", F.lit("s ("), F.col("p_size").cast("string"), F.lit(" oz), chopped; to taste"))
    forms = {"plain": N.plain_name, "term": N.term_name, "line": N.line_name, "unprefixed": N.without_prefixes, "bare": N.bare_name}
    return read(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select("p_partkey", *[f(F.col("t")).alias(n) for n, f in forms.items()])


@query("cell_lists", """SELECT p_partkey, p_name || '|' || p_type || ' (a, b)|' || p_brand AS parts, CASE p_size % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'broadcast_qty' ELSE 'truncate' END AS policy,
 CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 2 END AS n FROM part""")
def cell_lists(spark, sf_dir):
    cell = F.concat("p_name", F.lit(", "), "p_type", F.lit(" (a, b); "), "p_brand")
    amounts = F.when(F.col("p_size") % 3 == 0, 'c("1", NA, "3")').when(F.col("p_size") % 3 == 1, "[1]").otherwise("['1', '2']")
    cells = read(spark, sf_dir, "part").select("p_partkey", N.listed(cell).alias("p"), N.listed(amounts).alias("a"))
    both = cells.select("p_partkey", "p", N.aligned(F.col("p"), F.col("a")).alias("x"))
    return both.select("p_partkey", F.array_join("p", "|").alias("parts"), "x.policy", F.size("x.parts").alias("n"))


_SYNONYMS = {"cold anvil": "iron block", "blue": "azure", "hammer": "mallet"}


@query("synonym_names", "SELECT DISTINCT p_name, CASE WHEN p_name = 'cold anvil' THEN 'iron block' ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'blue' THEN 'azure' WHEN 'hammer' THEN 'mallet' ELSE w END), ' ') END AS named FROM part")
def synonym_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_name").distinct().select("p_name", N.with_synonyms(F.col("p_name"), _SYNONYMS).alias("named"))


@query("singular_names", """SELECT DISTINCT w, CASE WHEN w = 'leaves' THEN 'leaf' WHEN regexp_matches(w, '[^a-z-]') THEN NULL WHEN ends_with(w, 'ies') AND length(w) > 3 THEN w[:-4] || 'y' WHEN ends_with(w, 'es') AND length(w) > 2 THEN w[:-3]
 WHEN ends_with(w, 's') AND length(w) > 1 THEN w[:-2] ELSE w END AS one FROM (SELECT unnest(list_concat(string_split(p_name, ' '), [p_type || 'ies', p_type || 'oes', p_type || 's', 'leaves', lower(p_brand)])) AS w FROM part) x WHERE w = lower(w)""")
def singular_names(spark, sf_dir):
    words = F.concat(F.split("p_name", " "), F.array(*[F.concat("p_type", F.lit(s)) for s in ("ies", "oes", "s")], F.lit("leaves"), F.lower("p_brand")))
    every = read(spark, sf_dir, "part").select(F.explode(words).alias("w")).where("w = lower(w)").distinct()
    return every.select("w", N.singular(F.col("w")).alias("one"))


@query("fraction_labels", """WITH x AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS v FROM part) SELECT p_partkey, CASE WHEN v - floor(v) = 0 THEN floor(v)::INT::VARCHAR ELSE
 trim(CASE WHEN v >= 1 THEN floor(v)::INT::VARCHAR ELSE '' END || ' ' || CASE v - floor(v) WHEN 0.25 THEN '1/4' WHEN 0.5 THEN '1/2' ELSE '3/4' END) END || CASE WHEN v > 1 THEN ' cups' ELSE ' cup' END AS shown FROM x""")
def fraction_labels(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", N.fraction_text(F.col("p_size") / 4.0, "cup").alias("shown"))


@query("line_quantities", """SELECT p_partkey, (p_size + p_size + 2) / 2.0::DOUBLE AS amount, 'tbsp' AS unit, round(p_size * CASE WHEN contains(p_name, 'salt') THEN 18.0 ELSE 15.0 END::DOUBLE, 4) AS grams, p_name AS name,
 round(p_size * 28.349523125::DOUBLE, 6) AS mass, 'range,optional' AS flags, p_name AS cleaned FROM part""")
def line_quantities(spark, sf_dir):
    size = F.col("p_size").cast("string")
    spread = F.concat(size, F.lit("-"), (F.col("p_size") + 2).cast("string"), F.lit(" tbsp "), "p_name")
    part = read(spark, sf_dir, "part")
    lines = part.select("p_partkey", "p_name", Q.leading(spread).alias("l"), Q.line(F.concat(size, F.lit(" large Tbsps "), "p_name")).alias("g"), Q.mass_grams(F.concat(size, F.lit(" oz"))).alias("m"),
                        Q.audited(F.concat(spread, F.lit(", optional")), F.lit("1-2")).alias("a"))
    return lines.select("p_partkey", "l.amount", "l.unit", F.round("g.grams", 4).alias("grams"), "g.name", F.round("m", 6).alias("mass"), F.array_join("a.flags", ",").alias("flags"), Q.without_remarks(F.concat("p_name", F.lit(" to taste"))).alias("cleaned"))


@query("gram_lanes", """WITH d AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE END AS fdc, CASE WHEN p_size % 3 = 0 THEN 0.8::DOUBLE END AS cat, p_size FROM part),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, ['kg', 'cup', 'tsp', 'piece', 'pinch'][(l_linenumber % 5) + 1] AS u, fdc, cat, p_size FROM lineitem JOIN d ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(q * CASE u WHEN 'kg' THEN 1000 WHEN 'cup' THEN 236.588 * coalesce(fdc, cat, 1) WHEN 'tsp' THEN 4.92892 * coalesce(fdc, cat, 1) WHEN 'piece' THEN 50 END, 4) AS grams,
 CASE u WHEN 'kg' THEN 'weight' WHEN 'piece' THEN 'piece' WHEN 'pinch' THEN 'fallback' ELSE 'volume' END AS lane,
 round(least(1.0, CASE u WHEN 'kg' THEN 0.9 WHEN 'piece' THEN 0.65 WHEN 'pinch' THEN 0.0 ELSE CASE WHEN fdc IS NOT NULL THEN 0.95 WHEN cat IS NOT NULL THEN 0.8 ELSE 0.7 END END + 0.02 * least(5.0, ln(1 + p_size))), 6) AS confidence FROM x""")
def gram_lanes(spark, sf_dir):
    dense = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 2 == 0, 0.5).alias("fdc"), F.when(F.col("p_size") % 3 == 0, 0.8).alias("cat"))
    unit = F.get(F.array(*map(F.lit, ("kg", "cup", "tsp", "piece", "pinch"))), F.col("l_linenumber") % 5)
    lines = read(spark, sf_dir, "lineitem").join(dense, F.col("l_partkey") == F.col("p_partkey"))
    g = lines.withColumn("g", Q.layered_grams(F.col("l_quantity"), unit, [(F.col("fdc"), "fdc_density"), (F.col("cat"), "cat_density")], []))
    g = g.withColumn("lane_", Q.lane(F.col("g.path"), F.col("p_size")))
    return g.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("g.grams", 4).alias("grams"), F.col("lane_.lane").alias("lane"), F.round("lane_.confidence", 6).alias("confidence"))


@query("nutrient_units", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'kcal' ELSE 'mg' END AS unit, round(CASE p_size % 3 WHEN 0 THEN p_retailprice * 0.239005736 WHEN 1 THEN p_retailprice * 1000 ELSE p_retailprice / 1000 END, 6) AS value FROM part")
def nutrient_units(spark, sf_dir):
    kind = F.col("p_size") % 3
    name, unit = F.when(kind == 0, "Energy").otherwise("Sodium"), F.when(kind == 0, "kJ").when(kind == 1, "g").otherwise("µg")
    out = read(spark, sf_dir, "part").select("p_partkey", Q.nutrient_unit(name, unit, F.col("p_retailprice")).alias("x"))
    return out.select("p_partkey", "x.unit", F.round("x.value", 6).alias("value"))


@query("prompt_records", """SELECT p_partkey, 'Cook with ' || p_name || ' for ' || p_size || ' people.' AS prompt, '1. ' || p_name || chr(10) || '2. ' || p_type AS target, 3 AS turns, '{"k": ' || p_size || '}' AS body, p_size = 1 AS missing FROM part""")
def prompt_records(spark, sf_dir):
    prompt = N.filled("Cook with {name} for {n} people.", name=F.col("p_name"), n=F.col("p_size"))
    target = N.numbered(F.array("p_name", "p_type"))
    body = N.json_body(F.concat(F.lit("Sure: {\"k\": "), F.col("p_size").cast("string"), F.lit("} is it")))
    chat = N.messages("You write recipes.", prompt, target)
    out = read(spark, sf_dir, "part").select("p_partkey", chat.alias("c"), body.alias("body"), N.is_missing(F.when(F.col("p_size") == 1, " ").otherwise("x")).alias("missing"))
    return out.select("p_partkey", F.col("c")[1]["content"].alias("prompt"), F.col("c")[2]["content"].alias("target"), F.size("c").alias("turns"), "body", "missing")
