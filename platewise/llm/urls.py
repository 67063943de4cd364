"""URL filter: a path-template tree for each host, with rules as labels.

A url's host is what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; its path goes on up to
"?", "#" or the end; without "://", or null, both are empty. Of the rules that fit, the longest decides; the
others learn from those urls. Each host's paths form a tree of at most DEPTH segments; segments with digits, and the
children of a node that has more than FAN of them, become a wildcard; sibling branches whose rate of blocked urls does
not differ from their pool's (z of 1.96) are merged into it. A template's purity is its rate of blocked urls, smoothed
towards the same template on all hosts, and that towards the rate of all labelled urls; LIMIT or more is rejected.

All steps aggregate by (host, template) with partial sums; of the children of one node, FAN at most meet in one place. Repeated rows are judged alike.
An empty table gives no rows; without labelled urls every verdict is allow. Ids may be null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import ascii_lower, saved

DEPTH, FAN, WEIGHT, LIMIT = 4, 64, 8.0, 0.5
#: (verdict, rule): host, then path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def templated(pages: DataFrame) -> DataFrame:
    """pages (host, path, blocked 1/0/null) with template: per host, variable segments are wildcards."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    plain = F.transform(F.slice(parts, 1, DEPTH), lambda x: F.when(x.rlike("[0-9]"), F.lit("*")).otherwise(x))
    shaped = pages.withColumn("s", F.when(F.size(parts) > DEPTH, F.concat(plain, F.array(F.lit("**")))).otherwise(plain))
    for d in range(DEPTH):
        stem, own = F.array_join(F.slice("s", 1, d), "/"), F.get(F.col("s"), F.lit(d))
        nodes = shaped.where(F.size("s") > d).groupBy("host", stem.alias("stem"), own.alias("own")).agg(F.count("blocked").alias("n"), F.sum("blocked").alias("b"))
        nodes = saved(nodes, "nodes")
        # wide nodes are told by partial counts and lose their children's names; a window has FAN rows at most
        wide = saved(nodes.groupBy("host", "stem").agg(F.count("*").alias("fan")).where(F.col("fan") > FAN).select("host", "stem"), "wide")
        pool = Window.partitionBy("host", "stem")
        nodes = nodes.join(wide, ["host", "stem"], "left_anti")
        nodes = nodes.select("host", "stem", "own", "n", F.coalesce("b", F.lit(0)).alias("b"), F.count("*").over(pool).alias("fan"), F.sum("n").over(pool).alias("pn"), F.sum(F.coalesce("b", F.lit(0))).over(pool).alias("pb"))
        rate = F.try_divide(F.col("pb"), F.col("pn"))
        z = F.try_divide(F.abs(F.try_divide(F.col("b"), F.col("n")) - rate), F.sqrt(rate * (1 - rate) / F.greatest("n", F.lit(1))))
        alike = (F.col("n") >= 5) & (F.coalesce(z, F.lit(0.0)) <= 1.96) & (F.col("fan") > 1)
        merged = nodes.where((F.col("own") != "*") & alike).select(F.col("host").alias("_h"), F.col("stem").alias("_s"), F.col("own").alias("_o"), F.lit("~").alias("_to"))
        of_wide = wide.select(F.col("host").alias("_h2"), F.col("stem").alias("_s2"), F.lit("*").alias("_wide"))
        shaped = shaped.join(merged, (F.col("host") == F.col("_h")) & (stem == F.col("_s")) & (own == F.col("_o")), "left")
        shaped = shaped.join(of_wide, (F.col("host") == F.col("_h2")) & (stem == F.col("_s2")) & own.isNotNull(), "left")
        to = F.coalesce("_wide", "_to")
        shaped = shaped.withColumn("s", F.when(to.isNotNull(), F.concat(F.slice("s", 1, d), F.array(to), F.slice("s", d + 2, DEPTH + 1))).otherwise(F.col("s"))).drop("_h", "_s", "_o", "_to", "_h2", "_s2", "_wide")
    return shaped.withColumn("template", F.array_join("s", "/")).drop("s")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = saved(parsed.select("*", rule.alias("rule"), verdict.alias("ruled")), "urls")
    # one row for each distinct url: a hot host's rows do not meet in the tree
    distinct = parsed.groupBy("host", "path").agg(F.first("ruled").alias("ruled"), F.count("*").alias("rows"))
    distinct = distinct.withColumn("blocked", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    tree = saved(templated(distinct), "templates")
    every = tree.agg(F.sum("blocked").alias("b"), F.count("blocked").alias("n")).first()
    prior = (every["b"] or 0) / every["n"] if every["n"] else 0.0
    alike = tree.groupBy("template").agg(F.sum("blocked").alias("gb"), F.count("blocked").alias("gn"))
    own = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.count("blocked").alias("n"))
    wide = (F.coalesce("gb", F.lit(0)) + WEIGHT * prior) / (F.coalesce("gn", F.lit(0)) + WEIGHT)
    purity = own.join(alike, "template").select("host", "template", ((F.coalesce("b", F.lit(0)) + WEIGHT * wide) / (F.col("n") + WEIGHT)).alias("purity"))
    decided = tree.where("blocked IS NULL").join(purity, ["host", "template"]).select("host", "path", F.when(F.col("purity") >= LIMIT, "block").otherwise("allow").alias("found"))
    return parsed.join(decided, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "found", F.lit("allow")).alias("verdict"))
