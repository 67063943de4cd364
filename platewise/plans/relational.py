"""Joins, aggregates, ordering and set operations over recipes (orders), ingredients (lineitem, part) and users."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators.joins import two_hop
from platewise.plans.both import both
from platewise.plans.catalogue import query
from platewise.sources.tables import read

PCT = {"p25": ("percentile(v, 0.25)", "quantile_cont(v, 0.25)"), "p75": ("percentile(v, 0.75)", "quantile_cont(v, 0.75)")}

both("grams_source_stats", """SELECT l_returnflag AS unit_std, count(*) AS n, count(CASE WHEN l_quantity >= 25 THEN 1 END) AS n_household,
 count(CASE WHEN l_discount > 0.05 THEN 1 END) AS n_default, round(avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY l_returnflag""")
both("unmatched_report", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
both("semi_join_reduce", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
both("strict_relaxed_full_outer", """SELECT coalesce(a.k, b.k) AS recipe_id, round(a.s, 4) AS strict_sum, round(b.s, 4) AS relaxed_sum FROM
 (SELECT l_orderkey AS k, sum(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL OUTER JOIN
 (SELECT l_orderkey AS k, sum(l_extendedprice) AS s FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY 1) b ON a.k = b.k""")
both("unit_conflicts", "SELECT l_partkey, count(DISTINCT l_returnflag) AS units FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
both("household_weights", """SELECT l_partkey, l_returnflag, round(median(l_extendedprice / l_quantity) + 1e-7, 5) AS canonical, round(avg(l_extendedprice / l_quantity) + 1e-7, 5) AS mean_g,
 round(max(l_extendedprice / l_quantity) + 1e-7, 5) AS max_g, count(*) AS n, round(ln(1 + count(*)), 6) AS quality FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1, 2""")
both("unit_global_median", "SELECT l_returnflag AS unit, median(l_quantity) AS grams, count(*) AS n FROM lineitem GROUP BY 1")
both("winsor_global", """WITH q AS (SELECT {lo} AS lo, {hi} AS hi FROM lineitem)
 SELECT l_returnflag, round(sum(least(greatest(l_extendedprice, (SELECT lo FROM q)), (SELECT hi FROM q))), 2) AS clipped, count(*) AS n FROM lineitem GROUP BY 1""",
     lo=("percentile(l_extendedprice, 0.01)", "quantile_cont(l_extendedprice, 0.01)"), hi=("percentile(l_extendedprice, 0.99)", "quantile_cont(l_extendedprice, 0.99)"))
both("layered_medians", """SELECT 'category' AS key_type, p_brand AS k, l_returnflag AS unit, median(l_quantity) AS grams, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 2, 3
 UNION ALL SELECT 'token', t, l_returnflag, median(l_quantity), count(*) FROM (SELECT p_partkey, {words} AS t FROM part) w JOIN lineitem ON p_partkey = l_partkey GROUP BY 2, 3""",
     words=("explode(split(p_name, ' '))", "unnest(string_split(p_name, ' '))"))
both("dedup_latest_review", """SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) t WHERE r = 1""")
both("dedup_best_coverage", """SELECT p_name, p_partkey, n FROM (SELECT p_name, p_partkey, n, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_partkey) AS r FROM
 (SELECT p_name, p_partkey, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2) c) t WHERE r = 1""")
both("ingredient_frequency", """SELECT p_name, n, round(n / (sum(n) OVER () * 1.0), 8) AS share, round(sum(n) OVER (ORDER BY n DESC, p_name) / (sum(n) OVER () * 1.0), 8) AS cumulative
 FROM (SELECT p_name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) t""")
both("nutrient_summary", "\nUNION ALL ".join(f"""SELECT '{c}' AS nutrient, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, min({c}) AS lo,
 round({{p}}({c}, 0.1), 4) AS p10, round(median({c}), 4) AS p50, round({{p}}({c}, 0.9), 4) AS p90, max({c}) AS hi FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
     p=("percentile", "quantile_cont"))
both("key_set_diagnostics", """SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem) a) AS both_sides,
 (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) b) AS only_recipes,
 (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) c) AS only_items""")
both("union_source_priority", """SELECT k, src, price FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pri) AS r FROM
 (SELECT p_partkey AS k, 'part' AS src, 1 AS pri, p_retailprice AS price FROM part WHERE p_size > 25 UNION ALL SELECT s_suppkey, 'supplier', 2, s_acctbal FROM supplier) u) t WHERE r = 1""")
both("incremental_rescue", """SELECT p_partkey, 'kept' AS how, p_name AS target FROM part WHERE p_size <= 25
 UNION ALL SELECT p.p_partkey, 'rescued', f.p_name FROM part p JOIN (SELECT p_type, min(p_name) AS p_name FROM part WHERE p_size <= 25 GROUP BY 1) f ON p.p_type = f.p_type
 WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey AND q.p_size <= 25)""")
both("recipe_roles", """SELECT l_orderkey AS recipe_id, CASE WHEN kcal >= 400 AND n >= 15 THEN 'main' WHEN kcal >= 200 AND n >= 8 THEN 'side' WHEN kcal >= 80 THEN 'appetiser' ELSE 'snack' END AS role
 FROM (SELECT l_orderkey, sum(l_quantity) * 4 AS kcal, sum(l_quantity) / 10 AS n FROM lineitem GROUP BY 1) t""")
both("base_stats", """SELECT o_custkey AS user_id, count(*) AS n, sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN rating <= 2 THEN 1 ELSE 0 END) AS neg,
 round((sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) + 5 * 0.6) / (count(*) + 5), 6) AS shrunk, count(*) < 5 AS cold_start,
 {days} AS span FROM (SELECT *, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS rating FROM orders) t GROUP BY 1""",
     days=("CAST(datediff(max(o_orderdate), min(o_orderdate)) AS BIGINT)", "date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE))"))
both("time_decay_weights", """SELECT o_orderkey, round(exp(-ln(2) / 180 * d) + 1e-10, 8) AS w_exp, round(pow(0.5, d / 365.0) + 1e-10, 8) AS w_half FROM
 (SELECT o_orderkey, {days} AS d FROM orders) t""", days=("datediff(DATE'2000-01-01', o_orderdate)", "date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')"))  # fmt: skip
both("amdr_projection", """SELECT c_custkey, round(100 * p / (p + c + f), 4) AS protein_pct, round(100 * c / (p + c + f), 4) AS carb_pct, round(100 * f / (p + c + f), 4) AS fat_pct FROM
 (SELECT c_custkey, least(greatest(abs(c_acctbal) / 300, 10), 35) AS p, least(greatest(abs(c_acctbal) / 150, 45), 65) AS c, least(greatest(40 - abs(c_acctbal) / 500, 20), 35) AS f FROM customer) t""")
both("micronutrient_inference", """SELECT l_orderkey, l_linenumber, round(least(greatest(l_quantity * 20, 50), 800), 4) AS sodium, round(least(l_extendedprice * 0.001, 25) + 1e-7, 4) AS sugars,
 CASE WHEN 4 * l_quantity + 9 * l_linenumber BETWEEN 0.75 * l_quantity * 5 AND 1.25 * l_quantity * 5 THEN l_quantity * 5 ELSE 4 * l_quantity + 9 * l_linenumber END AS kcal FROM lineitem""")
both("cooccurrence_pmi", """WITH i AS (SELECT DISTINCT l_orderkey AS r, p_name AS i FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT count(DISTINCT r) AS n FROM i),
 f AS (SELECT i, count(*) AS c FROM i GROUP BY 1), p AS (SELECT a.i AS a, b.i AS b, count(*) AS c FROM i a JOIN i b ON a.r = b.r AND a.i < b.i GROUP BY 1, 2)
 SELECT p.a, p.b, p.c, round(ln(p.c * 1.0 * (SELECT n FROM n) / (x.c * y.c)), 4) AS pmi, round(p.c * 1.0 / x.c, 4) AS confidence, round(p.c * 1.0 / (SELECT n FROM n), 6) AS support
 FROM p JOIN f x ON x.i = p.a JOIN f y ON y.i = p.b WHERE p.c >= 5""")
both("idf_tables", """WITH i AS (SELECT DISTINCT l_orderkey AS r, p_name AS i FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT count(DISTINCT r) AS n FROM i), d AS (SELECT i, count(*) AS df FROM i GROUP BY 1)
 SELECT i, df, round(ln(1 + (SELECT n FROM n) / (df + 1.0)), 6) AS idf, round(greatest(ln(((SELECT n FROM n) - df + 0.5) / (df + 0.5)), 1e-9), 6) AS idf_bm25,
 round(ln(((SELECT n FROM n) - df + 0.5) / (df + 0.5) + 1), 6) AS idf_retrieval FROM d WHERE i NOT IN (SELECT min(i) FROM d)""")
_EVENTS = """e AS (SELECT o_custkey AS u, p_name AS i, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1 ELSE -1 END AS s, 1 / sqrt(count(*) OVER (PARTITION BY o_orderkey)) AS w
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE substr(o_orderpriority, 1, 1) <> '3')"""
_A = """t AS (SELECT u, i, sum(CASE WHEN s = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN s = -1 THEN w ELSE 0 END) AS n FROM e GROUP BY 1, 2),
 g AS (SELECT i, sum(p + n) / sum(sum(p + n)) OVER () AS bg FROM t GROUP BY 1), a AS (SELECT t.u, t.i, p, n,
 ln((p + 50 * bg) / (tp + 50 - p - 50 * bg)) - ln((n + 50 * bg) / (tn + 50 - n - 50 * bg)) AS d, 1 / (p + 50 * bg) + 1 / (n + 50 * bg) AS v
 FROM (SELECT *, sum(p) OVER (PARTITION BY u) AS tp, sum(n) OVER (PARTITION BY u) AS tn FROM t) t JOIN g ON g.i = t.i)"""
both("pref_logodds", f"WITH {_EVENTS}, {_A} SELECT u, i, round(tanh(d / 2), 6) AS score, round(d / sqrt(v), 6) AS z FROM a")
_B = """x AS (SELECT u, e.i, sum(s * w * f.idf) AS diff FROM e JOIN (SELECT i, ln(1 + (SELECT count(*) FROM e) / (count(*) + 1.0)) AS idf FROM e GROUP BY 1) f ON f.i = e.i GROUP BY 1, 2),
 b AS (SELECT u, i, tanh(diff / m) AS score FROM (SELECT x.u, x.i, diff, m FROM x JOIN (SELECT u, median(abs(diff)) AS m FROM x WHERE abs(diff) > 1e-12 GROUP BY 1) q ON q.u = x.u) y)"""
both("pref_bm25", f"WITH {_EVENTS}, {_B} SELECT u, i, round(score, 5) + 0.0 AS score FROM b")
both("pref_ensemble_topk", f"""WITH {_EVENTS}, {_A}, {_B} SELECT u, i, round(s, 5) AS score FROM (SELECT u, i, s, row_number() OVER (PARTITION BY u ORDER BY round(s, 6) DESC, i) AS r FROM
 (SELECT coalesce(a.u, b.u) AS u, coalesce(a.i, b.i) AS i, least(greatest(0.6 * coalesce(tanh(d / 2), 0) + 0.4 * coalesce(score, 0), -1), 1) AS s FROM a FULL OUTER JOIN b ON a.u = b.u AND a.i = b.i) c WHERE s > 0.05) t WHERE r <= 10""")
both("pref_ensemble_sides_topk", f"""WITH {_EVENTS}, {_A}, {_B} SELECT u, i, side, round(s, 5) + 0.0 AS score, r FROM (SELECT u, i, side, s, row_number() OVER (PARTITION BY u, side ORDER BY abs(round(s, 6)) DESC, i) AS r FROM
 (SELECT u, i, s, CASE WHEN s > 0 THEN 'liked' ELSE 'disliked' END AS side FROM (SELECT coalesce(a.u, b.u) AS u, coalesce(a.i, b.i) AS i, least(greatest(0.6 * coalesce(tanh(d / 2), 0) + 0.4 * coalesce(score, 0), -1), 1) AS s
 FROM a FULL OUTER JOIN b ON a.u = b.u AND a.i = b.i) c WHERE round(s, 6) <> 0) t) q WHERE r <= 80 AND (abs(s) > 0.05 OR r <= 3)""")
both("complementarity_pairs", """WITH n AS (SELECT p_name AS i, avg(p_size) AS a, avg(p_retailprice) AS b FROM part GROUP BY 1),
 q AS (SELECT {lo} AS lo, {hi} AS hi FROM n), t AS (SELECT i, CASE WHEN a <= (SELECT lo FROM q) THEN 'low' WHEN a >= (SELECT hi FROM q) THEN 'high' END AS tag, b FROM n)
 SELECT x.i AS a, y.i AS b, round(x.b / y.b, 6) AS synergy FROM t x JOIN t y ON x.tag = 'low' AND y.tag = 'high'""", lo=("percentile(a, 0.25)", "quantile_cont(a, 0.25)"), hi=("percentile(a, 0.75)", "quantile_cont(a, 0.75)"))  # fmt: skip
both("symmetric_rule_score", """WITH r AS (SELECT least(p_name, p_type) AS a, greatest(p_name, p_type) AS b, avg(p_size) AS s FROM part GROUP BY 1, 2)
 SELECT l_orderkey, round(avg(s), 6) AS score, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN r ON a = least(p_name, p_type) AND b = greatest(p_name, p_type) GROUP BY 1""")
both("tag_entropy_balance", """SELECT k, round(abs(sum(c * 1.0 / t * log2(c * 1.0 / t))) / greatest(log2(greatest(count(*), 2)), 1e-9), 6) AS entropy, count(*) AS tags FROM
 (SELECT l_orderkey AS k, p_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY l_orderkey) AS t FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) x GROUP BY 1""")
both("rank_topk_per_user", """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0) t WHERE rank <= 3""")
both("negatives_by_band", """SELECT o_custkey, o_orderkey, band FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, band ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey) AS r FROM
 (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'easy' WHEN o_totalprice < 250000 THEN 'medium' ELSE 'hard' END AS band FROM orders) b) t WHERE r <= 2""")
both("hard_constraints", """SELECT o_orderkey, bool_and(ok) AS passes, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS violated FROM
 (SELECT o_orderkey, o_totalprice <= c_acctbal * 100 AS ok FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey, o_totalprice >= 1000 FROM orders
 UNION ALL SELECT l_orderkey, sum(l_quantity) BETWEEN 20 AND 200 FROM lineitem GROUP BY 1) t GROUP BY 1""")
both("sample_classify", """SELECT o_orderkey, CASE WHEN r <= 0.1 THEN 'positive' WHEN r <= 0.3 THEN 'boundary' WHEN o_orderstatus = 'F' THEN 'preference_negative' ELSE 'negative' END AS class FROM
 (SELECT o_orderkey, o_orderstatus, percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t""")
both("correlation_matrix", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem")
both("graph_edges", """SELECT 'recipe_ingredient' AS edge_type, l_orderkey AS src, l_partkey AS dst, round(sum(l_quantity), 4) AS weight FROM lineitem GROUP BY 2, 3
 UNION ALL SELECT 'user_recipe', o_custkey, o_orderkey, 6.0 - CAST(substr(o_orderpriority, 1, 1) AS INT) FROM orders UNION ALL SELECT 'user_nation', c_custkey, CAST(c_nationkey AS BIGINT), 1.0 FROM customer""")
@query("two_hop_recommend", """WITH l AS (SELECT DISTINCT o_custkey AS u, p_name AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE substr(o_orderpriority, 1, 1) = '1'),
 e AS (SELECT p_type, p_name AS i, count(*) AS c FROM part GROUP BY 1, 2) SELECT u, i, s FROM (SELECT u, i, s, row_number() OVER (PARTITION BY u ORDER BY s DESC, i) AS r FROM
 (SELECT l.u, b.i, sum(a.c * b.c) AS s FROM l JOIN e a ON a.i = l.i JOIN e b ON a.p_type = b.p_type AND a.i <> b.i GROUP BY 1, 2) x
 WHERE NOT EXISTS (SELECT 1 FROM l z WHERE z.u = x.u AND z.i = x.i)) t WHERE r <= 5""")
def two_hop_recommend(spark, sf_dir):
    part, first = read(spark, sf_dir, "part"), read(spark, sf_dir, "orders").where("substr(o_orderpriority, 1, 1) = '1'")
    lines = first.join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    return two_hop(lines.select(F.col("o_custkey").alias("u"), F.col("p_name").alias("i")), part.select(F.col("p_type").alias("t"), F.col("p_name").alias("i")), 5)


both("metric_sncr", "SELECT o_orderstatus, round(avg(CASE WHEN o_totalprice BETWEEN c_acctbal * 0.9 AND c_acctbal * 110 THEN 1.0 ELSE 0.0 END), 6) AS sncr FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
both("metric_avc", "SELECT l_orderkey, sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) + sum(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS violations FROM lineitem GROUP BY 1")
both("metric_nutrition_acc", "SELECT l_orderkey, round(avg(CASE WHEN abs(l_extendedprice - l_quantity * 1000) <= 0.15 * l_quantity * 1000 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem GROUP BY 1")
both("aggregate_stats", """SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS sd, median(n_chars) AS med, {q} AS q25 FROM documents JOIN labels USING (doc_id) GROUP BY 1""", q=("percentile(n_chars, 0.25)", "quantile_cont(n_chars, 0.25)"))
both("multiseed_best", """SELECT lang, max(m) AS best, min(m) AS worst, round(stddev_pop(m), 6) AS sd FROM (SELECT lang, doc_id % 3 AS seed, round(avg(quality), 6) AS m FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) t GROUP BY 1""")
both("paired_t", "SELECT count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg(d) / stddev_samp(d), 6) AS cohens_d FROM (SELECT quality - toxic AS d FROM labels) x")
both("dataset_stats", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS mean_chars, max(turn) AS last_turn FROM conversations GROUP BY 1")
both("doc_duplicates", "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
both("doc_length", "SELECT source, count(*) AS n, round(avg(length(text)), 4) AS mean, median(length(text)) AS med, {q} AS p95, round(avg(CASE WHEN length(text) > 2048 THEN 1.0 ELSE 0.0 END), 6) AS truncated FROM documents GROUP BY 1", q=("round(percentile(length(text), 0.95), 6)", "round(quantile_cont(length(text), 0.95), 6)"))
both("doc_whitespace", "SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS spaces, length(text) - length(replace(text, chr(10), '')) AS line_feeds, text <> trim(text) AS untrimmed FROM documents")
both("doc_leakage", "SELECT item_id, count(*) AS holders FROM benchmark b JOIN documents d ON length(b.text) > 50 AND contains(d.text, b.text) GROUP BY 1")
both("metric_upm", """SELECT o_custkey, round(avg(CASE WHEN l.p_type = f.p_type THEN 1.0 ELSE 0.0 END), 6) AS upm FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part l ON l.p_partkey = l_partkey
 JOIN (SELECT u, min(p_type) AS p_type FROM (SELECT o_custkey AS u, p_type, count(*) AS c, max(count(*)) OVER (PARTITION BY o_custkey) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) q WHERE c = m GROUP BY 1) f ON f.u = o_custkey GROUP BY 1""")
