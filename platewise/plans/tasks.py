"""Text metrics over n-grams, rank tests, and edited recipes: a violation put in and corrected again."""

from __future__ import annotations

from platewise.operators import ngrams
from platewise.plans.both import both, doubles
from platewise.plans.catalogue import query
from platewise.sources.tables import read

# Each document against the one with the next id; ngrams.next_matches gives t.
_GRAMS = ("WITH w AS (SELECT doc_id, {split} AS w FROM documents), g AS (SELECT doc_id, n, gram, count(*) AS c FROM ("
          + " UNION ALL ".join(f"SELECT doc_id, {n} AS n, {{g{n}}} AS gram FROM w" for n in (1, 2, 3, 4))
          + """) x GROUP BY 1, 2, 3), m AS (SELECT a.doc_id, a.n, sum(least(a.c, b.c)) AS m FROM g a JOIN g b ON b.doc_id = a.doc_id + 1 AND b.n = a.n AND b.gram = a.gram GROUP BY 1, 2),
 l AS (SELECT a.doc_id, {size}(a.w) AS h, {size}(b.w) AS r FROM w a JOIN w b ON b.doc_id = a.doc_id + 1),
 t AS (SELECT l.doc_id, h, r, """ + ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN m END), 0) AS m{n}" for n in (1, 2, 3, 4)) + " FROM l LEFT JOIN m ON m.doc_id = l.doc_id GROUP BY 1, 2, 3)")  # fmt: skip
_FORMS = {"{split}": "string_split(coalesce(text, ''), ' ')", "{size}": "len"} | {
    f"{{g{n}}}": f"unnest(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))" for n in ngrams.ORDERS
}
# an order without a match counts 0.1 of one
_PRECISIONS = " + ".join(f"ln(CASE WHEN m{n} > 0 THEN m{n} * 1.0 ELSE 0.1 END / greatest(h - {n - 1}, 1))" for n in (1, 2, 3, 4))



def _against_next(name: str, select: str) -> None:
    """Register select over t: each document's counts of words and matches with the next one."""
    sql = f"{_GRAMS} {select}"
    for word, form in _FORMS.items():
        sql = sql.replace(word, form)
    query(name, sql)(lambda spark, sf_dir: spark.sql(doubles(select).replace("FROM t", "FROM {t}"), t=ngrams.next_matches(read(spark, sf_dir, "documents"), "doc_id", "text")))


_against_next("bleu", f"""SELECT doc_id, round(CASE WHEN m1 = 0 THEN 0.0 ELSE exp(({_PRECISIONS}) / 4.0) * CASE WHEN h > r THEN 1.0 ELSE exp(1 - r * 1.0 / h) END END, 6) AS bleu FROM t""")
_against_next("bleu_by_order", "SELECT doc_id, " + ", ".join(f"round(m{n} * 1.0 / greatest(h - {n - 1}, 1), 6) AS p{n}" for n in (1, 2, 3, 4)) + " FROM t")
_against_next("ngram_overlap_rouge12", "SELECT doc_id, round(2.0 * m1 / (h + r), 6) AS rouge_1, round(2.0 * m2 / greatest(h + r - 2, 1), 6) AS rouge_2 FROM t")

# Two-sided p of z by a rational approximation of erfc (fixed values, absolute error below 1.5e-7).
_U = "(1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)))"
_P = f"({_U} * (0.254829592 + {_U} * (-0.284496736 + {_U} * (1.421413741 + {_U} * (-1.453152027 + {_U} * 1.061405429)))) * exp(-z * z / 2))"
# Rows are counted by value first, so what is ordered in one place are distinct values only; ties share the mean rank.
both("wilcoxon_signed_rank", f"""WITH d AS (SELECT round(l_discount - l_tax, 4) AS d FROM lineitem),
 v AS (SELECT abs(d) AS a, count(*) AS c, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS up FROM d WHERE d <> 0 GROUP BY 1),
 k AS (SELECT c, up, sum(c) OVER (ORDER BY a) - c + (c + 1) / 2.0 AS rank FROM v),
 s AS (SELECT sum(c) * 1.0 AS n, sum(up * rank) AS w, sum(c * 1.0 * c * c - c) AS ties FROM k),
 z AS (SELECT n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)
 SELECT n, round(w, 1) AS w, round(z, 5) AS z, round({_P}, 6) AS p FROM z""")
both("mann_whitney", f"""WITH v AS (SELECT n_chars, count(*) AS c, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS a FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1),
 k AS (SELECT c, a, sum(c) OVER (ORDER BY n_chars) - c + (c + 1) / 2.0 AS rank FROM v),
 s AS (SELECT sum(c) * 1.0 AS n, sum(a) * 1.0 AS na, sum(a * rank) AS ra, sum(c * 1.0 * c * c - c) AS ties FROM k),
 u AS (SELECT na, n - na AS nb, n, ties, ra - na * (na + 1) / 2 AS u FROM s),
 z AS (SELECT na, nb, u, (u - na * nb / 2) / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)
 SELECT na, nb, round(u, 1) AS u, round(z, 5) AS z, round({_P}, 6) AS p FROM z""")

both("ingredient_coverage", """WITH i AS (SELECT DISTINCT l_orderkey AS r, p_name AS i FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT r, count(*) AS n FROM i GROUP BY 1)
 SELECT n.r AS recipe_id, round(count(a.i) * 1.0 / max(n), 6) AS coverage FROM n JOIN i b ON b.r = n.r LEFT JOIN i a ON a.r = n.r + 1 AND a.i = b.i GROUP BY 1""")
both("ratio_mix", """SELECT o_orderkey, CASE WHEN h < 60 THEN 'nutrition' WHEN h < 85 THEN 'preference' ELSE 'both' END AS task FROM (SELECT o_orderkey, (o_orderkey % 1000003) * 7919 % 1000003 % 100 AS h FROM orders) t""")

# Kinds of violation (fixed values): range of the factor on the line that has most of the nutrient, and the bound on the total.
_KINDS = "(VALUES (0, 'sodium_high', 2.5, 3.5, 1.0), (1, 'protein_low', 0.3, 0.5, 0.8), (2, 'fat_high', 2.5, 4.0, 1.25), (3, 'carb_low', 0.3, 0.5, 0.75), (4, 'energy_high', 1.4, 1.7, 1.25), (5, 'fibre_low', 0.2, 0.4, 0.8), (6, 'saturated_high', 2.5, 3.5, 1.2), (7, 'sugars_high', 2.0, 3.0, 1.5)) AS kinds(id, kind, lo, hi, bound)"
_EDITED = f"""WITH k AS (SELECT * FROM {_KINDS}), x AS (SELECT l_orderkey AS r, l_linenumber AS line, l_partkey AS item, (l_orderkey % 1000003) * 7919 % 1000003 AS h,
 l_quantity * 1.0 AS q, p_size * 1.0 AS size, p_retailprice * 1.0 AS price FROM lineitem JOIN part ON p_partkey = l_partkey),
 v AS (SELECT r, line, item, kind, lo + (hi - lo) * ((h * 31 % 1009) / 1009.0) AS factor, bound * 1.0 AS bound, lo > 1 AS raised, q * CASE WHEN id IN (0, 6, 7) THEN price / 1000 WHEN id IN (1, 3) THEN size ELSE size + price / 100 END AS v FROM x JOIN k ON id = h % 8),
 t AS (SELECT *, sum(v) OVER (PARTITION BY r) AS total, row_number() OVER (PARTITION BY r ORDER BY v DESC, line, item) AS n FROM v),
 e AS (SELECT r, line, item, kind, factor, raised, v, total, total * bound AS bounded, total + v * (factor - 1) AS edited FROM t WHERE n = 1)"""
both("violation_injection", f"""{_EDITED} SELECT r AS recipe_id, kind, line, item, round(factor, 4) AS factor, round(edited / total, 5) AS ratio, CASE WHEN raised THEN edited > bounded ELSE edited < bounded END AS violated FROM e""")
# The line goes to where the total meets its bound; of a violation by a lowered line no more than the line lost is given back.
both("violation_correction", f"""{_EDITED}, f AS (SELECT r, kind, line, raised, total, v, factor, edited, CASE WHEN raised THEN greatest(v * factor - (edited - bounded), 0.0) ELSE least(v * factor + (bounded - edited), v) END AS corrected
 FROM e WHERE CASE WHEN raised THEN edited > bounded ELSE edited < bounded END)
 SELECT r AS recipe_id, kind, line, CASE WHEN corrected = 0 THEN 'remove' WHEN raised THEN 'reduce' ELSE 'increase' END AS action, round(corrected / (v * factor), 5) AS change, round((edited + corrected - v * factor) / total, 5) AS ratio FROM f""")
