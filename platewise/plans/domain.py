"""Queries over the library's own operators: statistics, text, quantities, similarity, retrieval, metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from platewise.functions import quantity, text
from platewise.operators import joins, stats
from platewise.plans.catalogue import query
from platewise.sources.tables import read

_WINSOR = """WITH q AS (SELECT l_partkey, quantile_cont(l_extendedprice, {lo}) AS a, quantile_cont(l_extendedprice, {hi}) AS b, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, round(median(CASE WHEN n < {least} THEN l_extendedprice ELSE greatest(least(l_extendedprice, {top}), {bottom}) END), 4) AS median, count(*) AS n FROM lineitem JOIN q USING (l_partkey) GROUP BY 1"""


@query("winsor_iqr_median", _WINSOR.format(lo=0.25, hi=0.75, least=4, top="b + 1.5 * (b - a)", bottom="a - 1.5 * (b - a)"))
def winsor_iqr_median(spark, sf_dir):
    out = stats.winsorised_median(read(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", 0.25, 0.75, iqr=1.5, least=4)
    return out.withColumn("median", F.round("median", 4))


@query("winsor_pct_median", _WINSOR.format(lo=0.025, hi=0.975, least=3, top="b", bottom="a"))
def winsor_pct_median(spark, sf_dir):
    out = stats.winsorised_median(read(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", 0.025, 0.975, least=3)
    return out.withColumn("median", F.round("median", 4))


@query(
    "weighted_median_targets",
    """WITH v AS (SELECT o_custkey, l_quantity, sum(l_linenumber) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY o_custkey ORDER BY l_quantity) * 1.0 / sum(w) OVER (PARTITION BY o_custkey) AS c FROM v),
s AS (SELECT *, lag(c) OVER (PARTITION BY o_custkey ORDER BY l_quantity) AS pc, lag(l_quantity) OVER (PARTITION BY o_custkey ORDER BY l_quantity) AS pv FROM c)
SELECT o_custkey, round(coalesce(pv + (0.5 - pc) / (c - pc) * (l_quantity - pv), l_quantity), 6) AS median FROM s WHERE c >= 0.5 AND coalesce(pc, -1) < 0.5""",
)
def weighted_median_targets(spark, sf_dir):
    lines = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return stats.weighted_median(lines, ["o_custkey"], "l_quantity", "l_linenumber").withColumn("median", F.round("median", 6))


@query(
    "jaccard_similar_pairs",
    """WITH s AS (SELECT DISTINCT p_name, p_brand FROM part), n AS (SELECT p_name, count(*) AS n FROM s GROUP BY 1)
SELECT a.p_name AS a, b.p_name AS b, round(count(*) * 1.0 / (x.n + y.n - count(*)), 6) AS jaccard FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_name < b.p_name
JOIN n x ON x.p_name = a.p_name JOIN n y ON y.p_name = b.p_name GROUP BY a.p_name, b.p_name, x.n, y.n HAVING count(*) * 1.0 / (x.n + y.n - count(*)) >= 0.6""",
)
def jaccard_similar_pairs(spark, sf_dir):
    sets = read(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    size = sets.groupBy("p_name").agg(F.count("*").alias("n"))
    both = joins.item_pairs(sets, "p_brand", "p_name").groupBy("a", "b").agg(F.count("*").alias("c"))
    both = both.join(size.select(F.col("p_name").alias("a"), F.col("n").alias("x")), "a").join(size.select(F.col("p_name").alias("b"), F.col("n").alias("y")), "b")
    return both.select("a", "b", (F.col("c") / (F.col("x") + F.col("y") - F.col("c"))).alias("jaccard")).where("jaccard >= 0.6").withColumn("jaccard", F.round("jaccard", 6))


@query(
    "fuzzy_match_blocked",
    """WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), f AS (SELECT min(p_partkey) AS k, p_type, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part GROUP BY p_name, p_type),
t AS (SELECT k, w FROM f), m AS (SELECT p_partkey, k, len(list_intersect(p.w, t.w)) * 1.0 / len(list_distinct(list_concat(p.w, t.w))) AS s FROM p JOIN t ON len(list_intersect(p.w, t.w)) > 0)
SELECT p_partkey, min(k) AS target, round(max(s), 6) AS score FROM (SELECT *, max(s) OVER (PARTITION BY p_partkey) AS best FROM m WHERE s >= 0.6) x WHERE s = best GROUP BY 1""",
)
def fuzzy_match_blocked(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    foods = part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("target"))
    return joins.fuzzy_best(part, foods, "p_partkey", "p_name", "target", "p_name").withColumn("score", F.round("score", 6))


@query("levenshtein_alias", "WITH n AS (SELECT DISTINCT p_name AS w FROM part) SELECT a.w AS a, b.w AS b, CAST(levenshtein(a.w, b.w) AS INT) AS d FROM n a JOIN n b ON a.w < b.w AND left(a.w, 1) = left(b.w, 1) AND levenshtein(a.w, b.w) <= 5")
def levenshtein_alias(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    other = names.select(F.col("a").alias("b"))
    met = names.join(other, (F.left("a", F.lit(1)) == F.left("b", F.lit(1))) & (F.col("a") < F.col("b")))
    return met.select("a", "b", F.levenshtein("a", "b").alias("d")).where("d <= 5")


@query("levenshtein_alias_whole", "WITH n AS (SELECT DISTINCT p_name AS w FROM part) SELECT a.w AS a, b.w AS b, CAST(levenshtein(a.w, b.w) AS INT) AS d FROM n a JOIN n b ON a.w < b.w AND levenshtein(a.w, b.w) <= 5")
def levenshtein_alias_whole(spark, sf_dir):
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    return joins.levenshtein_pairs(names, "p_name", 5)


@query("substring_match", "SELECT a.p_partkey, min(b.p_type) AS best FROM part a JOIN (SELECT DISTINCT p_type FROM part) b ON contains(lower(a.p_type || ' ' || a.p_name), lower(b.p_type)) GROUP BY 1")
def substring_match(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    kinds = part.select(F.col("p_type").alias("kind")).distinct()  # a handful: Spark broadcasts them by their size
    met = part.join(kinds, F.lower(F.concat_ws(" ", "p_type", "p_name")).contains(F.lower("kind")))
    return met.groupBy("p_partkey").agg(F.min("kind").alias("best"))


_BM25 = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), l AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1),
f AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT w, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM f GROUP BY 1),
q AS (SELECT item_id, w, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) x GROUP BY 1, 2),
s AS (SELECT item_id, f.doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM l)))) AS score FROM q JOIN f USING (w) JOIN d USING (w) JOIN l ON l.doc_id = f.doc_id GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) r WHERE rank <= 5"""


def _bm25(spark, sf_dir):
    """BM25 of all documents that share a word with an item: item_id, doc_id, score."""
    docs = read(spark, sf_dir, "documents")
    split = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    q = read(spark, sf_dir, "benchmark").select("item_id", split("text").alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("qf"))
    # only words that some item has are counted, before any exchange
    tf = docs.select("doc_id", split("text").alias("w")).join(F.broadcast(q.select("w").distinct()), "w", "left_semi").groupBy("doc_id", "w").agg(F.count("*").alias("tf"))
    length = docs.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("dl")).where("dl > 0").groupBy("doc_id").agg(F.sum("dl").alias("dl"))
    n, mean = docs.count(), length.agg(F.avg("dl")).first()[0] or 1.0
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("qf") * idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / mean))
    return tf.join(df, "w").join(q, "w").join(length, "doc_id").groupBy("item_id", "doc_id").agg(F.sum(weight).alias("score"))


@query("bm25_topk", _BM25)
def bm25_topk(spark, sf_dir):
    return stats.top(_bm25(spark, sf_dir), ["item_id"], [F.round("score", 6).desc(), F.col("doc_id")], 5).withColumn("score", F.round("score", 4))


@query(
    "knn_cosine",
    """WITH e AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (a.n * b.n) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT vec_id, other, round(s, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, other) AS rank FROM p) t WHERE rank <= 5""",
)
def knn_cosine(spark, sf_dir):
    """Every fiftieth vector against all, in blocks: each task multiplies its vectors with the broadcast queries."""
    import numpy as np
    import pyarrow as pa

    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").toArrow()
    ids = asked["vec_id"].to_numpy()
    q = np.array(asked["embedding"].to_pylist(), np.float64).reshape(len(ids), -1)
    shared = spark.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

    def run(batches):
        ids, q = shared.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            e = np.array(batch.column(1).to_pylist(), np.float64)
            s = q @ (e / np.linalg.norm(e, axis=1, keepdims=True)).T
            s[ids[:, None] == own[None, :]] = -2
            for i in range(len(ids)):
                at = np.lexsort((own, -np.round(s[i], 9)))[:5]
                at = at[s[i][at] > -2]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[i])), pa.array(own[at]), pa.array(s[i][at])], ["vec_id", "other", "cosine"])

    best = vectors.mapInArrow(run, "vec_id long, other long, cosine double")
    return stats.top(best, ["vec_id"], [F.round("cosine", 9).desc(), F.col("other")], 5).withColumn("cosine", F.round("cosine", 6))


@query("inverted_index", "SELECT w, count(DISTINCT doc_id) AS df, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) t GROUP BY 1")
def inverted_index(spark, sf_dir):
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))))
    return read(spark, sf_dir, "documents").select("doc_id", words.alias("w")).groupBy("w").agg(F.count("*").alias("df"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("normalize_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(html, '')), '<[^>]*>', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) AS words FROM pages")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.normalised(F.col("html")).alias("words"))


@query("parse_r_vector", "SELECT p_partkey, p_type AS first_item, p_brand || ', ' || p_name AS second_item, CAST(2 AS INT) AS n FROM part")
def parse_r_vector(spark, sf_dir):
    vector = F.concat(F.lit('c("'), "p_type", F.lit('", "'), "p_brand", F.lit(", "), "p_name", F.lit('")'))
    items = read(spark, sf_dir, "part").select("p_partkey", text.r_vector(vector).alias("v"))
    return items.select("p_partkey", F.get("v", F.lit(0)).alias("first_item"), F.get("v", F.lit(1)).alias("second_item"), F.size("v").alias("n"))


@query("parse_quantity", "SELECT p_partkey, p_size + 0.5 AS mixed, 1.0 / p_size AS fraction, CAST(p_size + 1 AS DOUBLE) AS range_upper, p_size + 0.5 AS range_middle FROM part")
def parse_quantity(spark, sf_dir):
    n = F.col("p_size").cast("string")
    span = F.concat(n, F.lit("-"), (F.col("p_size") + 1).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", quantity.parsed(F.concat(n, F.lit(" 1/2"))).alias("mixed"), quantity.parsed(F.concat(F.lit("1/"), n)).alias("fraction"), quantity.parsed(span).alias("range_upper"), quantity.parsed(span, upper=False).alias("range_middle"))


@query("pack_size", "SELECT p_partkey, CAST(p_size * 14 AS DOUBLE) AS amount, 'ounce' AS unit, CAST(p_size * 14 AS DOUBLE) * CAST(28.35 AS DOUBLE) AS grams FROM part")
def pack_size(spark, sf_dir):
    found = read(spark, sf_dir, "part").select("p_partkey", "p_name", quantity.pack(F.concat(F.col("p_size").cast("string"), F.lit(" (14 ounce) cans"))).alias("p"))
    return found.select("p_partkey", "p.amount", "p.unit", quantity.grams(F.col("p.amount"), F.col("p.unit"), F.col("p_name")).alias("grams"))


@query("id_canonicalise", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS canonical FROM orders")
def id_canonicalise(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.canonical_id(F.concat(F.col("o_orderkey").cast("string"), F.lit(".000"))).alias("canonical"))


@query("explode_aligned", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_linenumber <= 7")
def explode_aligned(spark, sf_dir):
    packed = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    zipped = F.arrays_zip(F.col("x.l_linenumber").alias("l_linenumber"), F.col("x.l_partkey").alias("l_partkey"), F.col("x.l_quantity").alias("l_quantity"))
    return packed.select("l_orderkey", F.inline(zipped)).where("l_linenumber <= 7")


@query("profile_assembly", "SELECT o_custkey AS user_id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS recipes, count(*) AS n, min(c_mktsegment) AS state FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def profile_assembly(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("recipes"), F.count("*").alias("n"))
    return orders.join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("user_id")).select("user_id", "recipes", "n", F.col("c_mktsegment").alias("state"))


@query("split_10_2_2", "SELECT c_custkey, CASE WHEN h < 10 THEN 'train' WHEN h < 12 THEN 'val' ELSE 'test' END AS split FROM (SELECT c_custkey, (c_custkey * 2654435761) % 1000003 % 14 AS h FROM customer) t")
def split_10_2_2(spark, sf_dir):
    h = (F.col("c_custkey") * 2654435761) % 1000003 % 14
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(h < 10, "train").when(h < 12, "val").otherwise("test").alias("split"))


@query("distinct_n", "SELECT lang, round(count(DISTINCT g) * 1.0 / count(*), 6) AS distinct_2, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT lang, string_split(text, ' ') AS w FROM documents) t) x GROUP BY 1")
def distinct_n(spark, sf_dir):
    grams = read(spark, sf_dir, "documents").select("lang", F.split("text", " ").alias("w")).select("lang", F.explode(text.ngrams(F.col("w"), 2)).alias("g"))
    return grams.groupBy("lang").agg(F.round(F.count_distinct("g") / F.count("*"), 6).alias("distinct_2"), F.count("*").alias("n"))


@query("doc_vocab", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) t GROUP BY 1 HAVING count(*) >= 20")
def doc_vocab(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n >= 20")


@query("doc_numeric", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents")
def doc_numeric(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("numbers"))


@query("doc_format", "SELECT source, count(*) AS n, count(CASE WHEN contains(text, '|') THEN 1 END) AS tables, count(CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 1 END) AS numeric_docs, count(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 1 END) AS non_ascii FROM documents GROUP BY 1".replace("\\\\", "\\"))
def doc_format(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").contains("|")).alias("tables"), F.count_if(F.col("text").rlike("[0-9]{3}")).alias("numeric_docs"), F.count_if(F.col("text").rlike(r"[^\x00-\x7F]")).alias("non_ascii"))


@query("chat_records", "SELECT conv_id, string_agg(role || ':' || CAST(length(text) AS VARCHAR), ';' ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def chat_records(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(":"), x["n"].cast("string"))), ";").alias("turns"))


@query("props_json", "SELECT event_type, count(*) AS n, sum(CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def props_json(spark, sf_dir):
    k = F.coalesce(F.from_json("props", "k long")["k"], F.lit(0))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("event_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from platewise.streaming import windowed_counts

    out = windowed_counts(read(spark, sf_dir, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("nutrient_pivot", "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 4) AS a, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 4) AS n, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS r FROM lineitem GROUP BY 1")
def nutrient_pivot(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 4))
    return out.select("l_orderkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


_HYBRID = _BM25[: _BM25.rindex("\nSELECT")] + """, m AS (SELECT item_id, max(score) AS best FROM s GROUP BY 1),
h AS (SELECT b.item_id, d.doc_id, coalesce(0.4 * s.score / m.best, 0) + 0.6 * coalesce(quality, 0) AS hybrid FROM benchmark b CROSS JOIN documents d LEFT JOIN s ON s.item_id = b.item_id AND s.doc_id = d.doc_id LEFT JOIN m ON m.item_id = b.item_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT item_id, doc_id, round(hybrid, 4) AS hybrid, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(hybrid, 6) DESC, doc_id) AS rank FROM h) r WHERE rank <= 3"""


@query("hybrid_retrieval", _HYBRID)
def hybrid_retrieval(spark, sf_dir):
    """0.4 of BM25 over its maximum per item and 0.6 of the label-based similarity, of all documents; the first three."""
    k = 3
    similar = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("similarity"))
    scored = _bm25(spark, sf_dir)
    # of documents without a word of the item, only the k most similar ones (the same for all items) can be among its first k
    others = read(spark, sf_dir, "benchmark").select("item_id").crossJoin(F.broadcast(similar.orderBy(F.desc("similarity"), "doc_id").limit(k).select("doc_id"))).withColumn("score", F.lit(0.0))
    scored = scored.unionByName(others).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    best = F.max("score").over(Window.partitionBy("item_id"))
    mixed = scored.join(similar, "doc_id").withColumn("hybrid", F.coalesce(0.4 * F.col("score") / F.nullif(best, F.lit(0.0)), F.lit(0.0)) + 0.6 * F.col("similarity"))
    return stats.top(mixed, ["item_id"], [F.round("hybrid", 6).desc(), F.col("doc_id")], k).select("item_id", "doc_id", F.round("hybrid", 4).alias("hybrid"), "rank")


@query("grams_to_household", None)
def grams_to_household(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", quantity.household(F.col("l_quantity") * 10).alias("shown"))


@query("unit_to_grams", "SELECT p_partkey, p_size * CAST(28.35 AS DOUBLE) AS from_oz, p_size * CAST(453.592 AS DOUBLE) AS from_lb, p_size * CAST(100 AS DOUBLE) AS from_unknown FROM part")
def unit_to_grams(spark, sf_dir):
    n = F.col("p_size").cast("double")
    g = lambda u: quantity.grams(n, F.lit(u), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", g("oz").alias("from_oz"), g("pounds").alias("from_lb"), g("handful").alias("from_unknown"))


@query("rouge_l", None)
def rouge_l(spark, sf_dir):
    """ROUGE-L F1 of each benchmark item against the best document by BM25 (longest common subsequence, by words)."""
    @F.pandas_udf("double")
    def f1(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            p, q = x.lower().split(), y.lower().split()
            row = [0] * (len(q) + 1)
            for w in p:
                last = 0
                for j, v in enumerate(q, 1):
                    last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
            return 2 * row[-1] / (len(p) + len(q)) if p or q else 0.0

        return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])

    first = bm25_topk(spark, sf_dir).where("rank = 1").select("item_id", "doc_id")
    both = first.join(read(spark, sf_dir, "benchmark"), "item_id").join(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("found")), "doc_id")
    return both.select("item_id", "doc_id", F.round(f1("text", "found"), 6).alias("rouge_l"))


@query("quantity_optimizer", None)
def quantity_optimizer(spark, sf_dir):
    """Scale factors that bring a recipe's energy near its target: 20 multiplicative steps, folded in place. Protein is not fitted."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("energy"))
    step = lambda s, _: F.least(F.greatest(s * F.sqrt(F.least(F.greatest(F.lit(500.0) / (s * F.col("energy")), F.lit(0.8)), F.lit(1.25))), F.lit(0.25)), F.lit(4.0))
    return lines.select("l_orderkey", F.round(F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(1.0), step), 6).alias("factor"))
