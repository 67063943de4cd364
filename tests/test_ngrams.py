import random
from collections import Counter

from pyspark.sql import functions as F

from platewise.operators import ngrams
from platewise.plans import catalogue


def counted(rows):
    """Rows by plain Python: all texts of a key are counted as one."""
    texts, out = {}, []
    for k, t in rows:
        if k is not None:
            texts.setdefault(k, []).append((t or "").split(" "))
    grams = lambda ws, n: Counter(tuple(w[i : i + n]) for w in ws for i in range(len(w) - n + 1))
    for k, ws in texts.items():
        if k + 1 in texts:
            m = [(grams(ws, n) & grams(texts[k + 1], n)).total() for n in ngrams.ORDERS]
            out += [(k, h, r, *m) for h in {*map(len, ws)} for r in {*map(len, texts[k + 1])}]
    return sorted(out)


def test_next_matches(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["a", "b", "c", "", "d\n", "É"], k=rng.randrange(0, 30)))) for k in range(-130, 900) if rng.random() < 0.9]
    rows += [(5, "a b a b a"), (5, None), (6, "b a b"), (6, "b a b"), (64, "c c c c"), (None, "a"), (2000, "a"), (2001, "")]
    got = ngrams.next_matches(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert sorted(map(tuple, got)) == counted(rows)
    assert ngrams.next_matches(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_grams_are_not_shuffled(spark, tmp_path):
    """The three queries deal out texts once, not their n-grams."""
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("bleu", "bleu_by_order", "ngram_overlap_rouge12"):
        plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "array_join" not in plan
