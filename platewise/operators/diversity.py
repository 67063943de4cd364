"""How alike the texts of a table are: each one's BLEU against all the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4)


def self_bleu(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, self_bleu, the BLEU (four orders alike; an order without a match counts 0.1 of one) with all other rows as references.

    No pair of rows is made: a gram's clip is the largest count among the other rows, which is the largest of all or, for
    the one row that alone has that, the second largest. Words are split at white space, lower case. A text without words,
    or without a word that another row has, scores 0, as does the only row of a table. key must be unique."""
    words = texts.select(F.col(key).alias("k"), F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "").alias("w"))
    words = words.withColumn("h", F.size("w"))

    def grams(n: int) -> Column:
        starts = F.when(F.col("h") >= n, F.sequence(F.lit(1), F.col("h") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("g")))

    counts = words.select("k", F.explode(F.flatten(F.array(*map(grams, ORDERS)))).alias("g")).groupBy("k", F.col("g.n").alias("n"), F.col("g.g").alias("g")).agg(F.count("*").alias("c"))
    by_count = counts.groupBy("n", "g", "c").agg(F.count("*").alias("rows"))
    best = by_count.groupBy("n", "g").agg(F.max(F.struct("c", "rows")).alias("m"), F.count("*").alias("kinds"))
    below = by_count.join(best, ["n", "g"]).where(F.col("c") < F.col("m.c")).groupBy("n", "g").agg(F.max("c").alias("second"))
    top = best.join(below, ["n", "g"], "left").select("n", "g", F.col("m.c").alias("most"), (F.col("m.rows") == 1).alias("alone"), F.coalesce("second", F.lit(0)).alias("second"))
    clip = F.when((F.col("c") == F.col("most")) & F.col("alone"), F.col("second")).otherwise(F.col("most"))
    matched = counts.join(top, ["n", "g"]).groupBy("k").agg(*[F.sum(F.when(F.col("n") == n, F.least("c", clip))).alias(f"m{n}") for n in ORDERS])
    # the nearest length among the other rows, the shorter of two: distinct lengths only, whatever the number of rows
    by_length = Window.orderBy("h")
    lengths = words.groupBy("h").agg(F.count("*").alias("rows")).withColumn("down", F.lag("h").over(by_length)).withColumn("up", F.lead("h").over(by_length))
    h, down, up = F.col("h"), F.col("down"), F.col("up")
    near = F.when(F.col("rows") > 1, h).when(down.isNull(), up).when(up.isNull() | (h - down <= up - h), down).otherwise(up)
    scored = words.select("k", "h").join(F.broadcast(lengths.select("h", near.alias("r"))), "h").join(matched, "k", "left")
    hits = [F.coalesce(f"m{n}", F.lit(0)) for n in ORDERS]
    logs = [F.log(F.when(m > 0, m.cast("double")).otherwise(0.1) / F.greatest(h - (n - 1), F.lit(1))) for n, m in zip(ORDERS, hits, strict=True)]
    brevity = F.when(h > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / h))
    value = F.when((hits[0] == 0) | F.col("r").isNull(), 0.0).otherwise(F.exp(sum(logs) / len(ORDERS)) * brevity)
    return scored.select(F.col("k").alias(key), value.alias("self_bleu"))
