"""Exact duplicates, with the heavy hitters split off.

Texts are equal when identical after each run of ASCII white space becomes one space. A frequent-items sketch of the
Misra-Gries family finds the digests that may be frequent; their exact counts and smallest ids (partial aggregates) are
the verified winners, at most WINNERS rows, and are broadcast: rows of a hot group never meet in one task. The
remaining digests, each with few rows, go through an ordinary shuffle.

Null text counts as empty; empty texts are equal to each other. Null ids come last; rows with equal text and equal id
are all marked kept by `groups`, and `deduplicated` leaves one of them. An empty table gives an empty result. Other
columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import SPACE, fresh, saved, without

WINNERS, TRACKED = 1024, 16384


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256, row (hash of the normalised text)."""
    text = normalised(F.col("text"))
    digests = saved(docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("row")), "digests")
    frequent = digests.agg(F.expr(f"approx_top_k(row, {WINNERS}, {TRACKED})").alias("top")).select(F.explode("top.item").alias("row"))
    # whatever the sketch names is counted exactly, so its errors cost time, not results
    each = F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    winners = digests.join(F.broadcast(frequent), "row", "left_semi").groupBy("text_sha256").agg(*each).where("group_size > 1")
    winners = saved(winners.orderBy(F.desc("group_size"), "text_sha256").limit(WINNERS), "winners")
    hot = digests.join(F.broadcast(winners), "text_sha256")
    rest = digests.join(F.broadcast(winners), "text_sha256", "left_anti")
    # of the rest only minima and counts are grouped; single texts meet nothing
    more = rest.groupBy("text_sha256").agg(*each).where("group_size > 1")
    rest = rest.join(more, "text_sha256", "left")
    single = F.col("group_size").isNull()
    rest = rest.withColumn("keep_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "row"]
    return hot.select(columns).unionByName(rest.select(columns))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text a row with a smaller id has; of rows of equal id and text one stays. Columns as given."""
    found = saved(groups(docs), "groups")
    row = F.xxhash64(normalised(F.col("text")))
    # drop by (id, digest): ids may repeat with other texts
    dropped = found.where(~F.col("kept")).select("doc_id", "row").distinct()
    twice = saved(found.where("kept").groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    kept = without(docs, dropped, row)
    if twice.isEmpty():
        return kept
    a, b, c = fresh(docs, "twice_id", "twice_row", "row_key")
    again = kept.withColumn(c, row).join(twice.select(F.col("doc_id").alias(a), F.col("row").alias(b)), F.col("doc_id").eqNullSafe(F.col(a)) & (F.col(c) == F.col(b)), "left_semi")
    return without(kept, twice, row).unionByName(again.dropDuplicates(["doc_id", c]).drop(c))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
