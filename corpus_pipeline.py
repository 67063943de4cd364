"""A corpus from raw documents: quality, exact duplicates, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; the first four return the columns
of documents, the last each document's ids.

In every stage a null text counts as empty, an empty table gives an empty one, other columns stay as they are whatever
their names, and rows of equal id and text are treated alike (exact_duplicates leaves one of them). Documents without
text are scored like others; of those that stay, one is left by exact_duplicates, and the later stages keep it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import bpe, decontaminate, exact_dedup, jaccard, quality
from platewise.llm.common import fresh, new_path, saved, table, without


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble (learned from their labelled rows) scores at the threshold or above."""
    model = quality.learned(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "quality_score")[0]
    return quality.scored(docs, model, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id; of rows of equal text and id, one."""
    return exact_dedup.deduplicated(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8), the document with the smallest id.

    Of texts that share that id, the one with the smallest hash stays. Documents without words, or without id, stay."""
    found = saved(jaccard.joined(docs, words=5, percent=80).where("n_shingles > 0 AND doc_id IS NOT NULL"), "near")
    first = F.min(F.struct("doc_id", "row"))
    best = found.groupBy("component").agg(first.alias("best"), F.count("*").alias("n")).where("n > 1")
    dropped = found.join(best, "component").where(F.struct("doc_id", "row") != F.col("best")).select("doc_id", "row").distinct()
    return without(docs, saved(dropped, "near-dropped"), F.xxhash64("text"))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; items shorter than a shingle are no evidence and are left out."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), least_words=decontaminate.SHINGLE)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe.digest(docs, bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality", good), ("exact_duplicates", distinct), ("near_duplicates", unlike), ("benchmark_leaks", unleaked), ("token_ids", encoded)]

#: Neither the classifier nor the token ids can be said in SQL; tests hold stages and the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := new_path(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
    return docs
