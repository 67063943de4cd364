"""The operators' queries over the driver's tables, and the SQL that some of them equal."""

from __future__ import annotations

from platewise.llm import bpe, chat, context_tree, decontaminate, exact_dedup, jaccard, quality, shards, token_files, urls
from platewise.llm.common import table


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def op1_byte_bpe(spark, sf_dir, ranks: str | None = None):
    tokenizers = _tokenizers()
    return bpe.digest(table(spark, sf_dir, "documents"), bpe.Ranks(ranks or tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN))


def op2_context_tree_scores(spark, sf_dir):
    return context_tree.scored(table(spark, sf_dir, "documents"))


def op3_rule_ensemble_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark, sf_dir):
    return chat.digest(chat.with_escapes(table(spark, sf_dir, "conversations")))


def op5_simhash_decontamination(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_tiered_shards(spark, sf_dir):
    return shards.digest(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard.joined(table(spark, sf_dir, "documents")).drop("row", "component")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents")).drop("row")


def op9_url_templates(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages"))


def op10_repair_token_files(spark, sf_dir, tokenizer: str | None = None):
    return token_files.digest(table(spark, sf_dir, "documents"), tokenizer or _tokenizers().path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_context_tree_scores, op3_rule_ensemble_quality, op4_chat_format, op5_simhash_decontamination, op6_tiered_shards, op7_ngram_jaccard_join, op8_exact_dedup, op9_url_templates, op10_repair_token_files)}

ORACLES = {
    "op4_chat_format": chat.SQL,
    "op6_tiered_shards": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars_read, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "op8_exact_dedup": exact_dedup.SQL,
}
