"""One registered query for each corpus operator, over its whole table; SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_pairs, conversation_trie, decontaminate, html_text, language_id, mixing, pii, quality_model, quality_rules, repeats, simhash, token_alignment, token_counts
from weftline.llm.common import crc_mod, table


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's columns, then the text that is left
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=True).drop("kept")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii.session_key(spark)).select("doc_id", "text", "n_entities")


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_model.train(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    texts, languages = language_id.training_texts(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))
    found = language_id.identify(docs, language_id.fit(texts, languages))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_rules.rule_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coder = byte_pairs.Coder(byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    ids = byte_pairs.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), coder).drop("text")
    return byte_pairs.decode(ids, coder).select(
        "doc_id",
        byte_pairs.n_ids(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    found = token_alignment.with_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_bytes": op1_repeated_bytes,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_quality_scores": op3_quality_scores,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_html_text": op6_html_text,
    "op7_decontaminate": op7_decontaminate,
    "op8_mix_sources": op8_mix_sources,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_trie": op13_conversation_trie,
}
