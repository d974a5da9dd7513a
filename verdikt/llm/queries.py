"""The registered queries of this subpackage: thin forms that derive the contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html, line_dedup, ngram_join, packing, quality, suffix_tree, token_store, toxicity
from .common import held_out, table, work_path


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{both}'), (-7L, 1L, 'assistant', '{both}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    digest = lambda parts: F.sha2(F.array_join(parts, "").cast("binary"), 256)
    loss = F.array_join("loss_texts", "")
    return chat.parse_chats(chat.format_chats(rows)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end=2)
    return token_store.read(spark, path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end=1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, sf_dir, documents)
    return toxicity.score(documents, model).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, sf_dir: str, documents: DataFrame) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id"), 4))
    return toxicity.fit(documents, labels)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; removed: places of removed lines, kept_in: the documents that keep such a line."""
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "kept_in", "text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.score(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 7))
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_toxicity": op2_toxicity,
        "op7_decontamination": op7_decontamination,
        "op9_html_extraction": op9_html_extraction,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op10_line_dedup": op10_line_dedup,
        "pipeline": pipeline,
        "op5_lm_scoring": op5_lm_scoring,
        "op4_token_store": op4_token_store,
        "op8_packing": op8_packing,
        "op6_quality_rules": op6_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.sql()
