"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, filter_audit, langid, maxent, mixing, neighbours, packing, perplexity, quality, simhash, spelling, tokens, toxicity
from .common import fold, stored, table


def op1_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 1
    found = maxent.score(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op8_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(fold("doc_id", 4) != 2))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.classify(docs, labels.filter(fold("doc_id", 3) != 1))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    words = stored(spelling.vocabulary(runs.select(spelling.typos(F.col("run"), F.col("doc_id")).alias("word"))))
    return spelling.with_roots(spelling.variants(words)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(planted)
    return chat.digest_conversations(chat.format_conversations(conversations))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_perplexity_rules": op1_perplexity_rules,
        "op2_pack_best_fit": op2_pack_best_fit,
        "op3_language_mixture": op3_language_mixture,
        "op4_simhash": op4_simhash,
        "op5_mix_sources": op5_mix_sources,
        "op6_maxent_scores": op6_maxent_scores,
        "op7_pack_tokens": op7_pack_tokens,
        "op8_toxic_grammar": op8_toxic_grammar,
        "op9_quality_kernel": op9_quality_kernel,
        "op10_cross_polytope": op10_cross_polytope,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_filter_audit": op12_filter_audit,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mix_sources": mixing.OP5_SQL,
        "op11_spelling_variants": spelling.OP11_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_chat_format": chat.OP13_SQL,
    }
